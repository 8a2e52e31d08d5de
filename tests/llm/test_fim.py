import hashlib
import random

import duckdb
import numpy as np
import pytest

from siltstone.llm import fim

SPACES = "\t\n\x0b\x0c\r "


def units(text, unit):
    """Where units begin, by a loop over code points."""
    found = [0] if text else []
    for i in range(1, len(text)):
        a, b = text[i - 1], text[i]
        if unit == "char" or unit == "line" and a == "\n" or unit == "word" and a in SPACES and b not in SPACES:
            found.append(i)
    return found


def brute(doc_id, text, unit="char", rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    at = units(text, unit)
    n = len(at)
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    x, y = [*at, len(text)][a], [*at, len(text)][b]
    p, m, s = text[:x], text[x:y], text[y:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "a", "é", "😀", "<P>", "x <S y <M> z", "<P", "<", "P>", "<S<P", " a\n b\n\n", "\n", "日本語\nだ よ", "<p>", "ab" * 9000, "é\n" * 7000, "\x00\x00", "á"]


def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice("ab é\n日😀<PSM>  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("sizes", [(4096, 1 << 22), (3, 7), (1, 1), (5, 64)])
def test_places_equal_a_scan(monkeypatch, unit, sizes):
    monkeypatch.setattr(fim, "CHUNK", sizes[0])
    monkeypatch.setattr(fim, "BLOCK", sizes[1])
    some = [t or "" for t in texts() if len(t or "") < 200]
    raw = [t.encode() for t in some]
    ends = np.cumsum([len(r) for r in raw])
    cutter = fim.Cutter(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends, unit)
    want = [units(t, unit) for t in some]
    assert cutter.units.tolist() == [len(w) for w in want]
    asked = [(i, r) for i, w in enumerate(want) for r in range(len(w) + 1)]
    got = cutter.place(np.array([i for i, _ in asked]), np.array([r for _, r in asked]))
    starts = ends - [len(r) for r in raw]
    assert got.tolist() == [starts[i] + len(some[i][: [*want[i], len(some[i])][r]].encode()) for i, r in asked]


def test_only_owning_chunks_are_scanned_again(monkeypatch):
    raw = ("é" * 100_000).encode()
    cutter = fim.Cutter(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), "char")
    scanned = []
    real = fim._begins
    monkeypatch.setattr(fim, "_begins", lambda d, a, b, u: scanned.append(b - a) or real(d, a, b, u))
    assert cutter.place(np.array([0, 0, 0]), np.array([10, 70_000, 100_000])).tolist() == [20, 140_000, 200_000]
    assert scanned == [fim.CHUNK, fim.CHUNK]


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_rows_equal_brute_force(spark, unit):
    rows = [(i, t, 1, "x") for i, t in enumerate(texts())] + [(None, "no id here", 2, "y"), (3, "é", 3, "z"), (3, "é", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, output string")
    made = fim.fill_in_middle(df, unit=unit)
    got = sorted(map(str, (tuple(r) for r in made.collect())))
    assert got == sorted(str((i, *brute(i, t, unit))) for i, t, *_ in rows)
    back = made.select("doc_id", fim.restored(made.output, made.form).alias("text")).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t, *_ in rows)


def test_query_equals_sql_and_takes_odd_tables(spark, docs):
    df = docs(texts(), extra=1)
    got = fim.digests(df)
    rows = df.toPandas()
    con = duckdb.connect()
    con.register("documents", rows)
    want = con.execute(fim.SQL)
    assert got.columns == [c[0] for c in want.description]
    found = got.orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == sorted(want.fetchall()) and {r.form for r in found} == {"plain", "psm", "spm"}
    assert [r.restored_sha256 for r in found] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts()]
    assert fim.digests(df.limit(0)).count() == 0


def test_rates_seeds_and_markers(spark, docs):
    df = docs([f"text number {i} with words" for i in range(300)])
    assert fim.fill_in_middle(df, rate=0).where("form <> 'plain'").count() == 0
    assert fim.fill_in_middle(df, rate=100, spm_rate=100).where("form <> 'spm'").count() == 0
    one, two = (fim.fill_in_middle(df, seed=s).orderBy("doc_id").collect() for s in (1, 2))
    assert one != two and one == fim.fill_in_middle(df.repartition(7)).orderBy("doc_id").collect()
    own = ("[[pre]]", "[[suf]]", "[[mid]]")
    made = fim.fill_in_middle(df, markers=own)
    assert made.where(fim.restored(made.output, made.form, own) == made.output).count() == made.where("form = 'plain'").count()
    for bad in (("<P>", "<P", "<M>"), ("", "a", "b"), ("aba", "c", "d"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, markers=bad)
