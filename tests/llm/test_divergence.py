import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n long, item string"
BREAK = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return BREAK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least=3, top=200):
    out = set()
    docs = [(lang or "", source or "", terms(text)) for _, text, lang, source, *_ in rows]
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in seen if seen[t] >= least]
        v = len(kept)
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if seen[t] >= least) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())
        n = {s: sum(c.values()) for s, c in counts.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (n[s] + v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(n.values()) + v) for t in kept}
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            out |= {(lang, s, "pair", o, -x, i + 1) for i, (x, _, o) in enumerate(sorted(pairs))}
            above = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", t, -x, i + 1) for i, (x, _, t) in enumerate(sorted(above)[:top])}
    return sorted(out)


def rows_of(seed, n=150, sources=7):
    rng = random.Random(seed)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"] + ["É", "été", "日本", "😀x", "Zed", "ZED", "b c", "1 2", ""]
    rows = []
    for i in range(n):
        s = rng.randrange(sources)
        text = " ".join(rng.choice(words[: 8 + 4 * s]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", "de", None]), f"s{s}" if s else None, i, "x"))
    return rows


ODD = [
    (None, None, "xx", "a", 1, "i"), (1, "", "xx", "b", 1, "i"), (2, "only twice", "yy", "a", 1, "i"), (2, "only twice", "yy", "a", 1, "i"), (3, "same same", "zz", "a", 1, "i"),
    (3, "same same", "zz", "a", 1, "i"), (3, "same SAME", "zz", "b", 1, "i"), (4, "same", None, None, 1, "i"), (5, "same", "", "", 1, "i"), (6, "same", "", None, 1, "i"),
    (7, None, None, "c", 1, "i"), (8, "word " * 20_000, "zz", "long", 1, "i"),
]


def got(df, **k):
    return sorted(tuple(r) for r in dv.audit(df, **k).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_brute_force(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == brute(rows)
    assert got(df, least_docs=9, top=3) == brute(rows, 9, 3)


def test_odd_tables(spark, monkeypatch):
    df = spark.createDataFrame(ODD, SCHEMA)
    want = brute(ODD)
    assert got(df) == want and any(r[0] == "xx" and r[2] == "pair" and r[4] == 0 for r in want)
    monkeypatch.setattr(dv, "BROADCAST_ROWS", 0)
    assert got(df) == want
    assert dv.audit(df.limit(0)).count() == 0
    assert [c for c, _ in dv.audit(df).dtypes] == ["lang", "source", "part", "item", "value", "rank"]


def test_sql(spark):
    rows = rows_of(4) + ODD
    con = duckdb.connect()
    documents = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841
    con.register("documents", documents)
    assert sorted(con.execute(dv.SQL).fetchall()) == brute(rows)


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(6)
    some = [(0, 0, 1), (0, 1, 1), (10**12, 10**12, 1), (3 * 10**14, 9 * 10**15, 10**9)]
    some += [(c := rng.randrange(10**e), c + rng.randrange(10**e), 1 + rng.randrange(10**8)) for e in range(1, 16) for _ in range(20)]
    some = [x for x in some if x[1] + x[2] < 9 * 10**15]
    df = spark.createDataFrame(some, "c long, t long, v long")
    for c, t, v, p in df.select("c", "t", "v", dv.share(F.col("c"), F.col("t"), F.col("v"))).collect():
        assert p == 1 + 10**9 * (c + 1) // (t + v)


def test_pairs_are_made_over_the_sources_of_a_term_alone(spark):
    """Forty sources with words of their own and one in common: contributions come from the common one."""
    rows = [(i, f"common word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'ab'[i // 26 % 2]}", "en", f"s{i % 40}", 1, "x") for i in range(400)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
