import hashlib
import random

from siltstone.llm import decontaminate
from tests.llm.conftest import words


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        wins = [b[i : i + window] for i in range(max(1, len(b) - window + 1))] if b else []
        for x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit)


def _fixture(seed=4):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("a b c d É e1 ß f g".split()) for _ in range(n))
    items = [(i, say(rng.randint(10, 30))) for i in range(12)]
    items += [(20, "one"), (21, "two Words"), (22, ""), (23, None), (24, "x, y; z!"), (25, items[0][1]), (None, items[1][1]), (100, items[2][1].upper())]
    texts = [None, "", "...", "ONE", "two words two words", "x y z x y", items[0][1], items[3][1] + " and " + items[3][1]]
    texts += ["a b c " * 2000 + items[5][1]]
    for _ in range(40):
        body = items[rng.randrange(12)][1].split()
        cut = rng.randint(0, max(0, len(body) - 9))
        texts.append(say(rng.randint(0, 40)) + " " + ", ".join(body[cut : cut + rng.randint(8, 14)]).upper() + " " + say(rng.randint(0, 40)))
    return items, texts


def _rows(df):
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.orderBy("doc_id").collect()]


def test_equals_brute_force(spark, docs):
    items, texts = _fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = [(i, t) for i, t in items if i is not None]
    got = _rows(decontaminate.decontaminate(docs(texts), bench.where("item_id is not null")))
    assert got == [brute(t, known) for t in texts]
    # A filter far too small for the benchmark passes nearly every position, and the join drops what is none.
    assert _rows(decontaminate.decontaminate(docs(texts), bench.where("item_id is not null"), most_bits=6)) == got
    for bound in (1000, -1):
        kept = decontaminate.keep_clean(docs(texts), bench, broadcast_rows=bound)
        assert kept.columns == docs(texts).columns
        assert sorted(r.doc_id for r in kept.collect()) == [i for i, r in enumerate(got) if not r[4]]


def test_empty_tables_repeated_rows_and_names(spark, docs):
    items, texts = _fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.decontaminate(docs(texts).limit(0), bench).count() == 0
    none = _rows(decontaminate.decontaminate(docs(texts), bench.limit(0)))
    assert none == [brute(t, []) for t in texts]
    assert decontaminate.keep_clean(docs(texts), bench.limit(0)).count() == len(texts)
    rows = [(1, items[0][1]), (1, items[0][1]), (1, "clean"), (None, items[0][1]), (None, None)]
    df = spark.createDataFrame([(i, t, "w", "h") for i, t in rows], "doc_id long, text string, w string, th string")
    got = sorted((r.doc_id or 0, r.n_hit > 0) for r in decontaminate.decontaminate(df, bench).collect())
    assert got == [(0, False), (0, True), (1, False), (1, True), (1, True)]
    assert sorted((r.doc_id or 0) for r in decontaminate.keep_clean(df, bench).collect()) == [0, 1]


def test_rarity_is_that_of_the_documents(spark, docs):
    """A shingle that is rare in the benchmark and common in the documents is no prefix where the window has a rarer one."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (2, "never seen words " * 4)], "item_id long, text string")
    texts = ["alpha beta gamma " * 500] * 20 + [item, item.replace("delta", "x")]
    shingles = decontaminate.window_shingles(bench)
    keys = shingles.select("q", "h").distinct()
    places = decontaminate.positions(docs(texts), keys).where("at >= 0").groupBy("q", "h").count().withColumnRenamed("count", "n")
    index = decontaminate.benchmark_index(shingles, places).collect()
    # The other item has no shingle in any document, so its windows have no prefix at all.
    assert [" ".join(r.win) for r in index] == [item] and index[0].off in (1, 2, 3)
    assert [r.doc_id for r in decontaminate.decontaminate(docs(texts), bench).where("contaminated").collect()] == [20]


def test_clashing_columns(spark):
    items, texts = _fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = ["hit", "th", "_hit", "_th", "id", "bits", "x", "w", "Found"]
    df = spark.createDataFrame([(i, t, *[f"{c}{i}" for c in clash]) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *(f"{c} string" for c in clash)]))
    dirty = {r.doc_id for r in decontaminate.decontaminate(df, bench).where("contaminated").collect()}
    for bound in (1000, -1):
        kept = decontaminate.keep_clean(df, bench, broadcast_rows=bound)
        assert kept.columns == df.columns
        assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in df.collect() if r.doc_id not in dirty}


def test_main_path_is_native(spark, docs):
    items, texts = _fixture()
    plan = decontaminate.decontaminate(docs(texts), spark.createDataFrame(items, "item_id long, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
    found = decontaminate.positions(docs(texts), spark.createDataFrame([(3, 7)], "q int, h long"))
    text = found._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
    assert found.where("at = -1").count() == len(texts)
