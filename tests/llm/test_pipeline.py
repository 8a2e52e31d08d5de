import corpus_pipeline

from siltstone.llm import secrets
from tests.llm.conftest import words
from tests.llm.test_simhash import brute_fingerprint, brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    good = corpus_pipeline.reject_low_quality(spark, docs, SF)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95 and good.columns == docs.columns

    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(rows)
    groups = brute_groups([brute_fingerprint(rows[i]) for i in ids])
    first = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in first.collect()) == sorted({ids[g] for g in groups})

    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = {i for i, t in rows.items() for n in sizes for k in range(len(words(t)) - n + 1) if tuple(words(t)[k : k + n]) in windows}
    clean = corpus_pipeline.drop_benchmark_passages(spark, docs, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(set(ids) - dirty)

    redacted = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect()}
    assert redacted.keys() == rows.keys() and any(redacted[i] != rows[i] for i in rows)
    assert all((redacted[i] == rows[i]) == (not secrets.find_secrets(rows[i])) for i in rows)

    mixed = {r.doc_id: r for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()}
    assert mixed and all(r.taken == r.copies * r.size and 1 <= r.copies <= 3 for r in mixed.values())


def test_run_is_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    want = sorted(map(str, docs.drop("target").collect()))
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("target").collect())) == want


def test_stages_with_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, blob string, spans int, id int, fp string, size int, copies string, key int, h int, bid int, y int, x int"
    more = (None, 1, 2, "f", 3, "c", 4, 5, 6, 7, 8)
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "  ", None, None, 2), (3, long, "en", "a", None), (3, long, "en", "a", None), (4, "short text here.", "en", "b", 16), (4, "another one.", "en", "b", 12), (None, "short text here.", "de", None, 16)]
    docs = spark.createDataFrame([r + more for r in rows], schema)
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.count() <= len(rows)
        assert step(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.redact_secrets(spark, docs, SF).count() == len(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sum(r.text == long for r in kept) == 1 and sum(r.text == "short text here." for r in kept) == 1 and sum(r.text == "another one." for r in kept) == 1
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert set(docs.columns) - {"size", "copies"} <= set(mixed.columns) and all(r.taken == r.size * r.copies > 0 for r in mixed.collect())
    assert corpus_pipeline.mix_sources(spark, docs.limit(0), SF).count() == 0
