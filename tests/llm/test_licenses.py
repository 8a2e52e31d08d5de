from siltstone.llm import licenses
from tests.llm.conftest import words

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute(text):
    w = words(text)
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    None,
    "",
    "...",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. Under the MIT license; CC BY-NC 4.0",
    "thunder the mit license, under the mit licenses",
    "cc by nc cc by nc cc_by/nc",
    "É under\nthe\tmit LICENSE é" + " x" * 3000 + " under the mit license",
    "a" * 200_000 + " under the mit license",
    "apache license version 20 apache license version 2",
]


def test_base_equals_brute_force(spark, docs):
    rows = licenses.license_summary(docs(TEXTS)).orderBy("doc_id").collect()
    got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert got == [brute(t) for t in TEXTS]
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_edits_are_found_and_licences_told_apart(spark, docs):
    texts = [
        "relased undr the MIT Licence now",
        "under the BSD license",
        "apache licence version 2",
        "apache license version 3",
        "GNU Genral Public License, version 3",
        "the gnu general public license version 9",
        "permission is hereby granted, free of charge, to any persons obtaining a copy of this sofware",
    ]
    rows = licenses.license_summary(docs(texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit", "", "apache-2", "", "", "", "mit"]
    assert all(r.n_base == 0 and r.base_labels == "" for r in rows)
    spans = licenses.scan_licenses(docs(texts)).orderBy("doc_id").first().spans
    assert [(s.label, s.first_word, s.end_word, s.edits) for s in spans] == [("mit", 1, 5, 2)]


def test_pieces_cover_the_phrase():
    for n in licenses.NOTICES:
        parts = licenses.pieces(n.phrase, n.edits)
        assert len(parts) == n.edits + 1 and "".join(p for _, p in parts) == n.phrase


def test_repeated_rows_nulls_and_clashing_names(spark):
    rows = [(1, "under the mit license", 5), (1, "under the mit license", 6), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").withColumnRenamed("spans", "n_words")
    got = licenses.license_summary(df).collect()
    assert sorted((r.doc_id or -1, r.n_base) for r in got) == [(-1, 0), (1, 1), (1, 1)]
    assert licenses.license_summary(df.limit(0)).count() == 0
