import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import jaccard, simhash
from tests.llm.test_simhash import brute_fingerprint

SF = "/root/testdata/sf0.001"


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_first(rows, share=0.8):
    """The ids that stay: rows are (doc_id, text) with unique ids."""
    prints = [brute_fingerprint(t) for _, t in rows]
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        near = both and both * 10 >= round(share * 10) * (len(sets[i]) + len(sets[j]) - both)
        if near or bin(prints[i] ^ prints[j]).count("1") <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def _texts():
    """Edited copies of several lengths and degrees, a large group of copies of one text, and a common passage."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 5000)}"
    common = [word() for _ in range(40)]
    out = []
    for length in (3, 6, 20, 50, 120, 300):
        for edits in (1, 1, 2, 3, 5):
            base = [word() for _ in range(length)]
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(length)] = word()
            out += [base, copy, common + base[:8]]
    base = [word() for _ in range(200)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(200)] = word()
        out.append(copy)
    out = [" ".join(t) for t in out]
    rng.shuffle(out)
    return out + ["", None, "One two", "one  two"]


@pytest.mark.parametrize("pairs_each", [50, 0])
def test_links_equal_brute_force(spark, docs, monkeypatch, pairs_each):
    """Also by rounds with one partner a shingle; most of the links lie beyond the fingerprints' radius."""
    texts = _texts()
    inner = jaccard.links
    monkeypatch.setattr(jaccard, "ROUNDS", 2)
    monkeypatch.setattr(jaccard, "links", lambda *a: inner(*a, pairs_each=pairs_each, broadcast_rows=1000 if pairs_each else -1))
    want = brute_first(list(enumerate(texts)))
    assert sorted(r.doc_id for r in simhash.keep_first(docs(texts), share=0.8).collect()) == want
    if pairs_each:
        assert len(want) + 20 < simhash.keep_first(docs(texts)).count()


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in step(spark, docs, SF).collect()) == brute_first(rows)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    common = np.sort(rng.integers(0, 1 << 63, 30).astype(np.uint64))
    rank = rng.integers(4, 9, 30)
    for n in range(1, 80):
        a = np.unique(np.concatenate([rng.integers(0, 1 << 63, n).astype(np.uint64), rng.choice(common, n % 7)]))
        b = a[rng.permutation(len(a))[: -(-len(a) * 4 // 5)]]
        assert jaccard.alike(a, b, 0.8)
        assert len(np.intersect1d(jaccard.prefix(a, common, rank, 0.8), jaccard.prefix(np.sort(b), common, rank, 0.8)))
