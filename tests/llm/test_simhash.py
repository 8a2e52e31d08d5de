import random

import numpy as np
import xxhash

from siltstone.llm import simhash
from siltstone.operators.components import components
from tests.llm.conftest import lower


def brute_fingerprint(text):
    words = lower(text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_groups(values, radius=2):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    texts = [None, "", " \n", "One", "one two", "A b C d", "é É é", "a\x1cb c", "x y z " * 50, "w " * 5]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_chunks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def _points(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 1 << 63, n).astype(np.uint64)
    near = x[: n // 2].copy()
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64))
    dense = np.uint64(5) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    return np.unique(np.concatenate([x, near, near ^ np.uint64(3), dense]))


def test_trees_find_all_links(monkeypatch):
    x = _points(600, 1)
    want = brute_groups(x.tolist())
    monkeypatch.setattr(simhash, "FOLD_AT", 50)
    at = {v: i for i, v in enumerate(x.tolist())}
    for shards in (1, 4, 16):
        tree = simhash.Tree(np.random.default_rng(2).permutation(x)[:300], 1, 2, shards)
        u, v, homes = [], [], []
        for _, idx, home in tree.homes(x):
            a, b = simhash.links(x[idx[home]], x[idx[~home]])
            u += [at[i] for i in a.tolist()]
            v += [at[i] for i in b.tolist()]
            homes += idx[home].tolist()
        assert sorted(homes) == list(range(len(x)))
        got = simhash.forest(np.arange(len(x)), np.array(u), np.array(v))
        assert got.tolist() == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(rng.randint(200, 400),) * 2 for _ in range(5)]
    edges += [(rng.randint(1000, 1100), rng.randint(1000, 1100)) for _ in range(60)] + [(-5, 3), (None, 4), (7, 8)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _texts():
    rng = random.Random(5)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    near = [t + " tail" for t in base[:20]]
    return base + base[:15] + near + [None, "", "   ", "One two", "one  TWO"]


def test_query_equals_brute_force(spark, docs):
    texts = _texts()
    got = simhash.near_duplicates(docs(texts)).orderBy("doc_id").collect()
    prints = [brute_fingerprint(t) for t in texts]
    assert [r.fingerprint for r in got] == [f"{p:016x}" for p in prints]
    assert [r.component_id for r in got] == brute_groups(prints)
    assert simhash.near_duplicates(docs(texts).limit(0)).count() == 0


def test_keep_first(spark, docs):
    texts = _texts()
    groups = brute_groups([brute_fingerprint(t) for t in texts])
    for bound in (1000, -1):
        kept = simhash.keep_first(docs(texts), broadcast_rows=bound)
        assert kept.columns == docs(texts).columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups))


def test_keep_first_with_repeated_and_null_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, "q r s t"), (3, "q r s t"), (3, "other words here now"), (None, "lonely text it is")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    kept = simhash.keep_first(df)
    assert kept.columns == ["doc_id", "text", "fp"]
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(0, "lonely text it is"), (2, "a b c d"), (3, "other words here now"), (3, "q r s t")]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (0, 2), (0, 2), (2, 2), (3, 3), (3, 3), (3, 3)]


def test_clashing_columns(spark):
    """Also where identifiers are missing or repeated, which takes the other path."""
    clash = ["gone", "fp", "place", "bid", "bfp", "_gone", "_fp", "_bid", "_one", "id", "key", "Root"]
    rows = [(i, t, *[f"{c}{i}" for c in clash]) for i, t in enumerate(["one two three four", "one two three four", "five six", None])]
    schema = ", ".join(["doc_id long", "text string", *(f"{c} string" for c in clash)])
    df = spark.createDataFrame(rows, schema)
    for docs in (df, df.union(df.where("doc_id = 2"))):
        kept = simhash.keep_first(docs)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(r for r in rows if r[0] != 1)
