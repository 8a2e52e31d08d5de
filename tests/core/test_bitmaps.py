import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import bitmaps, landscape


def held(seed, papers, dims, zipf):
    rng = np.random.default_rng(seed)
    draw = (lambda: min(len(dims) - 1, int(rng.zipf(1.3)) - 1)) if zipf else (lambda: int(rng.integers(0, len(dims))))
    return sorted({(p, draw()) for p in range(papers) for _ in range(rng.integers(0, 9))} | {(papers - 1, 0)})


def brute(pairs, dims, size):
    by = {}
    for p, c in pairs:
        by.setdefault(p, []).append(c)
    sets = (t for cs in by.values() for t in itertools.combinations(sorted(cs), size) if len({dims[c] for c in t}) == size)
    return Counter(sets)


@pytest.mark.parametrize(("seed", "papers", "zipf"), [(0, 40, False), (1, 300, True), (2, 1000, True), (3, 700, False), (4, 1, False)])
def test_a_bucket_equals_brute_force(seed, papers, zipf):
    dims = np.repeat(np.arange(5), [3, 30, 5, 200, 2])
    pairs = held(seed, papers, dims, zipf)
    a = np.array(pairs)[np.random.default_rng(seed).permutation(len(pairs))]
    bucket = bitmaps.Bucket(a[:, 0], a[:, 1], dims)
    for size in (2, 3, 4):
        got = Counter()
        for codes, last, count in bucket.combinations(size):
            got.update({(*codes, x): n for x, n in zip(last.tolist(), count.tolist())})
        assert got == brute(pairs, dims, size)


@pytest.mark.parametrize("bucket", [1 << 18, 50])
def test_combinations_of_values(spark, monkeypatch, bucket):
    monkeypatch.setattr(bitmaps, "ROWS", 7)
    dims = ["problem"] * 3 + ["method"] * 20 + ["dataset"] * 40 + ["study_type"] * 2
    pairs = held(5, 120, dims, True)
    rows = spark.createDataFrame([(f"p{p}", dims[c], f"v{c}") for p, c in pairs] * 2, "paper_id string, dimension string, value string").repartition(5)
    place = F.element_at(F.create_map(F.lit("problem"), F.lit(0), F.lit("method"), F.lit(1), F.lit("dataset"), F.lit(2)), F.col("dimension"))
    kept = [(p, c) for p, c in pairs if dims[c] != "study_type"]
    order = ["problem", "method", "dataset"]
    for size in (2, 3):
        got = bitmaps.together(rows.where("dimension <> 'study_type'").distinct(), place, size, bucket).collect()
        assert len(got) == len({str(r.dims) for r in got})
        want = Counter()
        for t, n in brute(kept, [order.index(d) if d in order else -1 for d in dims], size).items():
            want[tuple((dims[c], f"v{c}") for c in t)] += n
        assert {tuple((d.dimension, d.value) for d in r.dims): r["count"] for r in got} == want
    papers = rows.select("paper_id", F.lit("empirical").alias("study_type")).distinct()
    assert landscape.combos(rows.limit(0), papers, 2).count() == 0


@pytest.mark.parametrize("slice_", [1 << 20, 1, 13])
@pytest.mark.parametrize(("seed", "papers", "zipf"), [(0, 40, False), (1, 300, True), (4, 1, False)])
def test_arrays_equal_brute_force(monkeypatch, seed, papers, zipf, slice_):
    monkeypatch.setattr(bitmaps, "SLICE", slice_)
    dims = np.repeat(np.arange(5), [3, 8, 1, 12, 2])
    a = np.array(held(seed, papers, dims, zipf))
    for size in (2, 3, 5):
        cells = bitmaps.Cells(dims, size)
        counters = np.zeros(cells.n, np.uint32)
        for some in np.array_split(np.arange(papers), 3):  # papers come in several batches
            mine = a[np.isin(a[:, 0], some)]
            cells.count(counters, mine[:, 1], np.searchsorted(mine[:, 0], [*some, some[-1] + 1] if len(some) else [0]))
        found = np.flatnonzero(counters)
        assert dict(zip(map(tuple, cells.codes(found).tolist()), counters[found].tolist())) == brute(a.tolist(), dims, size)


def test_what_a_task_sends_does_not_grow_with_its_papers():
    cells = bitmaps.Cells(np.repeat(np.arange(3), 4), 2)
    entry = pa.struct([("i", pa.int32()), ("dimension", pa.string()), ("value", pa.string())])
    rng = np.random.default_rng(0)
    one = lambda d: {"i": d, "dimension": f"d{d}", "value": f"v{rng.integers(0, 4)}"}
    batch = lambda: pa.record_batch({"held": pa.array([[one(d) for d in range(3)] for _ in range(50)], pa.list_(entry))})
    names = pa.array([f"{d}|d{d}|v{x}" for d in range(3) for x in range(4)])
    sent = [list(bitmaps._array_counter(cells, names)(batch() for _ in range(n))) for n in (1, 20)]
    assert [sum(b.num_rows for b in x) for x in sent] == [1, 1]
    assert [sum(np.frombuffer(n, np.uint32).sum() for b in x for n in b["n"].to_pylist()) for x in sent] == [150, 3000]


def test_values_too_many_for_arrays_are_counted_on_bitmaps(spark, monkeypatch):
    rows = spark.createDataFrame([(p, d, f"v{(p * (i + 2)) % 7}") for p in range(60) for i, d in enumerate(("problem", "method", "dataset"))], "paper_id int, dimension string, value string")
    place = F.element_at(F.create_map(F.lit("problem"), F.lit(0), F.lit("method"), F.lit(1), F.lit("dataset"), F.lit(2)), F.col("dimension"))
    got = lambda: sorted(map(str, bitmaps.together(rows, place, 3).collect()))
    by_arrays = got()
    for name in ("VALUES", "CELLS"):
        with monkeypatch.context() as m:
            m.setattr(bitmaps, name, 3)
            assert got() == by_arrays
