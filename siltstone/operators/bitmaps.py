"""How often values occur together, counted in arrays or on bitmaps of papers.

Where the values are so few that all combinations which could occur fit an array (CELLS), each task counts its papers' combinations there: a paper's
combinations are made as numbers, a slice of them at a time, and a task sends on the blocks of its array that it used, whatever number of papers it read.

Else papers fall into buckets by a hash. In a bucket a value that many papers hold is a row of bits, one a paper; a value that few hold is a list of papers.
Combinations grow a dimension at a time: by AND and a count of bits against the rows, by the papers' own lists against the rest, and a combination
that no paper of the bucket holds is not grown further. A paper's combinations are thus never written out, only how many of the bucket hold each;
buckets add up in a shuffle of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from siltstone.session import shipped
from siltstone.sources.staging import Staged

#: Rows (a paper's value each) that a bucket aims at, and papers to a word of a bitmap.
BUCKET = 1 << 18
WORD = 64
#: Counts sent on together.
ROWS = 20_000
#: Counters of a task, of 4 bytes each; values that a task knows by name; and counters sent on together.
CELLS, VALUES, BLOCK = 1 << 25, 50_000, 1 << 11
#: Combinations that a task makes at a time.
SLICE = 1 << 20


class Bucket:
    """paper and code (of a value, in order of dimension): numbers from 0, each pair once. dim: the dimension of each code."""

    def __init__(self, paper: np.ndarray, code: np.ndarray, dim: np.ndarray):
        self.dim = dim
        self.n = int(paper.max()) + 1
        words = -(-self.n // WORD)
        held = np.bincount(code, minlength=len(dim))
        self.row = np.full(len(dim), -1)
        self.codes = np.flatnonzero(held * WORD >= self.n)
        self.row[self.codes] = np.arange(len(self.codes))
        self.bits = np.zeros((len(self.codes), words), np.uint64)
        dense = self.row[code] >= 0
        np.bitwise_or.at(self.bits.reshape(-1), self.row[code[dense]] * words + paper[dense] // WORD, np.uint64(1) << (paper[dense] % WORD).astype(np.uint64))
        order = np.lexsort((code, paper))
        self.all = code[order], np.searchsorted(paper[order], np.arange(self.n + 1))
        order = order[~dense[order]]
        self.rare = code[order], np.searchsorted(paper[order], np.arange(self.n + 1))
        self.by_code = np.argsort(code, kind="stable")
        self.paper, self.starts = paper, np.searchsorted(code[self.by_code], np.arange(len(dim) + 1))
        #: The first code of a later dimension, and where it stands among the rows.
        self.later = np.searchsorted(dim, dim, side="right")
        self.later_row = np.searchsorted(self.codes, self.later)

    def _gathered(self, papers: np.ndarray, lists: tuple[np.ndarray, np.ndarray], least: int) -> np.ndarray:
        codes, starts = lists
        size = starts[papers + 1] - starts[papers]
        at = np.repeat(starts[papers] - np.cumsum(size) + size, size) + np.arange(size.sum())
        found = codes[at]
        return found[found >= least]

    def _members(self, code: int) -> np.ndarray:
        return self.paper[self.by_code[self.starts[code] : self.starts[code + 1]]]

    @staticmethod
    def _papers(bits: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))

    def combinations(self, size: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
        """(first codes, last codes, papers that hold the first and each last) of all combinations of one code each of `size` dimensions."""
        for code in range(len(self.dim)):
            members = self._members(code)
            if len(members):
                yield from self._grown((code,), self.bits[self.row[code]] if self.row[code] >= 0 else None, members, size)

    def _grown(self, codes: tuple[int, ...], bits: np.ndarray | None, members: np.ndarray, size: int):
        """members: papers that hold the codes; bits: the same as a bitmap, if they are many."""
        last = codes[-1]
        if bits is None:
            found, count = np.unique(self._gathered(members, self.all, self.later[last]), return_counts=True)
        else:
            rows = self.bits[self.later_row[last] :] & bits
            count = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
            some = count > 0
            found, count = self.codes[self.later_row[last] :][some], count[some]
            rare, times = np.unique(self._gathered(members, self.rare, self.later[last]), return_counts=True)
            found, count = np.concatenate([found, rare]), np.concatenate([count, times])
        if len(codes) == size - 1:
            if len(found):
                yield codes, found, count
            return
        for code, n in zip(found.tolist(), count.tolist()):
            many = bits is not None and n * WORD >= self.n and self.row[code] >= 0
            both = bits & self.bits[self.row[code]] if many else None
            yield from self._grown((*codes, code), both, self._papers(both) if many else np.intersect1d(members, self._members(code), assume_unique=True), size)


def _counts(table: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    """The combinations of one bucket."""
    paper = table["paper_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    # Values are numbered in the order of their dimensions' places.
    named = pc.binary_join_element_wise(table["i"].cast(pa.string()), table["value"], "|").combine_chunks().dictionary_encode()
    found, first = np.unique(named.indices.to_numpy(), return_index=True)
    values = table.take(pa.array(first))
    order = pc.sort_indices(values, [("i", "ascending"), ("value", "ascending")])
    number = np.empty(len(found), np.int64)
    number[found[order.to_numpy()]] = np.arange(len(found))
    values, code = values.take(order), number[named.indices.to_numpy()]
    names = [values[c].combine_chunks() for c in ("dimension", "value")]
    held, n = [], 0

    def sent() -> pa.RecordBatch:
        first = np.repeat(np.array([h[0] for h in held]).reshape(len(held), -1), [len(h[1]) for h in held], axis=0)
        codes = np.column_stack([first, np.concatenate([h[1] for h in held])])
        flat = pa.array(codes.reshape(-1))
        entries = pa.StructArray.from_arrays([c.take(flat) for c in names], ["dimension", "value"])
        dims = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * size), entries)
        return pa.record_batch({"dims": dims, "n": pa.array(np.concatenate([h[2] for h in held]), pa.int64())})

    for found in Bucket(paper, code, values["i"].to_numpy()).combinations(size):
        held.append(found)
        n += len(found[1])
        if n >= ROWS:
            yield sent()
            held, n = [], 0
    if held:
        yield sent()


def _counter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, rows = None, []
        for batch in batches:
            buckets = batch.column("_b").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for x, y in zip(ends, ends[1:]):
                if x < y and buckets[x] != open_:
                    if rows:
                        yield from _counts(pa.Table.from_batches(rows), size)
                    open_, rows = buckets[x], []
                if x < y:
                    rows.append(batch.slice(x, y - x))
        if rows:
            yield from _counts(pa.Table.from_batches(rows), size)

    return run


class Cells:
    """Counters of all combinations of one code each of `size` dimensions. dim: the dimension of each code, ascending."""

    def __init__(self, dim: np.ndarray, size: int):
        self.size, self.radix = size, np.bincount(dim).tolist()
        self.specs = [s for s in combinations(range(len(self.radix)), size) if all(self.radix[d] for d in s)]
        sizes = [prod(self.radix[d] for d in s) for s in self.specs]
        self.offset = dict(zip(self.specs, np.cumsum([0, *sizes]).tolist()))
        self.n = sum(sizes)
        self.dim, self.first = dim, np.searchsorted(dim, np.arange(len(self.radix) + 1))

    def count(self, counters: np.ndarray, code: np.ndarray, ends: np.ndarray) -> None:
        """Adds the papers: code is ascending within a paper, whose codes stand between two ends."""
        papers = len(ends) - 1
        if not papers:
            return
        slot = np.repeat(np.arange(papers), np.diff(ends)) * len(self.radix) + self.dim[code]
        held = np.bincount(slot, minlength=papers * len(self.radix))
        start = (np.cumsum(held) - held).reshape(papers, -1)
        held = held.reshape(papers, -1)
        local = code - self.first[self.dim[code]]
        self._grown(counters, (), np.arange(papers), np.zeros(papers, np.int64), np.ascontiguousarray(start.T), np.ascontiguousarray(held.T), local)

    def _grown(self, counters, dims, paper, key, start, held, local) -> None:
        last = len(dims) == self.size - 1
        for d in range(dims[-1] + 1 if dims else 0, len(self.radix) - (self.size - len(dims) - 1)):
            if not self.radix[d]:
                continue
            n, at = held[d][paper], start[d][paper]
            total = np.cumsum(n)
            x = 0
            while x < len(n):
                done = int(total[x - 1]) if x else 0
                y = max(x + 1, int(np.searchsorted(total, done + SLICE, side="right")))
                k = n[x:y]
                many = int(total[y - 1]) - done
                if many:
                    grown = np.repeat(key[x:y] * self.radix[d], k) + local[np.arange(many) + np.repeat(at[x:y] - (total[x:y] - done - k), k)]
                    if last:
                        np.add.at(counters, grown + self.offset[(*dims, d)], counters.dtype.type(1))
                    else:
                        self._grown(counters, (*dims, d), np.repeat(paper[x:y], k), grown, start, held, local)
                x = y

    def codes(self, cell: np.ndarray) -> np.ndarray:
        """The codes of each cell, a row a cell. cell: ascending."""
        out = np.empty((len(cell), self.size), np.int64)
        starts = [self.offset[s] for s in self.specs]
        cuts = np.searchsorted(cell, [*starts, self.n])
        for s, low, x, y in zip(self.specs, starts, cuts, cuts[1:]):
            rest = cell[x:y] - low
            for j in range(self.size - 1, -1, -1):
                rest, local = np.divmod(rest, self.radix[s[j]])
                out[x:y, j] = self.first[s[j]] + local
        return out


def _array_counter(cells: Cells, names: pa.Array):
    """names: place, dimension and value of each code, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(-(-cells.n // BLOCK) * BLOCK, np.uint32)
        for batch in batches:
            held = batch.column("held")
            code = pc.index_in(_named(held.flatten()), names).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(held).to_numpy(zero_copy_only=False)
            code = code[np.lexsort((code, np.repeat(np.arange(len(size)), size)))]
            cells.count(counters, code, np.concatenate([[0], np.cumsum(size)]))
        blocks = counters.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        for x in range(0, len(used), 256):
            some = used[x : x + 256]
            yield pa.record_batch({"block": pa.array(some, pa.int64()), "n": pa.array([blocks[b].tobytes() for b in some], pa.binary())})

    return run


def _named(held: pa.StructArray) -> pa.Array:
    return pc.binary_join_element_wise(held.field("i").cast(pa.string()), held.field("dimension"), held.field("value"), "|")


def _adder(cells: Cells, dimension: list[str], value: list[str]):
    """The sums of the blocks, which come in their order, with the names of what they count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [pa.array(dimension, pa.string()), pa.array(value, pa.string())]
        open_, total = None, None

        def sent() -> Iterator[pa.RecordBatch]:
            found = np.flatnonzero(total)
            for x in range(0, len(found), ROWS):
                some = found[x : x + ROWS]
                flat = pa.array(cells.codes(open_ * BLOCK + some).reshape(-1))
                entries = pa.StructArray.from_arrays([c.take(flat) for c in names], ["dimension", "value"])
                dims = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * cells.size), entries)
                yield pa.record_batch({"dims": dims, "count": pa.array(total[some], pa.int64())})

        for batch in batches:
            for b, n in zip(batch.column("block").to_pylist(), batch.column("n")):
                if b != open_:
                    if total is not None:
                        yield from sent()
                    open_, total = b, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(n.as_buffer(), np.uint32)
        if total is not None:
            yield from sent()

    return run


def together(rows: DataFrame, place: Column, size: int, bucket: int = BUCKET) -> DataFrame:
    """dims (array of dimension and value, in the order of place), count: papers that hold each combination of `size` values of different dimensions.

    rows: paper_id, dimension, value, each once. Combinations that no paper holds have no row.
    """
    entry = F.struct(place.cast("int").alias("i"), "dimension", "value")
    return together_held(Staged(rows.groupBy("paper_id").agg(F.collect_list(entry).alias("held")), "held").df, size, bucket)


def together_held(held: DataFrame, size: int, bucket: int = BUCKET) -> DataFrame:
    """together() of papers (paper_id, held: distinct (i, dimension, value), i the place of the dimension), read twice."""
    each = held.select("paper_id", F.inline("held"))
    values = each.select("i", "dimension", "value").distinct().limit(VALUES + 1).collect()
    if len(values) <= VALUES:
        values = sorted(values)
        cells = Cells(np.unique([v.i for v in values], return_inverse=True)[1], size)
        if cells.n <= CELLS:
            return _by_arrays(held, values, cells)
    return _by_bitmaps(each, size, bucket)


def _by_arrays(held: DataFrame, values: list[Row], cells: Cells) -> DataFrame:
    spark = held.sparkSession
    dimension, value = [v.dimension for v in values], [v.value for v in values]
    names = pa.array([f"{v.i}|{v.dimension}|{v.value}" for v in values], pa.string())
    # A task sends its array on once, so there are no more of them than cores.
    dealt = shipped(held).select("held").coalesce(spark.sparkContext.defaultParallelism)
    counted = dealt.mapInArrow(_array_counter(cells, names), "block long, n binary")
    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(_adder(cells, dimension, value), "dims array<struct<dimension:string,value:string>>, count long")


def _by_bitmaps(rows: DataFrame, size: int, bucket: int) -> DataFrame:
    buckets = max(1, -(-rows.count() // bucket))
    dealt = shipped(rows).select("paper_id", "i", "dimension", "value", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).alias("_b"))
    streams = dealt.repartition("_b").sortWithinPartitions("_b")
    counted = streams.mapInArrow(_counter(size), "dims array<struct<dimension:string,value:string>>, n long")
    return counted.groupBy("dims").agg(F.sum("n").alias("count"))
