"""Exact Jaccard links between texts: a prefix-filtered self-join of shingle sets that never pairs up a whole group.

A text's set holds the XXH64 values of its five-word shingles (of the whole text where that is shorter).
Under one order of all shingles, two sets with Jaccard >= t share a shingle among the first
n - ceil(t n) + 1 of each (n being the set's size), so only those prefixes are dealt out. Any order is
right; here shingles that a sample of documents shows to be common come last, the others by hash.

Large groups would make pairs by the square. While the shared prefix shingles allow more than PAIRS pairs
a text between different components, a round pairs all holders of a shingle with one of them: in the first round the
one whose whole set is the commonest (of edited copies that is the text they were made from), later the best of a component
chosen by a hash of the round. It checks those pairs and joins components. What is left, or does not shrink by rounds, is
paired in full, but for holders of one component. A shingle with more than HOT holders then pairs only texts whose parity bitmaps differ in as few bits
as the similarity allows: each shingle flips one of BITS bits, so two sets differ in at least as many shingles as their bitmaps in bits.
Pairs that share too few prefix shingles to have the similarity are left out unread; the others count if their whole sets, made again from the texts, have the similarity.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import map_arrow, small, stage
from siltstone.operators.components import components
from siltstone.sources.staging import sized

SHINGLE = 5
SEED = 42
#: Documents sampled for common shingles; those kept (8 bytes each go to every task), and their least count.
SAMPLE = 20_000
COMMON = 200_000
COMMON_FROM = 4
#: Pairs a text (repeats included) from which a round with one partner a shingle comes first; rounds at most, and
#: the share of pairs that a round has to leave at most for another one to follow.
PAIRS = 50
ROUNDS = 8
SHRINK = 0.8
#: Holders of a shingle from which bitmaps are compared before texts are paired, and bits of a bitmap (a multiple of 64).
HOT = 32
BITS = 512
#: Rows of identifiers (16 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000

_TO_SPACE = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in range(256))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of the text's word shingles as sorted hashes; words as in simhash.fingerprint."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, n))


def _whole(share: float) -> int:
    """share in millionths, so that thresholds are compared in integers."""
    return round(share * 1_000_000)


def prefix(found: np.ndarray, common: np.ndarray, rank: np.ndarray, share: float) -> np.ndarray:
    """The first n - ceil(share n) + 1 of the sorted set, common ones (sorted hashes) last by rank."""
    n = len(found)
    length = n - -(-_whole(share) * n // 1_000_000) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        place = np.where(common[at] == found, rank[at], 0)
        found = found[np.argsort(place, kind="stable")]
    return found[:length]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(shingles(text).view(np.int64).tolist())
    items = list(counts.items())
    for at in range(0, len(items), 1 << 16):
        part = items[at : at + (1 << 16)]
        yield pa.record_batch([pa.array([h for h, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], ["tok", "n"])


def bitmap(found: np.ndarray) -> np.ndarray:
    """Parities: bit i is set if an odd number of the set's hashes fall on it."""
    odd = np.bincount((found >> np.uint64(7)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _dealer(common: np.ndarray, rank: np.ndarray, share: float):
    """For each text its prefix (pos from 0), and one row of its own (pos -1, tok the key) with its bitmap. mid: how common its whole set is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if len(s)]
            if not keep:
                continue
            keys, sets = keys[keep], [sets[i] for i in keep]
            heads = [prefix(s, common, rank, share) for s in sets]
            lengths = np.array([len(h) for h in heads])
            mids = np.array([_commonness(s, common, rank) for s in sets], np.float32)
            sizes = np.array([len(s) for s in sets], np.int32)
            tok = np.concatenate(heads)
            hot = np.isin(tok, common)
            n = len(tok)
            columns = [
                pa.array(np.concatenate([tok.view(np.int64), keys])),
                pa.array(np.concatenate([np.repeat(keys, lengths), keys])),
                pa.array(np.concatenate([np.repeat(sizes, lengths), sizes])),
                pa.array(np.concatenate([*(np.arange(k, dtype=np.int32) for k in lengths), np.full(len(keys), -1, np.int32)])),
                pa.array(np.concatenate([np.repeat(mids, lengths), mids])),
                pa.array(np.concatenate([hot, np.ones(len(keys), bool)])),
                pa.array([None] * n + [bitmap(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, ["tok", "key", "n", "pos", "mid", "hot", "bits"])

    return run


def _commonness(found: np.ndarray, common: np.ndarray, rank: np.ndarray) -> float:
    if not len(common):
        return 0.0
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return float(np.where(common[at] == found, rank[at], 0).mean())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], ["key", "found"])


def alike(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 1_000_000 >= _whole(share) * (len(a) + len(b) - both)


def _checker(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            good = pa.array([alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), share) for a, b in pairs], pa.bool_())
            yield pa.record_batch([batch.column(0), batch.column(1)], ["u", "v"]).filter(good)

    return run


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _one_each(texts: DataFrame, rows: DataFrame, broadcast_rows: int) -> DataFrame:
    """key and text, once for each key (rows equal in id and text stay repeated)."""
    low = rows.groupBy("key").agg(F.min("id").alias("low")).withColumnRenamed("key", "key2")
    same = (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("low"))
    out = rows.select("id", "key").join(low, same, "left_anti").distinct()
    out = stage(out.select(F.col("id").alias("low"), F.col("key").alias("key2")), "copies")
    if out.count() <= broadcast_rows:
        return texts.join(F.broadcast(out), same, "left_anti").select("key", "text")
    return texts.join(low.hint("shuffle_hash"), same, "left_semi").select("key", "text")


def _common(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    share = min(1.0, SAMPLE / max(1, n))
    some = texts.where(F.expr(f"pmod(xxhash64(key), 1000003) < {int(share * 1000003) + 1}")).select("text")
    counts = map_arrow(some, _counter, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "tok").limit(COMMON).collect()
    tok = np.array([r.tok for r in top], np.int64).view(np.uint64)
    by = np.argsort(tok)
    return tok[by], np.array([r.n for r in top], np.int64)[by]


def _verified(pairs: DataFrame, n: int, texts: DataFrame, share: float, broadcast_rows: int) -> DataFrame:
    """u, v: the components ra, rb of those of the n pairs (a, b of keys, ra, rb; staged) that have the similarity."""
    ends = pairs.select(F.col("a").alias("key2")).union(pairs.select(F.col("b").alias("key2"))).distinct()
    ends = stage(sized(ends, 2 * n), "candidate-keys")
    known = ends.count()
    wanted = texts.join(F.broadcast(ends) if known <= broadcast_rows else ends, F.col("key") == F.col("key2"), "left_semi")
    sets = stage(map_arrow(wanted.select("key", "text"), _sets, "key long, found binary"), "sets")
    if sets.count() > known:
        sets = sets.dropDuplicates(["key"])
    left = sets.select(F.col("key").alias("a"), F.col("found").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("found").alias("y"))
    # Sets of long texts are large, so partitions are not made fewer while they travel.
    both = pairs.join(left, "a").join(right, "b").select("ra", "rb", "x", "y")
    return sized(map_arrow(both, _checker(share), "u long, v long").distinct(), n)


def _holders(shared: DataFrame, turn: int) -> DataFrame:
    """For each shingle in more than one component: s holders, q (sum of squares of holders by component), major component, hub (key, n, pos, root)."""
    draw = F.lit(0).cast("long") if turn == 0 else F.xxhash64("root", F.lit(turn))
    best = F.struct(draw.alias("d"), "mid", F.xxhash64("key").alias("h"), "key", "n", "pos", "root")
    per = shared.groupBy("tok", "root").agg(F.count(F.lit(1)).alias("m"), F.max(best).alias("best"))
    m = F.col("m").cast("double")
    per = per.groupBy("tok").agg(
        F.count(F.lit(1)).alias("k"), F.sum(m).alias("s"), F.sum(m * m).alias("q"), F.max(F.struct("m", "root")).alias("major"), F.max("best").alias("hub")
    )
    return per.where("k > 1").select("tok", "s", "q", F.col("major.root").alias("major"), *(F.col(f"hub.{c}").alias(f"{c}_b") for c in ("key", "n", "pos", "root")))


def _counted(met: DataFrame, t: int, factor: int) -> DataFrame:
    """a, b, ra, rb: pairs that share enough of their prefixes, where they stand, to have the similarity."""
    ahead = "key < key_b"
    named = (("key", "a"), ("n", "na"), ("pos", "pa"), ("root", "ra"))
    sides = [F.expr(f"if({ahead}, {x}, {x}_b)").alias(name) for x, name in named]
    sides += [F.expr(f"if({ahead}, {x}_b, {x})").alias(name.replace("a", "b") if name != "ra" else "rb") for x, name in named]
    pairs = met.select(*sides).groupBy("a", "b", "na", "nb", "ra", "rb").agg(F.count(F.lit(1)).alias("c"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    # What both must share, against what the first common place leaves and what the prefixes share: of the
    # prefix that ends first all common ones stand in the other, and behind it at most ceil(share n) - 1 follow.
    rest = "(({t}L * {n} + 999999L) div 1000000L - 1)"
    most = f"c * {factor} + greatest({rest.format(t=t, n='na')}, {rest.format(t=t, n='nb')})"
    return pairs.where(f"(1000000L + {t}L) * least(na - pa, nb - pb, {most}) >= {t}L * (na + nb)").select("a", "b", "ra", "rb")


def _paired(shared: DataFrame, holders: DataFrame, bits: DataFrame, t: int, fits: str) -> DataFrame:
    """Holders of a shingle in different components, in full; one end stands outside the shingle's largest component."""
    rows = shared.join(holders.select("tok", "s", "major"), "tok")
    # Each pair once: from the end outside the largest component, of two such ends from the lesser key.
    once = f"root != root_b and (key < key_b or root_b = major) and {fits}"
    cold = rows.where(f"s <= {HOT}")
    other = lambda df, *more: df.select("tok", *(F.col(c).alias(f"{c}_b") for c in ("key", "n", "pos", "root", *more)))
    kept = ["key", "n", "pos", "root", "key_b", "n_b", "pos_b", "root_b"]
    plain = cold.where("root != major").join(other(cold), "tok").where(once).select(*kept)
    hot = rows.where(f"s > {HOT}").join(bits, "key")
    apart = " + ".join(f"bit_count(bits[{i}] ^ bits_b[{i}])" for i in range(BITS // 64))
    near = f"(1000000L + {t}L) * (n + n_b - ({apart})) >= 2L * {t}L * (n + n_b)"
    return plain.unionByName(hot.where("root != major").join(other(hot, "bits"), "tok").where(f"{once} and {near}").select(*kept))


def links(docs: DataFrame, rows: DataFrame, edges: DataFrame, share: float, pairs_each: int = PAIRS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """edges (u, v; staged) of fingerprints, and more: their components are those of edges and of all pairs with the similarity.

    rows: id, fp, key (text_key) of every row of docs, staged.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].alias("text")).where(F.col("text").isNotNull())
    texts = _one_each(texts.withColumn("key", text_key(F.col("text"))), rows, broadcast_rows)
    roots = components(edges).withColumnRenamed("u", "fp")
    keys = rows.groupBy("key").agg(F.min("fp").alias("fp")).join(roots, "fp", "left")
    keys = stage(keys.select(F.col("key").alias("key2"), F.coalesce("root", "fp").alias("root")), "keys")
    n = keys.count()
    common, rank = _common(texts, n)
    dealt = map_arrow(texts, _dealer(common, rank, share), "tok long, key long, n int, pos int, mid float, hot boolean, bits array<long>")
    # Common shingles and rows of the texts themselves stay without being counted, so no window holds many rows.
    held = "count(*) over (partition by if(hot, xxhash64(tok, key), tok))"
    dealt = dealt.withColumn("held", F.expr(held)).where("hot or held > 1").drop("hot", "held")
    dealt = stage(dealt.join(keys, F.col("key") == F.col("key2")).drop("key2"), "shared")
    bits, shared = dealt.where("pos < 0").select("key", "bits"), dealt.where("pos >= 0").drop("bits")
    if bits.count() > bits.select("key").distinct().count():  # rows equal in id and text
        bits, shared = bits.dropDuplicates(["key"]), stage(shared.distinct(), "shared")

    t = _whole(share)
    fits = f"1000000L * least(n, n_b) >= {t}L * greatest(n, n_b)"
    found, before = [edges.select("u", "v")], None
    for turn in range(ROUNDS + 1):
        size = shared.count()
        holders = stage(sized(_holders(shared, turn), size), "holders")
        many = holders.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0]
        if not many:
            break
        last = turn == ROUNDS or many <= pairs_each * n or (before is not None and many > SHRINK * before)
        before = many
        if last:
            met = _paired(shared, holders, bits, t, fits)
        else:
            met = shared.join(small(holders.drop("s", "q", "major"), broadcast_rows), "tok").where(f"root != root_b and {fits}")
        pairs = stage(sized(_counted(met, t, 1 if last else 2), size), "candidates")
        good = stage(_verified(pairs, pairs.count(), texts, share, broadcast_rows), "similar")
        found.append(good)
        if last:
            break
        moved = components(good).select(F.col("u").alias("old"), F.col("root").alias("new"))
        moved = small(stage(moved, "moved"), broadcast_rows)
        shared = shared.join(moved, F.col("root") == F.col("old"), "left").withColumn("root", F.coalesce("new", "root")).drop("old", "new")
        shared = stage(shared, "shared")
    return stage(reduce(DataFrame.unionByName, found).distinct(), "links")
