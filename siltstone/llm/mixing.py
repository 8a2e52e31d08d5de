"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to), so the flow network
has one node per pattern and one per source, whatever the number of documents. From the origin to a
pattern run `repeats` arcs, each with the pattern's size as capacity, at the convex costs 0, 1, 2, ...:
a first copy is free, each further one dearer than the one before, and no document can be taken more
often. Patterns connect to their sources without bound, sources to the sink with their quotas. As arcs of
all patterns cost the same at the same copy, cheapest paths come by level: a maximal flow with the first
arcs, then augmented with the second ones, and so on, each by blocking flows. The flow
through a pattern gives whole copies of all its documents and a remainder, for which documents are taken
in the order of a seeded hash until the remainder is met as nearly as whole documents can.

The hash is of identifier, text and pattern, and of a number among rows equal in all three, so that no rows share
their fate for want of identifiers. Its cut is found by three rounds of histograms (12 bits of the hash each), so no
pattern is ever sorted or gathered in one task. Equal rows are numbered by the partitions in which they stand.

The driver holds the network of at most MAX_PATTERNS patterns. Where there are more and none joins sources, every
node of the network has one arc: its flow is the lesser of quota and capacity, found in Spark for all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._common import SPACE_BREAK, fresh, small, split_words, stage

REPEATS = 3
SEED = 42
WEIGHTS = (5, 2, 1)
#: Patterns whose network the driver solves; a pattern is a row of a few dozen bytes there, and in broadcasts of plans.
MAX_PATTERNS = 100_000
#: Repeated rows (8 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000
BITS = 12
ROUNDS = 3
#: Quotas are rounded to whole words; no source has more of them than this.
_INFINITE = 1 << 62


def targets(sizes: dict, weights: dict, repeats: int = REPEATS) -> dict:
    """Shares of the sum of sizes by weight; none above repeats times its size, the excess reshared by weight."""
    left, open_, found = float(sum(sizes.values())), dict.fromkeys(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        full = [s for s in open_ if share[s] > repeats * sizes[s]]
        if not full:
            return found | share
        for s in full:
            found[s] = float(repeats * sizes[s])
            left -= found[s]
            del open_[s]
    return found


def source_order(sources: list) -> list:
    """By code point; null last."""
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


class Flow:
    """A maximal flow by blocking flows, in which the rooms of arcs may be raised between runs."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def _layers(self, s: int, t: int) -> list[int] | None:
        """Arcs from s to each node at least, -1 where none leads; None if t is out of reach."""
        far = [-1] * len(self.arcs)
        far[s], now = 0, [s]
        while now and far[t] < 0:
            after = []
            for x in now:
                for e in self.arcs[x]:
                    if self.room[e] and far[self.to[e]] < 0:
                        far[self.to[e]] = far[x] + 1
                        after.append(self.to[e])
            now = after
        return far if far[t] >= 0 else None

    def run(self, s: int, t: int) -> None:
        while far := self._layers(s, t):
            tried = [0] * len(self.arcs)  # arcs of each node that lead no further
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    room = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= room
                        self.room[e ^ 1] += room
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    x = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                arcs = self.arcs[x]
                while tried[x] < len(arcs):
                    e = arcs[tried[x]]
                    if self.room[e] and far[self.to[e]] == far[x] + 1:
                        break
                    tried[x] += 1
                if tried[x] < len(arcs):
                    path.append(arcs[tried[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    tried[x] += 1
                else:
                    break


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """patterns: size of each set of sources. Words to take of each pattern; quotas are met if the sizes allow it."""
    keys, sources = sorted(patterns, key=repr), list(quotas)
    at = {s: 1 + len(keys) + i for i, s in enumerate(sources)}
    sink = 1 + len(keys) + len(sources)
    flow = Flow(sink + 1)
    first = {key: flow.arc(0, i, 0) for i, key in enumerate(keys, 1)}
    for i, key in enumerate(keys, 1):
        for s in key:
            flow.arc(i, at[s], _INFINITE)
    for s in sources:
        flow.arc(at[s], sink, round(quotas[s]))
    for _ in range(repeats):  # the arcs of one cost more
        for key, e in first.items():
            flow.room[e] += patterns[key]
        flow.run(0, sink)
    return {key: flow.room[e ^ 1] for key, e in first.items()}


def word_count(column: str = "text") -> Column:
    return F.expr(f"cast(size({split_words(f'coalesce({column}, {chr(39)}{chr(39)})', SPACE_BREAK)}) as bigint)")


def _key(members: Column) -> Column:
    """A pattern as one string: JSON of the sorted distinct sources, nulls as null."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("m")), {"ignoreNullFields": "false"})


def _who(key: Column) -> Column:
    """Stands for identifier, text and pattern. Rows that happen to share it are numbered like equal rows."""
    doc_id = F.col("doc_id").cast("long")
    return F.xxhash64(doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(F.coalesce("text", F.lit(""))), key)


def _draw(who: Column, number: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), who, number.cast("long")), 64 - BITS * ROUNDS)


def _numbered(rows: DataFrame, who: str, part: str, line: str, out: str) -> DataFrame:
    """rows (staged) with out: 0, 1, ... among rows of one `who`. part and line: where a row stood, so that no window holds
    more of them than one partition did."""
    within = F.row_number().over(Window.partitionBy(who, part).orderBy(line))
    w, p, o, n = fresh(["w", "p", "o", "n"], [*rows.columns, out])
    counts = rows.groupBy(who, part).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(who).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(who).alias(w), F.col(part).alias(p), F.coalesce(before, F.lit(0)).alias(o))
    placed = rows.withColumn(out, within).join(offsets, (F.col(who) == F.col(w)) & (F.col(part) == F.col(p)))
    return placed.withColumn(out, F.col(out) - 1 + F.col(o)).drop(w, p, o)


def _cuts(rows: DataFrame, rest: DataFrame, few: bool) -> DataFrame:
    """Of rows (key, size, h): for each key of rest (key, rest) the cut below which the sizes come nearest to rest, as key, cut.

    few: whether rest is known to have at most MAX_PATTERNS rows.
    """
    state = rest.select(F.col("key").alias("k"), "rest", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("d"))
    for i in range(ROUNDS):
        state = stage(state, "cells") if i else state  # the bits so far, and the words below them
        state = F.broadcast(state) if few else state
        shift = BITS * (ROUNDS - 1 - i)
        part = rows.join(state, F.col("key") == F.col("k"))
        part = part.where(F.shiftrightunsigned("h", shift + BITS) == F.col("p")).where(F.col("size") > 0)
        cells = part.groupBy("k", "d", "rest", F.shiftrightunsigned("h", shift).alias("c")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("c"))
        cells = cells.withColumn("upto", F.col("d") + upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        state = cells.select("k", "rest", F.col("c").alias("p"), (F.col("upto") - F.col("n")).alias("d"), "upto")
        if i < ROUNDS - 1:
            state = state.drop("upto")
    near = F.col("p") + F.when(F.col("upto") - F.col("rest") <= F.col("rest") - F.col("d"), 1).otherwise(0)
    found = state.select("k", near.alias("cut"))
    # A pattern without a crossing cell has fewer words than asked: all of it is taken.
    return rest.join(found, F.col("key") == F.col("k"), "left").select("key", F.coalesce("cut", F.lit(1 << (BITS * ROUNDS))).alias("cut"))


class Mix:
    """What a mix takes. plan: key, whole (copies of all documents), cut (below which one more is taken); sources: source, size, target.

    few: whether the driver has held them, so that they have at most MAX_PATTERNS rows, or a source a row of those.
    """

    def __init__(self, plan: DataFrame, sources: DataFrame, few: bool):
        self.plan, self.sources = plan, sources
        self.hint = F.broadcast if few else lambda df: df

    def copies(self, rows: DataFrame, key: str = "key", h: str = "h", out: str = "copies") -> DataFrame:
        names = fresh(["k", "whole", "cut"], [*rows.columns, out])
        plan = self.hint(self.plan.toDF(*names))
        k, whole, cut = names
        n = F.col(whole) + F.when(F.col(h) < F.col(cut), 1).otherwise(0)
        return rows.join(plan, F.col(key) == F.col(k), "left").withColumn(out, F.coalesce(n, F.lit(0)).cast("long")).drop(*names)

    def with_source(self, rows: DataFrame, source: str, size: str = "source_size", target: str = "target") -> DataFrame:
        """rows with the size and target of the source in a single column."""
        (s,) = fresh(["s"], [*rows.columns, size, target])
        return rows.join(self.hint(self.sources.toDF(s, size, target)), F.col(source).eqNullSafe(F.col(s)), "left").drop(s)


def _solved(spark, found: list, weights: dict | None, repeats: int) -> tuple[DataFrame, DataFrame]:
    """found: rows of key, members, n. (key, n, taken of each pattern; source, size, target), by the flow on the driver."""
    sizes: dict = {}
    for r in found:
        for s in set(r.members):
            sizes[s] = sizes.get(s, 0) + r.n
    order = source_order(list(sizes))
    weights = weights or {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    scale = sum(r.n for r in found) / max(1, sum(sizes.values()))  # overlapping sources share the documents' words once
    goals = {s: g * scale for s, g in targets(sizes, weights, repeats).items()}
    patterns = {tuple(source_order(list(set(r.members)))): r for r in found}
    taken = route({p: r.n for p, r in patterns.items()}, goals, repeats)
    rows = spark.createDataFrame([(r.key, r.n, taken[p]) for p, r in patterns.items()], "key string, n long, taken long")
    return rows, spark.createDataFrame([(s, sizes[s], float(goals[s])) for s in order], "source string, size long, target double")


def _apart(by_pattern: DataFrame, weights: dict | None, repeats: int) -> tuple[DataFrame, DataFrame]:
    """As _solved where no pattern joins sources, in Spark: quota by quota, as no two share a path."""
    source = F.col("members")[0]
    rows = by_pattern.select("key", source.alias("source"), F.col("n").alias("size"))
    if weights is None:
        # The place in the order of all sources: within sorted ranges, after those of the ranges before.
        sorted_ = rows.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
        sorted_ = stage(sorted_.withColumns({"part": F.spark_partition_id(), "line": F.monotonically_increasing_id()}), "sources")
        ends, before = {}, 0
        for r in sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("low")).orderBy("part").collect():
            ends[r.part] = before - r.low
            before += r.n
        shift = F.create_map(*[x for k, v in ends.items() for x in (F.lit(k), F.lit(v))])
        place = F.col("line") + shift[F.col("part")]
        rows = sorted_.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))).drop("part", "line")
    else:
        given = rows.sparkSession.createDataFrame([(s, float(w)) for s, w in weights.items()], "given string, weight double")
        rows = rows.join(given, F.col("source").eqNullSafe(F.col("given"))).drop("given")
    rows = stage(rows, "weighted")
    most = repeats * F.col("size")
    level, last = 0.0, None
    while level != last:
        # A source is full where its share would be more than it may be taken; the rest share what those leave.
        full = F.col("weight") * level > most
        r = rows.agg(F.sum("size"), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight")))).first()
        last, level = level, ((r[0] or 0) - (r[1] or 0)) / r[2] if r[2] else level
    rows = rows.withColumn("target", F.least(most.cast("double"), F.col("weight") * level))
    taken = F.least(most, F.rint("target").cast("long"))
    return rows.select("key", F.col("size").alias("n"), taken.alias("taken")), rows.select("source", "size", "target")


def plan_mix(rows: DataFrame, weights: dict | None = None, repeats: int = REPEATS, most: int = MAX_PATTERNS) -> Mix:
    """rows, staged: key (pattern), members (array of sources), size, h. weights: by source; by default WEIGHTS in turn.

    More than `most` patterns are an error if any of them joins sources, as the driver could not hold their network.
    """
    by_pattern = rows.groupBy("key").agg(F.first("members").alias("members"), F.sum("size").alias("n"))
    found = by_pattern.limit(most + 1).collect()
    few = len(found) <= most
    if few:
        solved, sources = _solved(rows.sparkSession, found, weights, repeats)
    else:
        by_pattern = stage(by_pattern, "patterns")
        if not by_pattern.where(F.size(F.array_distinct("members")) > 1).isEmpty():
            raise ValueError(f"more than {most} patterns of overlapping sources")
        solved, sources = (stage(x, "flow") for x in _apart(by_pattern, weights, repeats))
    whole = F.when(F.col("n") > 0, F.floor(F.col("taken") / F.col("n"))).otherwise(0).cast("long")
    solved = solved.withColumn("whole", whole).withColumn("rest", F.col("taken") - F.col("whole") * F.col("n"))
    cuts = _cuts(rows, solved.where(F.col("rest") > 0).select("key", "rest"), few).withColumnRenamed("key", "k")
    plan = solved.join(cuts, F.col("key") == F.col("k"), "left").select("key", "whole", F.coalesce("cut", F.lit(0)).alias("cut"))
    return Mix(stage(plan, "plan"), sources, few)


def measured(docs: DataFrame, members: Column, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, key, members, size, who, h, staged; repeats: who of rows that are not alone with it, staged)."""
    key = _key(members)
    rows = docs.select(
        F.col("doc_id").alias("doc_id"), key.alias("key"), members.alias("members"), word_count().alias("size"), _who(key).alias("who"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line"),
    )
    rows = stage(rows, "sizes")
    repeats = stage(rows.groupBy("who").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("who").alias("again")), "repeats")
    zero = F.lit(0)
    if repeats.isEmpty():
        return rows.drop("part", "line").withColumn("h", _draw(F.col("who"), zero, seed)), repeats
    few = small(repeats, BROADCAST_ROWS)
    alone = rows.join(few, F.col("who") == F.col("again"), "left_anti").withColumn("number", zero.cast("long"))
    same = stage(rows.join(few, F.col("who") == F.col("again"), "left_semi"), "repeated")
    both = alone.unionByName(_numbered(same, "who", "part", "line", "number"))
    return stage(both.withColumn("h", _draw(F.col("who"), F.col("number"), seed)).drop("part", "line", "number"), "drawn"), repeats


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, for sources that do not overlap.

    A null source is a source of its own and comes last; a null text has size 0 and is never taken. Rows
    that share a doc_id, or have none, are told apart by their texts, and rows equal in both by a number: of n of them
    as many are taken as the mix needs. A source's taken words miss its target by half a document at most, and half a
    word. An empty table gives no rows. Other columns are ignored.
    """
    rows, _ = measured(docs, F.array(F.col("source").cast("string")), seed)
    plan = plan_mix(rows)
    chosen = plan.with_source(plan.copies(rows).withColumn("source", F.col("members")[0]), "source")
    return chosen.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of docs that are taken, with size, source_size, target, copies and taken beside their columns.

    Takes what mix takes. Of rows equal in doc_id, text and source those that stand first are taken, where not all are.
    Columns that have one of the five names give way to them; all others keep names and values, whatever the names.
    Null and empty texts are never taken; an empty table gives no rows.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c.lower() not in added]
    members = F.array(F.col("source").cast("string"))
    rows, repeats = measured(docs, members, seed)
    plan = plan_mix(rows)
    key, who, h, number, part, line, again, source = names = fresh(["key", "who", "h", "number", "part", "line", "again", "source_name"], [*own, *added])
    docs = docs.select(*(F.col(f"`{c}`") for c in own)).withColumns({key: _key(members), who: _who(_key(members)), number: F.lit(0).cast("long")})
    if not repeats.isEmpty():
        few = small(repeats.toDF(again), BROADCAST_ROWS)
        same = docs.join(few, F.col(who) == F.col(again), "left_semi").drop(number).withColumns({part: F.spark_partition_id(), line: F.monotonically_increasing_id()})
        same = _numbered(stage(same, "repeated"), who, part, line, number).drop(part, line)
        docs = docs.join(few, F.col(who) == F.col(again), "left_anti").unionByName(same)
    docs = plan.copies(docs.withColumn(h, _draw(F.col(who), F.col(number), seed)), key, h, "copies").where(F.col("copies") > 0)
    docs = docs.withColumn("size", word_count()).where(F.col("size") > 0).withColumn(source, F.col("source").cast("string"))
    out = plan.with_source(docs, source).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*(F.col(f"`{c}`") for c in own), *added)
