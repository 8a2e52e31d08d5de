"""Benchmark decontamination by a prefix-filtered set join, in DataFrame and SQL functions only.

Every item is cut into windows of ten consecutive words (an item of fewer words is one window). Seen as
a set of shingles, a window is contained in a document only if all its shingles are, so by the prefix
principle one of them is enough to find every candidate: the first in an order by rarity. The steps:

1. the shingles of all windows (three words, fewer in shorter windows) go into a Bloom filter; one pass over the
   documents counts how often each stands there. A window with a shingle that stands nowhere is in no document and
   goes; each other window keeps the rarest of its shingles (fewest places in the documents, then by hash) and the
   shingle's offset: its prefix;
2. a second pass keeps the places of documents whose shingle passes the Bloom filter of the prefixes;
3. positions join the windows on the prefix, the window must lie within the document (positional and
   length bounds), and the words themselves are compared.

A filter is one row with an array of longs, read as a scalar subquery: at most 2 ** MAX_BITS bits (8 MB), whatever the
benchmark's size. A larger benchmark passes more positions, which the join then drops; no case is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import folded_words, fresh, small, stage

WINDOW = 10
SHINGLE = 3
#: Bits of a Bloom filter for each key, and bounds (powers of two) for all of them. Three bits stand for a key.
BITS_EACH = 32
MIN_BITS, MAX_BITS = 12, 26
SHIFTS = (0, 18, 36)
#: Contaminated rows (16 bytes each) that may be broadcast to drop them.
BROADCAST_ROWS = 500_000


def _shingle_hash(array: str, at: str, q: int) -> str:
    return "xxhash64(" + ", ".join(f"get({array}, {at} + {j})" for j in range(q)) + ")"


def window_shingles(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per distinct window and place in it: win (words), items, q and h (the shingle there), off."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), F.expr(folded_words("text")).alias("w"))
    windows = (
        item.where(F.size("w") > 0)
        .select(
            "item",
            F.explode(
                F.expr(
                    f"transform(sequence(0, greatest(size(w) - {window}, 0)), i -> slice(w, i + 1, least({window}, size(w))))"
                )
            ).alias("win"),
        )
        .groupBy("win")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    per_q = []
    for q in range(1, shingle + 1):
        has = F.size("win") == q if q < shingle else F.size("win") >= q
        offsets = f"transform(sequence(0, size(win) - {q}), i -> struct({_shingle_hash('win', 'i', q)} as h, i as off))"
        per_q.append(windows.where(has).select("win", "items", F.lit(q).alias("q"), F.explode(F.expr(offsets)).alias("s")))
    return reduce(DataFrame.union, per_q).select("win", "items", "q", "s.h", "s.off")


def benchmark_index(shingles: DataFrame, places: DataFrame) -> DataFrame:
    """One row per window that may occur: q and h (its prefix), off (the prefix's offset), win, items. places: q, h, n in the documents."""
    met = shingles.join(places, ["q", "h"]).groupBy("win")
    rarest = met.agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "h", "off", "q", "items")).alias("p"))
    whole = F.col("k") == F.size("win") - F.col("p.q") + 1
    return rarest.where(whole).select("p.q", "p.h", "p.off", "win", "p.items")


def _slots(h: str, bits: int) -> list[str]:
    return [f"(shiftrightunsigned({h}, {shift}) & {(1 << bits) - 1}L)" for shift in SHIFTS]


def bloom(keys: DataFrame, most_bits: int = MAX_BITS) -> tuple[Column, int]:
    """(the filter of keys.h as a scalar subquery, array of longs; its bits as a power of two)."""
    bits = MIN_BITS
    n = keys.count()
    while bits < most_bits and (1 << bits) < BITS_EACH * n:
        bits += 1
    slots = keys.select(F.explode(F.expr(f"array({', '.join(_slots('h', bits))})")).alias("s"))
    words = slots.groupBy(F.expr("shiftrightunsigned(s, 6)").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("w"))
    spark = keys.sparkSession
    every = spark.range(1 << (bits - 6)).join(words, F.col("id") == F.col("i"), "left").select("id", F.coalesce("w", F.lit(0)).alias("w"))
    whole = stage(every.agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("x")).select(F.col("x.w").alias("b")), "filter")
    return whole.scalar(), bits


def positions(docs: DataFrame, keys: DataFrame, window: int = WINDOW, most_bits: int = MAX_BITS) -> DataFrame:
    """Places of documents whose shingle may be a key: id (doc_id), th (hash of the text), n_words, at, q and h (the shingle's words and hash), and the
    words around (ctx, from lo). Each row of docs also has one row at -1, without a shingle.

    keys, staged: q, h. Words are made once a text and exploded by position, so that hashes and the filter run in compiled code over the text's array.
    """
    sizes = sorted(r.q for r in keys.select("q").distinct().collect()) or [1]  # at most as many as a shingle has words
    filter_, bits = bloom(keys.select("h"), most_bits)
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    texts = docs.select(F.col("doc_id").alias("id"), text_hash.alias("th"), F.expr(folded_words("text")).alias("w"))
    found = []
    for q in sizes:
        h = _shingle_hash("w", "at", q)
        rows = texts.select("id", "th", "w", F.explode_outer(F.expr(f"sequence(-1, greatest(size(w) - {q}, -1))")).alias("at"))
        held = F.lit(True)
        for slot in _slots(h, bits):
            word = F.get(filter_, F.expr(f"cast(shiftrightunsigned({slot}, 6) as int)"))
            held = held & (F.call_function("shiftrightunsigned", word, F.expr(f"cast({slot} & 63 as int)")).bitwiseAND(F.lit(1)) == 1)
        own = F.col("at") == -1 if q == sizes[0] else F.lit(False)
        around = f"greatest(at - {window}, 0)"
        shown = {"q": f"int({q})", "h": h, "lo": around, "ctx": f"slice(w, {around} + 1, at - {around} + {window})"}
        rows = rows.where(own | ((F.col("at") >= 0) & held))
        found.append(rows.select("id", "th", F.size("w").cast("long").alias("n_words"), "at", *(F.expr(f"if(at < 0, null, {x})").alias(k) for k, x in shown.items())))
    return reduce(DataFrame.unionByName, found)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: id (doc_id), th (hash of the text), n_words, n_hit and items (null where nothing occurs)."""
    shingles = stage(window_shingles(benchmark, window, shingle), "shingles")
    keys = stage(shingles.select("q", "h").distinct(), "shingle-keys")
    places = positions(docs, keys, window, most_bits).where("at >= 0").groupBy("q", "h").agg(F.count(F.lit(1)).alias("n"))
    index = stage(benchmark_index(shingles, places), "windows")
    staged = stage(positions(docs, stage(index.select("q", "h").distinct(), "prefixes"), window, most_bits), "positions")
    spans = (
        staged.where("at >= 0").join(index, ["q", "h"])
        .withColumns({"s": F.col("at") - F.col("off"), "len": F.size("win")})
        .where((F.col("s") >= 0) & (F.col("s") + F.col("len") <= F.col("n_words")))
        .where(F.expr("slice(ctx, s - lo + 1, len) = win"))
    )
    hits = spans.groupBy("id", "th").agg(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("len")).alias("e")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = (
        "aggregate(spans, named_struct('to', 0, 'n', 0), (a, x) -> named_struct('to', greatest(a.to, x.e),"
        " 'n', a.n + greatest(0, x.e - greatest(x.s, a.to)))).n"
    )
    hits = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), F.expr(covered).alias("n_hit"), "items")
    rows = staged.where("at < 0").select("id", "th", "n_words")
    joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    return joined.select("id", "th", "n_words", "n_hit", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without words have no windows. Repeated rows
    give repeated results; rows that share a doc_id but not a text are told apart by the text's hash. A
    null doc_id is a value like any other. Other columns are ignored, whatever their names. Empty
    tables give no rows, or rows without hits.
    """
    rows = find_hits(docs, benchmark, window, most_bits=most_bits)
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs without the rows that hold a window of any item. All columns stay as they are, whatever their names.

    The rows to drop are broadcast if a count has shown them to be few, else joined by a shuffle. Null and empty texts
    hold no window and stay; a null doc_id is a value like any other; rows that repeat share their fate. An empty table
    gives no rows, an empty benchmark drops none.
    """
    hit, th = fresh(["hit", "th"], docs.columns)
    dirty = find_hits(docs, benchmark).where(F.col("n_hit") > 0).select(F.col("id").alias(hit), F.col("th").alias(th)).distinct()
    dirty = small(stage(dirty, "contaminated"), broadcast_rows)
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(dirty, docs["doc_id"].eqNullSafe(F.col(hit)) & (text_hash == F.col(th)), "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i + 1:i + 10], ' ') AS t
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win),
shingle AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT shingle.doc_id, shingle.i, shingle.n, win.item FROM shingle JOIN win ON shingle.n = win.n AND shingle.t = win.t),
pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""
