"""Entity resolution: records of one work become one paper.

1. Records that share an identifier (work id or DOI, aliases included) are one cluster: keys meet in a
   grouped table, star rounds give components.
2. Clusters may still be one work by title and year, or by nearly equal titles; whether they merge depends
   on the DOIs and authors that both have gathered so far, and so on the order. Candidates (equal title and
   year; near titles found by parts of their words that agree) are linked to blocks, and each block of
   clusters is decided in order of first appearance. A large block (a title that very many works share) is split before: only clusters without a DOI,
   and clusters with a word of their authors' names in common, can ever merge, so what these links leave apart is decided apart.
3. Members merge from the richest record on, by ordered folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions import text as t
from siltstone.operators.components import components
from siltstone.session import bounded, shipped
from siltstone.sources.staging import Staged

MIN_WORDS, MIN_JACCARD, MIN_RATIO = 5, 0.9, 0.96
#: The share of two titles' words in which they can differ at MIN_JACCARD.
DIFFER = (1 - Fraction(str(MIN_JACCARD))) / (1 + Fraction(str(MIN_JACCARD)))
#: Bits of the parity bitmap of a title's words (a power of two).
BITS = 128
#: Identifiers of titles, and characters of titles, that may be broadcast; rows and bytes of an Arrow batch of titles.
BROADCAST_IDS, BROADCAST_CHARS = 500_000, 8_000_000
BATCH_ROWS, BATCH_BYTES = 4_096, 4 << 20
#: Pairs of titles in a file from which sequence ratios are computed, which take far longer than their bytes tell.
RATIO_PAIRS = 500
#: Records of a block from which it is split.
LARGE = 10_000


def _keys(papers: DataFrame) -> DataFrame:
    ids = F.transform(F.concat(F.array("openalex_id"), F.coalesce("openalex_aliases", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("w:"), t.work_key(x)))
    dois = F.transform(F.concat(F.array("doi"), F.coalesce("doi_aliases", F.array().cast("array<string>"))), lambda x: F.concat(F.lit("d:"), t.doi_key(x)))
    rows = papers.select("ord", F.explode(F.array_distinct(F.concat(ids, dois))).alias("key"))
    return rows.where(F.length("key") > 2)


def clusters_by_id(papers: DataFrame) -> DataFrame:
    """ord, root: the least ord of all records joined by shared identifiers, for every record."""
    keys = _keys(papers)
    least = keys.groupBy("key").agg(F.min("ord").alias("v"))
    edges = keys.join(least, "key").select(F.col("ord").alias("u"), "v").where("u != v")
    found = components(edges).withColumnRenamed("u", "ord")
    return papers.select("ord").join(found, "ord", "left").select("ord", F.coalesce("root", "ord").alias("root"))


def title_identity(papers: DataFrame) -> DataFrame:
    """papers with title_key and has_identity: a title other than `untitled`, and a year."""
    key = t.title_key(F.col("title"))
    rows = papers.withColumn("title_key", key)
    return rows.withColumn("has_identity", (F.col("title_key") != "") & (F.col("title_key") != "untitled") & F.col("publication_year").isNotNull())


def _sizes() -> tuple[np.ndarray, np.ndarray]:
    """Least words of each class of titles, and the parts in which a title of the class and one as long or longer that agrees with it are cut.

    A title that agrees with n words has n / MIN_JACCARD at most, so it is of the same class or of the next.
    """
    share = Fraction(str(MIN_JACCARD))
    least = [MIN_WORDS]
    while least[-1] < 1 << 31:
        least.append(int(least[-1] / share) + 1)
    most = [n - 1 for n in least[1:]]
    return np.array(least[:-1]), np.array([int((n + int(n / share)) * DIFFER) + 1 for n in most])


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, year, hashes (of distinct words) as one row for each part of a title: see near_title_pairs."""
    least, cuts = _sizes()
    for batch in batches:
        ids, years = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "year"))
        lists = batch.column("hashes")
        words = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(lists.offsets.to_numpy())
        if not len(n):
            continue
        title = np.repeat(np.arange(len(n)), n)
        odd = np.bincount(title * BITS + (words >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=len(n) * BITS) & 1
        bits = np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(n), -1)
        kind = np.searchsorted(least, n, "right") - 1
        for longer in (0, 1):
            parts = np.where(kind >= longer, cuts[kind - longer], 0)
            start = np.cumsum(parts) - parts
            kept = parts[title] > 0
            at, of = title[kept], words[kept]
            sums = np.zeros(parts.sum(), np.uint64)
            np.add.at(sums, start[at] + (of % parts[at].astype(np.uint64)).astype(np.int64), of)
            row = np.repeat(np.arange(len(n)), parts)
            columns = [years[row], (kind - longer)[row].astype(np.int32), (np.arange(len(row)) - start[row]).astype(np.int32), sums.view(np.int64)]
            columns += [ids[row], n[row].astype(np.int32), np.full(len(row), longer == 0), *(bits[row, i] for i in range(BITS // 64))]
            yield pa.record_batch([pa.array(c) for c in columns], ["year", "kind", "part", "sum", "id", "n", "own", *(f"b{i}" for i in range(BITS // 64))])


def _alike(titles: DataFrame) -> DataFrame:
    """a, b: identifiers of titles (id, publication_year, title_key) of one year that may have MIN_JACCARD of their words in common; none that have are left out."""
    bounded(shipped(titles).sparkSession, BATCH_ROWS, BATCH_BYTES)
    hashes = F.transform(F.array_distinct(F.split("title_key", " ")), lambda w: F.xxhash64(w))
    named = [f"b{i}" for i in range(BITS // 64)]
    schema = "year long, kind int, part int, sum long, id long, n int, own boolean, " + ", ".join(f"{b} long" for b in named)
    parts = titles.select("id", F.xxhash64("publication_year").alias("year"), hashes.alias("hashes")).mapInArrow(_dealt, schema)
    parts = parts.select(F.xxhash64("year", "kind", "part", "sum").alias("key"), "id", "n", "own", *named)
    side = lambda s: parts.select("key", *(F.col(c).alias(f"{c}_{s}") for c in parts.columns[1:]))
    apart = " + ".join(f"bit_count({b}_a ^ {b}_b)" for b in named)
    fits = f"id_a < id_b and (own_a or own_b) and ({apart}) * {DIFFER.denominator}L <= (n_a + n_b) * {DIFFER.numerator}L"
    return side("a").join(side("b"), "key").where(fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _held(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is among ids (id; repeated), which are broadcast if a count shows them to be few."""
    ids = Staged(ids.distinct(), "ids").df
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def near_title_pairs(papers: DataFrame) -> DataFrame:
    """left, right (ord, left < right) of records of one year whose titles nearly agree and whose authors match. Each pair once.

    Titles are compared once a year however many records have them, authors once for all records of a title that have the same.
    Word sets of a and b words with a Jaccard similarity of t differ in (a + b)(1 - t)/(1 + t) words at most. Cut by hash into one part more, they
    agree on a whole part, so only titles that agree on one (by the sum of its hashes) meet; parity bitmaps of the words then rule out most of those that differ
    in more. Word overlap, the sequence ratio (in the order in which records stand) and authors decide, and only what is left becomes pairs of records.
    """
    rows = title_identity(papers).where("publication_year is not null and size(authors) > 0").where(F.size(F.array_distinct(F.split("title_key", " "))) >= MIN_WORDS)
    rows = Staged(rows.select("ord", "publication_year", "title_key", "authors"), "titled").df
    titles = rows.groupBy("publication_year", "title_key").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    titles = Staged(titles.withColumn("id", F.monotonically_increasing_id()), "titles").df
    met = Staged(_alike(titles), "met").df
    ends = lambda df: df.select(F.explode(F.array(*df.columns)).alias("id"))
    wanted = Staged(_held(titles, ends(met)), "wanted").df
    side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))
    words = lambda s: F.array_distinct(F.split(f"title_key_{s}", " "))
    near = met.join(side(wanted, "a"), F.col("a") == F.col("id_a")).join(side(wanted, "b"), F.col("b") == F.col("id_b"))
    near = near.where("publication_year_a = publication_year_b").where(t.jaccard(words("a"), words("b")) >= MIN_JACCARD)
    order = lambda x, y: F.struct(
        F.col(x).alias("left"), F.col(y).alias("right"), F.col(f"title_key_{x}").alias("lt"), F.col(f"title_key_{y}").alias("rt"), (F.col(f"first_{x}") < F.col(f"last_{y}")).alias("occurs")
    )
    near = near.select(F.inline(F.array(order("a", "b"), order("b", "a")))).where("occurs")
    near = Staged(near.repartition(1 + min(met.count() // RATIO_PAIRS, 4_096)), "close").df
    near = Staged(near.where(t.sequence_ratio("lt", "rt") >= MIN_RATIO).select("left", "right"), "near-titles").df

    known = Staged(_held(wanted, ends(near)).select("id", "publication_year", "title_key"), "known").df
    length = known.agg(F.sum(F.length("title_key") + 40)).first()[0] or 0
    members = rows.join(F.broadcast(known) if length <= BROADCAST_CHARS else known, ["publication_year", "title_key"])
    members = Staged(members.select("id", "ord", "authors").distinct(), "members").df
    people = members.groupBy("id", "authors").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    people = Staged(people.withColumn("who", F.monotonically_increasing_id()), "people").df
    same = near.join(side(people, "l"), F.col("left") == F.col("id_l")).join(side(people, "r"), F.col("right") == F.col("id_r"))
    same = same.where("first_l < last_r").where(t.same_authors("authors_l", "authors_r")).select("who_l", "who_r")
    placed = members.join(people.select("id", "authors", "who"), ["id", "authors"]).select("who", "ord")
    pairs = same.join(side(placed, "l"), "who_l").join(side(placed, "r"), "who_r")
    return pairs.where("ord_l < ord_r").select(F.col("ord_l").alias("left"), F.col("ord_r").alias("right"))


class _Block:
    """Clusters of a block, with what tells whether two of them fit: DOIs, and distinct author lists found by their names' tokens."""

    def __init__(self, rows: pd.DataFrame):
        self.order = rows["ord"].tolist()
        self.parent = dict(zip(self.order, rows["root"].tolist()))
        self.members: dict[int, list[int]] = {}
        self.dois: dict[int, set] = {}
        self.people: dict[int, set[tuple]] = {}
        #: For each title and year and word of a name, the clusters known there that have it.
        self.by_token: dict[tuple[str, str], set[int]] = {}
        for o, r, d, a in zip(self.order, rows["root"], rows["dois"], rows["authors"]):
            self.members.setdefault(r, []).append(o)
            self.dois.setdefault(r, set()).update(d)
            self.people.setdefault(r, set()).add(tuple(a))
        words = {names: {w for name in names for w in t.author_tokens(name)} for names in {a for lists in self.people.values() for a in lists}}
        self.tokens = {r: set().union(*(words[names] for names in lists)) for r, lists in self.people.items()}
        self.matching: dict[tuple, bool] = {}
        #: For each title and year the clusters known by it, and where each cluster stands there.
        self.known: dict[str, list[int]] = {}
        self.place: dict[int, dict[str, int]] = {}
        self.bare: dict[str, set[int]] = {}

    def join(self, x: int, y: int) -> None:
        low, high = min(x, y), max(x, y)
        for o in self.members.pop(high):
            self.parent[o] = low
            self.members[low].append(o)
        self.dois[low] |= self.dois.pop(high)
        self.people[low] |= self.people.pop(high)
        theirs, words = self.place.pop(high, {}), self.tokens.pop(high)
        for identity in theirs:
            for w in words:
                self.by_token[identity, w].discard(high)
        self.tokens[low] |= words
        mine = self.place.setdefault(low, {})
        for identity, at in theirs.items():
            mine[identity] = min(at, mine.get(identity, at))
        for identity in mine:
            self.index(low, identity)

    def index(self, root: int, identity: str) -> None:
        for w in self.tokens[root]:
            self.by_token.setdefault((identity, w), set()).add(root)

    def fits(self, x: int, y: int) -> bool:
        if not self.dois[x] or not self.dois[y] or self.dois[x] & self.dois[y]:
            return True
        return any(self.match(a, b) for a in self.people[x] for b in self.people[y])

    def match(self, a: tuple, b: tuple) -> bool:
        """Whether two author lists match, found once for each two lists."""
        if (a, b) not in self.matching:
            self.matching[a, b] = t.authors_match(list(a), list(b))
        return self.matching[a, b]

    def candidates(self, mine: int, identity: str) -> list[int]:
        """Places of the known clusters that may be the same as this one or fit it, in order: all fit one without DOIs, so the first is enough."""
        if not self.dois[mine]:
            return [0]
        bare = {i for i in self.bare[identity] if not self.dois[self.parent[self.known[identity][i]]]}
        self.bare[identity] = bare
        near = {mine}.union(*(self.by_token.get((identity, w), ()) for w in self.tokens[mine]))
        return sorted(bare | {self.place[r][identity] for r in near if identity in self.place.get(r, ())})

    def meet(self, o: int, identity: str) -> None:
        """Joins the record's cluster with the first known of the title and year that fits, or makes it known there."""
        mine, known = self.parent[o], self.known.setdefault(identity, [])
        self.bare.setdefault(identity, set())
        for i in self.candidates(mine, identity) if known else []:
            theirs = self.parent[known[i]]
            if mine == theirs:
                return
            if self.fits(mine, theirs):
                self.join(mine, theirs)
                return
        self.place.setdefault(mine, {}).setdefault(identity, len(known))
        self.index(mine, identity)
        if not self.dois[mine]:
            self.bare[identity].add(len(known))
        known.append(mine)


def decide_block(rows: pd.DataFrame, near: set[tuple[int, int]]) -> dict[int, int]:
    """rows: ord, root, title_year, dois, authors of a block, in order of ord. The root of every record in the end.

    near: pairs (earlier, later) of nearly equal titles. A record meets only clusters that can fit it, so a title with very many different works costs
    little more than its records.
    """
    rows = rows.sort_values("ord")
    block = _Block(rows)
    for o, identity in zip(block.order, rows["title_year"]):
        if identity is not None and not pd.isna(identity):
            block.meet(o, identity)
    earlier: dict[int, list[int]] = {}
    for a, b in near:
        earlier.setdefault(b, []).append(a)
    for o in block.order:
        for other in sorted(earlier.get(o, ())):
            mine, theirs = block.parent[o], block.parent[other]
            if mine != theirs and block.fits(mine, theirs):
                block.join(mine, theirs)
                break
    return block.parent


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_words(lists: pd.Series) -> pd.Series:
    return lists.map(lambda names: sorted({w for name in names for w in t.author_tokens(name)}))


def split_blocks(rows: DataFrame, near: DataFrame) -> DataFrame:
    """root, part: what of a block (rows: block, ord, root, title_year, dois, authors) has to be decided together; part is a root.

    A record's cluster merges with the first known one of its title and year that it fits: any, if one of the two has no DOI, else one of matching authors,
    which share a word of a name. One without a DOI goes to the very first, and only while the first has no DOI does one with a DOI go there, too. So all links that
    can matter are: each record without a DOI, and the first record with one, to the first of the title and year; records of a block that share a word of
    a name; near titles. Each is a star around its least root, so a word that all records have makes as many links as records.
    """
    owned = rows.groupBy("root").agg(F.max(F.size("dois") > 0).alias("has_doi"))
    marked = rows.join(owned, "root")
    titled = marked.where("title_year is not null")
    ends = titled.groupBy("title_year").agg(F.min_by("root", "ord").alias("first"), F.min_by("root", F.when(F.col("has_doi"), F.col("ord"))).alias("doi"))
    bare = titled.where(~F.col("has_doi")).join(ends.select("title_year", "first"), "title_year").select(F.col("root").alias("u"), F.col("first").alias("v"))
    opening = ends.where("doi is not null").select(F.col("doi").alias("u"), F.col("first").alias("v"))
    words = shipped(rows).select("block", "root", F.explode(_name_words("authors")).alias("w")).distinct()
    least = words.groupBy("block", "w").agg(F.min("root").alias("v"))
    named = words.join(least, ["block", "w"]).select(F.col("root").alias("u"), "v").distinct()
    place = rows.select("ord", "root")
    close = near.join(place.toDF("left", "u"), "left").join(place.toDF("right", "v"), "right").select("u", "v")
    found = components(bare.unionByName(opening).unionByName(named).unionByName(close)).select(F.col("u").alias("root"), F.col("root").alias("part"))
    return rows.select("root").distinct().join(found, "root", "left").select("root", F.coalesce("part", "root").alias("part"))


def _folded(rows: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without repetitions, repetitions as ord, first): records without identifiers whose title, year and authors are those of an earlier one end where it does."""
    alone = rows.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("root")
    close = near.select(F.explode(F.array("left", "right")).alias("ord")).distinct()
    plain = rows.where((F.size("dois") == 0) & F.col("title_year").isNotNull()).join(alone, "root", "left_semi").join(close, "ord", "left_anti")
    first = plain.groupBy("title_year", "authors").agg(F.min("ord").alias("first"))
    again = Staged(plain.join(first, ["title_year", "authors"]).where("ord <> first").select("ord", "first"), "repeated").df
    return rows.join(again.select("ord"), "ord", "left_anti"), again


def decide(blocked: DataFrame, near: DataFrame, large: int = LARGE) -> DataFrame:
    """ord, root in the end of the records of all blocks (block, ord, root, title_year, dois, authors). near: left, right (ord).

    A block of more than `large` records is split, with the same result: see split_blocks.
    """
    sizes = blocked.groupBy("block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select("block")
    again = None
    if not sizes.isEmpty():
        big, again = _folded(blocked.join(sizes, "block", "left_semi"), near)
        big = Staged(big, "large-blocks").df
        links = near.join(big.select(F.col("ord").alias("left")), "left", "left_semi")
        parts = split_blocks(big, links).withColumnRenamed("part", "block")
        blocked = blocked.join(sizes, "block", "left_anti").unionByName(big.drop("block").join(parts, "root").select(*blocked.columns))
        blocked = Staged(blocked, "parts").df
    pairs = near.join(blocked.select(F.col("ord").alias("left"), F.col("block").alias("pair_block")), "left").select("pair_block", "left", "right")

    def run(key, records: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        found = decide_block(records, set(zip(links["left"], links["right"])))
        return pd.DataFrame({"ord": list(found), "root": list(found.values())})

    decided = shipped(blocked).groupBy("block").cogroup(pairs.groupBy("pair_block")).applyInPandas(run, "ord long, root long")
    if again is None:
        return decided
    decided = Staged(decided, "decided").df
    return decided.unionByName(again.join(decided.withColumnRenamed("ord", "first"), "first").select("ord", "root"))


def resolve(papers: DataFrame) -> DataFrame:
    """ord, root for every record: root is the first record of its work."""
    # What decides, without abstracts.
    told = title_identity(papers).select("ord", "title_key", "publication_year", "has_identity", "doi", "doi_aliases", "authors")
    base = Staged(told.join(clusters_by_id(papers), "ord"), "clusters").df
    near = Staged(near_title_pairs(papers), "near").df
    identity = F.when(F.col("has_identity"), F.concat_ws("|", "title_key", "publication_year"))
    dois = F.array_distinct(F.filter(F.transform(F.concat(F.array("doi"), F.coalesce("doi_aliases", F.array().cast("array<string>"))), t.doi_key), lambda x: x != ""))
    rows = base.select("ord", "root", identity.alias("title_year"), dois.alias("dois"), F.coalesce("authors", F.array().cast("array<string>")).alias("authors"))
    same = rows.where("title_year is not null").groupBy("title_year").agg(F.min("root").alias("v"))
    by_title = rows.join(same, "title_year").select(F.col("root").alias("u"), "v")
    place = rows.select("ord", "root")
    by_near = near.join(place.withColumnRenamed("ord", "left").withColumnRenamed("root", "u"), "left")
    by_near = by_near.join(place.withColumnRenamed("ord", "right").withColumnRenamed("root", "v"), "right").select("u", "v")
    blocks = Staged(components(by_title.unionByName(by_near)).select(F.col("u").alias("root"), F.col("root").alias("block")), "blocks").df
    alone = rows.join(blocks, "root", "left_anti").select("ord", "root")
    return alone.unionByName(decide(rows.join(blocks, "root").select("block", *rows.columns), near))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _merged_authors(lists: pd.Series) -> pd.Series:
    def rank(name: str) -> tuple[int, int, int]:
        return len(t.author_tokens(name)), sum(ord(ch) > 127 for ch in name), len(name)

    def merge(ordered) -> list[str]:
        out: list[str] = [*ordered[0]] if len(ordered) else []
        for names in ordered[1:]:
            for name in names:
                toks = t.author_tokens(name)
                at = next((i for i, x in enumerate(out) if x.casefold() == name.casefold() or (toks and t.names_match(t.author_tokens(x), toks))), None)
                if at is None:
                    out.append(name)
                elif rank(name) > rank(out[at]):
                    out[at] = name
        return out

    return lists.map(merge)


def richness() -> list[Column]:
    """Ten keys, best first: kind of work, abstract, DOI, locations, authors, date, source, URL, title."""
    kind = t.title_key(F.coalesce("work_type", F.lit("")))
    present = lambda c: F.coalesce(F.length(F.col(c).cast("string")) > 0, F.lit(False)).cast("int").desc()
    size = lambda c: F.size(F.coalesce(F.col(c), F.array())).desc()
    return [
        F.when(kind == "preprint", 0).when(kind.isin("", "other"), 1).otherwise(2).desc(), present("abstract"),
        F.coalesce(F.length("abstract"), F.lit(0)).desc(), present("doi"), size("full_text_locations"), size("authors"),
        present("publication_date"), present("source"), present("url"), F.length("title").desc(), F.asc("ord"),
    ]


def merge_records(papers: DataFrame, roots: DataFrame) -> DataFrame:
    """One row per work: ord (of its first record), id and merged columns, and n_records.

    The richest record leads, the others follow by ord: first non-null of single fields, most citations, longest
    abstract and title (earlier wins ties), unions of lists in order.
    """
    rows = shipped(papers).join(roots, "ord")
    lead = F.row_number().over(Window.partitionBy("root").orderBy(*richness())) == 1
    rows = rows.withColumn("at", F.when(lead, F.lit(-1)).otherwise(F.col("ord")))
    # Records equal in all that merges fold into their first, so copies of a work are never gathered.
    told = [c for c in papers.columns if c not in ("ord", "id", "citation_count")]
    rows = rows.groupBy("root", *told).agg(
        F.min("at").alias("at"), F.min_by("id", "at").alias("id"), F.max("citation_count").alias("citation_count"), F.count(F.lit(1)).alias("n")
    )
    none = F.array().cast("array<string>")
    single = ("openalex_id", "doi", "work_type", "publication_year", "publication_date", "source", "url")
    listed = lambda c: F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col(c), none).alias("x")))).alias(c)
    merged = rows.groupBy("root").agg(
        F.sum("n").alias("n_records"),
        F.min_by("id", "at").alias("lead_id"),
        F.array_sort(F.collect_list(F.struct("at", F.col("title").alias("x")))).alias("titles"),
        F.max_by("abstract", F.when(F.length("abstract") > 0, F.struct(F.length("abstract").alias("n"), (-F.col("at")).alias("o")))).alias("abstract"),
        F.max("citation_count").alias("citation_count"),
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in single],
        listed("authors"), listed("doi_aliases"), listed("openalex_aliases"), listed("referenced_work_ids"),
        F.array_sort(F.collect_list(F.struct("at", F.array(F.col("doi")).alias("x")))).alias("_dois"),
        F.array_sort(F.collect_list(F.struct("at", F.array(F.col("openalex_id")).alias("x")))).alias("_works"),
        F.array_sort(F.collect_list(F.struct("at", F.transform(F.coalesce("full_text_locations", F.array()), lambda v: v["url"]).alias("x")))).alias("_urls"),
    )
    flat = lambda c: F.flatten(F.transform(c, lambda v: v["x"]))
    # A record's own identifier stands before its aliases.
    both = lambda own, more: F.flatten(F.zip_with(own, more, lambda a, b: F.concat(a["x"], b["x"])))
    keyed = lambda values, url: F.array_distinct(F.filter(F.transform(values, url), lambda v: v.isNotNull()))
    title = F.aggregate(
        "titles", F.col("titles").getItem(0)["x"],
        lambda best, v: F.when((t.casefold(best) == "untitled") | (F.length(v["x"]) > F.length(best)), v["x"]).otherwise(best),
    )
    out = merged.select(
        F.col("root").alias("ord"), "n_records", title.alias("title"), "abstract", "citation_count", *single,
        _merged_authors(F.transform("authors", lambda v: v["x"])).alias("authors"),
        keyed(both(F.col("_dois"), F.col("doi_aliases")), t.canonical_doi_url).alias("doi_aliases"),
        keyed(both(F.col("_works"), F.col("openalex_aliases")), t.canonical_work_url).alias("openalex_aliases"),
        keyed(flat("referenced_work_ids"), t.canonical_work_url).alias("referenced_work_ids"),
        _distinct_urls(flat("_urls")).alias("location_urls"), "lead_id",
    )
    first = lambda c: F.when(F.length(c) > 0, F.col(c))
    return out.withColumn("id", F.coalesce(first("openalex_id"), first("doi"), "lead_id")).drop("lead_id")


def _distinct_urls(urls: Column) -> Column:
    key = lambda u: F.rtrim(t.casefold(u), F.lit("/"))
    numbered = F.transform(urls, lambda u, i: F.struct(key(u).alias("k"), u.alias("u"), i.alias("i")))
    first = F.filter(numbered, lambda x: F.array_position(F.transform(numbered, lambda y: y["k"]), x["k"]) == x["i"] + 1)
    return F.transform(first, lambda x: x["u"])


def deduplicate(papers: DataFrame) -> DataFrame:
    """Canonical works of papers, one row each. An empty table gives none."""
    return merge_records(papers, resolve(papers))


def same_work(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_ord, right_ord of records of two tables that are one work: by identifier, by title and year, or by near title.

    With equal title and year, DOIs on both sides need matching authors. Pairs meet on keys only.
    """
    lk, rk = _keys(left).withColumnRenamed("ord", "left_ord"), _keys(right).withColumnRenamed("ord", "right_ord")
    by_id = lk.join(rk, "key").select("left_ord", "right_ord")
    part = lambda df, side: title_identity(df).where("has_identity").select(
        F.col("ord").alias(f"{side}_ord"), "title_key", "publication_year", F.col("authors").alias(f"{side}_authors"),
        (F.size(F.filter(F.concat(F.array("doi"), F.coalesce("doi_aliases", F.array().cast("array<string>"))), lambda x: t.doi_key(x) != "")) > 0).alias(f"{side}_doi"),
    )
    met = part(left, "left").join(part(right, "right"), ["title_key", "publication_year"])
    by_title = met.where(~(F.col("left_doi") & F.col("right_doi"))).unionByName(met.where(F.col("left_doi") & F.col("right_doi")).where(t.same_authors("left_authors", "right_authors")))
    shift = left.agg(F.coalesce(F.max("ord"), F.lit(-1)) + 1).first()[0]
    stacked = left.select("ord", "title", "publication_year", "authors").unionByName(right.select((F.col("ord") + shift).alias("ord"), "title", "publication_year", "authors"))
    near = near_title_pairs(stacked).where((F.col("left") < shift) & (F.col("right") >= shift))
    near = near.select(F.col("left").alias("left_ord"), (F.col("right") - shift).alias("right_ord"))
    return by_id.unionByName(by_title.select("left_ord", "right_ord")).unionByName(near).distinct()


def canonicalise(incoming: DataFrame, references: DataFrame) -> DataFrame:
    """incoming with reference_ord and reference_id: the first reference that is the same work, or null."""
    pairs = same_work(incoming, references)
    first = pairs.groupBy("left_ord").agg(F.min("right_ord").alias("reference_ord"))
    ids = references.select(F.col("ord").alias("reference_ord"), F.col("id").alias("reference_id"))
    found = first.join(ids, "reference_ord")
    return incoming.join(found, incoming["ord"] == found["left_ord"], "left").drop("left_ord")
