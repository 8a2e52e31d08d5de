"""Lexical and hybrid ranking of papers against queries.

Inputs are DataFrames: papers (id, title, abstract, ...) and queries (query_id, text). Scores come for
the pairs that share a token or a phrase; every other pair scores 0 and is implied, so no operator
forms the product of papers and queries.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t
from siltstone.functions import vectors as v
from siltstone.operators import bounds
from siltstone.sources.staging import Staged

K1, B, TITLE_BOOST = 1.2, 0.75, 3
#: Query tokens that may be broadcast.
BROADCAST_TOKENS = 100_000
#: Letters by which a piece is looked up within tokens.
GRAM = 3
#: Query vectors in a block, and blocks broadcast together.
QUERY_BLOCK, BLOCKS = 256, 16


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if a count shows it to have at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token, n (distinct tokens of the query), phrase."""
    toks = queries.select("query_id", t.tokens(F.col("text")).alias("all"))
    distinct = toks.select("query_id", F.array_distinct("all").alias("toks"), F.array_join("all", " ").alias("phrase"))
    return distinct.select("query_id", F.size("toks").alias("n"), "phrase", F.explode("toks").alias("token"))


def tokenised(papers: DataFrame) -> DataFrame:
    """id, tt, ta: tokens of titles and abstracts, written once, as postings and phrases both read them."""
    return Staged(papers.select("id", t.tokens(F.col("title")).alias("tt"), t.tokens(F.col("abstract")).alias("ta")), "tokens").df


def postings(toks: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, token, tf, in_title, in_abstract, len) of vocabulary tokens, and (n, avg_len) of all papers. toks: see tokenised."""
    toks = toks.withColumn("len", TITLE_BOOST * F.size("tt") + F.size("ta"))
    stats = toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg"))
    stats = stats.select("n_docs", F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0).alias("avg_len"))
    title = F.transform("tt", lambda w: F.struct(w.alias("token"), F.lit(TITLE_BOOST).alias("w"), F.lit(1).alias("t")))
    body = F.transform("ta", lambda w: F.struct(w.alias("token"), F.lit(1).alias("w"), F.lit(0).alias("t")))
    rows = toks.select("id", "len", F.inline(F.concat(title, body)))
    kept = rows.join(_small(vocabulary.select("token").distinct(), BROADCAST_TOKENS), "token", "left_semi")
    found = kept.groupBy("id", "len", "token").agg(
        F.sum("w").alias("tf"), F.max("t").alias("in_title"), F.max(1 - F.col("t")).alias("in_abstract")
    )
    return found, stats


def _token_hits(vocabulary: DataFrame, pieces: DataFrame) -> DataFrame:
    """query_id, role, token: tokens (distinct) that hold a piece (query_id, role, piece) where its role says: within, at the end, or at the beginning.

    Tokens meet pieces by equality alone: all their endings and beginnings, and for pieces within a token its first GRAM letters.
    """
    n = F.length("token")
    parts = lambda cut: vocabulary.select("token", F.explode(F.sequence(F.lit(1), n)).alias("i")).select("token", cut.alias("piece"))
    ends = parts(F.expr("right(token, i)")).join(pieces.where("role = 'end'"), "piece")
    begins = parts(F.expr("left(token, i)")).join(pieces.where("role = 'begin'"), "piece")
    gram = pieces.where("role = 'within'").withColumn("gram", F.left("piece", F.lit(GRAM)))
    grams = vocabulary.select("token", F.explode(F.expr(f"array_distinct(flatten(transform(sequence(1, length(token)), i -> transform(sequence(1, {GRAM}), q -> substring(token, i, q)))))")).alias("gram"))
    within = grams.join(gram, "gram").where(F.col("token").contains(F.col("piece")))
    return reduce(DataFrame.unionByName, [x.select("query_id", "role", "token") for x in (ends, begins, within)]).distinct()


def phrase_hits(toks: DataFrame, queries: DataFrame, matched: DataFrame) -> DataFrame:
    """query_id, id, bonus of phrases that stand in a title (2.0) or else in an abstract (0.75).

    A phrase is sought as a substring of the tokens, joined by spaces. From three tokens on its inner tokens are whole tokens of the field,
    so only papers that match nearly all tokens can hold it. Of two tokens the first ends a token of the field and the second begins one; a single
    one lies within a token: tokens are found in the vocabulary, by equality, and only papers that hold them are looked at.
    """
    q = queries.select("query_id", t.tokens(F.col("text")).alias("toks")).select(
        "query_id", F.size("toks").alias("k"), F.array_join("toks", " ").alias("phrase"), "toks"
    ).where(F.col("phrase") != "")
    body = toks.select("id", F.array_join("tt", " ").alias("tp"), F.array_join("ta", " ").alias("ap"))
    bonus = F.when(F.col("tp").contains(F.col("phrase")), 2.0).when(F.col("ap").contains(F.col("phrase")), 0.75)
    long = matched.join(q.where("k > 2"), "query_id").where(F.col("n_hit") >= F.col("n") - 2).select("query_id", "id", "phrase")
    short = q.where("k <= 2")
    candidates = long
    if not short.isEmpty():
        role = lambda name, i: F.struct(F.lit(name).alias("role"), F.col("toks")[i].alias("piece"))
        pieces = short.where("k = 1").select("query_id", F.inline(F.array(role("within", 0))))
        pieces = pieces.unionByName(short.where("k = 2").select("query_id", F.inline(F.array(role("end", 0), role("begin", 1)))))
        of = toks.select("id", F.explode(F.array_distinct(F.concat("tt", "ta"))).alias("token"))
        hits = Staged(_token_hits(of.select("token").distinct(), pieces), "token-hits").df
        held = of.join(_small(hits, BROADCAST_TOKENS), "token").groupBy("query_id", "id").agg(F.countDistinct("role").alias("roles"))
        found = held.join(short, "query_id").where("roles = k").select("query_id", "id", "phrase")
        candidates = candidates.unionByName(found)
    return candidates.join(body, "id").select("query_id", "id", bonus.alias("bonus")).where(F.col("bonus").isNotNull())


def bm25(papers: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, lexical_raw_score: BM25 over boosted titles and abstracts, coverage and phrase bonus.

    The papers given are the corpus: document frequencies and the mean length are theirs. Pairs without a
    match are left out; they score 0. Null titles and abstracts are empty; a query without tokens has no rows.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b between 0 and 1")
    q, toks = query_tokens(queries), tokenised(papers)
    found, stats = postings(toks, q)
    found = Staged(found, "postings").df
    df = found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = k1 * (1 - b + b * F.col("len") / F.col("avg_len"))
    rows = found.join(q, "token").join(df, "token").join(F.broadcast(stats))
    scored = rows.groupBy("query_id", "id").agg(
        F.sum(idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("bm25"),
        F.sum("in_title").alias("n_title"),
        F.sum("in_abstract").alias("n_abstract"),
        F.count(F.lit(1)).alias("n_hit"),
        F.max("n").alias("n"),
    )
    bonus = phrase_hits(toks, queries, scored)
    every = scored.join(bonus, ["query_id", "id"], "full")
    cover = 1.5 * F.col("n_title") / F.col("n") + 0.5 * F.col("n_abstract") / F.col("n")
    total = F.coalesce("bm25", F.lit(0.0)) + F.coalesce(cover, F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))
    return Staged(every.select("query_id", "id", total.alias("lexical_raw_score")), "lexical").df


def _spread(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with _n (rows of the query) and lowest and highest value of each column for the query, as _lo_c and _hi_c.

    The figures are combined before they are shuffled and join back as one row a query, so a query with very many rows stays spread.
    """
    found = [x for c in columns for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"))]
    by = rows.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n"), *found)
    return rows.join(by, F.col("query_id").eqNullSafe(F.col("_q"))).drop("_q")


def scale(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows (query_id, ...) with the column scaled to 0 to 1 for each query."""
    made = v.scaled(F.col(column), F.col(f"_lo_{column}"), F.col(f"_hi_{column}"))
    return _spread(rows, column).withColumn(out, made).drop("_n", f"_lo_{column}", f"_hi_{column}")


def scale_sparse(scores: DataFrame, n: DataFrame, raw: str, out: str) -> DataFrame:
    """Min-max per query where `n` (one row, n_docs) papers were scored and pairs left out score 0."""
    marked = _spread(scores, raw).join(F.broadcast(n))
    low = F.when(F.col("_n") < F.col("n_docs"), F.least(F.lit(0.0), F.col(f"_lo_{raw}"))).otherwise(F.col(f"_lo_{raw}"))
    return marked.withColumn(out, v.scaled(F.col(raw), low, F.col(f"_hi_{raw}"))).drop(f"_lo_{raw}", f"_hi_{raw}", "_n", "n_docs")


def top_k(scores: DataFrame, order: list[Column], k: int, by: str = "query_id", rank: str = "rank") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scores.withColumn(rank, place).where(F.col(rank) <= k)


def semantic(vectors: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK, many: int = BLOCKS) -> DataFrame:
    """query_id, id, semantic_raw_score: cosine of each vector (id, vector) with each query's (query_id, vector).

    The queries are a stated set, however large: they go in blocks of about `block`, one row a block, that every vector meets by the block's number;
    at most `many` blocks are broadcast together.
    """
    norm = lambda c: F.sqrt(v.dot(F.col(c), F.col(c)))
    q = Staged(queries.select("query_id", F.col("vector").alias("_q"), norm("vector").alias("_qn")), "queries").df
    blocks = max(1, -(-q.count() // block))
    q = q.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    rows = vectors.select("id", "vector", norm("vector").alias("_n"))
    found = []
    for start in range(0, blocks, many):
        some = q.where((F.col("_b") >= start) & (F.col("_b") < start + many)).groupBy("_b").agg(F.collect_list(F.struct("query_id", "_q", "_qn")).alias("_qs"))
        numbered = rows.withColumn("_b", F.explode(F.sequence(F.lit(start), F.lit(min(blocks, start + many) - 1))))
        found.append(numbered.join(F.broadcast(some), "_b").select("id", "vector", "_n", F.inline("_qs")))
    pairs = reduce(DataFrame.unionByName, found)
    value = F.when(F.col("_n") * F.col("_qn") > 0, v.dot(F.col("vector"), F.col("_q")) / (F.col("_n") * F.col("_qn"))).otherwise(F.lit(0.0))
    checked = F.when(F.size("vector") == F.size("_q"), value).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    return pairs.select("query_id", "id", checked.alias("semantic_raw_score"))


def cosines(vectors: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, id, semantic_raw_score of the pairs (query_id, id) alone. Pairs without a vector on either side are left out."""
    norm = lambda c: F.sqrt(v.dot(F.col(c), F.col(c)))
    q = queries.select("query_id", F.col("vector").alias("_q"), norm("vector").alias("_qn"))
    met = pairs.select("query_id", "id").join(vectors.select("id", "vector", norm("vector").alias("_n")), "id").join(_small(q, BROADCAST_TOKENS // 10), "query_id")
    value = F.when(F.col("_n") * F.col("_qn") > 0, v.dot(F.col("vector"), F.col("_q")) / (F.col("_n") * F.col("_qn"))).otherwise(F.lit(0.0))
    return met.select("query_id", "id", value.alias("semantic_raw_score"))


def hybrid_topk(vectors: DataFrame, queries: DataFrame, lexical, k: int, lexical_weight: float = 0.4, semantic_weight: float = 0.6) -> DataFrame:
    """query_id, rank, id, final_score: the first k of fuse() over all vectors, without a row for each query and vector.

    lexical: scores of `lexical.scores`, or query_id, id, lexical_raw_score of the pairs that match; all others score 0. The lowest and the highest cosine of a query come by bounds. Pairs
    without a match share one lexical score, so of these the k with the largest cosine are enough; scores are compared to six digits, then by id.
    """
    from siltstone.operators import lexical as ways  # noqa: PLC0415 - it reads this module

    lexical = ways.Listed(lexical) if isinstance(lexical, DataFrame) else lexical
    made = bounds.gather(vectors)
    n = int(made.count.sum())
    near, far = bounds.both_ends(made, queries, 2 * k)
    # Extremes are of scores as they are, not as rounded.
    ends = _ends(vectors, queries, near, far)
    words = lexical.within(vectors.select("id"))
    best, by = words.best(2 * k)
    fewer = F.coalesce("_n", F.lit(0)) < n
    low = F.when(fewer, F.least(F.lit(0.0), F.coalesce(F.col("_lo"), F.lit(0.0)))).otherwise(F.col("_lo"))
    high = F.when(fewer, F.greatest(F.lit(0.0), F.coalesce(F.col("_hi"), F.lit(0.0)))).otherwise(F.col("_hi"))
    ends = Staged(ends.join(by, "query_id", "left").select("query_id", "lowest", "highest", low.alias("_lo"), high.alias("_hi")), "spreads").df
    ends = _small(ends, BROADCAST_TOKENS)
    lex = v.scaled(F.col("lexical_raw_score"), F.col("_lo"), F.col("_hi"))

    def scored(pairs: DataFrame) -> DataFrame:
        rows = cosines(vectors, queries, pairs).join(pairs, ["query_id", "id"]).join(ends, "query_id")
        score = v.fused(lex, v.scaled(F.col("semantic_raw_score"), F.col("lowest"), F.col("highest")), lexical_weight, semantic_weight)
        return rows.select("query_id", "id", score.alias("final_score"))

    order = [F.desc(F.round("final_score", 6)), F.asc("id")]
    # First the nearest, and the best by words; what these reach is a floor. A pair whose words and a perfect cosine do not reach it is never scored.
    best = Staged(best.join(ends.select("query_id"), "query_id", "left_semi"), "best-words").df
    pairs = Staged(near.select("query_id", "id").unionByName(best.select("query_id", "id")).distinct(), "first-ids").df
    pairs = pairs.join(words.of(pairs), ["query_id", "id"], "left").select("query_id", "id", F.coalesce("lexical_raw_score", F.lit(0.0)).alias("lexical_raw_score"))
    first = Staged(top_k(scored(Staged(pairs, "first-pairs").df), order, k).drop("rank"), "first").df
    floor = first.groupBy("query_id").agg(F.min("final_score").alias("_f"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == k).select("query_id", "_f")
    # The raw score whose scaled one reaches the floor together with a perfect cosine; scores that are all the same are scaled alike, so all of them may.
    whole = lexical_weight + semantic_weight
    least = ((F.col("_f") - 1e-6) * whole - semantic_weight) / (lexical_weight or 1.0)
    spread = F.col("_hi") - F.col("_lo") > 1e-6 * F.greatest(F.abs("_hi"), F.abs("_lo"))
    raw = F.when(spread & F.lit(lexical_weight > 0), F.col("_lo") + least * (F.col("_hi") - F.col("_lo")) - 1e-9)
    floors = Staged(ends.join(floor, "query_id", "left").select("query_id", raw.alias("floor")), "floors").df
    rest = words.reaching(floors).join(first.select("query_id", "id"), ["query_id", "id"], "left_anti").select("query_id", "id", "lexical_raw_score")
    return top_k(first.unionByName(scored(Staged(rest, "rest-pairs").df)), order, k)


def _ends(vectors: DataFrame, queries: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """query_id, lowest, highest cosine over all vectors, in full precision: of the nearest and farthest vectors that bounds.both_ends found."""
    pairs = near.where("rank = 1").select("query_id", "id").unionByName(far.select("query_id", "id")).distinct()
    found = cosines(vectors, queries, pairs)
    return Staged(found.groupBy("query_id").agg(F.min("semantic_raw_score").alias("lowest"), F.max("semantic_raw_score").alias("highest")), "ends").df


def _scaled(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, ends: DataFrame) -> DataFrame:
    found = cosines(vectors, queries, pairs).join(_small(ends, BROADCAST_TOKENS), "query_id")
    return found.select("query_id", "id", v.scaled(F.col("semantic_raw_score"), F.col("lowest"), F.col("highest")).alias("score"))


def scaled_cosines(made: bounds.Blocks, vectors: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, id, score of the pairs: the cosine, scaled to 0 to 1 over all vectors. made: the blocks of vectors."""
    return _scaled(vectors, queries, pairs, _ends(vectors, queries, *bounds.both_ends(made, queries, 1)))


def boostable(made: bounds.Blocks, vectors: DataFrame, queries: DataFrame, k: int, weight: float = 0.15) -> DataFrame:
    """query_id, id, final_score (the scaled cosine) of the vectors that can be among the first k once constraints of this weight raise them."""
    near, far = bounds.both_ends(made, queries, k)
    ends = _ends(vectors, queries, near, far)
    kth = near.groupBy("query_id").agg(F.min("score").alias("_k"))
    # What a constraint cannot lift to the k-th own score stays behind; the margin covers rounding to five digits.
    floor = F.col("lowest") + (F.col("_k") - F.col("lowest")) / (1 + weight) - 1e-4
    asked = queries.join(ends, "query_id").join(kth, "query_id").select("query_id", "vector", floor.alias("floor"))
    found = bounds.within(made, asked)
    return _scaled(vectors, queries, found.select("query_id", "id"), ends).withColumnRenamed("score", "final_score")


def fuse(rows: DataFrame, lexical_weight: float = 0.4, semantic_weight: float = 0.6) -> DataFrame:
    """rows (query_id, id, lexical_raw_score, semantic_raw_score or null) with scaled scores, final_score, ranking_mode.

    Every candidate has a row. A query none of whose rows has a semantic score is ranked by words alone.
    """
    lex, sem = "lexical_raw_score", "semantic_raw_score"
    marked = _spread(rows, lex, sem)
    return marked.withColumns(
        {
            "lexical_score": v.scaled(F.col(lex), F.col(f"_lo_{lex}"), F.col(f"_hi_{lex}")),
            "semantic_score": F.when(F.col(sem).isNotNull(), v.scaled(F.col(sem), F.col(f"_lo_{sem}"), F.col(f"_hi_{sem}"))),
            "ranking_mode": F.when(F.col(f"_hi_{sem}").isNotNull(), "hybrid").otherwise("lexical_only"),
        }
    ).withColumn("final_score", v.fused(F.col("lexical_score"), F.col("semantic_score"), lexical_weight, semantic_weight)).drop("_n", *(f"_{x}_{c}" for x in ("lo", "hi") for c in (lex, sem)))


def boost(ranked: DataFrame, constraints: DataFrame, weight: float = 0.15) -> DataFrame:
    """ranked with constraint_score and final_score raised by it.

    constraints: query_id, constraint_id, id, score (fused and scaled over the same candidates). Queries
    without constraints keep their scores and a null constraint_score.
    """
    if not 0 <= weight <= 1:
        raise ValueError("the constraint weight must lie between 0 and 1")
    mean = constraints.groupBy("query_id", "id").agg(F.avg("score").alias("constraint_score"))
    raised = F.least(F.lit(1.0), F.col("final_score") * (1 + weight * F.coalesce("constraint_score", F.lit(0.0))))
    return ranked.join(mean, ["query_id", "id"], "left").withColumn("final_score", raised)


def final_order() -> list[Column]:
    """The final order; ties go on to title, year and identifier."""
    return [
        F.coalesce("final_score", F.lit(0.0)).desc(),
        F.coalesce("constraint_score", F.lit(-1.0)).desc(),
        F.coalesce("semantic_score", F.lit(-1.0)).desc(),
        F.coalesce("lexical_score", F.lit(0.0)).desc(),
        t.title_key(F.col("title")),
        F.coalesce("publication_year", F.lit(0)),
        t.casefold(F.col("id").cast("string")),
    ]
