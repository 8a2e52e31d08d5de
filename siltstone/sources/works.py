"""Provider records to papers: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as t

LOCATION = "struct<is_oa: boolean, landing_page_url: string, pdf_url: string, source: struct<display_name: string>>"
WORK = (
    "id string, display_name string, publication_year string, publication_date string, doi string, type string,"
    " abstract_inverted_index map<string, array<int>>, authorships array<struct<author: struct<display_name: string>>>,"
    f" cited_by_count string, referenced_works array<string>, relevance_score string, primary_location {LOCATION}, best_oa_location {LOCATION},"
    f" locations array<{LOCATION}>"
)


def abstract_text(index: Column) -> Column:
    """An inverted index as text: words in order of position, then word; null if it is empty."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    words = F.transform(F.array_sort(F.filter(placed, lambda x: x["p"].isNotNull() & (x["p"] >= 0))), lambda x: x["w"])
    return F.nullif(F.array_join(words, " "), F.lit(""))


def inverted_index(text: Column) -> Column:
    """The index of a text's words: word to positions."""
    words = F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    keys = F.array_distinct(F.transform(words, lambda x: x["w"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(F.filter(words, lambda x: x["w"] == k), lambda x: x["i"])))


def _format(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(path.endswith(".pdf"), "pdf").when(path.endswith(".xml"), "xml").when(path.rlike(r"\.html?$"), "html").otherwise("unknown")


def locations(best: Column, primary: Column, others: Column) -> Column:
    """Open-access URLs as (url, source_format, is_open_access): all PDFs first, then landing pages; best, primary, others; each URL once."""
    every = F.filter(F.concat(F.array(best, primary), F.coalesce(others, F.array().cast(f"array<{LOCATION}>"))), lambda x: x.isNotNull() & F.coalesce(x["is_oa"], F.lit(False)))
    pdf = F.transform(every, lambda x: F.struct(x["pdf_url"].alias("u"), F.lit("pdf").alias("f")))
    page = F.transform(every, lambda x: F.struct(x["landing_page_url"].alias("u"), _format(x["landing_page_url"]).alias("f")))
    good = F.filter(F.concat(pdf, page), lambda x: x["u"].rlike(r"^https?://"))
    keyed = F.transform(good, lambda x, i: F.struct(F.rtrim(t.casefold(x["u"]), F.lit("/")).alias("k"), i.alias("i"), x["u"].alias("u"), x["f"].alias("f")))
    first = F.filter(keyed, lambda x: F.array_position(F.transform(keyed, lambda y: y["k"]), x["k"]) == x["i"] + 1)
    return F.transform(first, lambda x: F.struct(x["u"].alias("url"), x["f"].alias("source_format"), F.lit(True).alias("is_open_access")))


def synthetic_id(title: Column, year: Column) -> Column:
    key = F.concat_ws("|", t.casefold(F.coalesce(title, F.lit(""))), F.coalesce(year.cast("string"), F.lit("")))
    return F.concat(F.lit("openalex:synthetic:"), F.substring(F.sha2(key, 256), 1, 20))


def _text(c: Column) -> Column:
    return F.nullif(t.collapse(c), F.lit(""))


def parse_works(raw: DataFrame, column: str = "json") -> DataFrame:
    """raw: ord and a JSON object per row. Papers; rows that are no object are dropped, odd values of a field are null.

    Years outside 1000 to 3000 and negative counts are null and 0, unknown titles `Untitled`.
    """
    w = raw.select("ord", F.from_json(column, WORK).alias("w"), F.trim(F.col(column)).startswith("{").alias("ok")).where("ok").select("ord", "w.*")
    year = F.expr("try_cast(publication_year as int)")
    title = F.coalesce(_text(F.col("display_name")), F.lit("Untitled"))
    wid, doi = t.canonical_work_url(F.col("id")), _text(F.col("doi"))
    good_year = F.when((year >= 1000) & (year <= 3000), year)
    refs = F.filter(F.transform(F.coalesce("referenced_works", F.array().cast("array<string>")), t.valid_work_key), lambda k: k.isNotNull())
    names = F.transform("authorships", lambda a: _text(a["author"]["display_name"]))
    return w.select(
        "ord", F.coalesce(wid, doi, synthetic_id(title, good_year)).alias("id"), title.alias("title"), abstract_text(F.col("abstract_inverted_index")).alias("abstract"),
        F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>")).alias("authors"), good_year.alias("publication_year"),
        F.expr("try_to_date(publication_date)").alias("publication_date"), doi.alias("doi"), F.array().cast("array<string>").alias("doi_aliases"), wid.alias("openalex_id"),
        F.array().cast("array<string>").alias("openalex_aliases"), F.transform(F.array_distinct(refs), lambda k: F.concat(F.lit("https://openalex.org/"), F.upper(k))).alias("referenced_work_ids"),
        _text(F.col("type")).alias("work_type"), F.greatest(F.lit(0), F.coalesce(F.expr("try_cast(cited_by_count as int)"), F.lit(0))).alias("citation_count"),
        _text(F.col("primary_location.source.display_name")).alias("source"), F.col("primary_location.landing_page_url").alias("url"),
        locations(F.col("best_oa_location"), F.col("primary_location"), F.col("locations")).alias("full_text_locations"), F.expr("try_cast(relevance_score as double)").alias("provider_score"),
    )


def provider_query(text: Column) -> tuple[Column, Column]:
    """The text a provider gets (letters, digits, spaces and hyphens), and whether that changed it."""
    plain = t.collapse(F.regexp_replace(text, r"[^\p{L}\p{N}\s-]", " "))
    return plain, plain != t.collapse(text)
