"""Text and entity normalisation as Column expressions; four Arrow UDFs where Spark has no built-in.

`casefold` is lower-casing plus the one folding that differs in practice (ß to ss); `nfkc_casefold` is the
exact Unicode form, as a UDF.
"""

from __future__ import annotations

import difflib
import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
STOPWORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "using", "with")
NON_PERSON_TERMS = (
    "association", "collaboration", "committee", "conference", "consortium",
    "group", "institute", "society", "team", "university",
)
SENTINELS = ("", "other", "unknown", "unspecified", "none", "not specified", "not reported")
HEADING_RULES = (
    ("abstract", r"\babstract\b"),
    ("introduction", r"\b(?:introduction|background)\b"),
    ("related_work", r"\b(?:related work|literature review|prior work)\b"),
    ("methods", r"\b(?:methods?|methodology|approach|models?|training details?)\b"),
    ("materials", r"\bmaterials?\b"),
    ("dataset", r"\b(?:data(?:set)?s?|corpus|cohort)\b"),
    ("experimental_setup", r"\b(?:experiments?|experimental setup|evaluation setup|evaluation metrics?|metrics?|implementation details)\b"),
    ("results", r"\bresults?\b"),
    ("discussion", r"\b(?:discussion|error analysis)\b"),
    ("limitations", r"\b(?:limitations?|weaknesses?)\b"),
    ("conclusion", r"\b(?:conclusions?|concluding remarks|summary)\b"),
    ("future_work", r"\b(?:future work|future directions?|outlook)\b"),
    ("appendix", r"\b(?:appendix|appendices)\b"),
)

SECRET_RULE = (
    r"(?i)(sk-[a-z0-9_-]+|bearer\s+\S+|"
    r"(?:api[-_ ]?key|authorization|password|access[-_ ]?token|refresh[-_ ]?token|"
    r"service[-_ ]?role[-_ ]?key|webhook[-_ ]?secret)\s*[:=]\s*\S+)"
)

SPACE = r"[\s\x0b\x1c-\x1f\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.transform(F.array(value), lambda v: body(v)).getItem(0)  # one argument: transform would pass an index, too


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tokens(c: Column) -> Column:
    """Search tokens of a text without stopwords; all of them if nothing else is left. Null has none."""
    text = F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"[-./]", " ")
    # A token begins with a letter or digit and may hold + and #: split at the rest, strip what leads.
    parts = F.transform(F.split(text, r"[^\p{L}\p{N}+#]+"), lambda w: F.ltrim(w, F.lit("+#")))
    every = F.filter(parts, lambda w: w != "")

    def useful(words: Column) -> Column:
        kept = F.filter(words, lambda w: ~w.isin(*STOPWORDS))
        return F.when(F.size(kept) > 0, kept).otherwise(words)

    return let(every, useful)


def phrase(c: Column) -> Column:
    return F.array_join(tokens(c), " ")


def evidence_key(c: Column) -> Column:
    """Key of a claim's wording: folded, dashes and punctuation as spaces."""
    text = F.regexp_replace(casefold(c), r"[-_]", " ")
    return collapse(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "))


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(c), r"[^\p{L}\p{N}_]+", " "))


def doi_key(c: Column) -> Column:
    text = F.rtrim(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("/"))
    return F.regexp_replace(text, r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def work_key(c: Column) -> Column:
    """Key of an OpenAlex identifier."""
    text = F.lower(F.rtrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("/")))
    return F.regexp_replace(text, r"^(?:https?://openalex\.org/|openalex:\s*)", "")


def valid_work_key(c: Column) -> Column:
    key = work_key(c)
    return F.when(key.rlike(r"^w[1-9][0-9]*$"), key)


def usable(values: Column) -> Column:
    """Distinct values in first-seen order without sentinels and nulls."""
    return F.filter(F.array_distinct(values), lambda v: v.isNotNull() & ~F.trim(casefold(v)).isin(*SENTINELS))


def ascii_terms(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(casefold(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != ""))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set of terms; 0 if either is empty."""
    left, right = ascii_terms(a), ascii_terms(b)
    smaller = F.least(F.size(left), F.size(right))
    return F.when(smaller > 0, F.size(F.array_intersect(left, right)) / smaller).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def gap_key(c: Column) -> Column:
    """16 hexadecimal digits of the SHA-1 of the text's ASCII terms in order."""
    terms = F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != "")
    return F.substring(F.sha1(F.array_join(terms, " ").cast("binary")), 1, 16)


def heading_roles(c: Column) -> Column:
    """Every section role whose rule the heading meets; `other` if none."""
    text = F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    found = F.filter(F.array(*[F.when(text.rlike(rule), F.lit(role)) for role, rule in HEADING_RULES]), lambda r: r.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def redact(c: Column, limit: int = 1000) -> Column:
    """Credentials, then URLs, then e-mail addresses replaced; at most `limit` characters."""
    text = F.regexp_replace(c, SECRET_RULE, "[redacted]")
    text = F.regexp_replace(text, r"https?://\S+", "[url]")
    return F.substring(F.regexp_replace(text, r"\b[^\s@]+@[^\s@]+\b", "[email]"), 1, limit)


def canonical_doi_url(c: Column) -> Column:
    key = doi_key(c)
    return F.when(key != "", F.concat(F.lit("https://doi.org/"), key))


def canonical_work_url(c: Column) -> Column:
    key = work_key(c)
    return F.when(key != "", F.concat(F.lit("https://openalex.org/"), F.upper(key)))


def author_tokens(name: str | None) -> list[str]:
    """Letter tokens of a personal name without accents; none for bodies, single names and names with digits."""
    import re

    plain = "".join(ch for ch in unicodedata.normalize("NFKD", name or "") if not unicodedata.combining(ch))
    found = re.findall(r"[^\W\d_]+", plain.casefold())
    if len(found) < 2 or set(found) & set(NON_PERSON_TERMS) or any(ch.isdigit() for ch in name or ""):
        return []
    return sorted(set(found))


def names_match(a: list[str], b: list[str]) -> bool:
    """Two thirds of the larger name shared, or one token shared and an initial among the rest of short names."""
    left, right = set(a), set(b)
    common = left & right
    if len(common) > 1:
        return 3 * len(common) >= 2 * max(len(left), len(right))
    if len(common) == 0 or max(len(left), len(right)) > 3:
        return False
    return not {t[0] for t in left - common}.isdisjoint({t[0] for t in right - common})


def authors_match(left: list[str], right: list[str]) -> bool:
    """Enough personal names pair up, each used once in order of the left list: two, or one of single authors."""
    a, b = ([t for t in map(author_tokens, x or []) if t] for x in (left, right))
    free, paired = list(range(len(b))), 0
    for name in a:
        hit = next((i for i in free if names_match(name, b[i])), None)
        if hit is not None:
            free.remove(hit)
            paired += 1
    return paired > 1 or (paired == 1 and len(a) == 1 and len(b) == 1)


@F.pandas_udf(T.StringType())
def nfkc_casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two strings, with its treatment of popular characters."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.BooleanType())
def same_authors(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([authors_match(list(x) if x is not None else [], list(y) if y is not None else []) for x, y in zip(a, b)], dtype="bool")


def pseudonym(c: Column, key: bytes) -> Column:
    """HMAC-SHA256 of the value under a key."""

    @F.pandas_udf(T.StringType())
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest())

    return keyed(c)
