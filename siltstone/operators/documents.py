"""Documents to sections: HTML, JATS XML and text layers; bounds, chunks, context selection and packing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t
from siltstone.session import bounded, shipped

MAX_DOCUMENT, MAX_SECTION, MAX_CHUNK, MAX_CONTEXT, MAX_SECTIONS = 120_000, 20_000, 8_000, 30_000, 16

# Fixed values.
REFERENCE_HEADING = r"(?:references|bibliography|works cited)"
PLAIN_HEADINGS = (
    r"(?i)^(?:abstract|introduction|background|related work|literature review|methods?|methodology|materials(?: and methods)?|datasets?|data|"
    r"experiments?|experimental setup|evaluation(?: setup| metrics)?|metrics|results?(?: and discussion)?|discussion|error analysis|limitations?|"
    r"future work|future directions?|conclusions?|acknowledg(?:e)?ments?|references|bibliography|works cited)$"
)
NUMBERED_HEADING = r"^((?:[1-9]\d?(?:\.\d{1,2})*)|[A-Z])(?:[.)])?\s+(.{2,100})$"
PREFERRED_ROLES = (
    "abstract", "introduction", "methods", "materials", "dataset", "experimental_setup", "results", "discussion",
    "limitations", "conclusion", "future_work",
)
DROPPED_TAGS = {"script", "style", "nav", "footer", "header", "aside", "form"}
HEADING_TAGS = {"h1", "h2", "h3", "h4"}
TEXT_TAGS = {"p", "li"}
#: Tags without an end.
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Article(HTMLParser):
    """Headings and paragraphs of an article or main element, tags that hold no text of it aside.

    An open paragraph collects the text of whatever stands inside it; a paragraph inside another gives its text to both.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.container: str | None = None
        self.found = {"article": False, "main": False}
        self.blocks: dict[str, list[tuple[str, list[str]]]] = {"article": [], "main": []}
        self.open: list[tuple[int, tuple[str, list[str]]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            return
        self.stack.append(tag)
        if self.container is None and tag in self.found and not self.found[tag] and not self._hidden():
            self.container, self.found[tag] = tag, True
            self.depth = len(self.stack)
        elif self.container and tag in HEADING_TAGS | TEXT_TAGS and not self._hidden():
            block = (tag, [])
            self.blocks[self.container].append(block)
            self.open.append((len(self.stack), block))

    def _hidden(self) -> bool:
        return any(x in DROPPED_TAGS for x in self.stack)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            while self.open and self.open[-1][0] > len(self.stack):
                self.open.pop()
            if self.container and len(self.stack) < self.depth:
                self.container = None
            if top == tag:
                break

    def handle_data(self, data):
        if self._hidden() or not data.strip():
            return
        for _, (_, parts) in self.open:
            parts.append(data.strip())


def html_sections(html: str | None) -> list[tuple[str, str]]:
    """(heading, text) of an article page; none for landing pages: no container, or too little text in it."""
    parser = _Article()
    parser.feed(html or "")
    parser.close()
    name = "article" if parser.found["article"] else "main"
    sections, heading, body = [], "Full text", []

    def flush():
        if body and not re.fullmatch(REFERENCE_HEADING, heading, re.I):
            sections.append((heading, "\n".join(body)))

    for tag, parts in parser.blocks[name]:
        text = " ".join(parts)
        if not text:
            continue
        if tag in HEADING_TAGS:
            flush()
            heading, body = text, []
        else:
            body.append(text)
    flush()
    every = " ".join(x for _, x in sections)
    return sections if len(every) >= 500 and len(re.sub(r"\W", "", every)) >= 250 else []


def xml_sections(xml: str | None) -> list[tuple[str, str]]:
    """(heading, text) of a JATS article: the abstract, each section's own paragraphs, or else the whole body."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return []
    name = lambda node: str(node.tag).rsplit("}", 1)[-1].lower()
    words = lambda node: " ".join(node.itertext())
    nodes = list(root.iter())
    out = [("Abstract", words(n)) for n in [x for x in nodes if name(x) == "abstract"][:1]]
    for node in nodes:
        if name(node) != "sec":
            continue
        children = list(node)
        heading = next((words(x) for x in children if name(x) == "title"), "Section")
        paragraphs = [words(x) for x in children if name(x) == "p"]
        if paragraphs and not re.fullmatch(REFERENCE_HEADING, " ".join(heading.split()), re.I):
            out.append((heading, "\n".join(paragraphs)))
    if not out:
        out = [("Full text", words(n)) for n in [x for x in nodes if name(x) in ("article-body", "body")][:1]]
    return out


#: Bodies of a batch and their bytes, and characters of sections that are sent on together.
PARSED_ROWS, PARSED_BYTES, PARSED_CHARS = 256, 4 << 20, 4 << 20
SECTION_SCHEMA = "paper_id long, ord int, heading string, text string"


def parse(documents: DataFrame) -> DataFrame:
    """documents: paper_id, source_format (html or xml), body. paper_id, ord, heading, text; unusable documents give no rows."""
    parsers = {"html": html_sections, "xml": xml_sections}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = lambda rows: pd.DataFrame(rows, columns=["paper_id", "ord", "heading", "text"])
        for batch in batches:
            rows, held = [], 0
            for i, kind, body in zip(batch["paper_id"], batch["source_format"], batch["body"]):
                found = [(i, n, h, x) for n, (h, x) in enumerate(parsers.get(kind, lambda _: [])(body))]
                rows += found
                held += sum(len(h) + len(x) for _, _, h, x in found)
                if held > PARSED_CHARS:
                    yield sent(rows)
                    rows, held = [], 0
            if rows:
                yield sent(rows)

    # A worker holds a bounded number of bytes of bodies, and of what was parsed of them, whatever the size of the table.
    bounded(shipped(documents).sparkSession, PARSED_ROWS, PARSED_BYTES)
    return documents.select(F.col("paper_id").cast("long"), "source_format", "body").mapInPandas(run, SECTION_SCHEMA)


def is_heading(line: Column) -> Column:
    """Whether a line of a text layer is a heading: a usual one, or a numbered one that is no sentence."""
    title = F.regexp_extract(line, NUMBERED_HEADING, 2)
    marker = F.regexp_extract(line, NUMBERED_HEADING, 1)
    numbered = line.rlike(NUMBERED_HEADING) & ~F.trim(title).rlike(r"[.;:,]$") & (F.size(F.split(F.trim(title), " ")) <= 14) & title.rlike(r"^\p{L}")
    numbered = numbered & (marker.rlike(r"^\d") | title.rlike(r"^\p{Lu}"))
    return (F.length(line) > 0) & (F.length(line) <= 120) & (line.rlike(PLAIN_HEADINGS) | numbered)


def line_sessions(documents: DataFrame) -> DataFrame:
    """documents: paper_id, text. paper_id, ord, heading, text: lines in sections, each opened by a heading line.

    A section is a running count of headings over a document's lines; what stands before the first is front
    matter, reference sections and empty ones go.
    """
    lines = documents.select("paper_id", F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    lines = lines.withColumn("line", t.collapse(F.col("raw"))).withColumn("h", F.coalesce(is_heading(F.col("line")), F.lit(False)))
    w = Window.partitionBy("paper_id").orderBy("i")
    lines = lines.withColumn("ord", F.sum(F.col("h").cast("int")).over(w))
    rows = lines.groupBy("paper_id", "ord").agg(
        F.max(F.when(F.col("h"), F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("i", "line")))).alias("l")
    )
    text = F.trim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n "))
    rows = rows.select("paper_id", F.col("ord").cast("int").alias("ord"), F.coalesce("heading", F.lit("Front matter")).alias("heading"), text.alias("text"))
    label = F.trim(F.regexp_replace("heading", r"^(?:(?:\d{1,2}(?:\.\d{1,2})*)|[A-Z])(?:[.)])?\s+", ""))
    return rows.where((F.col("text") != "") & ~F.lower(label).rlike(f"^{REFERENCE_HEADING}$"))


def with_parents(sections: DataFrame) -> DataFrame:
    """sections whose sub-headings (2.1 Data) carry their numbered parent (2 Methods / 2.1 Data), the last one before them in the document.

    A plain heading ends the reach of a parent.
    """
    marker = F.regexp_extract("heading", r"^([1-9]\d?(?:\.\d{1,2})*)(?:[.)])?\s", 1)
    rows = sections.withColumn("_m", marker)
    top = F.when((F.col("_m") != "") & ~F.col("_m").contains("."), F.struct(F.col("_m").alias("m"), F.col("heading").alias("h")))
    reset = F.when(F.col("_m") == "", F.struct(F.lit("").alias("m"), F.lit("").alias("h")))
    w = Window.partitionBy("paper_id").orderBy("ord")
    rows = rows.withColumn("_p", F.last(F.coalesce(top, reset), ignorenulls=True).over(w))
    child = F.col("_m").contains(".") & (F.col("_p.m") == F.substring_index("_m", ".", 1))
    return rows.withColumn("heading", F.when(child, F.concat_ws(" / ", "_p.h", "heading")).otherwise(F.col("heading"))).drop("_m", "_p")


def semantic_or_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """The sections of documents with two recognised headings at least; the others' pages (paper_id, ord, heading, text) as they are."""
    known = F.count_if(~F.array_contains(t.heading_roles(F.col("heading")), "other"))
    good = sections.groupBy("paper_id").agg(known.alias("n")).where("n >= 2").select("paper_id")
    return sections.join(good, "paper_id", "left_semi").unionByName(pages.join(good, "paper_id", "left_anti"))


def normalise(sections: DataFrame, max_document: int = MAX_DOCUMENT, max_section: int = MAX_SECTION, max_chunk: int = MAX_CHUNK) -> DataFrame:
    """Bounded sections with stable ids: paper_id, ord, section_id, heading, section_types, text, truncated.

    Section and document budgets cut texts (a running sum of what was kept before); documents without any real heading
    fall into chunks. Documents with too little text have no rows. The budgets are the feature: a parser's bounds.
    """
    clean = sections.select(
        "paper_id", "ord", F.when(t.collapse(F.col("heading")) != "", t.collapse(F.col("heading"))).otherwise("Section").alias("heading"), t.collapse(F.col("text")).alias("full")
    ).where("full != ''")
    w = Window.partitionBy("paper_id").orderBy("ord")
    whole = Window.partitionBy("paper_id")
    before = F.coalesce(F.sum(F.least(F.length("full"), F.lit(max_section))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plain = F.lower("heading").rlike(r"^(?:page |full text|section)")
    rows = clean.withColumns({"before": before, "structured": F.max((~plain).cast("int")).over(whole) == 1}).where(F.col("before") < max_document)
    rows = rows.withColumn("text", F.expr(f"substring(full, 1, cast(least({max_section}, {max_document} - before) as int))"))
    rows = rows.withColumn("cut", F.length("text") < F.length("full"))
    letters = F.sum(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}_]", ""))).over(whole)
    rows = rows.withColumns({"_len": F.sum(F.length("text")).over(whole), "_letters": letters}).where("_len >= 80 and _letters >= 40")
    starts = F.when(F.col("structured"), F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length("text"), F.lit(max_chunk)))
    parts = rows.withColumn("_s", F.explode(starts))
    size = F.when(F.col("structured"), F.length("text")).otherwise(F.lit(max_chunk))
    parts = parts.withColumn("part", F.expr("substring(text, _s, cast(if(structured, length(text), {0}) as int))".format(max_chunk)))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "_s"))
    kind = F.when(F.col("structured"), "section-").otherwise("chunk-")
    types = F.when(F.col("structured"), t.heading_roles(F.col("heading"))).otherwise(F.array(F.lit("other")))
    return parts.select(
        "paper_id", n.alias("ord"), F.concat(kind, F.lpad(n.cast("string"), 4, "0")).alias("section_id"), "heading", types.alias("section_types"),
        F.col("part").alias("text"), (F.col("cut") | (F.col("_s") - 1 + size < F.length("text"))).alias("truncated"),
    )


def choose_context(sections: DataFrame, max_chars: int = MAX_CONTEXT, max_sections: int = MAX_SECTIONS) -> DataFrame:
    """The sections that fit a context, in document order: preferred roles first, at most max_sections, cut to max_chars.

    Each costs its header, its text and a separator; a running sum of costs gives the place where the budget ends.
    """
    preferred = F.arrays_overlap("section_types", F.array(*map(F.lit, PREFERRED_ROLES)))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.when(preferred, 0).otherwise(1), "ord"))
    rows = sections.withColumn("_p", place).where(F.col("_p") <= max_sections)
    header = F.concat(F.lit("[Full text section id="), "section_id", F.lit("; types="), F.array_join("section_types", ","), F.lit("; heading="), "heading", F.lit("]\n"))
    rows = rows.withColumns({"header": header}).withColumn("_cost", F.length("header") + F.length("text") + 2)
    w = Window.partitionBy("paper_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("left", max_chars - F.coalesce(F.sum("_cost").over(w), F.lit(0))).where(F.col("left") > F.length("header"))
    body = F.expr("substring(text, 1, cast(left - length(header) as int))")
    return rows.withColumn("kept", body).select("paper_id", "ord", "section_id", "header", F.col("kept").alias("text"), (F.length("kept") < F.length("text")).alias("cut"))


def choose_location(locations: DataFrame) -> DataFrame:
    """paper_id, ord, url, source_format, is_open_access, status. The location a paper's full text comes from.

    Open-access ones, known formats first, the first that is usable; without any, the failure that got furthest.
    """
    rank = F.when(F.col("status") == "usable", 0).otherwise(1)
    got = F.when(F.col("status") == "parse_failed", 3).when(F.col("status") == "fetch_failed", 2).when(F.col("status") == "unavailable", 1).otherwise(0)
    w = Window.partitionBy("paper_id").orderBy(rank, F.when(rank == 1, -got).otherwise(0), (F.col("source_format") == "unknown").cast("int"), "ord")
    return locations.where("is_open_access").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pack(items: DataFrame, max_items: int, max_chars: int, separator: int = 23) -> DataFrame:
    """items: queue, ord, chars. With batch: greedy packing in order by number and by characters with separators.

    Sequential within a queue; rows stream in order and only the open batch's sums are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queue, batch, n, used = None, 0, 0, 0
        for rows in batches:
            out = []
            for q, chars in zip(rows["queue"], rows["chars"]):
                if q != queue:
                    queue, batch, n, used = q, 0, 0, 0
                if n and (n >= max_items or used + separator + chars > max_chars):
                    batch, n, used = batch + 1, 0, 0
                used += chars + (separator if n else 0)
                n += 1
                out.append(batch)
            yield rows.assign(batch=out)

    rows = shipped(items).select("queue", "ord", "chars").repartition("queue").sortWithinPartitions("queue", "ord")
    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", batch long")
