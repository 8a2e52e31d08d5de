"""License scans: fuzzy search for short notices.

A text becomes its words, lower-cased and joined by single spaces. A notice that may differ in k edits
is split into k + 1 pieces; by the pigeonhole principle any text within k edits holds one piece
unchanged. Pieces are found exactly (seeds); around each seed the words are compared, first with the
notice itself (zero edits) and else by the regex library's bounded-error matching, which gives the span
and its edits. The words in `keys` tell licences apart ("mit", "2") and must stand in the span unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import map_arrow


@dataclass(frozen=True)
class Notice:
    label: str
    phrase: str
    edits: int
    keys: frozenset = field(default_factory=frozenset)


#: Phrases and labels that are counted exactly, at every place.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

NOTICES = (
    Notice("mit", "under the mit license", 2, frozenset({"mit"})),
    Notice("apache-2", "apache license version 2", 2, frozenset({"2"})),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc-by-nd", "cc by nd", 0),
    Notice("cc0", "cc0 1 0 universal", 1, frozenset({"cc0"})),
    Notice("gpl-2", "gnu general public license version 2", 3, frozenset({"gnu", "general", "2"})),
    Notice("gpl-3", "gnu general public license version 3", 3, frozenset({"gnu", "general", "3"})),
    Notice("lgpl", "gnu lesser general public license", 3, frozenset({"gnu", "lesser"})),
    Notice("agpl-3", "gnu affero general public license version 3", 3, frozenset({"gnu", "affero", "3"})),
    Notice("mpl-2", "mozilla public license version 2", 2, frozenset({"2"})),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", 6),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
)

_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): phrase in edits + 1 parts of nearly equal length."""
    n = edits + 1
    cuts = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: dict[str, str] = BASE):
        self.base = base
        self.notices = []
        for n in notices:
            seeds = [(at, p.encode()) for at, p in pieces(n.phrase, n.edits)]
            # Edits lie inside the span: its first and last character stand next to spaces.
            fuzzy = regex.compile(rf"(?e)(?<= )(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?= )") if n.edits else None
            self.notices.append((n, b" " + n.phrase.encode() + b" ", seeds, fuzzy))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
        """(number of words, spans): a span is (label, first word, end word, edits, whether it is a base phrase)."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()
        line = b" " + b" ".join(words) + b" "
        spans = []
        for notice, whole, seeds, fuzzy in self.notices:
            exact: set[int] = set()
            near: dict[tuple[int, int], int] = {}
            for at, seed in seeds:
                found = line.find(seed)
                while found >= 0:
                    start = found - at
                    if start >= 1 and line.startswith(whole, start - 1):
                        exact.add(start)
                    elif fuzzy is not None:
                        self._verify(line, notice, fuzzy, start, near)
                    found = line.find(seed, found + 1)
            spans += self._placed(line, notice, exact, near)
        return len(words), spans

    def _verify(self, line: bytes, notice: Notice, fuzzy, start: int, near: dict) -> None:
        # A match that keeps this piece in place begins at most `edits` characters (4 bytes each) off.
        slack = 4 * notice.edits + 1
        low = max(0, start - slack)
        window = line[low : start + len(notice.phrase) + slack].decode("utf-8", "ignore")
        if not all(f" {key} " in window for key in notice.keys):
            return
        for m in fuzzy.finditer(window, overlapped=True):
            if notice.keys <= set(m.group().split()):
                begin = low + _lead(line, low) + len(window[: m.start()].encode())
                near.setdefault((begin, begin + len(m.group().encode())), sum(m.fuzzy_counts))

    def _placed(self, line: bytes, notice: Notice, exact: set[int], near: dict) -> list[tuple]:
        taken = [(s, s + len(notice.phrase), 0) for s in sorted(exact)]
        for (a, b), edits in sorted(near.items(), key=lambda x: (x[1], x[0])):
            if all(b <= s or e <= a for s, e, _ in taken):
                taken.append((a, b, edits))
        placed, at, word = [], 0, -1
        for a, b, edits in sorted(taken):
            word += line.count(b" ", at, a)
            at = a
            end = word + 1 + line.count(b" ", a, b)
            placed.append((notice.label, word, end, edits, edits == 0 and self.base.get(notice.phrase) == notice.label))
        return placed


def _lead(line: bytes, low: int) -> int:
    """Bytes at low that continue a character begun before; decoding left them out."""
    n = 0
    while low + n < len(line) and line[low + n] & 0xC0 == 0x80:
        n += 1
    return n


SCHEMA = (
    "doc_id long, n_words long, spans array<struct<label: string, first_word: long, end_word: long, edits: int, base: boolean>>"
)
_SPANS = pa.list_(
    pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("edits", pa.int32()), ("base", pa.bool_())])
)


def _scan(notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        names = [f.name for f in _SPANS.value_type]
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column(1).to_pylist()]
            spans = pa.array([[dict(zip(names, s)) for s in spans] for _, spans in found], _SPANS)
            yield pa.record_batch([batch.column(0), pa.array([n for n, _ in found], pa.int64()), spans], ["doc_id", "n_words", "spans"])

    return run


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, spans (label, first_word, end_word, edits, base). One pass, no shuffle.

    Null and empty texts have no words and no spans. Spans of one notice never overlap; fewer edits win,
    then the earlier. Repeated rows give repeated results, a null doc_id stays null, other columns are
    ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_arrow(rows, _scan(notices), SCHEMA)


def license_summary(docs: DataFrame) -> DataFrame:
    """scan_licenses with spans condensed: n_base, first_word, last_word, base_labels, labels, score (1 / (1 + fewest edits), 0 without spans)."""
    base = "filter(spans, s -> s.base)"
    joined = "array_join(array_sort(array_distinct(transform({}, s -> s.label))), ',')"
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, s -> s.first_word))").alias("first_word"),
        F.expr(f"array_max(transform({base}, s -> s.first_word))").alias("last_word"),
        F.expr(joined.format(base)).alias("base_labels"),
        F.expr(joined.format("spans")).alias("labels"),
        F.expr("coalesce(1.0D / (1 + array_min(transform(spans, s -> s.edits))), 0.0D)").alias("score"),
    )
