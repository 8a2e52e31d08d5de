"""Fill-in-middle: a text cut at two drawn places into prefix, middle and suffix, and put together in another order.

Cuts stand between units: code points, words (with the white space after them) or lines. Whether a unit begins at a byte of
UTF-8 shows from that byte and the one before it, so texts fall into chunks that overlap by one byte and are counted
independently of each other: the bytes of a whole batch at once, a bounded block at a time. Prefix sums of the counts say which chunk of a text
owns a cut's rank; only owning chunks are scanned again for the place itself. No text is decoded or indexed by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import map_arrow

#: Bytes of a chunk, and of the chunks counted together.
CHUNK = 1 << 12
BLOCK = 1 << 22
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Texts in a hundred that are rearranged, and rearranged texts in a hundred whose suffix comes first.
RATE = 90
SPM_RATE = 20
SEED = 1

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

#: Whether a unit begins at a byte, by the byte before and the byte itself.
UNITS = {
    "char": lambda before, byte: (byte & 0xC0) != 0x80,
    "word": lambda before, byte: _SPACE[before] & ~_SPACE[byte],
    "line": lambda before, byte: before == 10,
}


def _begins(data: np.ndarray, start: int, end: int, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte from start to end; the byte before start is read too. Nothing stands before byte 0."""
    if start:
        return UNITS[unit](data[start - 1 : end - 1], data[start:end])
    return UNITS[unit](np.concatenate([data[:1] * 0, data[: end - 1]]), data[:end])


class Cutter:
    """Units of texts that lie one after another in data, text i from starts[i] to ends[i]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str):
        self.data, self.ends, self.unit = data, ends, unit
        chunks = -(-(ends - starts) // CHUNK)
        self.first = np.cumsum(chunks) - chunks
        owner = np.repeat(np.arange(len(starts)), chunks)
        number = np.arange(len(owner)) - self.first[owner]
        self.begin = starts[owner] + number * CHUNK
        self.end = np.minimum(self.begin + CHUNK, ends[owner])
        # A text begins with a unit whatever its first byte is.
        self.opens = number == 0
        counts = np.zeros(len(owner), np.int64)
        at = 0
        while at < len(owner):
            to = max(at + 1, int(np.searchsorted(self.end, self.begin[at] + BLOCK, side="right")))
            low = self.begin[at]
            flags = _begins(data, low, self.end[to - 1], unit)
            flags[self.begin[at:to][self.opens[at:to]] - low] = True
            counts[at:to] = np.add.reduceat(flags, self.begin[at:to] - low, dtype=np.int64)
            at = to
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.units = self.before[self.first + chunks] - self.before[self.first]

    def place(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Where unit rank[i] of text[i] begins; the text's end if it has no more units."""
        found = self.ends[text].copy()
        inside = np.flatnonzero(rank < self.units[text])
        total = self.before[self.first[text[inside]]] + rank[inside]
        chunk = np.searchsorted(self.before, total, side="right") - 1
        order = np.argsort(chunk, kind="stable")
        scanned, places = -1, None
        for i, c, r in zip(inside[order], chunk[order], (total - self.before[chunk])[order]):
            if c != scanned:
                flags = _begins(self.data, self.begin[c], self.end[c], self.unit)
                flags[0] |= self.opens[c]
                scanned, places = c, self.begin[c] + np.flatnonzero(flags)
            found[i] = places[r]
        return found


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """Bytes of a string column without nulls, where its texts begin and end, and the bytes as a view."""
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, bounds, memoryview(data)


def _arranger(unit: str, markers: tuple[str, str, str], rate: int, spm_rate: int):
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, bounds, view = _flat(batch.column("text"))
            h = np.column_stack([np.asarray(batch.column(f"h{i}")) for i in range(1, 5)])
            cutter = Cutter(data, bounds[:-1], bounds[1:], unit)
            units = cutter.units
            low, high = np.sort(h[:, :2] % (units + 1)[:, None], axis=1).T
            texts = np.arange(len(units))
            a, b = cutter.place(np.tile(texts, 2), np.concatenate([low, high])).reshape(2, -1)
            drawn, spm = h[:, 2] % 100 < rate, h[:, 3] % 100 < spm_rate
            out, form = [], []
            for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                text = view[x:y].tobytes()
                if x == y or not drawn[i] or p in text or s in text or m in text:
                    form.append("plain")
                    out.append(text)
                    continue
                first, second = int(a[i]) - x, int(b[i]) - x
                pre, mid, suf = text[:first], text[first:second], text[second:]
                form.append("spm" if spm[i] else "psm")
                out.append(b"".join((s, suf, p, pre, m, mid) if spm[i] else (p, pre, s, suf, m, mid)))
            plain = np.array([f == "plain" for f in form])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(units, pa.int64()),
                    "form": pa.array(form, pa.string()),
                    "prefix_units": pa.array(low, pa.int64(), mask=plain),
                    "middle_units": pa.array(high - low, pa.int64(), mask=plain),
                    "output": pa.array(out, pa.binary()).cast(pa.string()),
                }
            )

    return run


def fill_in_middle(
    docs: DataFrame, unit: str = "char", markers: tuple[str, str, str] = MARKERS, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED
) -> DataFrame:
    """One row per row of docs: doc_id, n (units), form (plain, psm or spm), prefix_units, middle_units (null if plain), output. No shuffle.

    Draws depend on seed and doc_id alone. psm is prefix, suffix, middle and spm suffix, prefix, middle, each after its marker.
    Empty and null texts, those not drawn and those that hold a marker are plain: the text as it is (null: empty).
    Rows without doc_id draw as one; repeated rows give repeated results; an empty table gives none; other columns are ignored.
    unit: "char" (code points), "word" or "line"; what stands before the first word belongs to it.
    """
    pairs = [(a, b, int(i == j)) for i, a in enumerate(markers) for j, b in enumerate(markers)]
    if not all(markers) or any(b.startswith(a[i:]) or a in b[i:] for a, b, at in pairs for i in range(at, len(a))):
        raise ValueError("a marker must not be empty, begin as another does, or end as one begins")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *[F.conv(F.substring(draw, 8 * i - 7, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(1, 5)],
    )
    schema = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"
    return map_arrow(rows, _arranger(unit, markers, rate, spm_rate), schema)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. Rearranged texts hold no marker, and none can arise where a marker meets text, so markers part them."""
    pieces = F.split(output, "|".join(f"\\Q{m}\\E" for m in markers))
    prefix_first = F.concat(pieces[1], pieces[3], pieces[2])
    suffix_first = F.concat(pieces[2], pieces[3], pieces[1])
    return F.when(form == "plain", output).when(form == "psm", prefix_first).otherwise(suffix_first)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of fill_in_middle over code points."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT doc_id, t, n, least(CAST('0x' || h[1:8] AS BIGINT) % (n + 1), CAST('0x' || h[9:16] AS BIGINT) % (n + 1)) AS a,
         greatest(CAST('0x' || h[1:8] AS BIGINT) % (n + 1), CAST('0x' || h[9:16] AS BIGINT) % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM o
"""
