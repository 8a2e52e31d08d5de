"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots holds a bitmask of languages per slot, ceil(L / 64) words wide: bit l of a slot is the bit
of language l's own Bloom filter, so one lookup of an n-gram's slots, ANDed, answers for all languages at once.
A text's n-grams are looked up in arrays; the count of set bits per language, less what the filter's false
positives account for, decides: with n n-grams, c hits and false-positive rate f the corrected share is
(c / n - f) / (1 - f), at least 0. The score is the best language's share of all corrected shares.

A language's filter holds the n-grams that stand in at least MIN_RATE of its sampled documents and are
not much more common in another language, at most NGRAMS of them, the commonest first, each language on its
own. Every language is learned. The fit counts n-grams of whole texts in Spark, over at most about SAMPLE
documents a language chosen by a hash; only the n-grams that filters hold reach the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._common import map_arrow, small, stage

SIZES = (1, 2, 3, 4)
#: Sampled documents and n-grams a language at most.
SAMPLE = 1_500
NGRAMS = 20_000
SLOT_BITS = 20
#: Rows of languages (a few dozen bytes each) that may be broadcast; beyond, a shuffle joins them.
BROADCAST_ROWS = 100_000
#: N-grams whose masks are counted at once.
TOGETHER = 1 << 16
HASHES = 3
MIN_RATE = 0.02
#: An n-gram is left out of a language where another one has it this many times as often.
RATIO = 3.0
SEED = 42
CHUNK = 1 << 20
UNKNOWN = "und"

_BREAK = 32


def _letters() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane; the break for anything else."""
    table = np.full(1 << 16, _BREAK, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTER = _letters()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _points(text: str) -> np.ndarray:
    """Letters in lower case, each run of anything else as one break, a break at either end."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _LETTER[np.minimum(raw, 0xFFFF)]
    high = raw > 0xFFFF
    if high.any():
        low[high] = [c if chr(c).isalpha() else _BREAK for c in raw[high].tolist()]
    gap = low == _BREAK
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    x = low[keep]
    edges = [_BREAK] if len(x) and x[0] != _BREAK else []
    tail = [_BREAK] if len(x) and x[-1] != _BREAK else []
    return np.concatenate([np.array(edges, np.uint32), x, np.array(tail, np.uint32)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Hashes of the text's character n-grams within words; word ends count as a character, breaks alone do not."""
    found, start = [], 0
    while start < len(text):
        end = min(len(text), start + CHUNK)
        if end < len(text):
            # Chunks end between words; only a word longer than a chunk is cut.
            space = text.rfind(" ", start, end)
            end = space if space > start else end
        x = _points(text[start:end]).astype(np.uint64)
        start = end
        gap = x == _BREAK
        for n in sizes:
            m = len(x) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n))
            inner = np.zeros(m, bool)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + x[i : i + m]
                if 0 < i < n - 1:
                    inner |= gap[i : i + m]
            alone = gap[:m] & gap[n - 1 : n - 1 + m] if n < 3 else np.zeros(m, bool)
            found.append(_mix(h[~(inner | alone)]))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(i) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # uint64 masks: slots x words
    rates: np.ndarray  # false positives of each language

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The set of languages that hold each n-gram, as bits: one row of words an n-gram."""
        found = np.full((len(h), self.table.shape[1]), np.uint64((1 << 64) - 1))
        for s in _slots(h):
            found &= self.table[s]
        return found

    def hits(self, h: np.ndarray) -> np.ndarray:
        """For each language, how many of the n-grams its filter holds."""
        n = len(self.languages)
        if n <= 10:  # few enough sets of languages to count each
            by_set = np.bincount(self.masks(h)[:, 0].astype(np.int64), minlength=1 << n)
            return by_set @ ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1)
        found = np.zeros(64 * self.table.shape[1], np.int64)
        for at in range(0, len(h), TOGETHER):
            words = np.ascontiguousarray(self.masks(h[at : at + TOGETHER]), "<u8")
            found += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return found[:n]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        h = ngrams(text)
        if not len(h):
            return UNKNOWN, 0.0
        share = np.maximum(0.0, (self.hits(h) / len(h) - self.rates) / (1 - self.rates))
        total = float(share.sum())
        best = int(np.argmax(share))  # ties go to the first by code point
        return self.languages[best], float(share[best] / total) if total > 0 else 0.0


def build(held: dict[str, np.ndarray]) -> Model:
    """held: for each language the hashes (int64) of the n-grams that its filter holds."""
    languages = sorted(held)
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    filled = np.zeros(len(languages))
    for bit, lang in enumerate(languages):
        column, one = table[:, bit // 64], np.uint64(1 << bit % 64)
        for s in _slots(np.asarray(held[lang], np.int64).view(np.uint64)):
            column[s] |= one
        filled[bit] = float(((column >> np.uint64(bit % 64)) & np.uint64(1)).mean())
    return Model(languages, table, np.minimum(filled**HASHES, 0.99))


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each n-gram, by language; rows with `whole` count the documents themselves."""
    counts: dict[str, Counter] = {}
    documents: Counter = Counter()
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            documents[lang] += 1
            counts.setdefault(lang, Counter()).update(np.unique(ngrams(text or "")).view(np.int64).tolist())
    for lang, c in counts.items():
        items = list(c.items())
        for at in range(0, len(items), 1 << 16):
            part = items[at : at + (1 << 16)]
            n = len(part)
            columns = [pa.array([lang] * n), pa.array([h for h, _ in part], pa.int64()), pa.array([k for _, k in part], pa.int64()), pa.array([False] * n)]
            yield pa.record_batch(columns, ["lang", "h", "n", "whole"])
    n = len(documents)
    columns = [pa.array(list(documents), pa.string()), pa.array([None] * n, pa.int64()), pa.array(list(documents.values()), pa.int64()), pa.array([True] * n)]
    yield pa.record_batch(columns, ["lang", "h", "n", "whole"])


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def held_ngrams(counts: DataFrame, documents: DataFrame, most: int = NGRAMS) -> DataFrame:
    """lang, h: the n-grams that each language's filter holds.

    counts: lang, h, n (documents of the language that hold the n-gram); documents: lang, n (its documents).
    """
    rates = counts.join(small(documents.select("lang", F.col("n").alias("of")), BROADCAST_ROWS), "lang").withColumn("rate", F.col("n") / F.col("of"))
    rates = rates.where(F.col("rate") >= MIN_RATE)
    own = rates.withColumn("top", F.max("rate").over(Window.partitionBy("h"))).where(F.col("top") <= RATIO * F.col("rate"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "h"))
    return own.withColumn("place", place).where(F.col("place") <= most).select("lang", "h")


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns every non-null lang from texts outside the held-out fold; at most about `sample` documents a language."""
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))
    )
    # One row a language, whatever the number of documents.
    sizes = stage(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    cuts = sizes.select(F.col("lang").alias("_lang"), F.least(F.lit(1.0), sample / F.col("n")).alias("_cut"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long")), 34) / float(1 << 30)
    some = usable.join(small(cuts, BROADCAST_ROWS), F.col("lang") == F.col("_lang")).where(draw < F.col("_cut")).select("text", "lang")
    counted = map_arrow(some, _counter, "lang string, h long, n long, whole boolean")
    totals = stage(counted.groupBy("lang", "h", "whole").agg(F.sum("n").alias("n")), "ngrams")
    documents = totals.where("whole").select("lang", "n")
    held = held_ngrams(totals.where("not whole").select("lang", "h", "n"), documents).toArrow()
    names, h = np.array(held.column(0).to_pylist(), object), held.column(1).to_numpy()
    learned = [r.lang for r in documents.select("lang").collect()]
    return build({lang: h[names == lang] for lang in learned})


def _predictor(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.record_batch(columns, ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. One pass, no shuffle.

    Null texts and texts without a letter are `und` with score 0; so is every text if nothing could be
    learned. Repeated rows repeat their result; a null doc_id is not held out; other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = map_arrow(rows, _predictor(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
