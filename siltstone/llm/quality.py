"""Quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (one of label 1 over one of label 0). The probability that a is
preferred to b is the logistic of w . (f(a) - f(b)), and w minimises the logistic loss over the pairs
with a small L2 penalty (Newton's method on a seeded set of pairs). A document's raw score is w . f(x).
The threshold is the quantile of the raw scores of the fitting sample that separates its labels best in
balanced accuracy (the lowest within SPARE of the best); the raw score is shifted so that the threshold maps to THRESHOLD and goes
through the logistic function.

Features are figures of the whole text, in Arrow batches. Only the fit sees a sample (at most
SAMPLE labelled rows, of a seeded hash); its features, not its texts, reach the driver. Every
document is scored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import bounded_batches, map_arrow, stage

#: Labelled rows that the fit sees at most.
SAMPLE = 12_000
PAIRS = 60_000
THRESHOLD = 0.3
#: Balanced accuracy given up (twice over) so that fewer good documents are rejected.
SPARE = 0.004
L2 = 1e-3
SEED = 42

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 symbol, 7 beyond ASCII
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[128:] = 7


def features(text: str | None) -> list[float]:
    """Figures of one text. Empty and null texts have all zero but the first, which marks them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [1.0] + [0.0] * (N_FEATURES - 1)
    n, size = len(words), len(raw)
    counts = Counter(words)
    by_class = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / size
    top = counts.most_common(1)[0][1]
    repeats = sum(map(bytes.__eq__, words, words[1:])) / max(1, n - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_copies = 1 - len(set(lines)) / max(1, len(lines))
    lengths = np.fromiter(map(len, words), np.int64, n)
    distinct = len(counts) / n
    letters = by_class[1] + by_class[2]
    ends = Counter(w[-1] for w in words)
    marks = sum(ends[c] for c in b"#$%&*+/<=>@\\^_`{|}~!") / n
    stops = sum(ends[c] for c in b".!?") / n
    shares = np.fromiter(counts.values(), np.float64, len(counts)) / n
    entropy = float(-(shares * np.log(shares)).sum()) / max(1.0, math.log(n))
    short = math.exp(-n / 20)
    return [
        0.0,
        min(1.0, math.log1p(n) / 10),
        short,
        by_class[2] / max(letters, 1e-9),
        by_class[3],
        by_class[4],
        by_class[5],
        by_class[6],
        by_class[7],
        min(1.0, lengths.mean() / 20),
        min(1.0, lengths.std() / 20),
        min(1.0, lengths.max() / 100),
        top / n,
        top / n * (1 - short),
        repeats,
        min(1.0, 20 * repeats),
        line_copies,
        distinct,
        # Distinct words against what prose of this length has.
        min(2.0, len(counts) / n**0.75) / 2,
        entropy,
        marks,
        min(1.0, 10 * marks),
        stops,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        sum(map(raw.count, (b"!!", b"??", b"...", b"***", b"$$$", b"&&&"))) / n,
        float((lengths == 1).mean()),
        float(n < 8),
    ]


N_FEATURES = 28


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """x: rows of features. Between 0 and 1; THRESHOLD stands for the fitted quantile."""
        raw = _expand((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.shift + math.log(THRESHOLD / (1 - THRESHOLD)), -40, 40)))


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -8, 8)
    return np.hstack([z, z * z / 8])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: features of labelled rows, y: labels 0 or 1. With one label only, every score is that label's."""
    if not len(y) or y.all() or not y.any():
        width = 2 * N_FEATURES
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(width), 20.0 if len(y) and not y.any() else -20.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = _expand((x - mean) / scale)
    rng = np.random.default_rng(SEED)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[rng.choice(good, PAIRS)] - z[np.resize(rng.permutation(bad), PAIRS)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the wrong order
        grad = -(d.T @ p) / len(d) + L2 * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + L2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    order = np.argsort(raw, kind="stable")
    hit_bad, hit_good = np.cumsum(y[order] == 0) / len(bad), np.cumsum(y[order] == 1) / len(good)
    gain = hit_bad - hit_good
    at = int(np.argmax(gain >= gain.max() - SPARE))  # the quantile: rows up to it are rejected
    above = raw[order[min(at + 1, len(order) - 1)]]
    return Model(mean, scale, w, float((raw[order[at]] + above) / 2))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), N_FEATURES)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t) for t in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), *batch.columns[1:]], ["x", *batch.schema.names[1:]])


def _scorer(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = model.score(_matrix(batch.column(at).to_pylist()))
            yield pa.record_batch([batch.column(i) for i in range(len(names)) if i != at] + [pa.array(scores)], [n for n in names if n != "text"] + ["score"])

    return run


def is_held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on about `sample` labelled rows outside the held-out fold at most, chosen by a hash of doc_id alone.

    The hash takes each labelled id with the chance sample / n, so their number strays from `sample` by a few times its
    root. Null ids and null labels take no part; an id with several labels counts once with the least one, an id with
    several documents with the one of the least hash.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("y")).select(F.col("doc_id").alias("_id"), "y")
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    cut = int(share * (1 << 30))
    some = stage(usable.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("_id").cast("long")), 34) < cut), "labelled")
    texts = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id"))
    texts = texts.select("text", F.col("y").cast("int").alias("y"), F.col("_id").cast("long").alias("id"), F.xxhash64("text").alias("th"))
    found = map_arrow(texts, _extract, "x array<double>, y int, id long, th long")
    # Of documents that share an id one counts, whatever the order in which they come.
    rows = found.groupBy("id").agg(F.min_by("x", "th").alias("x"), F.first("y").alias("y")).collect()
    rows.sort(key=lambda r: (r.y, list(r.x)))
    return fit(np.array([r.x for r in rows], np.float64).reshape(len(rows), N_FEATURES), np.array([r.y for r in rows], np.int64))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= THRESHOLD). One pass, no shuffle.

    Null and empty texts have a score like any other; repeated rows repeat it; a null doc_id is not held
    out; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    scored = map_arrow(rows, _scorer(model, ["doc_id", "text"]), "doc_id long, score double")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model accepts, with all their columns.

    Null and empty texts are judged like any other; rows that repeat share their fate; ids and other columns play no
    part, whatever their names. An empty table gives no rows.
    """

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix([t if isinstance(t, str) else None for t in texts])) >= THRESHOLD)

    bounded_batches(docs.sparkSession)
    return docs.where(accepted(F.col("text")))
