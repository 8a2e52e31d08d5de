"""Secret scans over an incremental blob ledger.

Every version of every file is content-addressed by the SHA-256 of its text. The ledger holds, for each
(blob, rule version) ever scanned, the spans found, also where there are none. A scan

1. addresses all versions and keeps one row per blob that the ledger lacks under this rule version;
2. reads the texts of those rows alone and scans them. The rows to leave out (copies and known blobs)
   are broadcast if a count has shown them to be few; else the texts of the rows to scan are joined in;
3. appends what it found to the ledger and joins the ledger back to all paths of all versions. Scans that ran at
   the same time may both have entered a blob; it counts once.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import bounded_batches, fresh, map_arrow, small, stage
from siltstone.sources.staging import own_dir

#: Kinds in the order in which spans with equal starts are listed; the first three are the base kinds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "code_host", "chat", "web_token", "cloud_key")
#: Rows of (id, blob) that may be broadcast: 40 bytes each.
BROADCAST_ROWS = 250_000

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_HEX_BYTES = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * 16
#: Prefix that a text must hold, and the rule.
_ADDED = (
    # A key with its body, however long, up to its end mark, or the lines of base64 after the header where there is no end mark. Either way a header
    # looks no further than the next five dashes, so many headers cost no more than one.
    (
        "private_key",
        "PRIVATE KEY-----",
        re.compile(
            r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"
            r"(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----|(?>(?:(?:\\[nr]|\s)*[A-Za-z0-9+/=]{16,})*))"
        ),
    ),
    ("code_host", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("web_token", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("cloud_key", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
)
#: Least lengths that the base rules ask for: of the value of assign, of access, of hex.
_LEAST = (12, 18, 16)


def rule_version() -> str:
    """Names the rules by their own text, so that any change of a rule scans all blobs again."""
    rules = [_ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, *map(str, _LEAST), *(f"{kind} {part} {rule.pattern}" for kind, part, rule in _ADDED)]
    return hashlib.sha256("\n".join([*KINDS, *rules]).encode()).hexdigest()[:16]


RULE_VERSION = rule_version()


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed, then end."""
    if not text:
        return []
    found = []
    raw = text.encode("utf-8", "surrogatepass")
    if b":" in raw or b"=" in raw:
        low = raw.lower()
        if any(w.encode() in low for w in _ASSIGN_WORDS):
            found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(2)) >= _LEAST[0]]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST[1]]
    # Runs of hexadecimal digits are maximal either way; bytes tell quickly whether any is long enough.
    if _HEX_RUN in raw.translate(_HEX_BYTES):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, part, rule in _ADDED:
        if part.encode() in raw:
            found += [(kind, *m.span()) for m in rule.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(spans, _SPANS)], ["blob", "spans"])


class Ledger:
    """(blob, rule_version, spans) in a Parquet folder that only grows."""

    def __init__(self, spark, path: str | None = None):
        self.spark = spark
        self.path = path or f"{own_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def exists(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def entries(self, rule_version: str) -> DataFrame | None:
        if not self.exists():
            return None
        rows = self.spark.read.schema(f"blob binary, rule_version string, spans {SPANS}").parquet(self.path)
        return rows.where(F.col("rule_version") == rule_version).select("blob", "spans")

    def findings(self, rule_version: str) -> DataFrame:
        """blob, spans of the blobs with any span, once each however often they were entered."""
        return self.entries(rule_version).where(F.size("spans") > 0).dropDuplicates(["blob"])

    def append(self, rows: DataFrame, rule_version: str) -> None:
        rows.select("blob", F.lit(rule_version).alias("rule_version"), "spans").write.mode("append").parquet(self.path)


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan(
    versions: DataFrame,
    id_column: str = "doc_id",
    ledger: Ledger | None = None,
    rule_version: str = RULE_VERSION,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per version: id, blob, spans (kind, start, end; code points, end exclusive), by way of the ledger.

    Each (blob, rule version) is scanned once ever, however many paths and versions hold it. A null text
    is an empty blob; a null id is a path like any other. Repeated rows give repeated results, other
    columns are ignored, an empty table gives no rows. A run that dies before its append scans again; one that
    dies after it finds its blobs in the ledger.
    """
    spark = versions.sparkSession
    ledger = ledger or Ledger(spark)
    texts = versions.select(F.col(id_column).alias("id"), F.col("text").alias("text")).withColumn("blob", address(F.col("text")))
    paths = stage(texts.select("id", "blob"), "paths")
    known = ledger.entries(rule_version)
    first = paths.groupBy("blob").agg(F.min("id").alias("low"))
    todo = first if known is None else first.join(known.select("blob"), "blob", "left_anti")
    todo = stage(todo, "unseen").select(F.col("blob").alias("blob2"), "low")
    same = (F.col("blob") == F.col("blob2")) & F.col("id").eqNullSafe(F.col("low"))
    left_out = paths.join(todo, same, "left_anti").distinct()
    left_out = stage(left_out.select(F.col("id").alias("low"), F.col("blob").alias("blob2")), "left-out")
    if left_out.count() <= broadcast_rows:
        chosen = texts.join(F.broadcast(left_out), same, "left_anti")
    else:
        chosen = texts.join(todo.hint("shuffle_hash"), same, "left_semi")
    scanned = map_arrow(chosen.select("blob", "text"), _scan, f"blob binary, spans {SPANS}")
    # Rows repeated whole are scanned as often as they stand there, but entered once.
    entered = stage(scanned, "scanned")
    if entered.count() > todo.count():
        entered = entered.dropDuplicates(["blob"])
    ledger.append(entered, rule_version)
    found = ledger.findings(rule_version).select(F.col("blob").alias("blob2"), "spans")
    joined = paths.join(found, F.col("blob") == F.col("blob2"), "left")
    return joined.select("id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _listed(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"


def secret_summary(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all, comma-joined kind:start:end)."""
    base = "filter(spans, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE_KINDS))
    count = "cast(size(filter(spans, s -> s.kind = '{}')) as bigint)"
    return scan(docs, "doc_id", ledger).select(
        F.col("id").alias("doc_id"),
        *(F.expr(count.format(k)).alias(f"n_{k}") for k in BASE_KINDS),
        F.expr(f"sha2({_listed(base)}, 256)").alias("base_sha256"),
        F.expr(_listed("spans")).alias("spans"),
    )


def cover(text: str, spans: list, mark: str) -> str:
    """text with its spans (sorted by start) replaced by mark; what is left of a later one that overlaps goes with the earlier."""
    parts, at = [], 0
    for span in spans:
        start, end = span["start"], span["end"]
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, if there, follows. No row is dropped.

    Null and empty texts stay as they are; repeated rows are each replaced; a null doc_id is an identifier like any
    other. Other columns keep their names and values, whatever the names. An empty table gives no rows.
    """

    @F.pandas_udf("string")
    def covered(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else cover(t, list(s), mark) for t, s in zip(texts, spans)], dtype=object)

    found = scan(docs, "doc_id").where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    blob, spans, replaced = fresh(["blob", "spans", "replaced"], docs.columns)
    found = small(stage(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "found"), broadcast_rows)
    bounded_batches(docs.sparkSession)
    joined = docs.join(found, address(docs["text"]) == F.col(blob), "left")
    # Only texts with findings go to Python; the others are null there.
    out = joined.withColumn(replaced, covered(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans)))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce(replaced, "text").alias("text"))
        elif c == "n_chars":
            changed = F.length(replaced).cast(docs.schema["n_chars"].dataType)
            columns.append(F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(changed).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return out.select(*columns)
