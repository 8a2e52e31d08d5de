"""Token identifiers as binary records: length, masked checksum, payload, masked checksum, with an offset index beside them.

A record file is a sequence of frames: the payload's length (8 bytes, little-endian), the masked CRC-32C of those 8 bytes, the payload, the
masked CRC-32C of the payload. A payload holds a document's token identifiers, little-endian and unsigned, of two bytes where the
vocabulary allows it and of four otherwise. The files together hold the documents in ascending order of doc_id: range partitions
write one after another, each as many files (rows with a binary column, written by Spark to the shared folder) as its bytes need.
The index is a table of its own, one row a record: file, offset, number of identifiers, and identifiers in all records before it. It answers which
frames a shuffled or partial read needs, and such a read opens no others.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm._common import map_arrow, small, stage

END = 2
SHARD = 8 << 20
#: Rows of (part, base) or of identifiers of files that may be broadcast, 12 to 30 bytes each.
BROADCAST_ROWS = 200_000
#: Characters after which a text is cut at its next space, different pieces remembered, characters of the longest that is.
PART = 1 << 20
REMEMBERED = 300_000
LONGEST = 64

# The polynomial of CRC-32C (reflected) and the mask added to a checksum that is rotated by 15 bits.
POLYNOMIAL = 0x82F63B78
MASK = 0xA282EAD8
LENGTH, CHECK = struct.Struct("<Q"), struct.Struct("<I")
FRAME = LENGTH.size + 2 * CHECK.size

#: Splitting pattern known to match no white space and not to look around.
APART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: The same over lower-cased ASCII and the Latin letters of two more blocks, which composition leaves alone and whose lower case is one letter; and
#: text of these alone that can hold no added token.
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\t-\\r 0-9a-zß-öø-ſ]+")
PLAIN = re.compile("[\\x00-;=-\\x7fÀ-ÖØ-öø-įı-ſ]*")

WORD = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each byte at each place of a block of WORD bytes its part of the block's remainder; and, for 2^b zero bytes that follow, of each byte of
    a remainder its part of the remainder after them."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1)
    place = np.empty((WORD, 256), np.uint32)
    place[-1] = byte
    for j in range(WORD - 2, -1, -1):
        place[j] = byte[place[j + 1] & 0xFF] ^ (place[j + 1] >> 8)
    powers = np.empty((40, 4, 256), np.uint32)
    for i in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * i)
        powers[0, i] = byte[value & 0xFF] ^ (value >> 8)
    for b in range(1, len(powers)):
        powers[b] = _after(powers[b - 1], powers[b - 1])
    return place, powers


def _after(power: np.ndarray, value: np.ndarray) -> np.ndarray:
    return power[0][value & 0xFF] ^ power[1][(value >> 8) & 0xFF] ^ power[2][(value >> 16) & 0xFF] ^ power[3][value >> 24]


PLACE, POWERS = _tables()


def _shifted(value: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each remainder after zeros[i] zero bytes."""
    value = value.copy()
    for b in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> b) & 1)
        value[at] = _after(POWERS[b], value[at])
    return value


def checksums(payloads: list[bytes | memoryview]) -> np.ndarray:
    """Masked CRC-32C of each payload, all of them at once: a checksum is linear in the bytes, so blocks of all payloads are looked up by place and summed."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    blocks = -(-sizes // WORD)
    pads = [bytes(int(n)) for n in blocks * WORD - sizes]
    cells = np.frombuffer(b"".join(x for pair in zip(pads, payloads) for x in pair), np.uint8).reshape(-1, WORD)
    rest = np.zeros(len(cells), np.uint32)
    for j in range(WORD):
        rest ^= PLACE[j][cells[:, j]]
    raw = np.zeros(len(sizes), np.uint32)
    if len(cells):
        ends = np.cumsum(blocks)
        rest = _shifted(rest, (np.repeat(ends, blocks) - 1 - np.arange(len(rest))) * WORD)
        full = np.flatnonzero(blocks)
        raw[full] = np.bitwise_xor.reduceat(rest, (ends - blocks)[full])
    ones = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    crc = raw ^ _shifted(ones, sizes) ^ ones
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record."""
    lengths = [LENGTH.pack(len(p)) for p in payloads]
    checks = checksums([*lengths, *payloads]).astype("<u4").tobytes()
    n = 4 * len(payloads)
    return [b"".join((size, checks[i : i + 4], p, checks[n + i : n + i + 4])) for i, size, p in zip(range(0, n, 4), lengths, payloads)]


def _verified(found: list[tuple[int, memoryview, memoryview, int, int]]) -> Iterator[tuple[int, memoryview]]:
    n = len(found)
    checks = checksums([f[1] for f in found] + [f[2] for f in found]).tolist()
    for i, (offset, _, payload, first, second) in enumerate(found):
        if checks[i] != first or checks[n + i] != second:
            raise ValueError(f"the record at offset {offset} does not match its checksums")
        yield offset, payload


def read_frames(data: bytes, offsets: list[int] | None = None) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of the records at the offsets given, or of all, one after another; a damaged one is an error."""
    view, held, size = memoryview(data), [], 0
    places = iter(offsets) if offsets is not None else None
    at = 0
    while True:
        if places is not None:
            at = next(places, len(view))
        if at >= len(view):
            break
        if at + FRAME > len(view):
            raise ValueError(f"the record at offset {at} is cut short")
        (n,) = LENGTH.unpack_from(view, at)
        body = at + LENGTH.size + CHECK.size
        if body + n + CHECK.size > len(view):
            raise ValueError(f"the record at offset {at} is cut short")
        held.append((at, view[at : at + LENGTH.size], view[body : body + n], CHECK.unpack_from(view, body - CHECK.size)[0], CHECK.unpack_from(view, body + n)[0]))
        size += n
        at = body + n + CHECK.size
        if size > 1 << 20:
            yield from _verified(held)
            held, size = [], 0
    yield from _verified(held)


def _parts_at_spaces(config: dict) -> bool:
    """Whether what stands before a space and after it is tokenized apart, and the space dropped."""
    first = config.get("pre_tokenizer") or {}
    if first.get("type") == "Sequence":
        first = first["pretokenizers"][0]
    if first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert") or first["pattern"].get("Regex") != APART:
        return False
    steps = config.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = steps["normalizers"] if steps["type"] == "Sequence" else [steps]
    plain = all(s["type"] in ("NFC", "NFD", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in config.get("added_tokens", []))


class Encoder:
    """The library's identifiers as bytes. Where a tokenizer drops spaces and never looks across one, each piece between spaces is encoded once and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.apart = _parts_at_spaces(config)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.ends = None
        if self.apart and (end := config["model"].get("end_of_word_suffix")):
            self.ends = np.zeros(1 << (8 * self.width) if self.width == 2 else self.library.get_vocab_size(), bool)
            self.ends[[i for name, i in config["model"]["vocab"].items() if name.endswith(end)]] = True

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        for i in range(0, len(texts), 1024):
            for e in self.library.encode_batch_fast(texts[i : i + 1024], add_special_tokens=False):
                yield np.array(e.ids, f"<u{self.width}").tobytes()

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Words that the tokenizer's pattern leaves whole, many in one text: the last token of each says so in its name."""
        for i in range(0, len(words), 512):
            some = words[i : i + 512]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, f"<u{self.width}")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                yield from self._encode(some)
                continue
            raw = ids.tobytes()
            at = [0, *(ends * self.width).tolist()]
            yield from (raw[x:y] for x, y in zip(at, at[1:]))

    def _joined(self, held: dict[str, bytes], lists: list[list[str]], encode) -> Iterator[bytes]:
        """Each list's entries as bytes end to end; those not held are encoded together, and held from then on."""
        every = set().union(*lists)
        if len(held) + len(every) > REMEMBERED:
            held.clear()
        new = list(every.difference(held))
        held.update(zip(new, encode(new)))
        look = held.__getitem__
        for entries in lists:
            yield b"".join(map(look, entries))
        for long in [e for e in new if len(e) > LONGEST]:
            del held[long]

    def _pieces(self, pieces: list[str]) -> Iterator[bytes]:
        """Pieces between spaces: those that are plain by their words, all others by themselves."""
        plain = [p for p in pieces if self._plain(p)]
        others = [p for p in pieces if not self._plain(p)]
        made = dict(zip(others, self._encode(others)))
        made.update(zip(plain, self._joined(self.words, [WORDS.findall(p.lower()) for p in plain], self._words)))
        return map(made.__getitem__, pieces)

    def _plain(self, text: str) -> bool:
        return self.ends is not None and PLAIN.fullmatch(text) is not None

    def _parts(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        by_word = self._joined(self.words, [WORDS.findall(t.lower()) for t, p in zip(texts, plain) if p], self._words)
        by_piece = self._joined(self.known, [t.replace("\n", " ").split(" ") for t, p in zip(texts, plain) if not p], self._pieces)
        # Words go first, as pieces use them too.
        done = list(by_word), list(by_piece)
        made = iter(done[0]), iter(done[1])
        return [next(made[0] if p else made[1]) for p in plain]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The identifiers of each text. Very long texts go in parts cut at spaces."""
        if not self.apart:
            return list(self._encode(texts))
        short = iter(self._parts([t for t in texts if len(t) <= PART]))
        return [next(short) if len(t) <= PART else b"".join(self._parts([part])[0] for part in _cut(t)) for t in texts]


def _cut(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        to = text.find(" ", at + PART)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to + 1


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SHARD_SCHEMA = "part int, shard int, width int, tokens long, data binary, ids array<long>, offsets array<long>, counts array<long>, starts array<long>"


def _writer(path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = np.array([end_id], f"<u{e.width}").tobytes()
        part, shard, tokens, size = 0, 0, 0, 0
        data: list[bytes] = []
        ids: list[int | None] = []
        counts: list[int] = []

        def row() -> pa.RecordBatch:
            sizes = np.array([len(d) for d in data], np.int64)
            n = np.array(counts, np.int64)
            cells = {
                "part": pa.array([part], pa.int32()),
                "shard": pa.array([shard], pa.int32()),
                "width": pa.array([e.width], pa.int32()),
                "tokens": pa.array([int(n.sum())], pa.int64()),
                "data": pa.array([b"".join(data)], pa.binary()),
                "ids": pa.array([ids], pa.list_(pa.int64())),
                "offsets": pa.array([np.cumsum(sizes) - sizes], pa.list_(pa.int64())),
                "counts": pa.array([n], pa.list_(pa.int64())),
                "starts": pa.array([tokens + np.cumsum(n) - n], pa.list_(pa.int64())),
            }
            return pa.record_batch(cells)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            payloads = [p + end for p in e.encode(batch.column(1).to_pylist())]
            for doc_id, payload, frame in zip(batch.column(0).to_pylist(), payloads, framed(payloads)):
                if data and size + len(frame) > shard_bytes:
                    yield row()
                    tokens += sum(counts)
                    shard, size = shard + 1, 0
                    data, ids, counts = [], [], []
                data.append(frame)
                ids.append(doc_id)
                counts.append(len(payload) // e.width)
                size += len(frame)
        if data:
            yield row()

    return run


@dataclass
class Store:
    """Record files (part, shard, width, data) and their index (doc_id, part, shard, offset, n_tokens, start)."""

    files: DataFrame
    index: DataFrame


def write_records(docs: DataFrame, tokenizer: str, end_id: int = END, shard_bytes: int = SHARD) -> Store:
    """Encodes the texts of docs, appends end_id to each, and writes records and index to the shared folder, in ascending order of doc_id.

    tokenizer: path of a tokenizers JSON file, present on every executor. A null text counts as empty: its record holds end_id alone. Rows without
    doc_id come first; rows equal in doc_id stand together, in the order of a hash of their texts. An empty table makes an
    empty store. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    # The place keeps rows that are repeated many times from meeting in one task.
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    made = stage(map_arrow(rows, _writer(tokenizer, end_id, shard_bytes), SHARD_SCHEMA), "records")
    parts = made.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stage(parts.select("part", F.coalesce(before, F.lit(0)).alias("base")), "parts")
    entries = made.select("part", "shard", F.inline(F.arrays_zip("ids", "offsets", "counts", "starts")))
    entries = entries.join(small(parts, BROADCAST_ROWS), "part")
    index = entries.select(
        F.col("ids").alias("doc_id"), "part", "shard", F.col("offsets").alias("offset"), F.col("counts").alias("n_tokens"), (F.col("base") + F.col("starts")).alias("start")
    )
    return Store(made.select("part", "shard", "width", "data"), stage(index, "index"))


def _reader(whole: bool):
    """whole: with identifiers; otherwise their number and the CRC-32 of them as four-byte integers. With a column of offsets, the records there alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for offset, payload in read_frames(row["data"], sorted(row["offsets"]) if "offsets" in row else None):
                    ids = np.frombuffer(payload, f"<u{row['width']}").astype("<u4")
                    held.append((row["part"], row["shard"], offset, ids if whole else (len(ids), zlib.crc32(ids.tobytes()))))
                    size += ids.nbytes if whole else 40
                    if size > 4 << 20:
                        yield _batch(held, whole)
                        held, size = [], 0
                if held:
                    yield _batch(held, whole)

    return run


def _batch(rows: list[tuple], whole: bool) -> pa.RecordBatch:
    part, shard, offset, found = zip(*rows)
    cells = {"part": pa.array(part, pa.int32()), "shard": pa.array(shard, pa.int32()), "offset": pa.array(offset, pa.int64())}
    if whole:
        return pa.record_batch(cells | {"tokens": pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))})
    n, crc = zip(*found)
    return pa.record_batch(cells | {"read_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})


WHOLE = "part int, shard int, offset long, tokens array<long>"
SUMMARY = "part int, shard int, offset long, read_tokens long, ids_crc32 long"
KEY = ["part", "shard", "offset"]


def read_records(store: Store) -> DataFrame:
    """doc_id, start, tokens of every record, its checksums verified."""
    found = map_arrow(store.files, _reader(True), WHOLE)
    return found.join(store.index, KEY).select("doc_id", "start", "tokens")


def read_some(store: Store, wanted: DataFrame) -> DataFrame:
    """doc_id, start, tokens of the index rows wanted. Files without any are not opened, nor are the other frames of those that have some."""
    wanted = stage(wanted.select("doc_id", *KEY, "start"), "wanted")
    places = wanted.groupBy("part", "shard").agg(F.collect_list("offset").alias("offsets"))
    files = store.files.join(small(wanted.select("part", "shard").distinct(), BROADCAST_ROWS), ["part", "shard"], "left_semi")
    found = map_arrow(files.join(places, ["part", "shard"]), _reader(True), WHOLE)
    return found.join(wanted, KEY).select("doc_id", "start", "tokens")


def read_shuffled(store: Store, seed: int = 0, share: float = 1.0) -> DataFrame:
    """As read_some, of a share of the records drawn by seed, in an order that depends on seed and place alone."""
    drawn = F.xxhash64(F.lit(seed), F.col("start"))
    wanted = store.index.where(F.pmod(drawn, F.lit(1_000_000)) < round(share * 1_000_000))
    return read_some(store, wanted).orderBy(F.xxhash64(F.lit(seed), F.lit("order"), F.col("start")), "start")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END, shard_bytes: int = SHARD) -> DataFrame:
    """Writes records and reads them back: doc_id, start, n_tokens, ids_crc32. A record whose length is not the index's is an error."""
    store = write_records(docs, tokenizer, end_id, shard_bytes)
    found = map_arrow(store.files, _reader(False), SUMMARY).join(store.index, KEY, "full")
    wrong = F.raise_error(F.lit("records and index differ"))
    n = F.when(F.col("read_tokens") == F.col("n_tokens"), F.col("read_tokens")).otherwise(wrong.cast("long"))
    return found.select("doc_id", "start", n.alias("n_tokens"), "ids_crc32")


def export(store: Store, folder: str) -> list[str]:
    """Writes the files one by one to a folder of the driver, in order; for small stores."""
    names = []
    for i, row in enumerate(store.files.orderBy("part", "shard").select("data").toLocalIterator()):
        names.append(os.path.join(folder, f"tokens-{i:05d}.rec"))
        with open(names[-1], "wb") as f:
            f.write(row.data)
    return names
