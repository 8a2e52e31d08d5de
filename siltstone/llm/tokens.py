"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens by the vocabulary's pattern. All pre-tokens of a batch that a worker has
not counted before lie end to end in one array of symbols; in each round every pre-token applies its
own lowest-ranked pair, at all its places at once, and pre-tokens without a pair leave the array with
the number of symbols they have left. A bounded table in each worker remembers counts of pre-tokens.

A long pre-token is merged on its own in the same rounds, but with its places held by rank, so that a round touches
only the places that merge and their neighbours, not the whole array.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import map_arrow

#: Splits text before merging; the public byte-level pattern, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts a worker remembers, and the longest pre-token (characters) it remembers.
REMEMBERED = 1 << 20
LONGEST = 64
#: Bytes from which a pre-token is merged on its own.
LONG = 1024
#: Pre-tokens taken from a text at once, and characters of texts handled together.
CHUNK = 1 << 16
TOGETHER = 1 << 20

_NO_PAIR = np.int64(1 << 40)


class Merger:
    """The merge table of a tokenizers JSON file: byte-level BPE, whole words never ignored."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = {"dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"}
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix space and normalizer is supported")
        if any(model.get(k) for k in plain) or model.get("ignore_merges") or len(model["vocab"]) > 1 << 16:
            raise ValueError("the model has options that merging by rank alone does not cover")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for b, c in _byte_letters().items():
            self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.int64)
        self.rank_to_id = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        # The rank at which a symbol may merge further at least. Where that is below the rank that made it, places of
        # that rank merge one by one from the left, as a further merge comes before the next place.
        further = np.full(1 << 16, _NO_PAIR)
        for side in (key >> 16, key & 0xFFFF):
            np.minimum.at(further, side, np.arange(len(key)))
        self.one_by_one = further[self.rank_to_id] < np.arange(len(key))
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NO_PAIR where they do not merge."""
        key = (left.astype(np.int64) << 16) | right
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[place] == key, self.ranks[place], _NO_PAIR)

    def merge_long(self, sequence: bytes) -> int:
        """Symbols left of one sequence after all merges."""
        symbol = self.byte_id[np.frombuffer(sequence, np.uint8)].astype(np.int32)
        n = left = len(symbol)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = np.full(n, _NO_PAIR)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Ranks the pairs that begin at these places anew and files them by rank."""
            at = at[after[at] < n]
            found = self.rank_of(symbol[at], symbol[after[at]])
            rank[at] = found
            at, found = at[found < _NO_PAIR], found[found < _NO_PAIR]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else []
            for r, part in zip(found[cuts].tolist() if len(found) else [], np.split(at, cuts[1:]) if len(found) else []):
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(part)

        enter(np.arange(n, dtype=np.int32))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.one_by_one[r] and len(at) > 1:
                waiting[r] = [at[1:]]
                heapq.heappush(heap, r)
                at = at[:1]
            # In a run such as x x x the same pair stands at neighbouring places: every second one merges.
            twin = np.r_[False, after[at[:-1]] == at[1:]]
            if twin.any():
                index = np.arange(len(at))
                at = at[(index - np.maximum.accumulate(np.where(twin, 0, index))) % 2 == 0]
            gone = after[at]
            symbol[at] = self.rank_to_id[r]
            rank[at], rank[gone] = _NO_PAIR, _NO_PAIR
            after[at] = after[gone]
            linked = after[at] < n
            before[after[at][linked]] = at[linked]
            left -= len(at)
            earlier = before[at]
            enter(np.unique(np.concatenate([at, earlier[earlier >= 0]])))
        return left

    def merge(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each sequence after all merges."""
        left = np.zeros(len(sequences), np.int64)
        short = [i for i, x in enumerate(sequences) if len(x) < LONG]
        left[short] = self._merge_together([sequences[i] for i in short])
        for i, x in enumerate(sequences):
            if len(x) >= LONG:
                left[i] = self.merge_long(x)
        return left

    def _merge_together(self, sequences: list[bytes]) -> np.ndarray:
        n = len(sequences)
        left = np.fromiter(map(len, sequences), np.int64, n)
        at = np.repeat(np.arange(n), left)
        symbol = self.byte_id[np.frombuffer(b"".join(sequences), np.uint8)]
        while len(symbol) > 1:
            rank = np.where(at[:-1] == at[1:], self.rank_of(symbol[:-1], symbol[1:]), _NO_PAIR)
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            lowest = np.minimum.reduceat(np.append(rank, _NO_PAIR), starts)
            size = np.diff(np.append(starts, len(at)))
            best = np.repeat(lowest, size)[:-1]
            take = (rank == best) & (rank < _NO_PAIR)
            # In a run such as x x x the same pair stands at neighbouring places: every second one merges.
            twin = np.flatnonzero(take[1:] & take[:-1]) + 1
            if len(twin):
                index = np.arange(len(take))
                begin = np.maximum.accumulate(np.where(take & ~np.r_[False, take[:-1]], index, 0))
                take &= (index - begin) % 2 == 0
            where = np.flatnonzero(take)
            single = self.one_by_one[rank[where]]
            if single.any():
                first = np.r_[True, at[where[1:]] != at[where[:-1]]] if len(where) else single
                where = where[~single | first]
            symbol[where] = self.rank_to_id[rank[where]]
            keep = np.ones(len(symbol), bool)
            keep[where + 1] = False
            done = np.repeat(lowest >= _NO_PAIR, size)
            ended = at[starts[lowest >= _NO_PAIR]]
            left[ended] = size[lowest >= _NO_PAIR]
            keep &= ~done
            symbol, at = symbol[keep], at[keep]
        if len(symbol):
            left[at[0]] = 1
        return left

    def _counts(self, words: set[str]) -> dict[str, int]:
        listed = sorted(words)
        return dict(zip(listed, self.merge([w.encode("utf-8", "surrogatepass") for w in listed]).tolist()))

    def _chunks(self, texts: list[str]) -> Iterator[tuple[int, list[str]]]:
        for i, text in enumerate(texts):
            for piece in self.special.split(text) if self.special else [text]:
                if len(piece) < CHUNK:
                    yield i, self.pattern.findall(piece)
                else:
                    found = (m.group() for m in self.pattern.finditer(piece))
                    while part := list(islice(found, CHUNK)):
                        yield i, part

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; added tokens inside a text are one token each."""
        totals = [len(self.special.findall(t)) if self.special else 0 for t in texts]
        held: list[tuple[int, list[str]]] = []
        n_held = 0
        for i, words in self._chunks(texts):
            held.append((i, words))
            n_held += len(words)
            if n_held >= CHUNK * 4:
                self._settle(held, totals)
                held, n_held = [], 0
        self._settle(held, totals)
        return totals

    def _settle(self, held: list[tuple[int, list[str]]], totals: list[int]) -> None:
        every = set().union(*(words for _, words in held))
        long = {w for w in every if len(w) > LONGEST}
        every -= long
        new = {w for w in every if w not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = every
        self.known.update(self._counts(new))
        known = {w: self.known[w] for w in every} | self._counts(long) if long else self.known
        look = known.__getitem__
        for i, words in held:
            totals[i] += sum(map(look, words))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            counts = m.count([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). One pass, no shuffle.

    vocabulary: path of a tokenizers JSON file, present on every executor. A null text counts as empty:
    no bytes, no tokens. Repeated rows give repeated results, a null doc_id stays null, other columns
    are ignored, an empty table gives no rows.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").alias("text"),
        F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"),
    )
    counted = map_arrow(rows, _counter(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
