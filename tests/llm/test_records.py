import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import records

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text, tokenizer=LIBRARY):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc32c(data):
    """Bit by bit."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def masked(crc):
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


TEXTS = [
    None, "", " ", "\n \n", "a", "Hello  World\n\nthe END.", "don't can't WE'LL I'VE ' 's", "x<|endoftext|>y <|startoftext|> <|endoftext|", "á ́b ́", "İSTANBUL ΣΑΣ ΣΑΣ. ß",
    "日本語 ñandú 😀😀 \x1c\x85\xa0end  　x", "word " * 3000, "unbroken" * 500, "12 345 6,7", "a ̧́c", "ᄀ ᅡ", "tab\tand\rreturn\x0bend", "Ω K Å ﬁ",
]


def test_checksums_equal_those_of_single_bits():
    assert crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    some = [rng.bytes(n) for n in (0, 1, 2, 63, 64, 65, 127, 128, 129, 1000, 4097)] + [b"", bytes(200), b"\xff" * 200]
    assert records.checksums(some).tolist() == [masked(crc32c(s)) for s in some]
    assert records.checksums([]).tolist() == [] and records.checksums([b""]).tolist() == [masked(crc32c(b""))]


def test_frames_and_damage():
    rng = np.random.default_rng(2)
    some = [rng.bytes(n) for n in (0, 5, 300, 64)]
    frames = records.framed(some)
    data = b"".join(frames)
    assert frames[1] == (5).to_bytes(8, "little") + masked(crc32c((5).to_bytes(8, "little"))).to_bytes(4, "little") + some[1] + masked(crc32c(some[1])).to_bytes(4, "little")
    at = np.cumsum([0, *map(len, frames)]).tolist()
    assert [(o, bytes(p)) for o, p in records.read_frames(data)] == list(zip(at, some))
    assert [bytes(p) for _, p in records.read_frames(data, [at[2], at[0]])] == [some[2], some[0]]
    for i in (3, 9, at[1] + 13, at[2] - 2, len(data) - 1):
        bad = bytearray(data)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            list(records.read_frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.read_frames(data[:-3]))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(min_codepoint=0, max_codepoint=0x250), st.characters(codec="utf-8"), st.sampled_from(" \n'́̇aSt<|>")), max_size=40))
def test_pieces_equal_the_whole(text):
    assert np.frombuffer(records.encoder(PATH).encode([text])[0], "<u2").tolist() == library(text)


def test_long_texts_and_forgetting(monkeypatch):
    monkeypatch.setattr(records, "PART", 20)
    monkeypatch.setattr(records, "REMEMBERED", 9)
    monkeypatch.setattr(records, "LONGEST", 4)
    e = records.Encoder(PATH)
    for _ in range(2):
        assert [np.frombuffer(b, "<u2").tolist() for b in e.encode([t or "" for t in TEXTS])] == [library(t) for t in TEXTS]


def test_every_plain_letter_and_mixed_words():
    letters = [chr(c) for c in range(0x180) if records.PLAIN.fullmatch(chr(c))]
    assert len(letters) > 240 and "İ" not in letters and "<" not in letters
    texts = [f"a{c}b {c}{c} {c}'s x{c}1{c} {c},{c}" for c in letters] + ["é1İ2 ß", "Ÿ ſt Ĳ ŉ", "it's IT'S ''s '' ' 't1"]
    assert [np.frombuffer(b, "<u2").tolist() for b in records.Encoder(PATH).encode(texts)] == [library(t) for t in texts]


def test_other_tokenizers_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    e = records.Encoder(path)
    assert not e.apart and records.encoder(PATH).apart
    whole = Tokenizer.from_file(path)
    assert [np.frombuffer(b, "<u2").tolist() for b in e.encode([t or "" for t in TEXTS])] == [library(t, whole) for t in TEXTS]


def want(rows):
    """Rows in order, by a loop."""
    out, start = [], 0
    for i, t in rows:
        ids = [*library(t), 2]
        out.append((i, start, ids))
        start += len(ids)
    return out


def test_round_trip_equals_a_loop(spark):
    rng = random.Random(4)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta", "été", "x1"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    rows = [(7 * i - 50, t, i) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(5)
    made = want(sorted((i, t) for i, t, _ in rows))
    flat = [(i, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, s, ids in made]
    for shard in (records.SHARD, 300, 1):
        assert sorted(map(tuple, records.round_trip(df, PATH, shard_bytes=shard).collect())) == flat
    store = records.write_records(df, PATH, shard_bytes=2000)
    assert store.files.count() > 4
    assert [(r.doc_id, r.start, r.tokens) for r in records.read_records(store).orderBy("start").collect()] == made
    few = store.index.where("doc_id % 5 = 0")
    assert [(r.doc_id, r.start, r.tokens) for r in records.read_some(store, few).orderBy("start").collect()] == [m for m in made if m[0] % 5 == 0]
    one, two, again = (records.read_shuffled(store, s).collect() for s in (1, 2, 1))
    assert one == again and one != two and sorted((r.doc_id, r.start, r.tokens) for r in two) == made and [r.start for r in one] != sorted(r.start for r in one)
    assert 0 < records.read_shuffled(store, 3, share=0.3).count() < 150


def test_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, part int, data string"
    rows = [(None, "b", 1, ""), (None, None, 1, ""), (3, "same text", 1, ""), (3, "same text", 1, ""), (3, "other", 2, ""), (1, "", 0, None)]
    got = sorted(tuple(r) for r in records.round_trip(spark.createDataFrame(rows, schema), PATH).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()
    assert [r[1] for r in got] == [None, None, 1, 3, 3, 3]
    assert sorted(r[2:] for r in got) == sorted((len(library(t)) + 1, zlib.crc32(np.array([*library(t), 2], "<u4").tobytes())) for _, t, *_ in rows)
    assert records.round_trip(spark.createDataFrame([], schema), PATH).count() == 0
    store = records.write_records(spark.createDataFrame(rows, schema), PATH, shard_bytes=30)
    read = [p for name in records.export(store, str(tmp_path)) for _, p in records.read_frames(open(name, "rb").read())]
    assert len(read) == 6


def test_a_third_of_all_rows_equal(spark):
    rows = [(5 if i % 3 == 0 else i, "same" if i % 3 == 0 else f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = records.write_records(df, PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.index.where("doc_id = 5").select("part").distinct().count() > 1
    got = records.round_trip(df, PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
