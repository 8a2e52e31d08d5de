import json
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


HARD = [
    "",
    " ",
    "a" * 3000,
    " " * 2000,
    "ab" * 2000,
    "x<|endoftext|>y <|endoftext|><|endoftext|",
    "aaaa aaa aa a",
    "don't can't we'll I'VE",
    "日本語 ñandú ß 😀😀😀 \x1c\x85\xa0end  \n\n\t x",
    "!" * 999 + "\r\n" * 50,
]


def test_counts_equal_the_library():
    rng = random.Random(7)
    texts = HARD + ["".join(rng.choice("aab cé\n'st09.!  日") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    assert tokens.merger(PATH).count(texts) == library(texts)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert tokens.merger(PATH).count([text]) == library([text])


def test_chunks_and_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 5)
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "LONGEST", 3)
    texts = HARD + ["the quick brown fox jumps over the lazy dog " * 9]
    assert tokens.Merger(PATH).count(texts) == library(texts)


def test_query(spark):
    texts = [None, "", "a b", "word " * 2000, "a b"]
    df = spark.createDataFrame([(i if i < 4 else 2, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    rows = tokens.count_tokens(df, PATH).collect()
    want = sorted(zip([0, 1, 2, 3, 2], [0, 0, 3, 10000, 3], library(texts), [n > 1024 for n in library(texts)]))
    assert sorted(map(tuple, rows)) == want
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.Merger(public_tokenizers.path("word_bpe_49k.json"))


def test_long_pretokens_take_seconds():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(200_000)), "ab" * 100_000, "the" * 40_000 + "😀" * 9_000]
    started = time.monotonic()
    counts = tokens.Merger(PATH).count(texts)
    assert time.monotonic() - started < 20
    assert counts == library(texts)


@pytest.mark.parametrize("long", [2, 1024])
def test_symbols_made_twice(tmp_path, monkeypatch, long):
    """A symbol that a later merge makes again may merge further at once, before other places of that rank."""
    letters = sorted(tokens._byte_letters().values())
    merges = [["a", "b"], ["ab", "c"], ["abc", "a"], ["abc", "d"], ["b", "c"], ["a", "bc"], ["abca", "bc"], ["d", "d"]]
    vocab = {x: i for i, x in enumerate(dict.fromkeys([*letters, *("".join(m) for m in merges)]))}
    spec = json.loads(LIBRARY.to_str())
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "made.json"
    path.write_text(json.dumps(spec))
    made = Tokenizer.from_file(str(path))
    monkeypatch.setattr(tokens, "LONG", long)
    merger = tokens.Merger(str(path))
    assert merger.one_by_one.any()
    rng = random.Random(long)
    texts = ["".join(rng.choice("aabbccd") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    assert merger.count(texts) == [len(e.ids) for e in made.encode_batch(texts, add_special_tokens=False)]
