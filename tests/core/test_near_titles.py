import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.operators import resolution

SCHEMA = "ord long, title string, publication_year int, authors array<string>"


def found(df):
    return sorted(map(tuple, resolution.near_title_pairs(df).collect()))


def by_all_pairs(rows):
    out = set()
    for a, x, year, left in rows:
        for b, y, other, right in rows:
            if a is None or b is None or a >= b or year is None or year != other or not x or not y or x == y:
                continue
            u, v = set(x.split()), set(y.split())
            if min(len(u), len(v)) >= 5 and len(u & v) / len(u | v) >= 0.9 and t.authors_match(left, right) and difflib.SequenceMatcher(None, x, y).ratio() >= 0.96:
                out.add((a, b))
    return sorted(out)


def edited(rng, words):
    words, at = list(words), rng.randrange(len(words))
    how = rng.randrange(5)
    if how == 0:
        words[at] += "s"
    elif how == 1:
        words.insert(at, rng.choice("abcdefg") * 3)
    elif how == 2 and len(words) > 5:
        del words[at]
    elif how == 3:
        words.append(words[0])
    return words


@pytest.fixture(scope="module")
def records():
    rng = random.Random(5)
    people = [*[["Ann Lee"], ["Lee, Ann"]] * 3, ["Ann Lee", "Bo Ray"], ["B. Ray", "A. Lee"], ["Cy Day"], ["Some Institute"], [], None]
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for base in range(14):
        words = rng.choices(vocabulary, k=[5, 8, 9, 10, 12, 18, 19, 20, 30, 45, 60, 90, 140, 250][base])
        for _ in range(20):
            for _ in range(rng.randrange(3)):
                words_of = edited(rng, words)
                rows.append((" ".join(words_of), rng.choice([2000, 2000, 2000, 2001, None]), rng.choice(people)))
            if rng.random() < 0.5:
                rows.append((" ".join(words), 2000, rng.choice(people)))
            if rng.random() < 0.3:
                words = edited(rng, words)
    rows += [(None, 2000, ["Ann Lee"]), ("", 2000, ["Ann Lee"]), ("a b c d", 2000, ["Ann Lee"])] * 2
    rng.shuffle(rows)
    return [(i if i % 50 else None, *r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_near_titles_equal_all_pairs(spark, records, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(resolution, "BROADCAST_IDS", -1)
        monkeypatch.setattr(resolution, "BROADCAST_CHARS", -1)
    want = by_all_pairs(records)
    assert len(want) > 100 and found(spark.createDataFrame(records, SCHEMA)) == want
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_records_repeated_whole_stay_in_their_pairs(spark, records):
    df = spark.createDataFrame(records, SCHEMA)
    assert found(df.unionByName(df.where("ord % 3 = 0"))) == by_all_pairs(records)


def test_authors_are_compared_once_for_all_copies_of_two_titles(spark, monkeypatch):
    compared = spark.sparkContext.accumulator(0)

    @F.pandas_udf("boolean")
    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        compared.add(len(a))
        return pd.Series([t.authors_match(list(x), list(y)) for x, y in zip(a, b)], dtype="bool")

    monkeypatch.setattr(t, "same_authors", counted)
    title = "a study of deep river networks for coastal flood forecasting under climate stress alpha beta gamma delta epsilon zeta eta theta"
    rows = [(i, title if i % 2 else title.replace("networks", "network"), 2000, ["Ann Lee"]) for i in range(80)]
    assert len(found(spark.createDataFrame(rows, SCHEMA))) == 40 * 40
    assert compared.value <= 2


def test_titles_that_agree_are_of_one_class_or_the_next_and_cut_into_a_part_more_than_they_differ_in():
    least, cuts = resolution._sizes()
    a = np.arange(resolution.MIN_WORDS, 100_000)
    b = a * 10 // 9
    kind = lambda n: np.searchsorted(least, n, "right") - 1
    assert (kind(b) - kind(a) <= 1).all() and ((a + b) // 19 < cuts[kind(a)]).all()
