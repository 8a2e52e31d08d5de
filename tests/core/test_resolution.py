import random
import time

import pandas as pd
import pytest

from siltstone.functions import text as t
from siltstone.operators import resolution

SCHEMA = (
    "ord long, id string, title string, abstract string, authors array<string>, publication_year int, publication_date date, doi string,"
    " doi_aliases array<string>, openalex_id string, openalex_aliases array<string>, referenced_work_ids array<string>, work_type string,"
    " citation_count int, source string, url string, full_text_locations array<struct<url:string,source_format:string>>"
)


def make(spark, *records):
    rows = []
    for i, r in enumerate(records):
        base = dict(
            ord=i, id=f"p{i}", title="T", abstract=None, authors=[], publication_year=None, publication_date=None, doi=None, doi_aliases=[], openalex_id=None,
            openalex_aliases=[], referenced_work_ids=[], work_type=None, citation_count=0, source=None, url=None, full_text_locations=[],
        )
        rows.append(tuple((base | r).values()))
    return spark.createDataFrame(rows, SCHEMA)


def works(df):
    return resolution.deduplicate(df).orderBy("ord").collect()


LONG = "a study of deep river networks for coastal flood forecasting under climate stress"


def test_identifiers_join_transitively(spark):
    rows = works(make(
        spark, dict(openalex_id="https://openalex.org/W1", doi="10.1/A"), dict(doi="https://doi.org/10.1/a/", openalex_id="W2"),
        dict(openalex_id="openalex: W2", citation_count=9), dict(openalex_id="W3"),
    ))
    assert [(r.ord, r.n_records) for r in rows] == [(0, 3), (3, 1)]
    assert rows[0].openalex_aliases == ["https://openalex.org/W1", "https://openalex.org/W2"] and rows[0].doi_aliases == ["https://doi.org/10.1/a"]
    assert rows[0].citation_count == 9


def test_title_and_year_guarded_by_dois(spark):
    same = dict(title="Rivers, and Floods!", publication_year=2020)
    rows = works(make(spark, same, same | dict(doi="10.1/x"), same | dict(doi="10.1/y"), same))
    assert [r.n_records for r in rows] == [3, 1]
    authors = dict(authors=["José Núñez", "Ann B. Lee"])
    rows = works(make(spark, same | authors | dict(doi="10.1/x"), same | dict(doi="10.1/y", authors=["Nunez, Jose", "Lee, Ann"])))
    assert [r.n_records for r in rows] == [2]
    rows = works(make(spark, same | authors | dict(doi="10.1/x"), same | dict(doi="10.1/y", authors=["Bob Ray", "Eve Day"])))
    assert [r.n_records for r in rows] == [1, 1]
    rows = works(make(spark, dict(title="Untitled", publication_year=2020), dict(title="untitled", publication_year=2020), dict(title="Alone"), dict(title="alone")))
    assert len(rows) == 4


@pytest.mark.parametrize(("change", "n"), [({}, 1), ({"authors": ["Bob Ray", "Eve Day"]}, 2), ({"publication_year": 2021}, 2), ({"title": LONG.replace("coastal", "urban")}, 2)])
def test_near_titles(spark, change, n):
    one = dict(title=LONG, authors=["Ann Lee", "Jo Ray"], publication_year=2020)
    words = LONG + " alpha beta gamma delta epsilon zeta eta theta"
    a, b = one | dict(title=words), one | dict(title=words.replace("networks", "network"))
    if "title" in change:
        a, b = one, one
    assert len(works(make(spark, a, b | change))) == n


def test_merge_takes_the_best_of_each_record(spark):
    rows = works(make(
        spark,
        dict(openalex_id="W1", title="Short", work_type="preprint", abstract="the longest abstract of all three records here", authors=["J. Doe", "Acme Institute"], full_text_locations=[("http://a/", "pdf")]),
        dict(openalex_id="W1", openalex_aliases=["W7"], title="A longer title", work_type="article", abstract="brief", doi="10.5/q", authors=["Jane Doe", "Äda Lo"], source="Journal", full_text_locations=[("HTTP://A", "pdf"), ("http://b", "xml")]),
        dict(openalex_id="W7", title="Mid title", citation_count=4, referenced_work_ids=["W5", "https://openalex.org/w5", "W6"], url="http://u"),
    ))
    (r,) = rows
    assert r.title == "A longer title" and r.abstract.startswith("the longest") and r.work_type == "article" and r.source == "Journal" and r.url == "http://u"
    assert r.authors == ["Jane Doe", "Äda Lo", "Acme Institute"] and r.citation_count == 4 and r.doi == "10.5/q" and r.id == "W1"
    assert r.referenced_work_ids == ["https://openalex.org/W5", "https://openalex.org/W6"] and r.location_urls == ["HTTP://A", "http://b"]
    assert works(make(spark).limit(0)) == []


def test_names():
    assert t.names_match(t.author_tokens("Jane Q. Doe"), t.author_tokens("Doe, Jane"))
    assert t.names_match(t.author_tokens("J. Doe"), t.author_tokens("Jane Doe")) and not t.names_match(t.author_tokens("J. Doe"), t.author_tokens("Kim Doe"))
    assert t.author_tokens("Plato") == [] and t.author_tokens("Flood Research Group") == [] and t.author_tokens("Ann 2 Lee") == []
    assert t.authors_match(["Ann Lee"], ["Lee, Ann"]) and not t.authors_match(["Ann Lee", "Bo Ray"], ["Ann Lee", "Cy Day"])


def test_canonicalise_against_references(spark):
    refs = make(spark, dict(id="R0", openalex_id="W1", title="One", publication_year=2000), dict(id="R1", title="Two words", publication_year=2001))
    new = make(spark, dict(doi="10/1", openalex_aliases=["W1"]), dict(title="two, words", publication_year=2001), dict(title="else", publication_year=2001))
    got = [r.reference_id for r in resolution.canonicalise(new, refs).orderBy("ord").collect()]
    assert got == ["R0", "R1", None]


def by_all_pairs(rows, near):
    """decide_block as it reads: every record against all known clusters of its title, then against all records before it."""
    rows = rows.sort_values("ord")
    order = rows["ord"].tolist()
    parent = dict(zip(order, rows["root"]))
    dois, authors = dict(zip(order, rows["dois"])), dict(zip(order, rows["authors"]))
    of = lambda r: [o for o in order if parent[o] == r]

    def fits(x, y):
        a, b = (set().union(*(dois[o] for o in of(r))) for r in (x, y))
        return not a or not b or bool(a & b) or any(t.authors_match(authors[i], authors[j]) for i in of(x) for j in of(y))

    def join(x, y):
        for o in of(max(x, y)):
            parent[o] = min(x, y)

    known = {}
    for o, identity in zip(order, rows["title_year"]):
        if identity is None:
            continue
        for other in known.setdefault(identity, []):
            if parent[o] == parent[other]:
                break
            if fits(parent[o], parent[other]):
                join(parent[o], parent[other])
                break
        else:
            known[identity].append(parent[o])
    for i, o in enumerate(order):
        for other in order[:i]:
            if parent[o] != parent[other] and (other, o) in near and fits(parent[o], parent[other]):
                join(parent[o], parent[other])
                break
    return parent


def test_blocks_equal_all_pairs():
    rng = random.Random(5)
    people = ["Ann Lee", "Jo Ray", "Bob Day", "Eve Lee", "Al Wu", "Lee Ann", "MIT", "A. Lee"]
    for _ in range(300):
        n = rng.randint(1, 14)
        roots = []
        for i in range(n):
            roots.append(roots[rng.randrange(i)] if i and rng.random() < 0.2 else i)
        rows = pd.DataFrame({
            "ord": range(n), "root": roots, "title_year": [rng.choice(["a", "a", "b", None]) for _ in range(n)],
            "dois": [[f"10.1/{rng.randrange(9)}"] if rng.random() < 0.7 else [] for _ in range(n)],
            "authors": [rng.sample(people, rng.randint(0, 3)) for _ in range(n)],
        })
        near = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 6))} if n > 1 else set()
        # Records that share a DOI are one cluster before blocks are decided.
        first = {}
        for i, d in enumerate(rows["dois"]):
            for x in d:
                first.setdefault(x, rows["root"][i])
        rows["root"] = [min([rows["root"][i], *(first[x] for x in d)]) for i, d in enumerate(rows["dois"])]
        assert resolution.decide_block(rows, near) == by_all_pairs(rows, near)


def test_a_title_of_many_works_takes_seconds():
    n = 30_000
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = pd.DataFrame({"ord": range(n), "root": range(n), "title_year": "t|2020", "dois": [[f"10.1/{i}"] for i in range(n)], "authors": [[f"x{name(i)} y{name(i)}", f"p{name(i)} q{name(i)}"] for i in range(n)]})
    started = time.monotonic()
    assert len(set(resolution.decide_block(rows, set()).values())) == n
    assert time.monotonic() - started < 20


BLOCK = "block long, ord long, root long, title_year string, dois array<string>, authors array<string>"


def _blocks(seed, n=260):
    """Three blocks of clusters that share titles, some over several titles, some without a DOI; and near titles within a block."""
    rng = random.Random(seed)
    names = ["Ann Lee", "Bo Lee", "Ann Ray", "Cy Moss", "Di Fox", "A. Ray", "Ed Gray", "Flo Hay", "Gus Ives", "Hal Jay"]
    rows, roots = [], {}
    for i in range(n):
        block = rng.randrange(3)
        mine = [r for r in roots if roots[r][0] == block]
        root = rng.choice(mine) if mine and rng.random() < 0.3 else i
        title = None if rng.random() < 0.05 else f"t{block}{rng.randrange(3)}|2020"
        own = roots.setdefault(root, (block, f"10.1/{root}" if rng.random() < 0.6 else None))[1]
        rows.append((block, i, root, title, [own] if own and rng.random() < 0.8 else [], rng.sample(names, rng.choice([0, 1, 1, 2, 2, 3]))))
    at = [r[0] for r in rows]
    near = {(a, b) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(25)) if at[a] == at[b]}
    return rows, near


@pytest.mark.parametrize("seed", range(4))
def test_split_blocks_are_decided_as_whole_ones(spark, seed):
    rows, near = _blocks(seed)
    df, links = spark.createDataFrame(rows, BLOCK), spark.createDataFrame(sorted(near), "left long, right long")
    want = {}
    for block in range(3):
        mine = pd.DataFrame([r[1:] for r in rows if r[0] == block], columns=["ord", "root", "title_year", "dois", "authors"])
        want |= resolution.decide_block(mine, {p for p in near if rows[p[0]][0] == block})
    for large in (0, 10_000):
        assert {r.ord: r.root for r in resolution.decide(df, links, large).collect()} == want


def test_a_title_of_many_works_is_decided_in_many_parts(spark):
    """5,000 works of one title, five with the same first author; and as many records that only repeat a title."""
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(0, i, i, "t|2020", [f"10.1/{i}"], [f"x{name(i % 4995)} y{name(i % 4995)}"]) for i in range(5000)]
    df, none = spark.createDataFrame(rows, BLOCK), spark.createDataFrame([], "left long, right long")
    parts = resolution.split_blocks(df, none).groupBy("part").count()
    assert parts.count() == 4995 and parts.agg({"count": "max"}).first()[0] == 2
    bare = spark.createDataFrame([(0, 5000 + i, 5000 + i, "t|2020", [], []) for i in range(5000)], BLOCK)
    kept, again = resolution._folded(df.unionByName(bare), none)
    assert again.count() == 4999 and kept.count() == 5001
    got = {r.ord: r.root for r in resolution.decide(df.unionByName(bare), none, 1_000).collect()}
    assert len(got) == 10_000 and len(set(got.values())) == 4995 and {got[5000 + i] for i in range(5000)} == {0}
