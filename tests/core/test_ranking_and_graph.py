import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as t
from siltstone.functions import vectors as v
from siltstone.operators import graph, ranking, retrieval

STOP = {"a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "using", "with"}


def toks(text):
    import re

    words = re.findall(r"[^\W_]+(?:[+#][^\W_]*)*", re.sub(r"[-./]", " ", (text or "").casefold()))
    return [w for w in words if w not in STOP] or words


def brute(papers, query, k1=1.2, b=0.75):
    q = list(dict.fromkeys(toks(query)))
    docs = [(toks(x), toks(y)) for _, x, y in papers]
    bags = [x * 3 + y for x, y in docs]
    avg = sum(map(len, bags)) / len(bags) or 1.0
    out = []
    for (x, y), bag in zip(docs, bags):
        s = 0.0
        for w in q:
            df, tf = sum(w in d for d in bags), bag.count(w)
            s += math.log(1 + (len(bags) - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(bag) / avg)) if tf else 0
        s += 1.5 * len(set(q) & set(x)) / len(q) + 0.5 * len(set(q) & set(y)) / len(q)
        phrase = " ".join(toks(query))
        s += 2.0 if phrase in " ".join(x) else 0.75 if phrase in " ".join(y) else 0.0
        out.append(s)
    return out


PAPERS = [
    (1, "C++ for the river", "graph networks and C# in floods"), (2, "The of and", None), (3, "River floods, river-floods", "networks"), (4, "concatenate", "a cat"), (5, "", ""),
    (6, "Straße study", "deep river flood forecasting networks"),
]


@pytest.mark.parametrize("query", ["river floods", "cat", "the", "C++ networks river", "flood forecasting networks", "strasse", "networks floods river graph"])
def test_bm25_equals_brute_force(spark, query):
    papers = spark.createDataFrame(PAPERS, "id int, title string, abstract string")
    got = {r.id: r.lexical_raw_score for r in ranking.bm25(papers, spark.createDataFrame([(0, query)], "query_id int, text string")).collect()}
    for (i, _, _), want in zip(PAPERS, brute(PAPERS, query)):
        assert got.get(i, 0.0) == pytest.approx(want, abs=1e-9)


def test_scaling_fusion_and_boost(spark):
    rows = spark.createDataFrame([(1, 1, 2.0, 0.1), (1, 2, 2.0, 0.9), (2, 1, 0.0, None), (2, 2, 0.0, None), (3, 1, 5.0, None), (3, 2, 1.0, None)], "query_id int, id int, lexical_raw_score double, semantic_raw_score double")
    got = {(r.query_id, r.id): r for r in ranking.fuse(rows).collect()}
    assert got[1, 1].lexical_score == 1.0 and got[1, 2].final_score == pytest.approx(1.0) and got[1, 1].final_score == pytest.approx(0.4)
    assert got[2, 1].lexical_score == 0.0 and got[2, 1].ranking_mode == "lexical_only" and got[3, 1].final_score == 1.0
    con = spark.createDataFrame([(3, 0, 1, 0.0), (3, 0, 2, 1.0)], "query_id int, constraint_id int, id int, score double")
    out = {(r.query_id, r.id): r for r in ranking.boost(ranking.fuse(rows), con).collect()}
    assert out[3, 1].final_score == 1.0 and out[3, 2].final_score == 0.0 and out[1, 1].constraint_score is None
    with pytest.raises(ValueError):
        ranking.boost(rows, con, 2)


def test_final_order_breaks_ties(spark):
    rows = [("b", "Zeta", 2001, 1.0, None, None, 1.0), ("a", "zeta!", 2001, 1.0, None, None, 1.0), ("c", "alpha", None, 1.0, None, None, 1.0), ("d", "alpha", None, 1.0, 0.0, None, 0.0)]
    df = spark.createDataFrame(rows, "id string, title string, publication_year int, final_score double, constraint_score double, semantic_score double, lexical_score double")
    assert [r.id for r in df.orderBy(*ranking.final_order()).collect()] == ["d", "c", "a", "b"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([3.0, 4.0], [6.0, 8.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(v.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    with pytest.raises(Exception, match="length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(v.cosine(F.col("a"), F.col("b"))).collect()


def test_interleave(spark):
    hits = [(1, r, f"r{r}h{h}", float(9 - h)) for r in range(5) for h in range(2)] + [(1, 4, "r0h0", 1.0)]
    ranked = retrieval.rank_routes(spark.createDataFrame(hits, "idea_id int, route_ord int, id string, score double"))
    got = retrieval.interleave(ranked, 5).orderBy("ord").collect()
    assert [r.id for r in got] == [f"r{i}h0" for i in range(5)] and len(got[0].provenance) == 2
    q = spark.createDataFrame([(1, 0, "o"), (1, 1, "x")], "idea_id int, ord int, text string")
    assert [(r.route_ord, r.mode) for r in retrieval.routes(q).orderBy("route_ord").collect()] == [(0, "broad_lexical"), (1, "title_abstract"), (2, "semantic"), (3, "broad_lexical")]


def test_citation_graph(spark):
    papers = spark.createDataFrame([(1, 1, ["https://openalex.org/W1", "W11"]), (2, 2, ["w2"]), (3, 3, ["bad"])], "paper_id long, ord long, aliases array<string>")
    refs = [(1, "W2"), (1, "https://openalex.org/w2/"), (1, "W11"), (1, "W99"), (1, "nonsense"), (2, "W2"), (3, None)]
    resolved = graph.resolve_references(papers, spark.createDataFrame(refs, "paper_id long, reference string"))
    edge = graph.edges(resolved)
    deg = {r.paper_id: r for r in graph.degrees(papers, edge, resolved).collect()}
    assert (deg[1].out_degree, deg[1].external_reference_count, deg[2].in_degree, deg[3].isolated) == (1, 1, 1, True)
    s = graph.summary(graph.degrees(papers, edge, resolved), edge, graph.components(papers, edge)).first()
    assert (s.node_count, s.edge_count, s.component_count, s.isolated_node_count, s.external_reference_count) == (3, 1, 2, 1, 1)


def test_keys(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/A/", "openalex: W5", "Deep-Learning_for  X!", "a b", "5 Methods and Materials")], "d string, w string, v string, o string, h string")
    r = df.select(t.doi_key(F.col("d")).alias("d"), t.work_key(F.col("w")).alias("w"), t.evidence_key(F.col("v")).alias("k"), t.title_key(F.col("v")).alias("t"), t.heading_roles(F.col("h")).alias("h"), t.pseudonym(F.col("o"), b"k").alias("p")).first()
    assert (r.d, r.w, r.k, r.t) == ("10.1/a", "W5".lower(), "deep learning for x", "deep learning_for x") and r.h == ["methods", "materials"] and len(r.p) == 64
    one = spark.createDataFrame([("sk-abc1 mail a@b.c at https://x.y/z?token=1 password: hunter2",)], "s string").select(t.redact(F.col("s"))).first()[0]
    assert one == "[redacted] mail [email] at [url] [redacted]"
    n = spark.createDataFrame([("Ｆｕｌｌ STRASSE ß",)], "s string").select(t.nfkc_casefold("s")).first()[0]
    assert n == "full strasse ss"
