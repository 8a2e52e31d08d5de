"""Citation graphs as vertices and edges: resolution of references, degrees, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as t
from siltstone.operators.components import components as star_components


def resolve_references(papers: DataFrame, references: DataFrame) -> DataFrame:
    """papers: paper_id, aliases; references: paper_id, reference. paper_id, alias, cited_id (null: external).

    Malformed references, and any of a paper's own aliases, are dropped. An alias of several papers
    stands for the one with the least (ord or paper_id).
    """
    order = F.col("ord") if "ord" in papers.columns else F.col("paper_id")
    alias = papers.select("paper_id", order.alias("o"), F.explode("aliases").alias("a"))
    alias = alias.select("paper_id", "o", t.valid_work_key(F.col("a")).alias("alias")).where(F.col("alias").isNotNull())
    owner = alias.groupBy("alias").agg(F.min_by("paper_id", F.struct("o", "paper_id")).alias("cited_id"))
    refs = references.select("paper_id", t.valid_work_key(F.col("reference")).alias("alias")).where(F.col("alias").isNotNull()).distinct()
    own = alias.select("paper_id", "alias").distinct()
    foreign = refs.join(own, ["paper_id", "alias"], "left_anti")
    resolved = foreign.join(owner, "alias", "left")
    return resolved.where(F.col("cited_id").isNull() | (F.col("cited_id") != F.col("paper_id"))).select("paper_id", "alias", "cited_id")


def edges(resolved: DataFrame) -> DataFrame:
    rows = resolved.where(F.col("cited_id").isNotNull())
    return rows.select(F.col("paper_id").alias("citing_paper_id"), F.col("cited_id").alias("cited_paper_id")).distinct()


def degrees(nodes: DataFrame, edge: DataFrame, resolved: DataFrame) -> DataFrame:
    """paper_id, in_degree, out_degree, external_reference_count, isolated; one row per node."""
    ends = edge.select(F.col("citing_paper_id").alias("paper_id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(0).alias("x"))
    ends = ends.unionByName(edge.select(F.col("cited_paper_id").alias("paper_id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("x")))
    outside = resolved.where(F.col("cited_id").isNull()).select("paper_id", F.lit(0).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("x"))
    summed = ends.unionByName(outside).groupBy("paper_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.sum("x").alias("x"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return nodes.select("paper_id").join(summed, "paper_id", "left").select(
        "paper_id",
        zero("i").alias("in_degree"),
        zero("o").alias("out_degree"),
        zero("x").alias("external_reference_count"),
        ((zero("i") + zero("o")) == 0).alias("isolated"),
    )


def components(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """paper_id (long), component_id: the least paper_id of its weakly connected component; alone, a node is its own."""
    roots = star_components(edge.select(F.col("citing_paper_id").alias("u"), F.col("cited_paper_id").alias("v")))
    found = roots.select(F.col("u").alias("paper_id"), "root")
    return nodes.select("paper_id").join(found, "paper_id", "left").select("paper_id", F.coalesce("root", "paper_id").alias("component_id"))


def summary(degree: DataFrame, edge: DataFrame, component: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, component_count, isolated_node_count, external_reference_count."""
    d = degree.agg(
        F.count(F.lit(1)).alias("node_count"),
        F.coalesce(F.sum(F.col("isolated").cast("long")), F.lit(0)).alias("isolated_node_count"),
        F.coalesce(F.sum("external_reference_count"), F.lit(0)).alias("external_reference_count"),
    )
    e = edge.agg(F.count(F.lit(1)).alias("edge_count"))
    c = component.agg(F.countDistinct("component_id").alias("component_count"))
    return d.crossJoin(e).crossJoin(c)  # three single rows


MAX_NODES = 500


def bounded(papers: DataFrame, references: DataFrame, selected: DataFrame | None = None, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graph among the first `max_nodes` papers (by ord, or paper_id), each with ord by identifiers in lower case.

    papers: paper_id, aliases and any other columns, which nodes keep. nodes also have sorted aliases, selected (whether in `selected`: paper_id), degrees and
    external references; edges have citing_paper_id and cited_paper_id. The bound keeps the two orders within one task.
    """
    if not 1 <= max_nodes <= MAX_NODES:
        raise ValueError(f"max_nodes must lie between 1 and {MAX_NODES}")
    first = papers.orderBy(*([F.asc("ord")] if "ord" in papers.columns else []), F.asc("paper_id")).limit(max_nodes)
    resolved = resolve_references(first, references.join(first.select("paper_id"), "paper_id", "left_semi"))
    edge = edges(resolved)
    rows = first.join(degrees(first, edge, resolved), "paper_id")
    chosen = rows.select("paper_id").limit(0) if selected is None else selected.select("paper_id").distinct()
    rows = rows.join(chosen.withColumn("_sel", F.lit(True)), "paper_id", "left").withColumn("selected", F.coalesce("_sel", F.lit(False))).drop("_sel")
    by_name = F.array_sort(F.transform(F.array_distinct("aliases"), lambda a: F.struct(t.casefold(a).alias("k"), a.alias("a"))))
    rows = rows.withColumn("aliases", F.transform(by_name, lambda x: x["a"]))
    folded = lambda c: t.casefold(F.col(c).cast("string"))
    place = lambda *c: (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*c)) - 1).alias("ord")
    nodes = rows.drop("ord").select("*", place(folded("paper_id"), F.col("paper_id")))
    ordered = edge.select("*", place(folded("citing_paper_id"), folded("cited_paper_id"), F.col("citing_paper_id"), F.col("cited_paper_id")))
    return nodes, ordered
