"""The concept map: nodes, edges, gaps and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.params import DEFAULTS, Params


def importance_rank(importance: Column) -> Column:
    """critical, important (also null or unknown), nice_to_have."""
    return F.when(importance == "critical", 0).when(importance == "nice_to_have", 2).otherwise(1)


def map_concepts(concepts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The concepts in the map of each project: the best real ones and the most important gaps.

    One scan and one ranking; tasks drop what can't be in the map before they shuffle.
    """
    gap = F.coalesce(F.col("is_gap"), F.lit(False))
    head = F.when(F.col("parent_concept_id").isNull(), 1.0).otherwise(0.0)
    rank = 0.4 * F.coalesce("coverage_score", F.lit(0.0)) + 0.3 * F.coalesce("generality_score", F.lit(0.0)) + 0.3 * head
    order = [F.when(gap, importance_rank(F.col("importance"))), F.desc(F.when(~gap, rank)), F.col("id")]
    rows = concepts.withColumn("_gap", gap)
    ranked = rows.withColumn("_k", F.row_number().over(W.partitionBy("project_id", "_gap").orderBy(*order)))
    kept = ranked.where(F.col("_k") <= max(p.map_concepts, p.map_gaps)).where(F.col("_k") <= F.when(F.col("_gap"), p.map_gaps).otherwise(p.map_concepts))
    return kept.drop("_k", "_gap")


def map_nodes(shown: DataFrame, claims: DataFrame) -> DataFrame:
    """Nodes with their documents counted, and parents and children by name."""
    ids = F.broadcast(shown.select(F.col("id").alias("concept_id")))  # 23 a project at most
    docs = claims.join(ids, "concept_id", "left_semi").groupBy(F.col("concept_id").alias("id")).agg(F.count_distinct("document_id").alias("document_count"))
    name = F.concat(F.lit("concept_"), F.col("id").cast("string"))
    children = shown.where("parent_concept_id is not null").groupBy(F.col("parent_concept_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list("id")), lambda i: F.concat(F.lit("concept_"), i.cast("string"))).alias("children"))
    joined = shown.join(docs, "id", "left").join(children, "id", "left")
    return joined.select(
        "project_id", name.alias("node_id"), F.when(F.coalesce(F.col("is_gap"), F.lit(False)), "gap").otherwise("concept").alias("type"),
        F.col("name").alias("label"), "coverage_score", "consensus_score", "generality_score",
        F.coalesce("document_count", F.lit(0)).alias("document_count"),
        F.when(F.col("cluster_label").isNotNull(), F.concat(F.lit("cluster_"), F.col("cluster_label").cast("string"))).alias("cluster_id"),
        F.when(F.col("parent_concept_id") != 0, F.concat(F.lit("concept_"), F.col("parent_concept_id").cast("string"))).alias("parent_id"),
        F.coalesce("children", F.array().cast("array<string>")).alias("children"),
    )


def map_edges(shown: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships of which both ends are in the map."""
    ids = shown.select("id")
    own = relationships.join(F.broadcast(ids.withColumnRenamed("id", "source_concept_id")), "source_concept_id", "left_semi")
    own = own.join(F.broadcast(ids.withColumnRenamed("id", "target_concept_id")), "target_concept_id", "left_semi")

    def node(c: str) -> Column:
        return F.concat(F.lit("concept_"), F.col(c).cast("string"))

    kind = F.coalesce("relationship_type", F.lit("similar"))
    return own.select(F.concat(F.lit("rel_"), F.col("id").cast("string")).alias("edge_id"), node("source_concept_id").alias("source"), node("target_concept_id").alias("target"), kind.alias("type"), "strength", "confidence", kind.alias("label"))


def map_gaps(shown: DataFrame) -> DataFrame:
    """The gap panel, most important first, then by subtype."""
    subtype = F.coalesce("gap_subtype", F.lit("weak_coverage"))
    gaps = shown.where("is_gap").select("project_id", "id", "name", F.coalesce("gap_type", F.lit("missing_link")).alias("gap_type"), subtype.alias("gap_subtype"), "importance", "coverage_score", "generality_score", "cluster_label")
    return gaps.orderBy(importance_rank(F.col("importance")), "gap_subtype", "id")


def map_metadata(shown: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many concepts, relationships, gaps and clusters the map has."""
    counts = shown.agg(F.count("*").alias("total_concepts"), F.count(F.when(F.col("is_gap"), 1)).alias("total_gaps"), F.count_distinct("cluster_label").alias("num_clusters"))
    return counts.crossJoin(edges.agg(F.count("*").alias("total_relationships"))).withColumn("has_clustering", F.col("num_clusters") > 0)


def gap_list(concepts: DataFrame, subtype: str | None = None) -> DataFrame:
    """All gaps by importance, subtype, coverage (nulls first) and id."""
    kind = F.coalesce("gap_subtype", F.lit("weak_coverage"))
    gaps = concepts.where("is_gap").withColumn("gap_subtype", kind)
    gaps = gaps if subtype is None else gaps.where(F.col("gap_subtype") == subtype)
    return gaps.orderBy(importance_rank(F.col("importance")), "gap_subtype", F.asc_nulls_first("coverage_score"), "id")


def concept_detail(concepts: DataFrame, claims: DataFrame, documents: DataFrame, concept_id: int) -> DataFrame:
    """The concept with its claims and documents as arrays."""
    own = claims.where(F.col("concept_id") == concept_id)
    listed = own.groupBy(F.col("concept_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("claim_id"), "claim_type", "confidence"))).alias("claims"))
    cited = documents.join(own.select(F.col("document_id").alias("id")), "id", "left_semi")
    docs = cited.agg(F.array_sort(F.collect_list(F.struct("id", "filename"))).alias("documents"))
    return concepts.where(F.col("id") == concept_id).join(listed, "id", "left").crossJoin(docs)
