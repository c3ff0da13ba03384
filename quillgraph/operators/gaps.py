"""Knowledge gaps: expected topics, bridges between clusters, weak coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.vectors import dot, mean_vectors, midpoint
from quillgraph.operators.consensus import with_totals
from quillgraph.params import DEFAULTS, Params

# What is suggested for a gap.
SEARCH = "Search for papers about: %s"
ABSENT = "'%s' is absent but relevant to the domain of %s"
CONNECTS = "'%s' would connect to existing concepts: %s"
BETWEEN = "This gap connects '%s' and '%s'"
BRIDGES = "'%s' may bridge the '%s' and '%s' research clusters"
FEW = "Only ~%d of %d document(s) cover '%s' — consider adding more sources"

#: Columns that say a concept is a gap.
GAP_COLUMNS = ("gap_subtype", "suggestions", "related_to", "importance")


def clear_gaps(concepts: DataFrame) -> DataFrame:
    """Concepts without synthetic gaps, and real ones no longer marked."""
    flagged = F.coalesce(F.col("is_gap"), F.lit(False))
    out = concepts.where(~F.coalesce(F.col("is_synthetic_gap"), F.lit(False)))
    for c in ("gap_type", *GAP_COLUMNS):
        if c in concepts.columns:
            out = out.withColumn(c, F.when(~flagged, F.col(c)))
    return out.withColumn("is_gap", F.lit(False))


def weak_coverage(concepts: DataFrame, total_docs: int | DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``project_id, id, name, approx_docs, suggestions``: general concepts that few documents of the project cover; none in small collections."""
    cover, general = F.coalesce("coverage_score", F.lit(0.0)), F.coalesce("generality_score", F.lit(0.0))
    weak = (cover < p.weak_coverage) & (general > p.weak_generality) & ~F.coalesce(F.col("is_synthetic_gap"), F.lit(False)) & (F.col("total_docs") >= p.weak_min_docs)
    docs = F.greatest(F.lit(1), F.bround(cover * F.col("total_docs"))).cast("long")
    found = with_totals(concepts, total_docs).where(weak).withColumn("approx_docs", docs)
    suggestions = F.array(F.format_string(SEARCH, "name"), F.format_string(FEW, F.col("approx_docs"), F.col("total_docs"), F.col("name")))
    return found.select("project_id", "id", "name", "approx_docs", suggestions.alias("suggestions"))


def flag_weak(concepts: DataFrame, total_docs: int | DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Concepts, those with weak coverage marked in place."""
    weak = weak_coverage(concepts, total_docs, p).select("id", F.col("suggestions").alias("_s"))
    out, hit = concepts.join(weak, "id", "left"), F.col("_s").isNotNull()
    values = {"is_gap": F.lit(True), "gap_type": F.lit("under_explored"), "gap_subtype": F.lit("weak_coverage"), "suggestions": F.col("_s"), "related_to": F.array().cast("array<string>"), "importance": F.lit("important")}
    for c, v in values.items():
        out = out.withColumn(c, F.when(hit, v).otherwise(F.col(c)) if c in concepts.columns else F.when(hit, v))
    return out.drop("_s")


def connected_clusters(relationships: DataFrame, concepts: DataFrame) -> DataFrame:
    """``project_id, a, b``: pairs of clusters (a < b) that a relationship joins."""
    label = concepts.where("cluster_label is not null").select("project_id", F.col("id").alias("source_concept_id"), F.col("cluster_label").alias("la"))
    other = label.select("project_id", F.col("source_concept_id").alias("target_concept_id"), F.col("la").alias("lb"))
    both = relationships.select("source_concept_id", "target_concept_id").join(label, "source_concept_id").join(other, ["project_id", "target_concept_id"]).where("la <> lb")
    return both.select("project_id", F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()


def heads(concepts: DataFrame) -> DataFrame:
    """``project_id, cluster_label, head``: the most general concept's name, the least id on ties."""
    return concepts.groupBy("project_id", "cluster_label").agg(F.max_by("name", F.struct(F.coalesce("generality_score", F.lit(0.0)), -F.col("id"))).alias("head"))


def bridge_candidates(concepts: DataFrame, relationships: DataFrame, threshold: float = DEFAULTS.gap_similarity, n: int = DEFAULTS.max_bridging, dim: int | None = None) -> DataFrame:
    """``project_id, a, b, sim, head_a, head_b, embedding``: clusters that are similar and not joined, the ``n`` most similar of a project.

    Clusters are few beside concepts; their centroids meet within a project.
    """
    labelled = concepts.where("cluster_label is not null")
    means = mean_vectors(labelled, ["project_id", "cluster_label"], normalize=True, dim=dim).join(heads(labelled), ["project_id", "cluster_label"])
    a = means.select("project_id", F.col("cluster_label").alias("a"), F.col("centroid").alias("ca"), F.col("head").alias("head_a"))
    b = means.select("project_id", F.col("cluster_label").alias("b"), F.col("centroid").alias("cb"), F.col("head").alias("head_b"))
    pairs = a.join(b, "project_id").where("a < b").withColumn("sim", dot(F.col("ca"), F.col("cb"))).where(F.col("sim") >= threshold)
    pairs = pairs.join(connected_clusters(relationships, labelled), ["project_id", "a", "b"], "left_anti")
    ranked = pairs.withColumn("k", F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("sim"), "a", "b"))).where(F.col("k") <= n)
    return ranked.select("project_id", "a", "b", "sim", "head_a", "head_b", midpoint(F.col("ca"), F.col("cb")).alias("embedding"))


def bridging_gaps(candidates: DataFrame) -> DataFrame:
    """Gap concepts for bridges, named by a template in place of a model."""
    name = F.concat("head_a", F.lit(" × "), "head_b")
    texts = F.array(F.format_string(BETWEEN, "head_a", "head_b"), F.format_string(SEARCH, name), F.format_string(BRIDGES, name, F.col("head_a"), F.col("head_b")))
    return candidates.select(
        "project_id", name.alias("name"), F.lit(0.5).alias("generality_score"), F.lit(0.0).alias("coverage_score"), "embedding", F.lit(True).alias("is_gap"), F.lit("missing_link").alias("gap_type"),
        F.lit(True).alias("is_synthetic_gap"), F.lit("bridging").alias("gap_subtype"), F.lit("important").alias("importance"), texts.alias("suggestions"), F.array("head_a", "head_b").alias("related_to"),
        F.array("a", "b").alias("bridge_clusters"), F.round("sim", 4).alias("cluster_similarity"),
    )


def representatives(concepts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``project_id, id, name, rank``: the best covered concepts of each project."""
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc(F.coalesce("coverage_score", F.lit(0.0))), "id"))
    return concepts.withColumn("rank", rank).where(F.col("rank") <= p.top_concepts).select("project_id", "id", "name", "rank")


def domain(concepts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``project_id, domain``: names of the most general concepts."""
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc(F.coalesce("generality_score", F.lit(0.0))), "id"))
    top = concepts.withColumn("rank", rank).where(F.col("rank") <= p.top_domain)
    return top.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), ", ").alias("domain"))


def clean_importance(importance: Column) -> Column:
    low = F.lower(importance)
    return F.when(low.isin("critical", "important", "nice_to_have"), low).otherwise("important")


def expected_topics(suggested: DataFrame, concepts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Gap concepts of ``suggested(project_id, seq, name, description, related_to, importance)``: critical, with names that aren't there yet, the first few."""
    named = suggested.withColumn("name", F.trim("name")).where("name <> ''").withColumn("importance", clean_importance(F.col("importance"))).where("importance = 'critical'")
    have = concepts.select("project_id", F.lower("name").alias("low")).distinct()
    new = named.withColumn("low", F.lower("name")).join(have, ["project_id", "low"], "left_anti")
    first = new.withColumn("k", F.row_number().over(W.partitionBy("project_id", "low").orderBy("seq"))).where("k = 1")
    first = first.withColumn("k", F.row_number().over(W.partitionBy("project_id").orderBy("seq"))).where(F.col("k") <= p.max_expected)
    related = F.slice(F.coalesce("related_to", F.array().cast("array<string>")), 1, 5)
    area = F.coalesce(F.trim(F.split_part("domain", F.lit(","), F.lit(1))), F.lit(""))
    texts = F.array(F.format_string(SEARCH, "name"), F.format_string(ABSENT, F.col("name"), area))
    texts = F.when(F.size(related) > 0, F.concat(texts, F.array(F.format_string(CONNECTS, F.col("name"), F.array_join(F.slice(related, 1, 3), ", "))))).otherwise(texts)
    return first.join(domain(concepts, p), "project_id", "left").select(
        "project_id", "name", "description", F.lit(0.6).alias("generality_score"), F.lit(0.0).alias("coverage_score"), F.lit(True).alias("is_gap"), F.lit("missing_link").alias("gap_type"),
        F.lit(True).alias("is_synthetic_gap"), F.lit("expected_topic").alias("gap_subtype"), "importance", texts.alias("suggestions"), related.alias("related_to"),
    )
