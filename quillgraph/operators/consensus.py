"""Consensus among claims, and the state of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much each type of claim weighs for its concept.
SUPPORT = {"supports": 1.0, "extends": 0.7, "complements": 0.5}
AGAINST = {"contradicts": 1.0}


def _weight(weights: dict[str, float]) -> Column:
    """Tenths, which sums keep exact: a score on the edge of a band must not fall over it by the order of its claims."""
    tenths = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, round(10 * w))])
    return F.coalesce(tenths[F.col("claim_type")], F.lit(0)).cast("long")


def consensus_by_concept(concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """``project_id, id, n_claims, consensus_score``: weight of support over all weight; 0.5 where there is none."""
    sums = claims.groupBy(F.col("concept_id").alias("id")).agg(F.sum(_weight(SUPPORT)).alias("s"), F.sum(_weight(AGAINST)).alias("c"), F.count("*").alias("n"))
    score = F.coalesce(F.try_divide(F.col("s") / 10.0, (F.col("s") + F.col("c")) / 10.0), F.lit(0.5))
    return concepts.join(sums, "id", "left").select("project_id", "id", F.coalesce("n", F.lit(0)).alias("n_claims"), score.alias("consensus_score"))


def band(score: Column) -> Column:
    return F.when(score > 0.8, "strong").when(score < 0.3, "contradicted").otherwise("contested")


def consensus_bands(scored: DataFrame) -> DataFrame:
    """``project_id, band, n, avg_score``."""
    return scored.groupBy("project_id", band(F.col("consensus_score")).alias("band")).agg(F.count("*").alias("n"), F.avg("consensus_score").alias("avg_score"))


def brain_state(scored: DataFrame, most: int = 20) -> DataFrame:
    """``project_id, strong_consensus, contested, contradictions, avg_score``: names per band, by id, the first ``most``.

    Only the ``most`` least ids of a band are gathered, however large the project.
    """
    from pyspark.sql import Window as W

    banded = scored.withColumn("band", band(F.col("consensus_score")))
    head = banded.withColumn("k", F.row_number().over(W.partitionBy("project_id", "band").orderBy("id"))).where(F.col("k") <= most)

    def names(b: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == b, F.struct("id", "name")))), lambda s: s["name"])

    lists = head.groupBy("project_id").agg(names("strong").alias("strong_consensus"), names("contested").alias("contested"), names("contradicted").alias("contradictions"))
    return lists.join(scored.groupBy("project_id").agg(F.avg("consensus_score").alias("avg_score")), "project_id")


def summary_text(state: DataFrame) -> DataFrame:
    """The state's summary by a template; stands in for a model's."""
    n = [F.size(c) for c in ("strong_consensus", "contested", "contradictions")]
    return state.withColumn("summary_text", F.format_string("%d concepts with strong consensus, %d contested, %d contradicted; mean consensus %.2f.", *n, F.col("avg_score")))


def project_health(documents: DataFrame, concepts: DataFrame) -> DataFrame:
    """``project_id, documents, concepts, gaps, avg_consensus, health``: 0.4 consensus, 0.3 documents up to 10, 0.3 concepts up to 50."""
    d = documents.groupBy("project_id").agg(F.count("*").alias("documents"))
    gap = F.coalesce(F.col("is_gap"), F.lit(False))
    c = concepts.groupBy("project_id").agg(F.count(F.when(~gap, 1)).alias("concepts"), F.count(F.when(gap, 1)).alias("gaps"), F.avg(F.when(~gap, F.col("consensus_score"))).alias("avg_consensus"))
    joined = d.join(c, "project_id", "full").na.fill(0, ["documents", "concepts", "gaps"])
    health = 0.4 * F.coalesce("avg_consensus", F.lit(0.5)) + 0.3 * F.least(F.col("documents") / 10.0, F.lit(1.0)) + 0.3 * F.least(F.col("concepts") / 50.0, F.lit(1.0))
    return joined.withColumn("health", F.round(health, 4))


def with_totals(rows: DataFrame, total_docs: int | DataFrame) -> DataFrame:
    """Rows with ``total_docs``: one number for all, or that of each project (0 where it has none)."""
    if isinstance(total_docs, DataFrame):
        return rows.join(total_docs.select("project_id", "total_docs"), "project_id", "left").withColumn("total_docs", F.coalesce("total_docs", F.lit(0)))
    return rows.withColumn("total_docs", F.lit(total_docs))


def document_totals(documents: DataFrame) -> DataFrame:
    """``project_id, total_docs``."""
    return documents.groupBy("project_id").agg(F.count("*").alias("total_docs"))


def coverage(concepts: DataFrame, claims: DataFrame, total_docs: int | DataFrame) -> DataFrame:
    """``project_id, id, n_docs, coverage_score``: documents with a claim over all of the project, 1 at most, 0 without documents."""
    n = claims.groupBy(F.col("concept_id").alias("id")).agg(F.count_distinct("document_id").alias("n_docs"))
    joined = with_totals(concepts.select("project_id", "id").join(n, "id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))), total_docs)
    return joined.withColumn("coverage_score", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("n_docs"), F.col("total_docs")), F.lit(0.0)))).drop("total_docs")


def frequencies(claims: DataFrame) -> DataFrame:
    """``concept_id, n_claims, n_docs``."""
    return claims.groupBy("concept_id").agg(F.count("*").alias("n_claims"), F.count_distinct("document_id").alias("n_docs"))


def rebuild(concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """Concepts with their scores made anew."""
    fresh = consensus_by_concept(concepts, claims).select("id", F.col("consensus_score").alias("_score"))
    return concepts.drop("consensus_score").join(fresh, "id").withColumnRenamed("_score", "consensus_score")


def upsert_state(states: DataFrame, fresh: DataFrame) -> DataFrame:
    """One state per project: the fresh one where there is one."""
    return states.join(fresh, "project_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def latest_state(states: DataFrame) -> DataFrame:
    """Each project's newest state, the greatest id on ties."""
    columns = [c for c in states.columns if c != "project_id"]
    newest = states.groupBy("project_id").agg(F.max_by(F.struct(*columns), F.struct("last_updated", "id")).alias("s"))
    return newest.select("project_id", *[F.col(f"s.{c}") for c in columns])
