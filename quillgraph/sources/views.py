"""The knowledge-graph tables, as views of the shared Parquet tables.

Each function has its SQL twin in ``SQL``, which DuckDB reads over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.substring("source", 4, 10).cast("int").alias("project_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("filename"),
        F.col("lang").alias("file_type"),
        F.col("text").alias("content_text"),
        (F.length("text") <= 8000).alias("is_small"),
    )


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 3 == 0, 2).otherwise(1).alias("project_id"),
        F.concat(F.lit("concept_"), F.col("vec_id").cast("string")).alias("name"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").alias("cluster_label"),
        ((F.col("vec_id") % 101) / F.lit(101.0)).alias("generality_score"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    # What stands for each type of claim.
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "supports", "view", "extends", "click", "complements", "error", "contradicts")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.get_json_object("props", "$.k").cast("long").alias("document_id"),
        F.col("user_id").alias("concept_id"),
        F.coalesce(kind[F.col("event_type")], F.lit("other")).alias("claim_type"),
        F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


#: Documents that the claims speak of, in projects 1 and 2 of the concepts; and as SQL.
TOTAL_DOCS = {1: 100, 2: 60}
TOTAL_DOCS_SQL = "case project_id when 1 then 100 else 60 end"


def totals(spark: SparkSession) -> DataFrame:
    """``project_id, total_docs``."""
    return spark.createDataFrame(list(TOTAL_DOCS.items()), "project_id int, total_docs long")


SQL = {
    "docs": "select doc_id as id, substr(source, 4)::int as project_id, 'doc_' || doc_id as filename, lang as file_type, text as content_text, length(text) <= 8000 as is_small from documents",
    "concepts": "select vec_id as id, case when vec_id % 3 = 0 then 2 else 1 end as project_id, 'concept_' || vec_id as name, embedding::double[] as embedding, label as cluster_label, (vec_id % 101) / 101.0::double as generality_score from embeddings",
    "claims": "select event_id as id, (props->>'$.k')::bigint as document_id, user_id as concept_id, case event_type when 'purchase' then 'supports' when 'view' then 'extends' when 'click' then 'complements' when 'error' then 'contradicts' else 'other' end as claim_type, least(greatest(value / 100.0, 0.0), 1.0)::double as confidence from events",
}


def with_views(query: str, *names: str) -> str:
    """The query after these views; it may have a WITH of its own."""
    views = ", ".join(f"{n} as ({SQL[n]})" for n in names)
    query = query.strip()
    return f"with {views}, {query[5:]}" if query.startswith("with ") else f"with {views} {query}"
