"""Schemas of the engine's tables, by version, and of their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables and their columns. Keys of former JSON columns are columns here.
TABLES = {
    "users": "id string, email string, name string, created_at timestamp",
    "projects": "id long, name string, description string, created_at timestamp, updated_at timestamp, user_id string, color_index int",
    "documents": "id long, project_id long, filename string, file_type string, content_text string, is_small boolean, word_count int, reading_time_minutes double, created_at timestamp, embedding array<double>",
    "chunks": "id long, document_id long, content string, chunk_index long, section_title string, section_level int, page_num int, n_words long, embedding array<double>, extraction_status string",
    "concepts": "id long, project_id long, name string, description string, generality_score double, coverage_score double, consensus_score double, embedding array<double>, is_gap boolean, gap_type string, parent_concept_id long, cluster_label int, is_synthetic_gap boolean, gap_subtype string, suggestions array<string>, related_to array<string>, importance string, aliases array<string>, merged_from_ids array<long>",
    "claims": "id long, document_id long, concept_id long, claim_text string, claim_type string, confidence double",
    "relationships": "id long, source_concept_id long, target_concept_id long, relationship_type string, strength double, confidence double, reasoning string, embedding_similarity double, co_occurrence_chunks long",
    "brain_state": "id long, project_id long, last_updated timestamp, summary_text string, strong_consensus array<string>, contested array<string>, contradictions array<string>, avg_score double",
}
CLAIM_TYPES = ("supports", "contradicts", "extends", "complements")
RELATIONSHIP_TYPES = ("prerequisite", "builds_on", "contradicts", "complements", "similar", "parent_child")
GAP_TYPES = ("missing_link", "under_explored", "contradictory", "isolated_concept")
EXTRACTED = ("extracted", "skipped")


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema(table))


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows in the table's columns and types: those that lack are null, others go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def invalid(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Rows whose value isn't allowed; null is."""
    return rows.where(~F.col(column).isin(*values))


def migrate_dimension(rows: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Vectors of another length become null, to be made anew."""
    return rows.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)))
