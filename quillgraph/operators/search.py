"""Exact vector search and retrieval for question answering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import snippet
from quillgraph.functions.vectors import cosine_literal


def _check(top_k: int, threshold: float, most: int = 100) -> None:
    if not 1 <= top_k <= most:
        raise ValueError(f"top_k must be from 1 to {most}")
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be from 0 to 1")


def top_k(rows: DataFrame, query: list[float], k: int, threshold: float | None = None, where: Column | None = None, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, ties by id; those below the threshold are left out.

    Each task keeps its own ``k`` best; no row is shuffled but those.
    """
    found = rows.where(F.col(vector).isNotNull())
    found = found if where is None else found.where(where)
    found = found.withColumn("similarity", cosine_literal(F.col(vector), query))
    if threshold is not None:
        found = found.where(F.lit(1.0) - F.col("similarity") <= F.lit(1.0 - threshold))
    return found.orderBy(F.desc("similarity"), id_col).limit(k)


def search_chunks(chunks: DataFrame, documents: DataFrame, query: list[float], k: int = 5, threshold: float = 0.0, document_id: int | None = None) -> DataFrame:
    """The nearest chunks with their documents' file names."""
    _check(k, threshold)
    where = None if document_id is None else F.col("document_id") == document_id
    best = top_k(chunks, query, k, threshold, where)
    return best.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")


def concept_top_k(concepts: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The nearest concepts that are no gaps."""
    return top_k(concepts, query, k, where=~F.coalesce(F.col("is_gap"), F.lit(False)))


def retrieve(chunks: DataFrame, documents: DataFrame, project_id: int, query: list[float], k: int = 5, prefilter: bool = True) -> DataFrame:
    """Chunks of a project for an answer.

    ``prefilter=False`` takes the nearest 3k of all projects and then those of the project, so
    it may return fewer than there are.
    """
    own = documents.where(F.col("project_id") == project_id).select(F.col("id").alias("document_id"))
    if prefilter:
        return top_k(chunks.join(own, "document_id", "left_semi"), query, k)
    near = top_k(chunks, query, 3 * k)
    return near.join(own, "document_id", "left_semi").orderBy(F.desc("similarity"), "id").limit(k)


def rank_small_documents(documents: DataFrame, query: list[float], k: int = 5, newest: str = "created_at") -> DataFrame:
    """Small documents by similarity (0 without a vector), then the newest."""
    scored = documents.where("is_small").withColumn("similarity", F.coalesce(cosine_literal(F.col("embedding"), query), F.lit(0.0)))
    return scored.orderBy(F.desc("similarity"), F.desc(newest), "id").limit(k)


def chat_confidence(found: DataFrame) -> DataFrame:
    """``confidence``: mean similarity of what was found, 0.3 for nothing, 1 at most."""
    return found.agg(F.least(F.coalesce(F.avg("similarity"), F.lit(0.3)), F.lit(1.0)).alias("confidence"))


def prompt_context(found: DataFrame, chars: int = 400) -> DataFrame:
    """``context``: numbered snippets in order of similarity."""
    ranked = found.withColumn("n", F.row_number().over(W.orderBy(F.desc("similarity"), "id")))
    line = F.format_string("[%d] (%s) %s", F.col("n"), F.col("filename"), snippet(F.col("content"), chars))
    return _joined(ranked, F.col("n"), line, "context")


def _joined(rows: DataFrame, order: Column, line: Column, name: str) -> DataFrame:
    """Lines, one below the other, of a few rows."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("n"), line.alias("line")))), lambda s: s["line"]), "\n").alias(name))


def document_context(found: DataFrame, chars: int = 4000) -> DataFrame:
    """``documents``: small documents in order of similarity."""
    ranked = found.withColumn("n", F.row_number().over(W.orderBy(F.desc("similarity"), "id")))
    return _joined(ranked, F.col("n"), F.format_string("[Full Doc %d] (%s) %s", F.col("n"), F.col("filename"), snippet(F.col("content"), chars)), "documents")


def concept_lines(found: DataFrame, chars: int = 150) -> DataFrame:
    """``concepts``: a line for each concept in order of similarity, with its consensus if it has one."""
    ranked = found.withColumn("n", F.row_number().over(W.orderBy(F.desc("similarity"), "id")))
    tag = F.when(F.col("consensus_score").isNotNull(), F.format_string(" [consensus: %.2f]", F.col("consensus_score"))).otherwise("")
    return _joined(ranked, F.col("n"), F.concat(F.lit("- "), "name", tag, F.lit(": "), F.left(F.coalesce("description", F.lit("")), F.lit(chars))), "concepts")


def claim_lines(claims: DataFrame, most: int = 12, chars: int = 200) -> DataFrame:
    """``claims``: a line for each of the first claims, by id."""
    some = claims.orderBy("id").limit(most)
    return _joined(some, F.col("id"), F.format_string("- [%s] %s", F.col("claim_type"), F.left("claim_text", F.lit(chars))), "claims")


def gap_lines(concepts: DataFrame, most: int = 5, chars: int = 120) -> DataFrame:
    """``gaps``: a line for each of the first gaps, by id."""
    some = concepts.where("is_gap").orderBy("id").limit(most)
    line = F.format_string("- %s (%s): %s", F.col("name"), F.coalesce("gap_type", F.lit("None")), F.left(F.coalesce("description", F.lit("")), F.lit(chars)))
    return _joined(some, F.col("id"), line, "gaps").withColumn("gaps", F.when(F.col("gaps") == "", "(no gaps detected)").otherwise(F.col("gaps")))


def source_list(near: DataFrame, small: DataFrame) -> DataFrame:
    """``sources``: file names of the chunks in order of similarity, then of small documents, each once."""
    both = near.select(F.lit(0).alias("kind"), "similarity", "id", "filename").unionByName(small.select(F.lit(1).alias("kind"), "similarity", "id", "filename"))
    listed = F.array_sort(F.collect_list(F.struct("kind", (-F.col("similarity")).alias("s"), "id", "filename")))
    return both.agg(F.array_distinct(F.transform(listed, lambda r: r["filename"])).alias("sources"))
