"""The queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import chat, line_crf, matroska, mil_quality, mixing, packing, recurrent_lm, simhash, token_counts, token_files
from quillgraph.llm.common import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.score_documents(read_table(spark, sf_dir, "documents"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digest(read_table(spark, sf_dir, "documents"))


def op6_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mil_quality.score_quality(docs, mil_quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["first"].cast("string"), m["last"].cast("string"))), ";")
    return turned.select("conv_id", "part", "speaker", "start", "n_turns", "n_own", "text", spans.alias("mask"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_crf.apply_rules(docs, line_crf.fit_rules(docs, read_table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = (
        op1_best_fit_packing, op2_source_mixing, op3_token_counts, op4_recurrent_lm, op5_matroska, op6_mil_quality,
        op7_token_files, op8_simhash, op9_chat_rotation, op10_line_crf,
    )
    return {f.__name__: f for f in own} | {"pipeline": run}
