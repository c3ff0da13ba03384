"""A training corpus from raw documents: quality, rules, near-duplicates, mixture, packing.

Each stage takes what the one before it kept, written as Parquet and reread.

Null and empty texts fail the rules; where a stage gets them by itself, they are scored, linked and
packed as its operator says. Very long texts are taken whole. Rows without an id are classified, mixed and packed like
others, and the near-duplicate stage keeps them; rows of one id and text are one document to that
stage. Ties go to the least id. An empty table, or one without labels, gives what its operators say: no rows, or a
classifier that scores 0.5 and a field with prior weights. Columns besides those of ``documents`` go on to the packing, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import line_crf, mil_quality, mixing, packing, simhash
from quillgraph.llm.common import materialize, read_table

#: Texts that share 0.8 of their shingles differ in 39 of 256 bits on average, with a deviation of 6.
BITS, RADIUS = 256, 46


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return mil_quality.keep_good(docs, mil_quality.fit_quality(docs, read_table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which enough is content. The field learns from labelled documents of both kinds, so also from those that the classifier rejected."""
    return line_crf.keep_content(docs, line_crf.fit_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, a similarity of about 0.8 or more by 256 bits."""
    return simhash.keep_first(docs, shingle=5, bits=BITS, radius=RADIUS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture has them."""
    return mixing.mix_sources(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("source mixture", source_mixture),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and fingerprints can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
