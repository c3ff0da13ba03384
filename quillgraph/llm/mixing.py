"""Mixing of sources to target weights, with DataFrame functions alone.

Words are added up per source; sources by code point (null last) weigh 5, 2, 1, repeating,
and share a number of words: the targets. No target passes ``most`` times its source; what
is above is shared again by weight. A source's rate is its target over its size, and each
document is emitted floor(rate) times, and once more if the hash of the seed, its id, its text and its
number among the rows that share both, as a fraction, is below the rest of the rate. Reruns agree.

A null or empty text has size 0 and is emitted like the others of its source. A null source
is a source of its own, the last. A null id is hashed as the empty text. Repeated rows are numbered, and drawn
each by itself. Empty tables give empty results. The plan's
columns replace columns of the same name; the mix has the columns of the documents as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import WORD, materialize

#: Sources up to which their table is broadcast (some 100 bytes each); beyond, the join is salted.
BROADCAST_SOURCES = 100_000
#: Keys of repeated rows up to which they are broadcast (32 bytes each).
BROADCAST_KEYS = 500_000
SALTS = 64


def words_of(text: str = "text") -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target``: one row per source.

    With caps c = ``most`` x size and weights w, the targets are min(c, level x w): sources
    by c / w, the level is that at which those below it are full and the rest share what is
    left. One row per source is ordered in one task; documents are added up before.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 bytes order as code points do.
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sizes.select("source", "source_size", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", F.col("source").isNull(), "source")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    whole = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("level", level)
    # The first source that the level doesn't fill sets it for all after it; the others are full.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return filled.select("source", "source_size", target.alias("target"))


ADDED = ("size", "source_size", "target", "copies")


def _with_draws(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``_mix_draw``, from 0 to 1. Rows of the same id and text are few as a rule; they alone are shuffled, salted, to be numbered."""
    keyed = docs.withColumn("_mix_key", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))))
    often = materialize(keyed.groupBy("_mix_key").count().where("count > 1").select("_mix_key"), "mix-repeats")
    n = often.count()
    if not n:
        numbered = keyed.withColumn("_mix_number", F.lit(1).cast("long"))
    else:
        few = F.broadcast(often) if n <= BROADCAST_KEYS else often
        salted = keyed.join(few, "_mix_key", "left_semi").withColumn("_mix_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
        own = W.partitionBy("_mix_key", "_mix_salt").orderBy(F.lit(0))
        some = materialize(salted.withColumn("_mix_own", F.row_number().over(own)), "mix-repeated")
        sums = some.groupBy("_mix_key", "_mix_salt").count()
        before = W.partitionBy("_mix_key").orderBy("_mix_salt").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select("_mix_key", "_mix_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_before"))
        some = some.join(sums, ["_mix_key", "_mix_salt"]).withColumn("_mix_number", (F.col("_mix_before") + F.col("_mix_own")).cast("long"))
        once = keyed.join(few, "_mix_key", "left_anti").withColumn("_mix_number", F.lit(1).cast("long"))
        numbered = once.unionByName(some.select(once.columns))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("_mix_key"), F.lit(":"), F.col("_mix_number").cast("string")))
    return numbered.withColumn("_mix_draw", F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).drop("_mix_key", "_mix_number")


def _planned(docs: DataFrame, seed: int, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``docs`` with what the plan adds, under names that begin with ``_mix_``."""
    docs = docs.withColumn("_mix_size", words_of())
    targets = materialize(source_targets(docs.select("source", F.col("_mix_size").alias("size")), weights, share, most), "mix-targets")
    targets = targets.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"))
    docs = _with_draws(docs, seed)
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("_mix_source")), "left")
    else:  # salted, as one source may hold most documents
        docs = docs.withColumn("_mix_salt", F.pmod(F.xxhash64("doc_id", "_mix_draw"), F.lit(SALTS)).cast("int"))
        targets = targets.withColumn("_mix_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        same = F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_salt") == F.col("_mix_salt2"))
        joined = docs.join(targets, same, "left").drop("_mix_salt", "_mix_salt2")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(F.col("_mix_draw") < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return joined.withColumn("_mix_copies", copies).drop("_mix_source", "_mix_draw")


def mixing_plan(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``size, source_size, target, copies`` to every document of ``docs(doc_id, text, source)``."""
    planned = _planned(docs, seed, weights, share, most)
    return planned.select(*[F.col(c) for c in docs.columns if c.lower() not in ADDED], *[F.col(f"_mix_{c}").alias(c) for c in ADDED])


def mix_sources(docs: DataFrame, seed: int = 17, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mix: each document as often as its copies say, with the columns of ``docs``."""
    planned = _planned(docs, seed, weights, share, most).where(F.col("_mix_copies") > 0)
    repeated = planned.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
    return repeated.select(*[F.col(c) for c in docs.columns])
