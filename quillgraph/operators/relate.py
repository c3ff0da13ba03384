"""Relationships between concepts: candidates, evidence, classes, strength, duplicates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.vectors import most_similar, similar_pairs
from quillgraph.params import DEFAULTS, Params
from quillgraph.sources.store import stored

# A model's classes as stored types, and how much a type counts.
STORED_TYPE = {"supports": "similar", "extends": "builds_on", "contradicts": "contradicts", "complements": "complements", "none": None}
TYPE_WEIGHT = {"prerequisite": 1.0, "contradicts": 0.95, "builds_on": 0.9, "parent_child": 0.85, "complements": 0.7, "similar": 0.5}


PAIR = "project_id long, a long, b long, sim double"


def candidate_pairs(concepts: DataFrame, p: Params = DEFAULTS, **more) -> DataFrame:
    """``project_id, a, b, sim``: pairs whose similarity is neither too low nor too high; ``more`` is for ``similar_pairs``.

    Candidates grow with the square of a project's concepts. What follows takes what it needs of concepts along with their
    vectors (``top_candidates``, ``fresh_candidates``, ``classify_candidates``, ``shared_candidates``, ``score_candidates``),
    so that no candidate is shuffled; the functions of pairs are for few, such as the most similar.
    """
    return similar_pairs(concepts, p.pair_low, p.pair_high, **more)


def top_candidates(concepts: DataFrame, n: int = 500, p: Params = DEFAULTS) -> DataFrame:
    """Each project's most similar candidates, with ``rank``; a task gives no more than ``n`` of a project."""
    return top_pairs(candidate_pairs(concepts, p, fold=most_similar(n), schema=PAIR), n)


def fresh_candidates(concepts: DataFrame, relationships: DataFrame, p: Params = DEFAULTS, most: int | None = None) -> DataFrame:
    """Candidates without a relationship in either direction; with ``most``, the most similar of each project, with ``rank``."""
    ends = F.least("source_concept_id", "target_concept_id").alias("id"), F.greatest("source_concept_id", "target_concept_id").alias("other")
    known = relationships.select(*ends).distinct().groupBy("id").agg(F.collect_list("other").alias("known"))
    rows = concepts.select("project_id", "id", "embedding").join(known, "id", "left")
    if most is None:
        return candidate_pairs(rows, p, without="known")
    return top_pairs(candidate_pairs(rows, p, without="known", fold=most_similar(most), schema=PAIR), most)


def fresh_pairs(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    """Pairs without a relationship in either direction."""
    known = relationships.select(F.least("source_concept_id", "target_concept_id").alias("a"), F.greatest("source_concept_id", "target_concept_id").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti")


def top_pairs(pairs: DataFrame, n: int = 500) -> DataFrame:
    """Each project's most similar pairs. Tasks rank their own rows first, so that few are shuffled."""
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("sim"), "a", "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n)


#: Bytes of names that a worker's automaton is built from; more are matched in as many passes over the texts as it takes.
NAME_BYTES = 16 << 20
_AUTOMATA: dict = {}


def _automaton(key: str, names: list[tuple[int, str]]):
    """The worker's automaton of these names; it keeps one."""
    if key not in _AUTOMATA:
        import ahocorasick

        found = ahocorasick.Automaton()
        for i, name in names:
            found.add_word(name, i)
        found.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = found
    return _AUTOMATA[key]


def mentions(concepts: DataFrame, chunks: DataFrame, most_bytes: int = NAME_BYTES) -> DataFrame:
    """``concept_id, chunk_id``: chunks that contain a concept's name, whatever the case; blank names match none.

    Equal names are looked for once. Each worker builds an automaton of all names and reads its texts once; texts
    aren't shuffled. Names of more than ``most_bytes`` in all are parted by a hash, and each part reads the texts.
    """
    named = concepts.select(F.col("id").cast("long").alias("concept_id"), F.lower(F.trim("name")).alias("name")).where("name <> ''")
    names = stored(named.groupBy("name").agg(F.min("concept_id").alias("name_id")), "names")
    texts = chunks.select(F.col("id").cast("long").alias("chunk_id"), F.lower("content").alias("content")).where("content is not null")
    size = names.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).first()[0]
    parts, spark, out = max(1, -(-size // most_bytes)), concepts.sparkSession, None
    for part in range(parts):
        own = [tuple(r) for r in names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).select("name_id", "name").collect()]
        shared, key = spark.sparkContext.broadcast(own), uuid.uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(key, shared.value) if shared.value else None
            for batch in batches if automaton else ():
                ids, where = [], []
                for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    met = {i for _, i in automaton.iter(text)}
                    ids += met
                    where += [chunk] * len(met)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(where, pa.int64())], ["name_id", "chunk_id"])

        seen = texts.mapInArrow(find, "name_id long, chunk_id long")
        out = seen if out is None else out.unionByName(seen)
    owners = named.join(names, "name").select("name_id", "concept_id")
    return out.join(owners, "name_id").select("concept_id", "chunk_id")


def cooccurrence(mentioned: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, co_occurrence``: chunks that mention both, for the given pairs. Mentions are joined from the pairs, not with each other."""
    first = pairs.select("a", "b").join(mentioned.withColumnRenamed("concept_id", "a"), "a")
    both = first.join(mentioned.withColumnRenamed("concept_id", "b"), ["b", "chunk_id"])
    return both.groupBy("a", "b").agg(F.count_distinct("chunk_id").alias("co_occurrence"))


def shared_documents(claims: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, shared_docs``: documents with claims on both, for the given pairs."""
    seen = claims.select("concept_id", "document_id").distinct()
    first = pairs.select("a", "b").join(seen.withColumnRenamed("concept_id", "a"), "a")
    both = first.join(seen.withColumnRenamed("concept_id", "b"), ["b", "document_id"])
    return both.groupBy("a", "b").agg(F.count("*").alias("shared_docs"))


def _listed(rows: DataFrame, of: str, name: str) -> DataFrame:
    """``id`` and the distinct values of ``of`` in rows of that concept."""
    return rows.select(F.col("concept_id").alias("id"), of).distinct().groupBy("id").agg(F.collect_list(of).alias(name))


def shared_candidates(concepts: DataFrame, claims: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``a, b, shared_docs``: candidates with documents that have claims on both."""
    rows = concepts.select("project_id", "id", "embedding").join(_listed(claims, "document_id", "shared_docs"), "id", "left")
    return candidate_pairs(rows, p, shared=("shared_docs",)).where("shared_docs > 0").select("a", "b", "shared_docs")


def evidence(pairs: DataFrame, mentioned: DataFrame, chunks: DataFrame, n: int = 3, chars: int = 150) -> DataFrame:
    """``a, b, previews``: the first chunks that mention both."""
    first = pairs.select("a", "b").join(mentioned.withColumnRenamed("concept_id", "a"), "a")
    both = first.join(mentioned.withColumnRenamed("concept_id", "b"), ["b", "chunk_id"])
    ranked = both.withColumn("k", F.row_number().over(W.partitionBy("a", "b").orderBy("chunk_id"))).where(F.col("k") <= n)
    texts = chunks.select(F.col("id").alias("chunk_id"), F.regexp_replace(F.left("content", F.lit(chars)), "\n", " ").alias("preview"))
    return ranked.join(texts, "chunk_id").groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "preview"))), lambda s: s["preview"]).alias("previews"))


def claims_for_prompt(claims: DataFrame, n: int = 4) -> DataFrame:
    """The first claims of each concept."""
    return claims.withColumn("k", F.row_number().over(W.partitionBy("concept_id").orderBy("id"))).where(F.col("k") <= n).drop("k")


def rule_type(g1: Column, g2: Column, sim: Column) -> Column:
    """Type and strength of a pair by rules on generality and similarity, the first that holds."""
    gap = F.abs(g1 - g2)

    def of(kind: str, strength: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), strength.alias("strength"))

    return (
        F.when((gap > 0.3) & (sim > 0.6), of("parent_child", sim)).when(g1 > g2 + 0.2, of("prerequisite", sim * 0.8))
        .when((gap < 0.2) & (sim > 0.7), of("complements", sim)).when((sim > 0.5) & (sim < 0.7) & (g2 > g1), of("builds_on", sim)).otherwise(of("similar", sim))
    )


def classify_by_rules(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """Pairs with ``type`` and ``rule_strength``; a missing generality counts as 0.5."""
    g = concepts.select(F.col("id").alias("a"), F.coalesce("generality_score", F.lit(0.5)).alias("g1"))
    both = pairs.join(g, "a").join(g.select(F.col("a").alias("b"), F.col("g1").alias("g2")), "b")
    return _ruled(both.select(*pairs.columns, "g1", "g2"))


def _ruled(pairs: DataFrame) -> DataFrame:
    """Pairs, which have ``g1`` and ``g2``, with ``type`` and ``rule_strength``."""
    rule = rule_type(F.col("g1"), F.col("g2"), F.col("sim"))
    return pairs.withColumn("_r", rule).select(*pairs.columns, F.col("_r.type").alias("type"), F.col("_r.strength").alias("rule_strength"))


def classify_candidates(concepts: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Candidates with ``g1, g2, type, rule_strength``, by the same rules."""
    rows = concepts.select("project_id", "id", "embedding", F.coalesce("generality_score", F.lit(0.5)).alias("g"))
    return _ruled(candidate_pairs(rows, p, carry=("g",)).withColumnsRenamed({"g_a": "g1", "g_b": "g2"}))


def strength(sim: Column, co: Column, max_co: Column, shared: Column, confidence: Column) -> Column:
    """0.30 similarity + 0.25 co-occurrence + 0.25 shared documents + 0.20 confidence, within 0 and 1."""
    s = 0.30 * sim + 0.25 * (co / max_co) + 0.25 * shared + 0.20 * confidence
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)), 4)


def score_pairs(pairs: DataFrame, co: DataFrame, shared: DataFrame, mentioned: DataFrame, concepts: DataFrame) -> DataFrame:
    """Pairs with ``co_occurrence, shared_docs, strength``; ``pairs`` has ``confidence``. The most mentions of a single concept of the project scale co-occurrence."""
    joined = pairs.join(co, ["a", "b"], "left").join(shared, ["a", "b"], "left").join(_most_mentions(mentioned, concepts), "project_id", "left")
    return _scored(joined.na.fill(0, ["co_occurrence", "shared_docs"]).na.fill(1, ["max_co"])).drop("max_co")


def _most_mentions(mentioned: DataFrame, concepts: DataFrame) -> DataFrame:
    """``project_id, max_co``."""
    counts = mentioned.groupBy("concept_id").count().join(concepts.select(F.col("id").alias("concept_id"), "project_id"), "concept_id")
    return counts.groupBy("project_id").agg(F.max("count").alias("max_co"))


def _scored(pairs: DataFrame) -> DataFrame:
    has = F.when(F.col("shared_docs") > 0, 1.0).otherwise(0.0)
    return pairs.withColumn("strength", strength(F.col("sim"), F.col("co_occurrence"), F.col("max_co"), has, F.col("confidence")))


def score_candidates(concepts: DataFrame, mentioned: DataFrame, claims: DataFrame, confidence: Column, p: Params = DEFAULTS) -> DataFrame:
    """Candidates with ``co_occurrence, shared_docs, strength``, as ``score_pairs`` has them; ``confidence`` may use the columns of pairs."""
    rows = concepts.select("project_id", "id", "embedding").join(_listed(mentioned, "chunk_id", "co_occurrence"), "id", "left").join(_listed(claims, "document_id", "shared_docs"), "id", "left")
    rows = rows.join(_most_mentions(mentioned, concepts), "project_id", "left").na.fill(1, ["max_co"])
    pairs = candidate_pairs(rows, p, carry=("max_co",), shared=("co_occurrence", "shared_docs")).withColumnRenamed("max_co_a", "max_co").drop("max_co_b")
    return _scored(pairs.withColumn("confidence", confidence)).drop("max_co")


def resolve_direction(pairs: DataFrame) -> DataFrame:
    """``source_concept_id, target_concept_id, relationship_type`` from a model's ``type`` and ``direction``.

    Only ``b_to_a`` turns a pair round; an ``extends`` both ways becomes ``complements``; a class without a stored type is dropped.
    """
    stored = F.create_map(*[F.lit(x) for k, v in STORED_TYPE.items() if v for x in (k, v)])
    back = F.col("direction") == "b_to_a"
    both = (F.col("type") == "extends") & (F.col("direction") == "bidirectional")
    out = pairs.withColumn("relationship_type", F.when(both, "complements").otherwise(stored[F.col("type")])).where("relationship_type is not null")
    return out.withColumn("source_concept_id", F.when(back, F.col("b")).otherwise(F.col("a"))).withColumn("target_concept_id", F.when(back, F.col("a")).otherwise(F.col("b")))


def dedupe_relationships(detected: DataFrame) -> DataFrame:
    """One row per unordered pair of ``detected(seq, source_concept_id, target_concept_id, type, direction, confidence, strength)``.

    In order of ``seq``: an ``extends`` that meets one of the other direction makes both a ``complements`` with mean
    confidence and strength; otherwise the higher confidence stays and notes what it replaced.
    """
    fields = ["seq", "source_concept_id", "target_concept_id", "type", "direction", "confidence", "strength"]
    state = F.struct(*fields, F.lit(None).cast("string").alias("replaced_type"), F.lit(None).cast("double").alias("replaced_confidence"), F.lit(False).alias("merged_extends"))
    key = [F.least("source_concept_id", "target_concept_id").alias("a"), F.greatest("source_concept_id", "target_concept_id").alias("b")]
    grouped = detected.withColumn("_s", state).groupBy(*key).agg(F.array_sort(F.collect_list("_s")).alias("all"))

    def step(best: Column, r: Column) -> Column:
        merge = (r["type"] == "extends") & (best["type"] == "extends") & ~r["direction"].eqNullSafe(best["direction"])
        merged = best.withField("type", F.lit("complements")).withField("direction", F.lit("bidirectional")).withField("confidence", F.round((best["confidence"] + r["confidence"]) / 2, 4))
        merged = merged.withField("strength", F.round((best["strength"] + r["strength"]) / 2, 4)).withField("merged_extends", F.lit(True))
        better = r.withField("replaced_type", best["type"]).withField("replaced_confidence", best["confidence"])
        return F.when(merge, merged).when(r["confidence"] > best["confidence"], better).otherwise(best)

    best = F.aggregate(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), F.col("all")[0], step)
    return grouped.select("a", "b", best.alias("best")).select("a", "b", *[F.col(f"best.{c}") for c in [*fields[1:], "replaced_type", "replaced_confidence", "merged_extends"]])


def type_counts(relationships: DataFrame) -> DataFrame:
    return relationships.groupBy("relationship_type").agg(F.count("*").alias("n"))


def importance(relationships: DataFrame, concepts: DataFrame) -> DataFrame:
    """0.4 strength + 0.3 mean coverage of both ends + 0.3 weight of the type."""
    c = concepts.select(F.col("id").alias("source_concept_id"), F.coalesce("coverage_score", F.lit(0.5)).alias("c1"))
    both = relationships.join(c, "source_concept_id").join(c.select(F.col("source_concept_id").alias("target_concept_id"), F.col("c1").alias("c2")), "target_concept_id")
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_WEIGHT.items() for x in kv])[F.col("relationship_type")], F.lit(0.5))
    return both.withColumn("importance", 0.4 * F.coalesce("strength", F.lit(0.0)) + 0.3 * (F.col("c1") + F.col("c2")) / 2 + 0.3 * weight).drop("c1", "c2")


def detect(concepts: DataFrame, chunks: DataFrame, claims: DataFrame, relationships: DataFrame, classify: Callable[[DataFrame, DataFrame], DataFrame], p: Params = DEFAULTS) -> DataFrame:
    """New relationships: candidates that aren't stored, the most similar of each project, classified, scored, without duplicates.

    ``classify`` maps pairs and concepts to pairs with ``type, direction, confidence``, and ``reasoning`` if it gives any.
    """
    pairs = stored(fresh_candidates(concepts, relationships, p, p.max_pairs), "pairs")
    pairs = classify(pairs, concepts)
    pairs, seen = stored(pairs, "classified"), stored(mentions(concepts, chunks), "mentions")  # a model is asked once; texts are searched once
    scored = score_pairs(pairs, cooccurrence(seen, pairs), shared_documents(claims, pairs), seen, concepts)
    return dedupe_relationships(resolve_direction(scored).withColumn("seq", F.col("rank").cast("long")))
