"""Interfaces to models, with deterministic stand-ins that need no network, and remote ones around a caller's function.

A stand-in never claims to equal a model; it makes runs reproducible. A call that fails is a row's error, not a job's.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import jsonfix
from quillgraph.functions.text import content_hash, keywords, sentences, words
from quillgraph.operators import relate

#: What an extractor returns for each piece of text.
CONCEPTS = "array<struct<name:string,description:string,specificity_level:string,confidence:double>>"
CLAIMS = "array<struct<claim_text:string,related_concept:string,claim_type:string,confidence:double>>"
TOPICS = "project_id long, seq long, name string, description string, related_to array<string>, importance string"

# How general a concept is by its level.
GENERALITY = {"broad": 0.8, "medium": 0.5, "specific": 0.2}


class Embedder(Protocol):
    """Vectors of texts."""

    dim: int

    def embed(self, rows: DataFrame, text: str, out: str) -> DataFrame: ...


class Extractor(Protocol):
    """``piece, concepts, claims, error`` of ``pieces(piece, title, content, whole)``; ``whole`` says that a piece is a whole document."""

    def extract(self, pieces: DataFrame) -> DataFrame: ...


class Classifier(Protocol):
    """Pairs with ``type, direction, confidence, reasoning``. ``pairs`` has the columns of ``relate.top_pairs``."""

    def classify(self, pairs: DataFrame, concepts: DataFrame) -> DataFrame: ...


class Suggester(Protocol):
    """Expected topics, as ``TOPICS``, of projects ``(project_id, concepts, domain)``."""

    def suggest(self, projects: DataFrame) -> DataFrame: ...


class Writer(Protocol):
    """One text for a prompt; empty where the model fails. Called on the driver, once a question or project."""

    def write(self, prompt: str) -> str: ...


# --- vectors ------------------------------------------------------------------


class HashedWords:
    """Counts of words by four hashes each, normalised: column expressions alone."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, rows: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        """Blank texts have no vector."""
        spot = lambda w, k: F.pmod(F.conv(F.substring(F.md5(w), 1 + 8 * k, 8), 16, 10).cast("long"), F.lit(self.dim)).cast("int")
        spots = F.flatten(F.transform(words(F.lower(F.col(text))), lambda w: F.array(*[spot(w, k) for k in range(4)])))
        counts = F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)), lambda i: F.size(F.filter("_spots", lambda s: s == i)).cast("double"))
        n = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda s, x: s + x * x))
        counted = rows.withColumn("_spots", spots).withColumn("_counts", counts).withColumn("_n", n)
        return counted.withColumn(out, F.when(F.col("_n") > 0, F.transform("_counts", lambda x: x / F.col("_n")))).drop("_spots", "_counts", "_n")


class RemoteEmbedder:
    """A caller's function from texts to vectors, with retries, once per distinct text."""

    def __init__(self, call: Callable[[list[str]], list[list[float] | None]], dim: int, batch: int = 16, attempts: int = 3, concurrency: int = 3, wait: float = 1.0):
        self.call, self.dim, self.batch, self.attempts, self.concurrency, self.wait = call, dim, batch, attempts, concurrency, wait

    def embed(self, rows: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        call, dim, size, attempts, wait = self.call, self.dim, self.batch, self.attempts, self.wait

        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                got: list = []
                for at in range(0, len(texts), size):
                    some = texts.iloc[at : at + size].tolist()
                    for turn in range(attempts):
                        try:
                            found = call(some)
                            break
                        except Exception:
                            found = [None] * len(some)
                            if turn + 1 < attempts:
                                time.sleep(wait * 2**turn)
                    got += [v if v is not None and len(v) == dim else None for v in found]
                yield pd.Series(got, index=texts.index)

        keyed = rows.withColumn("_h", content_hash(F.trim(F.col(text))))
        once = keyed.where(F.trim(F.col(text)) != "").select("_h", F.trim(F.col(text)).alias("_t")).dropDuplicates(["_h"]).repartition(self.concurrency)
        return keyed.join(once.select("_h", vectors("_t").alias(out)), "_h", "left").drop("_h")


# --- concepts and claims ------------------------------------------------------

#: Words by which the stand-in takes a sentence for an objection.
OBJECTIONS = ("not", "no", "never", "cannot", "fails", "contrary", "unlike")


class KeywordExtractor:
    """Keywords stand in for a model's concepts, and the first sentences that contain one for its claims."""

    def __init__(self, n: int = 8, claims: int = 3):
        self.n, self.claims = n, claims

    def extract(self, pieces: DataFrame) -> DataFrame:
        found = keywords(pieces.select(F.col("piece").alias("id"), F.col("content").alias("content_text")), self.n)
        named = found.groupBy(F.col("id").alias("piece")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda k: k).alias("k"))
        said = sentences(F.col("content"))
        objects = lambda s: F.arrays_overlap(words(F.lower(s)), F.array(*[F.lit(w) for w in OBJECTIONS]))

        def about(k):
            own = F.slice(F.filter(said, lambda s: F.contains(F.lower(s), k["keyword"])), 1, self.claims)
            return F.transform(own, lambda s: F.struct(s.alias("claim_text"), k["keyword"].alias("related_concept"), F.when(objects(s), "contradicts").otherwise("supports").alias("claim_type"), F.lit(0.7).cast("double").alias("confidence")))

        concepts = F.transform("k", lambda k: F.struct(k["keyword"].alias("name"), F.lit("").alias("description"), F.lit("medium").alias("specificity_level"), F.round(0.75 + 0.25 / k["rank"], 4).alias("confidence")))
        joined = pieces.select("piece", "content").join(named, "piece", "left").withColumn("k", F.coalesce("k", F.array().cast("array<struct<rank:bigint,keyword:string>>")))
        return joined.select("piece", concepts.cast(CONCEPTS).alias("concepts"), F.flatten(F.transform("k", about)).cast(CLAIMS).alias("claims"), F.lit(None).cast("string").alias("error"))


def ask_json(call: Callable[[str], str], prompt: str, simpler: str, attempts: int = 2) -> str | None:
    """The answer as JSON text; null if none came. An empty answer ends it, one that isn't JSON is asked for again by the simpler prompt."""
    for turn in range(attempts):
        answer = call(simpler if turn else prompt)
        if not answer:
            return None
        if (fixed := jsonfix.repair(answer)) is not None:
            return fixed
    return None


class RemoteExtractor:
    """A caller's function from a prompt to a text, which should be JSON with ``concepts`` and ``claims``."""

    def __init__(self, call: Callable[[str], str], attempts: int = 2, concurrency: int = 2):
        self.call, self.attempts, self.concurrency = call, attempts, concurrency

    @staticmethod
    def prompts(title: str, content: str, whole: bool) -> tuple[str, str]:
        form = '{"concepts": [{"concept_name", "description", "specificity_level": "broad|medium|specific", "confidence": 0..1}], "claims": [{"claim_text", "related_concept", "claim_type": "supports|contradicts|extends|complements", "confidence": 0..1}]}'
        what = "document" if whole else "passage"
        return f"List the main concepts of this {what} of '{title}', and what it claims about them, as JSON of the form {form}.\n\n{content}", f"Answer with JSON alone, of the form {form}, for this text:\n\n{content}"

    def extract(self, pieces: DataFrame) -> DataFrame:
        call, attempts, prompts, threads = self.call, self.attempts, self.prompts, self.concurrency

        def ask(row: tuple) -> tuple:
            piece, title, content, whole = row
            try:
                answer = ask_json(call, *prompts(title or "", content or "", bool(whole)), attempts)
                return piece, answer, None if answer is not None else "no answer that is JSON"
            except Exception as error:  # one piece's failure
                return piece, None, f"{type(error).__name__}: {error}"[:500]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(threads) as pool:
                for pdf in batches:
                    yield pd.DataFrame(list(pool.map(ask, pdf.itertuples(index=False, name=None))), columns=["piece", "answer", "error"])

        answers = pieces.select(F.col("piece").cast("long").alias("piece"), "title", "content", "whole").mapInPandas(run, "piece long, answer string, error string")
        # An answer that is a bare array lists concepts.
        whole = answers.withColumn("answer", F.when(F.col("answer").startswith("["), F.concat(F.lit('{"concepts": '), "answer", F.lit("}"))).otherwise(F.col("answer")))
        parts = whole.withColumn("concepts_json", F.get_json_object("answer", "$.concepts")).withColumn("claims_json", F.get_json_object("answer", "$.claims"))
        concepts = jsonfix.concept_rows(parts.select("piece", "concepts_json"), "concepts_json")
        claims = jsonfix.claim_rows(parts.select("piece", "claims_json"), "claims_json")
        listed = concepts.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "description", "specificity_level", "confidence"))), lambda c: c.dropFields("position")).cast(CONCEPTS).alias("concepts"))
        said = claims.groupBy("piece").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "claim_text", "related_concept", "claim_type", "confidence"))), lambda c: c.dropFields("position")).cast(CLAIMS).alias("claims"))
        joined = answers.select("piece", "error").join(listed, "piece", "left").join(said, "piece", "left")
        return joined.select("piece", F.coalesce("concepts", F.array().cast(CONCEPTS)).alias("concepts"), F.coalesce("claims", F.array().cast(CLAIMS)).alias("claims"), "error")


# --- relationships, topics, texts ----------------------------------------------


class RuleClassifier:
    """Rules on generality and similarity stand in for a model's classes."""

    # The model's class that a rule's type stands for.
    CLASSES = {"parent_child": "supports", "prerequisite": "extends", "builds_on": "extends", "complements": "complements", "similar": "supports"}

    def classify(self, pairs: DataFrame, concepts: DataFrame) -> DataFrame:
        to = F.create_map(*[F.lit(x) for kv in self.CLASSES.items() for x in kv])
        typed = relate.classify_by_rules(pairs, concepts)
        direction = F.when(F.col("type") == "builds_on", "b_to_a").otherwise("a_to_b")
        return typed.select(*pairs.columns, to[F.col("type")].alias("type"), direction.alias("direction"), F.col("rule_strength").alias("confidence"), F.lit(None).cast("string").alias("reasoning"))


class RemoteClassifier:
    """A caller's function from a prompt to a text, which should be JSON with ``relationship_type, direction, confidence, reasoning``.

    Unknown types are ``complements``, unknown directions ``a_to_b``; a pair whose call fails has the type ``none``, which isn't stored.
    """

    def __init__(self, call: Callable[[str], str], attempts: int = 2, concurrency: int = 2):
        self.call, self.attempts, self.concurrency = call, attempts, concurrency

    def classify(self, pairs: DataFrame, concepts: DataFrame) -> DataFrame:
        call, attempts, threads = self.call, self.attempts, self.concurrency
        texts = concepts.select(F.col("id").alias("a"), F.concat_ws(": ", "name", "description").alias("text_a"))
        rows = pairs.join(texts, "a").join(texts.select(F.col("a").alias("b"), F.col("text_a").alias("text_b")), "b")

        def ask(row: tuple) -> tuple:
            a, b, one, two = row
            form = '{"relationship_type": "supports|contradicts|extends|complements|none", "direction": "a_to_b|b_to_a|bidirectional", "confidence": 0..1, "reasoning": ""}'
            try:
                answer = ask_json(call, f"How does A relate to B? Answer as JSON of the form {form}.\nA: {one}\nB: {two}", f"JSON alone, of the form {form}. A: {one} B: {two}", attempts)
                found = json.loads(answer) if answer else {}
            except Exception:
                found = {}
            found = found if isinstance(found, dict) else {}
            failed = {} if found else {"relationship_type": "none"}
            return a, b, *(str(x) if (x := (found | failed).get(k)) is not None else None for k in ("relationship_type", "direction", "confidence", "reasoning"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(threads) as pool:
                for pdf in batches:
                    yield pd.DataFrame(list(pool.map(ask, pdf.itertuples(index=False, name=None))), columns=["a", "b", "type", "direction", "confidence", "reasoning"])

        said = rows.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, type string, direction string, confidence string, reasoning string")
        typed = said.select(
            "a", "b", jsonfix.allowed(F.col("type"), ("supports", "contradicts", "extends", "complements", "none"), "complements").alias("type"),
            jsonfix.allowed(F.col("direction"), ("a_to_b", "b_to_a", "bidirectional"), "a_to_b").alias("direction"), jsonfix.clamp(F.col("confidence")).alias("confidence"), "reasoning",
        )
        return pairs.join(typed, ["a", "b"])


class NoSuggestions:
    """No topics."""

    def suggest(self, projects: DataFrame) -> DataFrame:
        return projects.sparkSession.createDataFrame([], TOPICS)


class RemoteSuggester:
    """A caller's function from a prompt to a text, which should be a JSON array of topics. Projects are asked for one by one in tasks."""

    def __init__(self, call: Callable[[str], str], attempts: int = 2):
        self.call, self.attempts = call, attempts

    def suggest(self, projects: DataFrame) -> DataFrame:
        call, attempts = self.call, self.attempts
        form = '[{"name": "", "description": "", "related_to": [""], "importance": "critical|important|nice_to_have"}]'

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for project, concepts, domain in pdf.itertuples(index=False, name=None):
                    about = f"Domain: {domain}. Concepts: {', '.join(concepts)}."
                    try:
                        answer = ask_json(call, f"Which topics would one expect here that are absent? JSON of the form {form}.\n{about}", f"JSON alone, of the form {form}. {about}", attempts)
                        found = json.loads(answer) if answer else []
                    except Exception:
                        found = []
                    for k, t in enumerate(t for t in (found if isinstance(found, list) else []) if isinstance(t, dict)):
                        related = [str(x) for x in t["related_to"]] if isinstance(t.get("related_to"), list) else []
                        rows.append((project, k, str(t.get("name") or ""), str(t.get("description") or ""), related, str(t.get("importance") or "")))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in TOPICS.split(", ")])

        return projects.select(F.col("project_id").cast("long").alias("project_id"), "concepts", "domain").mapInPandas(run, TOPICS)


class NoWriter:
    """No text; templates stand in."""

    def write(self, prompt: str) -> str:
        return ""


class RemoteWriter:
    """A caller's function from a prompt to a text; empty where it fails."""

    def __init__(self, call: Callable[[str], str]):
        self.call = call

    def write(self, prompt: str) -> str:
        try:
            return self.call(prompt) or ""
        except Exception:
            return ""


def template_answer(found: DataFrame) -> DataFrame:
    """``answer``: the nearest chunk's text stands in for a model's answer."""
    return found.agg(F.coalesce(F.max_by("content", F.struct("similarity", -F.col("id"))), F.lit("")).alias("answer"))
