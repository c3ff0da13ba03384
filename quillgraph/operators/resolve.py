"""Resolution of concepts that are one: by name, by similarity, and what hangs on them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import clean_name
from quillgraph.functions.vectors import BEST, best_of, mean_vectors, similar_pairs, spanning
from quillgraph.params import DEFAULTS, Params
from quillgraph.sources.store import stored


def name_key() -> Column:
    """The clean name, or the id where that is blank."""
    clean = clean_name(F.coalesce("name", F.lit("")))
    return F.when(clean == "", F.concat(F.lit("#"), F.col("id").cast("string"))).otherwise(clean)


def name_groups(concepts: DataFrame) -> DataFrame:
    """``project_id, clean, group_id, n``: concepts of one clean name; the group's id is its least."""
    return concepts.groupBy("project_id", name_key().alias("clean")).agg(F.min("id").alias("group_id"), F.count("*").alias("n"))


def merge_threshold(n: Column, p: Params = DEFAULTS) -> Column:
    return F.when(n < p.small_project, p.merge_similarity_small).otherwise(p.merge_similarity)


class Known:
    """Unit vectors with their owners, in a matrix that doubles when it is full."""

    def __init__(self, threshold: float):
        self.threshold, self.owners, self.rows = threshold, [], np.empty((0, 0))

    def add(self, owner: int, x: np.ndarray) -> None:
        n = len(self.owners)
        if n == len(self.rows):
            grown = np.empty((max(16, 2 * n), len(x)))
            grown[:n] = self.rows[:n] if n else 0
            self.rows = grown
        self.rows[n] = x
        self.owners.append(owner)

    def first(self, x: np.ndarray) -> int | None:
        """The first owner whose vector is similar enough."""
        hit = np.flatnonzero(self.rows[: len(self.owners)] @ x >= self.threshold) if self.owners else ()
        return self.owners[hit[0]] if len(hit) else None


def average_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """Groups of unit vectors, merged while the mean distance of two groups is below 1 - ``threshold``.

    The nearest two merge first, by place on ties. A group's mean distances follow from those of its parts.
    """
    n = len(x)
    d = 1.0 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(n), np.arange(n)
    while n > 1:
        i, j = divmod(int(np.argmin(d)), len(d))
        if not d[i, j] < 1.0 - threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        group[group == j] = i
        n -= 1
    return group


def chain_linkage(x: np.ndarray, size: np.ndarray, threshold: float) -> np.ndarray:
    """The groups of ``average_linkage`` for many: ``x`` has means of unit vectors, ``size`` how many each stands for.

    The mean similarity of two groups is the product of their means, so no matrix of distances is held. Chains of nearest
    neighbours merge two that are nearest to each other, which gives the same groups in any order: a merged group is never
    nearer to a third than its nearer part was.
    """
    n = live = len(x)
    x, size, parent, place, dead, chain, start = x.copy(), np.asarray(size, float).copy(), np.arange(n), np.arange(n), np.zeros(n, bool), [], 0
    while live > 1:
        if not chain:
            while dead[start]:
                start += 1
            chain.append(start)
        top = chain[-1]
        near = x @ x[top]
        near[dead], near[top] = -np.inf, -np.inf
        best = int(np.argmax(near))
        if len(chain) > 1 and (near[chain[-2]] >= near[best] or best in chain):
            best = chain[-2]
        if not 1.0 - near[best] < 1.0 - threshold:
            dead[top] = True  # and never merges
            chain.pop()
            live -= 1
        elif len(chain) > 1 and best == chain[-2]:
            i, j = min(top, best), max(top, best)
            x[i] = (size[i] * x[i] + size[j] * x[j]) / (size[i] + size[j])
            size[i] += size[j]
            parent[place[j]], dead[j] = place[i], True
            del chain[-2:]
            live -= 1
        else:
            chain.append(best)
        if dead.sum() * 2 > len(dead) > 64:
            kept = np.flatnonzero(~dead)
            chain, start = np.searchsorted(kept, chain).tolist(), 0
            x, size, place, dead = x[kept], size[kept], place[kept], np.zeros(len(kept), bool)
    for k in range(n):  # a parent is before its parts
        parent[k] = parent[parent[k]]
    return parent


#: Concepts of a component that a task clusters by all their distances, and groups that it merges by chains, for which rounds go on.
LINKED, CHAINED = 2000, 8000


def _merge_large(rows: DataFrame, linked: float) -> DataFrame:
    """``id, merged_id`` of large components: ``rows`` has ``part, id, embedding, t``.

    In rounds, all groups that are nearest to each other merge at once, which is exact for average linkage. Groups without
    a near one are done. When few are left, or rounds merge few, a task merges what is left of a component by chains.
    """

    def ways(pairs: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        p, a, b, sim, t = (pairs.column(c).to_numpy() for c in ("project_id", "a", "b", "sim", "t_a"))
        near = 1.0 - sim < 1.0 - t
        return tuple(np.concatenate([x[near], y[near]]) for x, y in ((p, p), (a, b), (b, a), (sim, sim)))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        group = chain_linkage(np.stack(pdf["embedding"].to_numpy()).astype(float), pdf["n"].to_numpy(), float(pdf["t"].iat[0]))
        return pd.DataFrame({"id": pdf["id"], "merged_id": pdf["id"].to_numpy()[group]})

    groups = stored(rows.select("part", "id", "embedding", "t", F.lit(1).cast("long").alias("n")), "groups")
    members = rows.select("id", F.col("id").alias("merged_id"))
    done = None
    while True:
        best = similar_pairs(groups, linked - 1e-9, float("inf"), project="part", carry=("t",), unit=False, fold=best_of(ways), schema=BEST)
        best = stored(best.groupBy("id").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("other")), "nearest")
        both = best.join(best.select(F.col("id").alias("other"), F.col("other").alias("back")), "other").where("back = id and id < other")
        pairs = stored(both.select(F.col("id").alias("keep"), F.col("other").alias("gone")), "merged")
        left, merges = best.count(), pairs.count()
        if not merges:
            return members
        members = _renamed(members, pairs)
        near = groups.join(best.select("id"), "id", "left_semi").join(pairs.select(F.col("gone").alias("id"), "keep"), "id", "left").withColumn("id", F.coalesce("keep", "id"))
        # Two at most have one id.
        rows_ = F.array_sort(F.collect_list(F.struct("n", "embedding")))
        one = near.groupBy("part", "id").agg(rows_.alias("s"), F.max("t").alias("t"), F.sum("n").alias("n"))
        mean = F.when(F.size("s") == 1, F.col("s")[0]["embedding"]).otherwise(
            F.zip_with(F.col("s")[0]["embedding"], F.col("s")[1]["embedding"], lambda x, y: (x * F.col("s")[0]["n"] + y * F.col("s")[1]["n"]) / F.col("n"))
        )
        groups = stored(one.select("part", "id", mean.alias("embedding"), "t", "n"), "groups")
        members = stored(members, "members")
        if left - merges <= CHAINED or merges * 50 < left:
            last = groups.groupBy("part").applyInPandas(link, "id long, merged_id long")
            return _renamed(members, last.where("id <> merged_id").select(F.col("merged_id").alias("keep"), F.col("id").alias("gone")))


def _renamed(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members whose group is ``gone`` belong to ``keep``."""
    return members.join(pairs.select(F.col("gone").alias("merged_id"), "keep"), "merged_id", "left").select("id", F.coalesce("keep", "merged_id").alias("merged_id"))


def merge_similar(concepts: DataFrame, threshold: float | None = None, p: Params = DEFAULTS) -> DataFrame:
    """``project_id, id, group_id``: name groups with vectors, merged by average linkage.

    The mean vectors of name groups are split into components of the graph of pairs nearer than the
    threshold first: groups of different components are never merged, as all their distances are too large. A small
    component is then clustered in a task, large ones in rounds over all tasks; no task holds the distances of many.
    """
    from quillgraph.plans.components import label_components

    groups = name_groups(concepts)
    keyed = concepts.withColumn("clean", name_key()).join(groups, ["project_id", "clean"])
    means = mean_vectors(keyed, ["project_id", "group_id"], normalize=True).select("project_id", F.col("group_id").alias("id"), F.col("centroid").alias("embedding"))
    size = concepts.groupBy("project_id").agg(F.count("*").alias("size"))
    means = means.join(size, "project_id").withColumn("t", F.lit(threshold) if threshold is not None else merge_threshold(F.col("size"), p))
    lowest = threshold if threshold is not None else min(p.merge_similarity, p.merge_similarity_small)
    means = stored(means, "means")
    parts = label_components(similar_pairs(means, lowest, float("inf"), fold=spanning, schema="a long, b long"))
    joined = stored(means.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")), "parts")
    large = stored(joined.groupBy("part").count().where(F.col("count") > LINKED).select("part"), "large")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        group = average_linkage(np.array(pdf["embedding"].tolist(), float), float(pdf["t"][0]))
        return pd.DataFrame({"project_id": pdf["project_id"], "group_id": pdf["id"], "merged_id": pdf["id"].to_numpy()[group]})

    merged = joined.join(large, "part", "left_anti").groupBy("project_id", "part").applyInPandas(link, "project_id long, group_id long, merged_id long")
    if large.limit(1).count():
        rows = joined.join(large, "part", "left_semi")
        large_merged = _merge_large(rows, lowest)
        merged = merged.unionByName(rows.select(F.col("project_id").cast("long"), "id").join(large_merged, "id").select("project_id", F.col("id").alias("group_id"), "merged_id"))
    return keyed.join(merged, ["project_id", "group_id"], "left").select("project_id", "id", F.coalesce("merged_id", "group_id").alias("group_id"))


def canonical_names(grouped: DataFrame) -> DataFrame:
    """``project_id, group_id, keep_id, canonical_name, aliases, merged_from_ids``.

    The name is the most frequent, then the shortest, then the first by alphabet; the row that stays has a vector if any has, then the least id.
    """
    counts = grouped.groupBy("project_id", "group_id", "name").agg(F.count("*").alias("n"))
    best = counts.groupBy("project_id", "group_id").agg(F.min_by("name", F.struct(-F.col("n"), F.length("name"), F.col("name"))).alias("canonical_name"), F.array_sort(F.collect_set("name")).alias("names"))
    kept = grouped.groupBy("project_id", "group_id").agg(F.min(F.struct(F.col("embedding").isNull().alias("none"), F.col("id").alias("id")))["id"].alias("keep_id"), F.array_sort(F.collect_list("id")).alias("ids"))
    joined = best.join(kept, ["project_id", "group_id"])
    return joined.select("project_id", "group_id", "keep_id", "canonical_name", F.array_except("names", F.array("canonical_name")).alias("aliases"), F.array_except("ids", F.array("keep_id")).alias("merged_from_ids"))


def merge_descriptions(grouped: DataFrame, short: int = 40, most: int = 600) -> DataFrame:
    """``project_id, group_id, description``: the longest, then others of more than ``short`` characters, cut at ``most``."""
    each = grouped.select("project_id", "group_id", "id", F.trim("description").alias("d")).where("d <> ''")
    once = each.groupBy("project_id", "group_id", "d").agg(F.min("id").alias("id"))
    ordered = once.groupBy("project_id", "group_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("d")).alias("l"), "id", "d"))).alias("all"))
    rest = F.transform(F.filter(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), lambda s: F.length(s["d"]) > short), lambda s: s["d"])
    text = F.array_join(F.concat(F.array(F.col("all")[0]["d"]), rest), "; ")
    return ordered.select("project_id", "group_id", F.left(text, F.lit(most)).alias("description"))


def remap(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ids in ``columns`` are replaced by ``mapping(old_id, new_id)``; others stay."""
    out = rows
    for c in columns:
        out = out.join(mapping.select(F.col("old_id").alias(c), F.col("new_id").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*rows.columns)


def normalize(tables: dict[str, DataFrame], total_docs: int, threshold: float | None = None, drop_self_loops: bool = False, p: Params = DEFAULTS) -> dict[str, DataFrame]:
    """New versions of concepts, claims and relationships in which concepts that are one have merged, and the alias table."""
    concepts = tables["concepts"]
    groups = merge_similar(concepts, threshold, p)
    grouped = concepts.join(groups.select("id", "group_id"), "id")
    names = canonical_names(grouped)
    mapping = groups.join(names.select("group_id", "keep_id"), "group_id").where("id <> keep_id").select(F.col("id").alias("old_id"), F.col("keep_id").alias("new_id"))
    claims = remap(tables["claims"], mapping, "concept_id")
    relationships = remap(tables["relationships"], mapping, "source_concept_id", "target_concept_id")
    if drop_self_loops:
        relationships = relationships.where("source_concept_id <> target_concept_id")
    means = mean_vectors(grouped, ["group_id"], normalize=True).select("group_id", F.col("centroid").alias("_mean"))
    texts = merge_descriptions(grouped).select("group_id", F.col("description").alias("_text"))
    docs = claims.groupBy(F.col("concept_id").alias("id")).agg(F.count_distinct("document_id").alias("_docs"))
    kept = concepts.join(names.select(F.col("keep_id").alias("id"), "group_id", "canonical_name", "aliases", "merged_from_ids"), "id")
    kept = remap(kept.join(means, "group_id", "left").join(texts, "group_id", "left").join(docs, "id", "left"), mapping, "parent_concept_id")
    share = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.coalesce("_docs", F.lit(0)), F.lit(total_docs)), F.lit(0.0)))
    single = F.size("merged_from_ids") == 0
    kept = kept.withColumn("name", F.col("canonical_name")).withColumn("embedding", F.when(single, F.col("embedding")).otherwise(F.col("_mean"))).withColumn("description", F.when(single, F.col("description")).otherwise(F.coalesce("_text", "description"))).withColumn("coverage_score", share)
    out = kept.select(*concepts.columns, "aliases", "merged_from_ids")
    return {**tables, "concepts": out, "claims": claims, "relationships": relationships, "aliases": mapping}


def greedy_merge(rows: DataFrame, threshold: float = DEFAULTS.merge_similarity) -> DataFrame:
    """``project_id, id, group_id``: each concept in order of id joins the first seed of its clean name, or else the first seed that is
    similar enough, or becomes a seed. The order matters, so a project is one task's work; nameless concepts are dropped."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        seeds: list[int] = []
        by_name: dict[str, int] = {}
        seen, out = Known(threshold), []
        for i, clean, v in zip(pdf["id"], pdf["clean"], pdf["embedding"]):
            to = by_name.get(clean)
            x = None if v is None else np.asarray(v, float) / max(float(np.linalg.norm(v)), 1e-10)
            if to is None and x is not None:
                to = seen.first(x)
            if to is None:
                to = i
                seeds.append(i)
                if x is not None:
                    seen.add(i, x)
            by_name.setdefault(clean, to)
            out.append(to)
        return pd.DataFrame({"project_id": pdf["project_id"], "id": pdf["id"], "group_id": out})

    named = rows.withColumn("clean", clean_name(F.coalesce("name", F.lit("")))).where("clean <> ''")
    return named.select(F.col("project_id").cast("long").alias("project_id"), F.col("id").cast("long").alias("id"), "clean", F.col("embedding").cast("array<double>").alias("embedding")).groupBy("project_id").applyInPandas(run, "project_id long, id long, group_id long")


def match_names(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new_id, concept_id``: the existing concept of the same clean name with the least id, or none."""
    have = existing.groupBy("project_id", clean_name(F.col("name")).alias("clean")).agg(F.min("id").alias("concept_id"))
    return new.withColumn("clean", clean_name(F.col("name"))).join(have, ["project_id", "clean"], "left").select(F.col("id").alias("new_id"), "concept_id")


def claim_targets(claims: DataFrame, concepts: DataFrame) -> DataFrame:
    """``claim_id, concept_id``: by the same clean name, else the first concept of the batch of which one name contains the other.

    ``claims(claim_id, batch, related_concept)`` meet only concepts ``(id, batch, name)`` of their own batch, which a document bounds;
    the first is that with the least ``position`` if there is one, else with the least id.
    """
    c = claims.withColumn("clean", clean_name(F.col("related_concept")))
    position = F.col("position") if "position" in concepts.columns else F.lit(0)
    k = concepts.select("batch", F.col("id").alias("concept_id"), position.alias("position"), clean_name(F.col("name")).alias("known")).where("known <> ''")
    met = c.join(k, "batch").where((F.col("clean") == F.col("known")) | F.contains("clean", "known") | F.contains("known", "clean"))
    return met.where("clean <> ''").groupBy("claim_id").agg(F.min_by("concept_id", F.struct((F.col("clean") != F.col("known")), "position", "concept_id")).alias("concept_id"))


def _last_wins(all_: Column, one: Column) -> Column:
    """Two maps as one; of equal keys the second's value counts."""
    kept = F.map_filter(all_, lambda k, _: ~F.array_contains(F.map_keys(one), k))
    return F.when(one.isNull(), all_).otherwise(F.map_concat(kept, one))


def merge_records(rows: DataFrame) -> DataFrame:
    """One record per group: the first name by id, the longest description, means of scores, and ``metadata`` maps as one if there are any."""
    first = W.partitionBy("group_id").orderBy("id")
    ranked = rows.withColumn("_k", F.row_number().over(first))
    return ranked.groupBy("group_id").agg(
        F.min("id").alias("id"), F.min_by("name", "_k").alias("name"), F.max_by("description", F.struct(F.length("description"), -F.col("_k"))).alias("description"),
        F.avg("generality_score").alias("generality_score"), F.avg("coverage_score").alias("coverage_score"), F.avg("consensus_score").alias("consensus_score"),
        *([F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("_k", "metadata"))), lambda s: s["metadata"]), F.create_map().cast("map<string,string>"), _last_wins).alias("metadata")] if "metadata" in rows.columns else []),
    )


def first_names(rows: DataFrame, *within: str) -> DataFrame:
    """Of rows of one clean name within ``within`` (such as a chunk), the first by ``position``."""
    first = W.partitionBy(*within, "_clean").orderBy("position")
    named = rows.withColumn("_clean", clean_name(F.col("name"))).where("_clean <> ''")
    return named.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k", "_clean")


def match_concepts(new: DataFrame, existing: DataFrame, threshold: float = DEFAULTS.merge_similarity) -> DataFrame:
    """``project_id, id, concept_id, is_new``: what each new concept is.

    In order of id: the concept of the same clean name; else the first known one that is similar enough; else
    it is new, and known to those after it. Names are matched by a join; only what is left is matched in order, one
    project a task, against the vectors of its project.
    """
    names = match_names(new, existing)
    left = new.join(names.where("concept_id is null").select(F.col("new_id").alias("id")), "id", "left_semi")
    columns = [F.col("project_id").cast("long").alias("project_id"), F.col("id").cast("long").alias("id"), clean_name(F.col("name")).alias("clean"), F.col("embedding").cast("array<double>").alias("embedding")]
    both = left.select(*columns, F.lit(True).alias("fresh")).unionByName(existing.select(*columns, F.lit(False).alias("fresh")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fresh", "id"])
        known: dict[str, int] = {}
        seen, out = Known(threshold), []
        for i, clean, v, fresh in zip(pdf["id"], pdf["clean"], pdf["embedding"], pdf["fresh"]):
            x = None if v is None else np.asarray(v, float) / max(float(np.linalg.norm(v)), 1e-10)
            to = known.get(clean) if fresh else None
            if fresh and to is None and x is not None:
                to = seen.first(x)
            if fresh:
                out.append((pdf["project_id"].iat[0], i, i if to is None else to, to is None))
            known.setdefault(clean, i if to is None else to)
            if to is None and x is not None:
                seen.add(i, x)
        return pd.DataFrame(out, columns=["project_id", "id", "concept_id", "is_new"])

    matched = both.groupBy("project_id").applyInPandas(run, "project_id long, id long, concept_id long, is_new boolean")
    named = names.where("concept_id is not null").join(new.select(F.col("id").alias("new_id"), "project_id"), "new_id")
    return matched.unionByName(named.select(F.col("project_id").cast("long"), F.col("new_id").alias("id"), "concept_id", F.lit(False).alias("is_new")))
