"""Clusters of concepts: density, k-means, centroids, hierarchy, generality, bridges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.vectors import BEST, best_of, dot, l2_normalize, mean_vectors, meet, met, similar_pairs
from quillgraph.operators.consensus import with_totals
from quillgraph.params import DEFAULTS, Params
from quillgraph.sources.store import stored

NOISE = -1
#: Vectors of a block of a large project, and trees that a task merges.
BLOCK, TREES = 2048, 16


def adaptive_size(n: int, floor: int) -> int:
    """Members that a cluster needs in a project of ``n`` concepts."""
    return max(2, max(floor, n // 10) if n >= 10 else floor)


def kmeans_k(n: int, size: int) -> int:
    return min(max(2, min(n // max(size, 2), 10)), n)


# --- density clustering -----------------------------------------------------


def _spanning_tree(d: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of a least spanning tree of a full distance matrix, by Prim's algorithm."""
    n = len(d)
    near, source, out = np.full(n, np.inf), np.zeros(n, int), []
    inside = np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = d[at] < near
        near[closer & ~inside], source[closer & ~inside] = d[at][closer & ~inside], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        out.append((float(near[at]), int(source[at]), at))
    return sorted(out)


def _tree_between(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, rows and columns of a least spanning tree of the edges between rows and columns."""
    sides = d, np.ascontiguousarray(d.T)
    # Nodes inside are never reached again (least) and never chosen (near).
    least = [np.full(k, np.inf) for k in d.shape]
    near = [np.full(k, np.inf) for k in d.shape]
    source = [np.zeros(k, int) for k in d.shape]
    side, at, out = 0, 0, []
    least[0][0] = -np.inf
    for _ in range(sum(d.shape) - 1):
        row, other = sides[side][at], 1 - side
        closer = np.flatnonzero(row < least[other])
        least[other][closer] = near[other][closer] = row[closer]
        source[other][closer] = at
        first = [int(np.argmin(x)) for x in near]
        side = 0 if near[0][first[0]] <= near[1][first[1]] else 1
        at = first[side]
        out.append((near[side][at], *((at, source[0][at]) if side == 0 else (source[1][at], at))))
        least[side][at], near[side][at] = -np.inf, np.inf
    h, a, b = zip(*out)
    return np.array(h), np.array(a), np.array(b)


def merge_trees(edges: list[np.ndarray]) -> np.ndarray:
    """A least spanning forest of the edges (rows: length, two points), sorted by length and points."""
    all_edges = np.concatenate(edges)
    lo, hi = np.minimum(all_edges["a"], all_edges["b"]), np.maximum(all_edges["a"], all_edges["b"])
    all_edges = all_edges[np.lexsort((hi, lo, all_edges["h"]))]
    points, place = np.unique(np.concatenate([all_edges["a"], all_edges["b"]]), return_inverse=True)
    root, keep = list(range(len(points))), []
    n = len(all_edges)
    for k, (a, b) in enumerate(zip(place[:n].tolist(), place[n:].tolist())):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[b] = a
            keep.append(k)
    return all_edges[keep]


def density_clusters(x: np.ndarray, size: int, samples: int) -> np.ndarray:
    """Labels by hierarchical density (excess of mass); -1 is noise. Distances are Euclidean."""
    n = len(x)
    if n < 2:
        return np.full(n, NOISE)
    d = distances(x, x)
    core = np.sort(d, 1)[:, min(samples, n) - 1]
    np.fill_diagonal(reach := np.maximum(np.maximum(core[:, None], core), d), 0)
    return tree_labels(n, _spanning_tree(reach), size)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T, 0))


def tree_labels(n: int, tree: list[tuple[float, int, int]], size: int) -> np.ndarray:
    """Labels from the sorted edges of a least spanning tree of mutual reachability."""
    # Single linkage: nodes n.. join two; each has its size and distance.
    parent, left, right, height, count = list(range(n)), [], [], [], [1] * n

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for h, a, b in tree:
        a, b = top(a), top(b)
        node = len(parent)
        parent.append(node)
        parent[a] = parent[b] = node
        left.append(a)
        right.append(b)
        height.append(h)
        count.append(count[a] + count[b])
    children: dict[int, list[int]] = {}
    birth: dict[int, float] = {}
    mass: dict[int, float] = {}
    member: dict[int, list[int]] = {}

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            if k < n:
                out.append(k)
            else:
                todo += [left[k - n], right[k - n]]
        return out

    # Condense: a split into two large parts makes two clusters; smaller parts fall out of theirs.
    todo = [(len(parent) - 1, 0)]
    birth[0], mass[0], children[0], member[0], made = 0.0, 0.0, [], [], 1
    while todo:
        node, cluster = todo.pop()
        while node >= n:
            a, b, lam = left[node - n], right[node - n], 1.0 / max(height[node - n], 1e-12)
            big = [k for k in (a, b) if count[k] >= size]
            if len(big) == 2:
                mass[cluster] += count[node] * (lam - birth[cluster])
                member[cluster] += leaves(node)
                for k in big:
                    birth[made], mass[made], children[made], member[made] = lam, 0.0, [], []
                    children[cluster].append(made)
                    todo.append((k, made))
                    made += 1
                node = -1
                break
            for k in (a, b):
                if k not in big:
                    mass[cluster] += count[k] * (lam - birth[cluster])
                    member[cluster] += leaves(k)
            if not big:
                node = -1
                break
            node = big[0]
        if 0 <= node < n:
            member[cluster].append(node)
    chosen: set[int] = set()
    best: dict[int, float] = {}
    for c in range(made - 1, -1, -1):
        below = sum(best[k] for k in children[c])
        if c and (not children[c] or mass[c] >= below):
            best[c] = mass[c]
            todo_c = list(children[c])
            while todo_c:
                k = todo_c.pop()
                chosen.discard(k)
                todo_c += children[k]
            chosen.add(c)
        else:
            best[c] = below
    labels = np.full(n, NOISE)
    for c in sorted(chosen):
        inside, stack = list(member[c]), list(children[c])
        while stack:
            k = stack.pop()
            inside += member[k]
            stack += children[k]
        labels[inside] = c
    return labels


def canonical(labels: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Labels numbered by their least member; noise stays."""
    out = np.full(len(labels), NOISE)
    least = sorted((ids[labels == c].min(), c) for c in set(labels.tolist()) - {NOISE})
    for k, (_, c) in enumerate(least):
        out[labels == c] = k
    return out


def kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels by k-means with distant first centres, the best of several starts."""
    rng, best, found = np.random.default_rng(seed), np.inf, np.zeros(len(x), int)
    for _ in range(starts):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d = ((x[:, None] - centres) ** 2).sum(2).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum()) if d.sum() else 0]])
        for _ in range(rounds):
            d = ((x[:, None] - centres) ** 2).sum(2)
            labels = d.argmin(1)
            new = np.array([x[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        if (cost := d.min(1).sum()) < best:
            best, found = cost, labels
    return found


def cluster_concepts(concepts: DataFrame, method: str = "density", p: Params = DEFAULTS, most: int = 5000) -> DataFrame:
    """``project_id, id, cluster_label`` of concepts with vectors.

    Concepts are clustered by density at every size; where density finds no cluster, by k-means. Up to ``most``
    concepts of a project are held by a task; those of larger projects are compared block by block.
    """
    rows = concepts.where("embedding is not null").select(F.col("project_id").cast("long").alias("project_id"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.groupBy("project_id").count()
    big = [r["project_id"] for r in sizes.where(F.col("count") > most).collect()]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x = np.array(pdf["embedding"].tolist(), float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-10)
        size = adaptive_size(len(x), p.min_cluster_size)
        labels = density_clusters(x, size, p.min_samples) if method == "density" and len(x) >= size else np.full(len(x), NOISE)
        if (labels == NOISE).all():
            labels = kmeans(x, kmeans_k(len(x), size)) if len(x) > 1 else np.zeros(len(x), int)
        return pd.DataFrame({"project_id": pdf["project_id"], "id": pdf["id"], "cluster_label": canonical(labels, pdf["id"].to_numpy())})

    schema = "project_id long, id long, cluster_label int"
    out = rows.where(~F.col("project_id").isin(big)).groupBy("project_id").applyInPandas(run, schema)
    for project in big:
        own = rows.where(F.col("project_id") == project)
        labels = _large_density(own, p) if method == "density" else None
        out = out.unionByName(_large_kmeans(own, p) if labels is None else labels)
    return out


#: An edge of a tree: its length, and points (block and place) that it joins.
EDGE = np.dtype([("h", "<f8"), ("a", "<i8"), ("b", "<i8")])


def _large_density(rows: DataFrame, p: Params, block: int | None = None) -> DataFrame | None:
    """A project's labels by density, or nothing if all is noise.

    Pairs of blocks give each point's core distance, then a least spanning tree of their mutual reachability; trees
    are merged, which is exact. A task holds two blocks or the project's tree, never all distances.
    """
    block = block or BLOCK
    n, project = rows.count(), rows.first()["project_id"]
    size, samples = adaptive_size(n, p.min_cluster_size), min(p.min_samples, n)
    if n < size:
        return None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, ids, vectors = TaskContext.get().partitionId() << 20, 0, [], []

        def row() -> pa.RecordBatch:
            nonlocal made
            x = np.array(vectors, float)
            x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-10)
            made += 1
            out = pa.RecordBatch.from_pylist([{"k": base + made, "ids": np.array(ids, "<i8").tobytes(), "m": x.tobytes()}])
            ids.clear()
            vectors.clear()
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) >= block:
                    yield row()
        if ids:
            yield row()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for (ka, ma), (kb, mb), same in met(batches, lambda _, k, cells: (k, np.frombuffer(cells[0]).reshape(cells[1].size // 8, -1))):
            d = distances(ma, mb)
            for k, side in ((ka, d), (kb, d.T))[: 1 if same else 2]:
                few = np.ascontiguousarray(side)
                few = np.partition(few, min(samples, few.shape[1]) - 1, 1)[:, :samples]
                few = np.pad(few, ((0, 0), (0, samples - few.shape[1])), constant_values=np.inf)
                held[k] = np.sort(np.concatenate([held[k], few], 1), 1)[:, :samples] if k in held else few
        for k, few in held.items():
            yield pa.RecordBatch.from_pylist([{"k": k, "near": np.ascontiguousarray(few).tobytes()}])

    def cores(pdf: pd.DataFrame) -> pd.DataFrame:
        near = np.concatenate([np.frombuffer(x).reshape(-1, samples) for x in pdf["near"]], 1)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "core": [np.sort(near, 1)[:, samples - 1].tobytes()]})

    def forest(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for edges in found:
            held.append(edges)
            count += len(edges)
            if count > 2_000_000 and len(held) > 1:
                held = [merge_trees(held)]
                count = len(held[0])
        if held:
            yield pa.RecordBatch.from_pylist([{"edges": merge_trees(held).tobytes()}])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for (ka, ma, ca), (kb, mb, cb), same in met(batches, lambda _, k, cells: (k, np.frombuffer(cells[0]).reshape(cells[1].size // 8, -1), np.frombuffer(cells[1]))):
                reach = np.maximum(np.maximum(ca[:, None], cb), distances(ma, mb))
                if same:
                    np.fill_diagonal(reach, 0)
                    h, a, b = zip(*_spanning_tree(reach)) if len(ca) > 1 else ((), (), ())
                else:
                    h, a, b = _tree_between(reach)
                edges = np.empty(len(h), EDGE)
                edges["h"], edges["a"], edges["b"] = h, ka * block + np.array(a, int), kb * block + np.array(b, int)
                yield edges

        return forest(found())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return forest(np.frombuffer(x.as_py(), EDGE) for batch in batches for x in batch.column(0))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in merge(batches):
            edges = np.frombuffer(batch.column(0)[0].as_py(), EDGE)
            points, place = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
            tree = zip(edges["h"].tolist(), place[: len(edges)].tolist(), place[len(edges) :].tolist())
            labels = canonical(tree_labels(len(points), tree, size), points).astype("<i4")  # points are in order of ids
            starts = np.flatnonzero(np.diff(points // block, prepend=-1))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(points)]):
                yield pa.RecordBatch.from_pylist([{"k": int(points[at] // block), "labels": labels[at:end].tobytes(), "found": bool((labels[at:end] != NOISE).any())}])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids) // 8, project)), pa.array(np.frombuffer(ids, "<i8")), pa.array(np.frombuffer(labels, "<i4"))], ["project_id", "id", "cluster_label"])

    dealt = rows.select("id", "embedding").repartitionByRange(-(-n // block), "id").sortWithinPartitions("id")
    blocks = stored(dealt.mapInArrow(pack, "k long, ids binary, m binary"), "density-blocks")
    own = blocks.withColumn("p", F.lit(project).cast("long"))
    near = meet(own, ["m", "ids"]).mapInArrow(nearest, "k long, near binary")
    core = stored(near.groupBy("k").applyInPandas(cores, "k long, core binary"), "cores")
    pairs = meet(own.join(core, "k"), ["m", "core"])
    tasks = pairs.rdd.getNumPartitions()
    edges = stored(pairs.mapInArrow(trees, "edges binary"), "trees")
    while tasks > 2 * TREES:
        tasks = -(-tasks // TREES)
        edges = stored(edges.repartition(tasks).mapInArrow(merge, "edges binary"), "trees")
    labels = stored(edges.coalesce(1).mapInArrow(label, "k long, labels binary, found boolean"), "labels")
    if not labels.where("found").limit(1).count():
        return None
    return blocks.join(labels, "k").select("ids", "labels").mapInArrow(unpack, "project_id long, id long, cluster_label int")


def _large_kmeans(rows: DataFrame, p: Params) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    model = KMeans(k=kmeans_k(n, adaptive_size(n, p.min_cluster_size)), seed=42, featuresCol="v", predictionCol="c").fit(rows.withColumn("v", array_to_vector(l2_normalize(F.col("embedding"), 1e-10))))
    labelled = model.transform(rows.withColumn("v", array_to_vector(l2_normalize(F.col("embedding"), 1e-10))))
    # Ten clusters at most.
    order = labelled.groupBy("c").agg(F.min("id").alias("least")).withColumn("cluster_label", (F.row_number().over(W.orderBy("least")) - 1).cast("int"))
    return labelled.join(F.broadcast(order.select("c", "cluster_label")), "c").select("project_id", "id", "cluster_label")


# --- what follows from labels -----------------------------------------------


def centroids(concepts: DataFrame, normalize: bool = False, dim: int | None = None) -> DataFrame:
    """``project_id, cluster_label, centroid, n`` of labelled concepts."""
    return mean_vectors(concepts.where((F.col("cluster_label") != NOISE)), ["project_id", "cluster_label"], normalize=normalize, dim=dim)


def reassign_noise(concepts: DataFrame, dim: int | None = None) -> DataFrame:
    """Noise goes to the cluster whose raw centroid has the greatest product with it, the least label on ties; to 0 if there is none."""
    means = centroids(concepts, dim=dim).select(F.col("project_id"), F.col("cluster_label").alias("c"), "centroid")
    noise = concepts.where(F.col("cluster_label") == NOISE).select("project_id", "id", "embedding")
    scored = noise.join(means, "project_id").select("project_id", "id", F.struct(dot(F.col("embedding"), F.col("centroid")).alias("d"), (-F.col("c")).alias("m")).alias("s"))
    best = scored.groupBy("project_id", "id").agg((-F.max("s")["m"]).alias("best"))
    joined = concepts.join(best, ["project_id", "id"], "left")
    return joined.withColumn("cluster_label", F.when(F.col("cluster_label") == NOISE, F.coalesce("best", F.lit(0))).otherwise(F.col("cluster_label"))).drop("best")


def cluster_summary(concepts: DataFrame, dim: int | None = None) -> DataFrame:
    """``project_id, cluster_label, n, avg_generality, cohesion``: cohesion is the mean product with the raw centroid."""
    means = centroids(concepts, dim=dim).drop("n")
    joined = concepts.join(means, ["project_id", "cluster_label"])
    return joined.groupBy("project_id", "cluster_label").agg(F.count("*").alias("n"), F.round(F.avg("generality_score"), 4).alias("avg_generality"), F.round(F.avg(dot(F.col("embedding"), F.col("centroid"))), 4).alias("cohesion"))


def hierarchy(concepts: DataFrame) -> DataFrame:
    """``project_id, id, cluster_label, parent_concept_id``: the most general concept of a cluster is its head, and parent of the others.

    Heads are found by a combined maximum, so that no cluster is gathered.
    """
    heads = concepts.groupBy("project_id", "cluster_label").agg(F.max_by("id", F.struct(F.coalesce("generality_score", F.lit(float("-inf"))), -F.col("id"))).alias("head"))
    joined = concepts.join(heads, ["project_id", "cluster_label"])
    return joined.select("project_id", "id", "cluster_label", F.when(F.col("id") != F.col("head"), F.col("head")).alias("parent_concept_id"))


def children(concepts: DataFrame) -> DataFrame:
    return concepts.where("parent_concept_id is not null").groupBy(F.col("parent_concept_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children"))


def generality(concepts: DataFrame, frequencies: DataFrame, total_docs: int | DataFrame, dim: int | None = None) -> DataFrame:
    """``project_id, id, generality``: 0.4 share of documents + 0.3 share of the most claims + 0.2 former generality + 0.1 product with the centroid.

    Documents and the most claims are those of the concept's project; ``total_docs`` may be a table ``project_id, total_docs``.
    """
    counted = concepts.join(frequencies.withColumnRenamed("concept_id", "id"), "id", "left")
    most = counted.groupBy("project_id").agg(F.greatest(F.coalesce(F.max("n_claims"), F.lit(1)), F.lit(1)).alias("most"))
    means = centroids(concepts, dim=dim).drop("n")
    joined = with_totals(counted.join(means, ["project_id", "cluster_label"], "left").join(most, "project_id"), total_docs)
    docs = F.coalesce("n_docs", F.lit(0)) / F.greatest(F.col("total_docs"), F.lit(1))
    central = F.greatest(F.coalesce(dot(F.col("embedding"), F.col("centroid")), F.lit(0.0)), F.lit(0.0))
    score = 0.4 * docs + 0.3 * (F.coalesce("n_claims", F.lit(0)) / F.col("most")) + 0.2 * former_generality(F.col("generality_score")) + 0.1 * central
    return joined.select("project_id", "id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4).alias("generality"))


def former_generality(g: Column) -> Column:
    """Null and 0 count as 0.5."""
    return F.coalesce(F.nullif(g, F.lit(0.0)), F.lit(0.5))


def bridge_pairs(concepts: DataFrame, threshold: float = DEFAULTS.bridge_similarity, most: int | None = None) -> DataFrame:
    """``project_id, a, b, sim``: similar pairs of different clusters. With ``most`` (such as ``bridge_max_concepts``), larger projects have none."""
    rows = concepts
    if most is not None:
        sizes = concepts.groupBy("project_id").count().where(F.col("count") <= most).select("project_id")
        rows = concepts.join(sizes, "project_id", "left_semi")
    return similar_pairs(rows, threshold, float("inf"), carry=("cluster_label",)).where("cluster_label_a <> cluster_label_b").select("project_id", "a", "b", "sim")


def greedy_hierarchy(concepts: DataFrame, min_gap: float = 0.2, min_sim: float = 0.6, max_sim: float = float("inf")) -> DataFrame:
    """``project_id, id, parent_id``: of more general concepts with enough similarity (and ``max_sim`` at most), the most general; ties by id."""

    def ways(pairs: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        p, a, b, ga, gb = (pairs.column(c).to_numpy() for c in ("project_id", "a", "b", "g_a", "g_b"))
        up, down = gb - ga > min_gap, ga - gb > min_gap
        return tuple(np.concatenate([x[up], y[down]]) for x, y in ((p, p), (a, b), (b, a), (gb, ga)))

    rows = concepts.select("project_id", "id", "embedding", F.coalesce("generality_score", F.lit(0.5)).alias("g"))
    best = similar_pairs(rows, min_sim, max_sim, carry=("g",), fold=best_of(ways), schema=BEST)
    parents = best.groupBy("project_id", "id").agg(F.max_by("other", F.struct("score", -F.col("other"))).alias("parent_id"))
    return concepts.select("project_id", "id").join(parents, ["project_id", "id"], "left")

