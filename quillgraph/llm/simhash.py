"""SimHash near-duplicates, by tiled exact comparison of fingerprints.

A fingerprint has a bit set where over half of the text's word shingles' hashes have it: XXH64 for the first
64 bits, and for each 64 more a mix of it with another constant.
Distinct fingerprints are dealt by their population counts into tiles of bounded size; two
tiles meet in a task only if their counts come within the radius, and there blocks of them
are compared by exclusive-or and bit counts, unless the counts of the fingerprints'
16-bit words differ by more than the radius. Every pair within the radius is found. A
task returns the links that join different groups of its tiles, no more than there are
fingerprints; components are found from those.

Null and empty texts have fingerprint 0 and are linked like any other. Texts with fewer
words than a shingle are one shingle. Copies share a fingerprint, so one of each is compared.
A text's hash tells rows of one id apart where one document of a component is kept.
Repeated rows are members of one component; rows of one id with different texts are linked by their texts alone. A null
id is never a component's id, unless all its ids are null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, words_lower
from quillgraph.llm.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile (16 bytes each), and of a block that is compared at once.
TILE, BLOCK = 1 << 14, 256
#: Words of 64 bits that all pairs of a block are compared by; the rest is compared where these come within the radius.
ALL_PAIRS = 2
#: Whole tiles' worth of fingerprints in a set at most, about; a task compares the tiles of two sets.
SET = 8
#: Ids that are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes for the ``k``-th 64 bits: the finalizer of SplitMix64, from its ``k``-th step."""
    if not k:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED, bits: int = 64) -> bytes:
    """The fingerprint of a list of words: unsigned 64-bit words, each with its highest byte first."""
    import xxhash

    if not words:
        return bytes(bits // 8)
    n = max(1, len(words) - shingle + 1)
    digest, half, ones = xxhash.xxh64_intdigest, n / 2, np.zeros((bits // 64, 64), np.int64)
    for at in range(0, n, 1 << 15):
        part = words[at : at + (1 << 15) + shingle - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((digest(x, seed) for x in shingles), "<u8")
        for k in range(len(ones)):
            ones[k] += np.unpackbits(_mixed(h, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones > half, axis=1, bitorder="little")[:, ::-1].tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, bits: int = 64) -> DataFrame:
    """``doc_id, text_hash, fp``: XXH64 of the text as Spark has it, and the fingerprint as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(words_lower(x.as_py()), shingle, seed, bits) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.binary())], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, fp binary")


def matrix(fps: bytes, words: int) -> np.ndarray:
    """Fingerprints, one after the other, as rows of 64-bit words."""
    return np.frombuffer(fps, ">u8").reshape(-1, words).astype("<u8")


def _pops(fps: np.ndarray) -> np.ndarray:
    """Population counts of the 16-bit words of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(len(fps), -1)).astype(np.int64)


def _nodes(marked: DataFrame, words: int) -> DataFrame:
    """``fp, first, node, place``: distinct fingerprints with their least id, numbered in its order (null last), and a key that orders them by population counts."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pops = _pops(matrix(b"".join(batch.column(0).to_pylist()), words))
            keys = np.concatenate([pops.sum(1, keepdims=True), pops[:, :3]], 1).astype(">u2")
            yield batch.append_column("place", pa.array([k.tobytes() for k in keys], pa.binary()))

    first = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    order = [F.col("first").asc_nulls_last(), F.col("fp")]
    numbered = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    return numbered.mapInArrow(place, "fp binary, first long, node long, place binary")


def _tiles(nodes: DataFrame, count: int, tile: int, words: int, radius: int) -> DataFrame:
    """Fingerprints, ordered by population counts, as rows of at most ``tile``, with the groups that links within the radius make of them.

    ``roots`` has for each place that of its group's first.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        made, held, size = 0, [], 0

        def row(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            fps = b"".join(table.column(0).to_pylist())
            rows = matrix(fps, words)
            pops, groups = _pops(rows).sum(1), Forest(np.arange(len(rows)))
            tile_links(rows, rows, groups, radius)
            made += 1
            return pa.RecordBatch.from_pylist([{"tile": base + made, "lo": int(pops.min()), "hi": int(pops.max()), "fps": fps, "ids": table.column(1).to_numpy().astype("<i8").tobytes(), "roots": groups.find(np.arange(len(rows))).astype("<i4").tobytes()}])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= tile:
                table = pa.Table.from_batches(held)
                yield row(table.slice(0, tile))
                held, size = table.slice(tile).to_batches(), size - tile
        if size:
            yield row(pa.Table.from_batches(held))

    dealt = nodes.repartitionByRange(max(1, -(-count // tile)), "place", "fp").sortWithinPartitions("place", "fp")
    return dealt.select("fp", "node").mapInArrow(cut, "tile long, lo long, hi long, fps binary, ids binary, roots binary")


class Forest:
    """Groups of 0..n-1, at first those with the same root; ``join`` takes arrays of links and says which of them joined two groups."""

    def __init__(self, roots: np.ndarray):
        self.root = roots.astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while np.any(self.root[r] != r):
            r = self.root[r]
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        ra, rb = self.find(a), self.find(b)
        new = np.flatnonzero(ra != rb)
        if not len(new):
            return []
        _, once = np.unique(np.stack([np.minimum(ra[new], rb[new]), np.maximum(ra[new], rb[new])]), axis=1, return_index=True)
        joined = []
        for k in new[once].tolist():
            x, y = int(ra[k]), int(rb[k])
            while (p := int(self.root[x])) != x:
                x = p
            while (p := int(self.root[y])) != y:
                y = p
            if x != y:
                self.root[max(x, y)] = min(x, y)
                joined.append(k)
        touched = np.concatenate([a, b])
        self.root[touched] = self.find(touched)
        return joined


def _boxes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest counts of the 16-bit words in each block."""
    pops, first = _pops(fps), np.arange(0, len(fps), BLOCK)
    return np.minimum.reduceat(pops, first), np.maximum.reduceat(pops, first)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in two blocks of all pairs within the radius."""
    apart = np.bitwise_count(a[:, 0, None] ^ b[:, 0])
    for k in range(1, min(ALL_PAIRS, a.shape[1])):
        apart += np.bitwise_count(a[:, k, None] ^ b[:, k])
    p, q = np.nonzero(apart <= radius)
    if a.shape[1] > ALL_PAIRS and len(p):
        rest = np.bitwise_count(a[p, ALL_PAIRS:] ^ b[q, ALL_PAIRS:]).sum(1) + apart[p, q]
        p, q = p[rest <= radius], q[rest <= radius]
    return p, q


def tile_links(a: np.ndarray, b: np.ndarray, forest: Forest, radius: int = RADIUS, at: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join groups, between the fingerprints ``a`` and ``b`` (rows of 64-bit words), or within one if both are the same.

    ``forest`` holds the groups of all places, where ``a`` and ``b`` begin at those of ``at``.
    """
    same = a is b
    (alo, ahi), (blo, bhi) = _boxes(a), _boxes(b)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    for i in range(len(alo)):
        apart = (np.maximum(alo[i] - bhi, 0) + np.maximum(blo - ahi[i], 0)).sum(1)
        near = np.flatnonzero(apart <= radius)
        for j in near[near >= i].tolist() if same else near.tolist():
            p, q = near_pairs(a[i * BLOCK : (i + 1) * BLOCK], b[j * BLOCK : (j + 1) * BLOCK], radius)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                p, q = p + i * BLOCK + at[0], q + j * BLOCK + at[1]
                joined = forest.join(p, q)
                left.append(p[joined])
                right.append(q[joined])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def set_links(tiles: list[dict], same: bool, radius: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links between the tiles of two sets, or of one; each tile has ``own`` (which set), ``tile, lo, hi, fps, ids, roots``."""
    tiles = sorted(tiles, key=lambda t: t["tile"])
    fps, roots = [matrix(t["fps"], words) for t in tiles], [np.frombuffer(t["roots"], "<i4") for t in tiles]
    first = np.cumsum([0, *map(len, roots)])
    ids, forest = np.concatenate([np.frombuffer(t["ids"], "<i8") for t in tiles]), Forest(np.concatenate([r + at for r, at in zip(roots, first)]))
    left, right = [], []
    for k, t in enumerate(tiles):
        for m in range(k + 1, len(tiles)):
            u = tiles[m]
            if (same or t["own"] != u["own"]) and max(t["lo"] - u["hi"], u["lo"] - t["hi"]) <= radius:
                p, q = tile_links(fps[k], fps[m], forest, radius, (int(first[k]), int(first[m])))
                left.append(ids[p])
                right.append(ids[q])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, words: int = 1) -> DataFrame:
    """``a, b``: numbers of ``nodes(fp, node, place)`` whose links span the groups of fingerprints within the radius.

    Links within a tile come from its groups; the tiles of two sets add a link only where groups of theirs meet, so a large group has as many links
    as members, and one more for each tile of two sets that meet. A tile is sent once for each set that it meets, not for each tile. Sets
    grow with fingerprints alone: where Spark deals these to more partitions than asked for, tiles are smaller and a set has more of them.
    """
    count = nodes.count()
    parallel = nodes.sparkSession.sparkContext.defaultParallelism
    size = int(max(1, min(SET, (count // tile + 1) / (8 * parallel) ** 0.5)))
    tiles = materialize(_tiles(nodes, count, tile, words, radius), "tiles")
    parts = (tiles.agg(F.max(F.shiftright("tile", 32))).first()[0] or 0) + 1
    tiles = tiles.withColumn("own", F.floor(F.shiftright("tile", 32) / max(1, round(parts * size * tile / max(1, count)))))
    spans = tiles.groupBy("own").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    one, two = spans.toDF("s", "slo", "shi"), spans.toDF("r", "rlo", "rhi")
    meet = (F.col("s") <= F.col("r")) & (F.col("slo") - F.col("rhi") <= radius) & (F.col("rlo") - F.col("shi") <= radius)
    sets = materialize(one.join(two, meet).select("s", "r"), "tile-sets")
    tasks = max(1, sets.count())
    sent = sets.withColumn("own", F.explode(F.array_distinct(F.array("s", "r"))))
    dealt = sent.join(tiles, "own").repartition(tasks, "s", "r").sortWithinPartitions("s", "r", "tile")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def links() -> pa.RecordBatch:
            ends = set_links(held, held[0]["s"] == held[0]["r"], radius, words)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if held and (held[0]["s"], held[0]["r"]) != (row["s"], row["r"]):
                    yield links()
                    held = []
                held.append(row)
        if held:
            yield links()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, roots in zip(batch.column(0), batch.column(1)):
                ids, roots = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(roots.as_py(), "<i4")
                moved = np.flatnonzero(roots != np.arange(len(roots)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[roots[moved]])], ["a", "b"])

    across = dealt.select("s", "r", "own", "tile", "lo", "hi", "fps", "ids", "roots").mapInArrow(compare, "a long, b long")
    return tiles.select("ids", "roots").mapInArrow(within, "a long, b long").unionByName(across)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, tile: int = TILE, bits: int = 64) -> DataFrame:
    """``doc_id, text_hash, fp, component, component_id`` of every document; ``component`` is a number, ``component_id`` its least id. ``bits`` is a multiple of 64."""
    marked = materialize(fingerprints(docs, shingle, seed, bits), "fingerprints")
    nodes = materialize(_nodes(marked, bits // 64), "nodes")
    # The least node of a component has its least id.
    stars = connected_components(fingerprint_links(nodes, radius, tile, bits // 64)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    linked = stars.join(nodes.select(F.col("node").alias("root"), F.col("first").alias("least")), "root")
    classes = nodes.join(linked, "node", "left").select("fp", F.coalesce("root", "node").alias("component"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return marked.join(materialize(classes, "classes"), "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """One document of each component: that with its least id (null last), of its texts that with the least hash, once if it has repeated rows.

    Rows that go, and repeated ones, are few beside the texts; their ids and texts' hashes are broadcast
    up to ``BROADCAST_IDS`` and joined by a shuffle beyond.
    """
    rows = materialize(near_duplicates(docs, **parameters).groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")), "members")
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    groups = rows.groupBy("component").agg(F.min(own).alias("stays"), F.sum("n").alias("all")).where("all > 1").select("component", "stays")
    marked = rows.join(groups, "component").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), (F.col("stays") == own).alias("stays"), "n")
    marked = materialize(marked.where("not stays or n > 1"), "to-go")

    def some(condition: str) -> DataFrame:
        keys = marked.where(condition).select("_id", "_hash")
        return F.broadcast(keys) if marked.count() <= BROADCAST_IDS else keys

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_hash"))
    stay = docs.join(some("not stays"), same, "left_anti")
    if not marked.where("stays").limit(1).count():
        return stay
    once = stay.join(some("stays"), same, "left_semi").withColumn("_text", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "_text"]).drop("_text")
    return stay.join(some("stays"), same, "left_anti").unionByName(once)


def hex_fingerprint(fp: str = "fp"):
    """The fingerprint as lowercase hex digits."""
    return F.lower(F.hex(fp))
