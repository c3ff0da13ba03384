"""Near-duplicates, media and the pipeline against brute force and round trips."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quillgraph.llm import components, line_crf, matroska, mil_quality, mixing, simhash
from quillgraph.llm.queries import op5_matroska, op8_simhash


def split_mix(h, k):
    if k:
        h = (h + 0x9E3779B97F4A7C15 * k) % (1 << 64)
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        h = (h ^ h >> 27) * 0x94D049BB133111EB % (1 << 64)
        h ^= h >> 31
    return h


def brute_fingerprint(text, shingle=4, bits=64):
    """The first 64 bits are the highest of the number."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes, out = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles], 0
    for word in range(bits // 64):
        own = [split_mix(h, word) for h in hashes]
        out = out << 64 | sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))
    return out


def brute_components(ids, fps, radius=4):
    order = {i: i for i in range(len(ids))}

    def top(x):
        while order[x] != x:
            order[x] = order[order[x]]
            x = order[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                order[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(ids))]


def test_op8_against_brute_force(spark, sf, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = {(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps))}
    assert {tuple(r) for r in op8_simhash(spark, sf).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = sorted(zip([r["doc_id"] for r in rows], fps, brute_components([r["doc_id"] for r in rows], fps)), key=str)
    got = simhash.near_duplicates(odd).select("doc_id", "fp", "component_id").collect()
    assert sorted(((r["doc_id"], int.from_bytes(r["fp"]), r["component_id"]) for r in got), key=str) == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(({c for _, _, c in want if c is not None}) | {None}, key=str)
    assert simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("radius", [0, 4, 9])
def test_tiles_find_every_group(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce([np.uint64(1) << np.uint64(k) for k in rng.choice(64, rng.integers(1, 7), replace=False)]) for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate([base, rng.choice(base, 900) ^ flips]))
    fps = fps[np.lexsort((fps, np.bitwise_count(fps)))]
    fps = fps[:, None]
    a, b = fps[: len(fps) // 2], fps[len(fps) // 2 :]
    forest, made = simhash.Forest(np.arange(len(fps))), []
    one, two = simhash.Forest(np.arange(len(a))), simhash.Forest(np.arange(len(b)))
    for x, groups, s in ((a, one, 0), (b, two, len(a))):
        made.append(simhash.tile_links(x, x, groups, radius))
        forest.join(made[-1][0] + s, made[-1][1] + s)
    both = simhash.Forest(np.concatenate([one.find(np.arange(len(a))), two.find(np.arange(len(b))) + len(a)]))
    before = len(np.unique(both.root))
    p, q = simhash.tile_links(a, b, both, radius, (0, len(a)))
    made.append((p, q - len(a)))
    forest.join(p, q)
    assert len(made[-1][0]) == before - len(np.unique(both.find(np.arange(len(fps)))))  # a link for each two groups that meet
    for (p, q), x, y in zip(made, (a, b, a), (a, b, b)):
        assert (np.bitwise_count(x[p] ^ y[q]).sum(1) <= radius).all() and len(p) < len(x) + len(y)
    got = forest.find(np.arange(len(fps)))
    want = brute_components(list(range(len(fps))), [int(f) for f in fps[:, 0]], radius)
    first = {}
    assert [first.setdefault(g, i) for i, g in enumerate(got)] == want


@pytest.mark.parametrize("bits, radius", [(128, 30), (256, 46), (256, 100)])
def test_wide_fingerprints_against_brute_force(spark, docs, bits, radius):
    some = docs.where("doc_id < 250")
    rows = some.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"], 5, bits) for r in rows]
    want = {(r["doc_id"], f, c) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps, radius))}
    got = simhash.near_duplicates(some, shingle=5, bits=bits, radius=radius, tile=64).collect()
    assert {(r["doc_id"], int.from_bytes(r["fp"]), r["component_id"]) for r in got} == want


def test_rows_without_an_id_link_nothing_by_it(spark):
    """Near-duplicates of null ids, and rows of one id, are linked by their texts alone."""
    words = [f"w{k}" for k in range(400)]
    one, two = " ".join(words[:200]), " ".join(words[200:])
    rows = [(1, one), (None, one + " more"), (2, two), (None, two + " more"), (None, "neither of them at all"), (7, "first text of the id"), (7, "quite another text here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), radius=12).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components([i for i, _ in rows], fps, 12)
    assert want[:5] == [1, 1, 2, 2, None]
    assert sorted(((r["doc_id"], int.from_bytes(r["fp"]), r["component_id"]) for r in got), key=str) == sorted(zip([i for i, _ in rows], fps, want), key=str)


def test_small_tiles_give_the_same(spark, docs, monkeypatch):
    a = {tuple(r) for r in simhash.near_duplicates(docs).drop("component").collect()}
    assert {tuple(r) for r in simhash.near_duplicates(docs, tile=16).drop("component").collect()} == a
    monkeypatch.setattr(simhash, "SET", 1)
    assert {tuple(r) for r in simhash.near_duplicates(docs, tile=16).drop("component").collect()} == a


def test_more_partitions_make_no_more_sets(spark, docs, monkeypatch):
    """Where fingerprints are dealt to many partitions, each tile is still sent a few times and the groups are the same."""
    want = {tuple(r) for r in simhash.near_duplicates(docs).drop("component").collect()}
    made, frame, store = {}, type(docs), simhash.materialize

    def stored(rows, name="part"):
        out = store(rows, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", stored)
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *cols, f=frame.repartitionByRange: f(self, max(n, 40), *cols) if isinstance(n, int) else f(self, n, *cols))
    assert {tuple(r) for r in simhash.near_duplicates(docs).drop("component").collect()} == want
    assert made["tiles"] >= 20 and made["tile-sets"] <= 3


def test_one_of_each_group_stays(spark):
    """Null ids go with others, rows of one id and several texts are told apart, and repeated rows stay once."""
    words = [f"w{k}" for k in range(300)]
    one, two, three = (" ".join(words[k : k + 100]) for k in (0, 100, 200))
    rows = [(None, one), (4, one), (4, two), (4, two), (4, two), (9, two), (None, three), (None, three + " more"), (5, "a b c d e f")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5, bits=256, radius=46).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"]) == sorted([(4, one), (4, two), (5, "a b c d e f")])
    assert len(kept) == 4 and [r["text"].startswith(three) for r in kept if r["doc_id"] is None] == [True]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (250, 300), (250, 250), (None, 1), (7, 3)]
    got = {r["a"]: r["b"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {250: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parts_of_edges_meet(spark, monkeypatch):
    """One part of edges is done by one task, without a round; several parts give the same."""
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    forest = simhash.Forest(np.arange(1100))
    ends = np.array([e for e in edges if None not in e])
    forest.join(ends[:, 0], ends[:, 1])
    root = forest.find(np.arange(1100))
    want = {i: int(r) for i, r in enumerate(root) if r != i}
    made, store = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda rows, name="part": made.append(name) or store(rows, name))
    table = spark.createDataFrame(edges, "a long, b long")
    assert {r["a"]: r["b"] for r in components.connected_components(table).collect()} == want and "stars" not in made
    monkeypatch.setattr(components, "PART", 200)
    assert {r["a"]: r["b"] for r in components.connected_components(table.repartition(8)).collect()} == want and "stars" in made


@pytest.mark.parametrize("lacing", range(4))
@pytest.mark.parametrize("n", [0, 1, 64, 65, 2048, 70_000, 300_001])
def test_media_round_trip(lacing, n):
    payload, size = matroska.padded("é" * (n // 2) + "x" * (n % 2))
    assert size == n and len(payload) % 64 == 0 and payload
    stored = matroska.mux(payload, lacing)
    media = matroska.demux(stored)
    assert matroska.samples(stored, media, 1) == payload
    assert media.length == [64] * (len(payload) // 64) and media.timestamp == [8 * k for k in range(len(payload) // 64)]
    assert [(t, at) for t, _, at in media.cues] == [(t, at) for at, t in media.clusters]
    assert media.tracks[0] | {"number": 1} == {"number": 1, "type": 2, "codec": "A_PCM/INT/LIT", "default_ns": 8_000_000, "rate": 8000.0, "channels": 1, "bits": 8}


@pytest.mark.parametrize("lacing", [matroska.XIPH, matroska.EBML_LACING])
def test_lacing_of_uneven_frames(lacing):
    frames = [bytes([k]) * n for k, n in enumerate((5, 300, 255, 0, 70_000, 3))]
    data = matroska.lace(frames, lacing)
    sizes, at = matroska.frame_sizes(data, 0, len(data), lacing)
    assert sizes == [len(f) for f in frames] and data[at:] == b"".join(frames)


def test_unknown_sizes_groups_and_errors():
    n, e = matroska.number, matroska.element
    block = b"\x81" + (3).to_bytes(2, "big") + b"\x00" + b"abc"
    group = e(matroska.BLOCK_GROUP, e(matroska.BLOCK, block) + n(matroska.REFERENCE_BLOCK, 1))
    track = e(matroska.TRACKS, e(matroska.TRACK_ENTRY, n(matroska.TRACK_NUMBER, 1) + n(matroska.DEFAULT_DURATION, 8_000_000)))
    cluster = matroska.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + n(matroska.CLUSTER_TIMESTAMP, 10) + group + e(0xEC, b"void")
    data = e(matroska.EBML, e(matroska.DOC_TYPE, b"webm")) + matroska.SEGMENT.to_bytes(4, "big") + b"\xff" + track + cluster + cluster
    media = matroska.demux(data)
    assert (media.timestamp, media.key, media.length, media.cluster) == ([13, 13], [False, False], [3, 3], [0, 1])
    whole = matroska.mux(bytes(640))
    for bad in (b"", b"RIFF", whole[:-1], whole[:60]):
        with pytest.raises(ValueError):
            matroska.demux(bad)


def test_op5_digests(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op5_matroska(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_media_tables_of_odd_rows(spark, odd, none):
    digest = matroska.media_digest(odd).collect()
    assert len(digest) == odd.count() and len({r["media_sha256"] for r in digest if r["doc_id"] in (2, 3)}) == 1
    table = matroska.packets(matroska.to_media(odd))
    assert {r["doc_id"]: r["count"] for r in table.groupBy("doc_id").count().collect()}[2] == 1
    assert matroska.media_digest(none).count() == matroska.packets(matroska.to_media(none)).count() == 0
    assert matroska.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0


def test_pipeline_stages(spark, sf, docs):
    """Each stage by its operator's brute force or by its own verdicts; all but the last keep the columns."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "simhash near-duplicates", "source mixture", "best-fit packing"]
    model = mil_quality.fit_quality(docs, labels)
    good = {r["doc_id"] for r in mil_quality.score_quality(docs, model).where("predicted = 1").collect()}
    one = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == good
    one = one.cache()
    field = line_crf.fit_rules(docs, labels)
    assert not np.allclose(field.emit, line_crf.prior_field().emit)  # labels of both kinds are learned from
    stay = {r["doc_id"] for r in line_crf.apply_rules(one, field).where("kept").collect()}
    two = corpus_pipeline.quality_rules(spark, one, sf)
    assert {r["doc_id"] for r in two.collect()} == stay
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    failed = {r["doc_id"] for r in line_crf.apply_rules(docs, field).where("base_failed").collect()}
    assert all(i in stay for i, q in marked.items() if q == 1 and i not in failed)  # clean documents stay
    two = two.cache()
    rows = two.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"], 5, 256) for r in rows]
    three = corpus_pipeline.near_duplicates(spark, two, sf)
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(set(brute_components([r["doc_id"] for r in rows], fps, corpus_pipeline.RADIUS)))
    four = corpus_pipeline.source_mixture(spark, three, sf)
    assert four.columns == docs.columns
    assert four.count() == mixing.mixing_plan(three).agg({"copies": "sum"}).first()[0]
    assert corpus_pipeline.run(spark, sf).count() > 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_pipeline_links_near_copies(spark):
    """Of texts that share 0.8 of their five-word shingles or more at least 0.9 go; texts that share less than half stay."""
    rng = np.random.default_rng(8)
    rows, near = [], 0
    for k in range(200):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(80, 400))]
        copy = list(words)
        for at in rng.choice(len(words), rng.integers(1, max(2, len(words) // 40)), replace=False):
            copy[at] = "changed"
        other = [f"v{x}" if rng.random() < 0.25 else y for x, y in zip(rng.integers(0, 5000, len(words)), words)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(copy)), (3 * k + 2, " ".join(other))]
        a, b, c = (shingles(t) for _, t in rows[-3:])
        assert len(a & c) < 0.5 * len(a | c)
        near += (same := len(a & b) >= 0.8 * len(a | b))
        if not same:
            rows[-2] = (3 * k + 1, f"alone{k} " * 60)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert near > 100 and all(3 * k in kept and 3 * k + 2 in kept for k in range(200))
    assert len(rows) - len(kept) >= 0.9 * near


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, 0, 0), (5, 1, 0), (8, 1, 1), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    for name, docs, marks in (("odd", odd, labels), ("empty", none, labels.limit(0)), ("unlabelled", odd, labels.limit(0))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        marks.write.parquet(f"{folder}/labels.parquet")
        table = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, folder)
            assert out.columns == table.columns and {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in odd.collect()}
        assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} <= {r["doc_id"] for r in odd.collect()}
