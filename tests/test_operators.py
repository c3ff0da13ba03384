import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import catalog, cluster, consensus, gaps, graphmap, relate, resolve, search
from quillgraph.plans.components import label_components

CONCEPT = "id long, project_id long, name string, description string, embedding array<double>, generality_score double, coverage_score double"


def blobs(per=6, noise=2, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([np.eye(dim)[k] + rng.normal(size=(per, dim)) * 0.03 for k in range(3)] + [rng.normal(size=(noise, dim))])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_consensus_bands(spark):
    concepts = spark.createDataFrame([(i, 1, f"c{i}") for i in range(5)], "id long, project_id long, name string")
    claims = spark.createDataFrame([(1, 0, "supports"), (2, 1, "contradicts"), (3, 2, "supports"), (4, 2, "contradicts"), (5, 3, "odd")], "id long, concept_id long, claim_type string")
    scored = consensus.consensus_by_concept(concepts, claims)
    got = {r["id"]: r["consensus_score"] for r in scored.collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.5, 3: 0.5, 4: 0.5}
    state = consensus.brain_state(scored.join(concepts.select("id", "name"), "id")).first()
    assert (state["strong_consensus"], state["contradictions"], state["contested"]) == (["c0"], ["c1"], ["c2", "c3", "c4"])
    assert "1 concepts with strong" in consensus.summary_text(consensus.brain_state(scored.join(concepts.select("id", "name"), "id"))).first()["summary_text"]


@pytest.mark.parametrize(
    "g1, g2, sim, kind, strength",
    [(0.9, 0.5, 0.7, "parent_child", 0.7), (0.8, 0.5, 0.5, "prerequisite", 0.4), (0.5, 0.5, 0.8, "complements", 0.8), (0.4, 0.55, 0.6, "builds_on", 0.6), (0.5, 0.5, 0.6, "similar", 0.6), (0.5, 0.5, 0.7, "similar", 0.7)],
)
def test_rules(spark, g1, g2, sim, kind, strength):
    r = spark.range(1).select(relate.rule_type(F.lit(g1), F.lit(g2), F.lit(sim)).alias("r")).first()["r"]
    assert (r["type"], round(r["strength"], 9)) == (kind, strength)


def test_dedupe_merges_opposite_extends(spark):
    rows = [(1, 1, 2, "extends", "a_to_b", 0.6, 0.5), (2, 2, 1, "extends", "b_to_a", 0.8, 0.7), (3, 3, 4, "similar", "a_to_b", 0.5, 0.1), (4, 4, 3, "contradicts", "a_to_b", 0.9, 0.2), (5, 3, 4, "similar", "a_to_b", 0.9, 0.3)]
    df = spark.createDataFrame(rows, "seq long, source_concept_id long, target_concept_id long, type string, direction string, confidence double, strength double")
    got = {r["a"]: r for r in relate.dedupe_relationships(df).collect()}
    assert (got[1]["type"], got[1]["direction"], got[1]["confidence"], got[1]["strength"], got[1]["merged_extends"]) == ("complements", "bidirectional", 0.7, 0.6, True)
    assert (got[3]["type"], got[3]["confidence"], got[3]["replaced_type"], got[3]["replaced_confidence"]) == ("contradicts", 0.9, "similar", 0.5)


def test_unconnected_clusters_by_all_relationships(spark, tmp_path):
    from quillgraph.plans.queries import centroid_pairs_unconnected

    spark.createDataFrame([(i, [x, y] + [0.0] * 62, k) for i, x, y, k in ((20, 1.0, 0.0, 0), (35, 0.8, 0.6, 1), (40, 0.6, 0.8, 2), (30, 1.0, 0.0, 0), (33, 0.8, 0.6, 1))], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, 1, 20, 5, 10.0, 0.1)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [(r["a"], r["b"]) for r in centroid_pairs_unconnected(spark, str(tmp_path)).collect()] == [(1, 2), (0, 2), (0, 1)]  # 20 and 35 are joined; 30 and 33 are another project's


def test_dedup_query_folds_all_relationships(spark, sf):
    from quillgraph.plans.queries import _relationships, relationship_dedup

    want = {}
    for r in sorted(_relationships(spark, sf).collect(), key=lambda r: r["id"]):
        s, t = r["source_concept_id"], r["target_concept_id"]
        new = ["extends" if r["relationship_type"] == "builds_on" else r["relationship_type"], "a_to_b" if s <= t else "b_to_a", r["confidence"], r["strength"], False]
        best = want.setdefault((min(s, t), max(s, t)), new)
        if best is not new and best[0] == new[0] == "extends" and best[1] != new[1]:
            want[min(s, t), max(s, t)] = ["complements", "bidirectional", (best[2] + new[2]) / 2, (best[3] + new[3]) / 2, True]
        elif best is not new and new[2] > best[2]:
            want[min(s, t), max(s, t)] = new
    got = {(r["a"], r["b"]): r for r in relationship_dedup(spark, sf).collect()}
    assert got.keys() == want.keys()
    for k, (kind, direction, confidence, strength, merged) in want.items():
        assert (got[k]["type"], got[k]["direction"], got[k]["merged_extends"]) == (kind, direction, merged)
        assert (got[k]["confidence"], got[k]["strength"]) == pytest.approx((confidence, strength), abs=2e-4)
    assert {r["type"] for r in got.values()} >= {"extends", "contradicts"}


def test_direction(spark):
    rows = [(1, 2, "extends", "b_to_a"), (3, 4, "extends", "bidirectional"), (5, 6, "none", "a_to_b"), (7, 8, "supports", "a_to_b")]
    got = {r["a"]: (r["source_concept_id"], r["target_concept_id"], r["relationship_type"]) for r in relate.resolve_direction(spark.createDataFrame(rows, "a long, b long, type string, direction string")).collect()}
    assert got == {1: (2, 1, "builds_on"), 3: (3, 4, "complements"), 7: (7, 8, "similar")}


def test_mentions_both_ways(spark):
    concepts = spark.createDataFrame([(1, "Deep Nets"), (2, " "), (3, "ml"), (4, "nets")], "id long, name string")
    chunks = spark.createDataFrame([(10, "On DEEP NETS and ML"), (11, "nothing"), (12, "x")], "id long, content string")
    want = {(1, 10), (3, 10), (4, 10)}
    assert {tuple(r) for r in relate.mentions(concepts, chunks).collect()} == want
    assert {tuple(r) for r in relate.mentions(concepts, chunks, most_bytes=4).collect()} == want


def test_mention_queries_take_all_names_and_documents(spark, tmp_path):
    from quillgraph.plans.queries import cooccurrence_counts, mention_index

    spark.createDataFrame([(1, "blue rod"), (250, "Red Bolt"), (251, "red bolt"), (300, "old nut")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(7, "a red BOLT, a blue rod", "en", "src3"), (8, "red bolt", "en", "src5"), (9, "red nut", "en", "src3")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in mention_index(spark, str(tmp_path)).collect()} == {(1, 1, 7), (250, 3, 7), (251, 3, 7), (300, 2, 7)}
    assert {(r["a"], r["b"], r["co_occurrence"]) for r in cooccurrence_counts(spark, str(tmp_path)).collect()} == {(1, 250, 1), (250, 251, 3), (251, 300, 2)}


def test_projects_do_not_touch_each_other(spark):
    """Scores of one project are the same with and without another in the tables."""
    rows = [(i, p, f"c{i}", None, [1.0, 0.1 * i], 0.5, 0.1) for i, p in ((1, 1), (2, 1), (3, 2), (4, 2))]
    concepts = spark.createDataFrame(rows, CONCEPT).withColumn("cluster_label", F.lit(0)).withColumn("is_synthetic_gap", F.lit(False)).withColumn("generality_score", F.lit(0.6))
    claims = spark.createDataFrame([(k, 10 + k % 3, c) for k, c in enumerate([1] * 4 + [2] * 2 + [3] * 50 + [4])], "id long, document_id long, concept_id long")
    totals = spark.createDataFrame([(1, 5), (2, 500)], "project_id long, total_docs long")
    one = concepts.where("project_id = 1")
    pairs = spark.createDataFrame([(1, 1, 2, 0.5, 0.9), (2, 3, 4, 0.5, 0.9)], "project_id long, a long, b long, sim double, confidence double")
    seen = claims.select("concept_id", F.col("id").alias("chunk_id"))

    def scores(rows, pairs, totals):
        made = {
            "generality": cluster.generality(rows, consensus.frequencies(claims), totals, dim=2), "coverage": consensus.coverage(rows, claims, totals), "weak": gaps.weak_coverage(rows, totals).drop("suggestions"),
            "strength": relate.score_pairs(pairs, relate.cooccurrence(seen, pairs), relate.shared_documents(claims, pairs), seen, rows),
        }
        return {k: sorted(map(tuple, df.where("project_id = 1").select(sorted(df.columns)).collect())) for k, df in made.items()}

    both = scores(concepts, pairs, totals)
    assert both == scores(one, pairs.where("project_id = 1"), 5) and all(both.values())


def test_tasks_of_pairs_grow_with_pairs(spark):
    """Many small projects ask for no more tasks than they have pairs of blocks."""
    from quillgraph.functions.vectors import similar_pairs

    rows = spark.range(400).select("id", F.floor(F.col("id") / 2).alias("project_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    pairs = similar_pairs(rows, 0.5, 2.0)
    assert pairs.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism and pairs.count() == 200


def test_bridges_of_large_projects(spark):
    """501 concepts of two clusters have all their bridges; the limit is an option."""
    rows = spark.range(501).select("id", F.lit(1).cast("long").alias("project_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), (F.col("id") % 2).cast("int").alias("cluster_label"))
    assert cluster.bridge_pairs(rows).count() == 251 * 250
    assert cluster.bridge_pairs(rows, most=500).count() == 0


def test_density_finds_blobs():
    x = blobs()
    labels = cluster.canonical(cluster.density_clusters(x, 3, 2), np.arange(len(x)))
    assert labels[:18].tolist() == [0] * 6 + [1] * 6 + [2] * 6
    assert (cluster.density_clusters(x[:1], 2, 2) == -1).all()
    assert len(set(cluster.kmeans(x[:18], 3).tolist())) == 3


def test_cluster_concepts_falls_back_and_scales(spark):
    x = blobs(noise=0)
    rows = [(i, 1, [float(v) for v in x[i]]) for i in range(18)] + [(100, 2, [1.0] * 8)]
    df = spark.createDataFrame(rows, "id long, project_id long, embedding array<double>")
    got = {r["id"]: r["cluster_label"] for r in cluster.cluster_concepts(df).collect()}
    assert [got[i] for i in range(18)] == [0] * 6 + [1] * 6 + [2] * 6 and got[100] == 0
    large = {r["id"]: r["cluster_label"] for r in cluster.cluster_concepts(df.where("project_id = 1"), most=5).collect()}
    assert len(large) == 18


def test_large_projects_are_clustered_by_density(spark, monkeypatch):
    x = np.concatenate([blobs(per=14, noise=0, seed=4), np.random.default_rng(8).normal(size=(6, 8))])
    rows = [(3 * i, 1, [float(v) for v in x[i]]) for i in range(len(x))]
    df = spark.createDataFrame(rows, "id long, project_id long, embedding array<double>")
    want = {r["id"]: r["cluster_label"] for r in cluster.cluster_concepts(df).collect()}
    monkeypatch.setattr(cluster, "BLOCK", 5)
    got = {r["id"]: r["cluster_label"] for r in cluster.cluster_concepts(df, most=5).collect()}
    assert got == want and cluster.NOISE in got.values() and len(set(got.values())) == 4
    alone = spark.createDataFrame([(i, 1, [1.0, 0.0]) for i in range(9)], "id long, project_id long, embedding array<double>")
    assert len(cluster.cluster_concepts(alone, most=5).collect()) == 9


def test_density_query_labels_all_concepts(spark, tmp_path):
    from quillgraph.plans.queries import density_clusters

    rows = [(i, [float(v) for v in np.random.default_rng(i).normal(size=8)], i % 10) for i in range(490, 530)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["id"] for r in density_clusters(spark, str(tmp_path)).collect()} == set(range(490, 530))


def test_noise_and_hierarchy(spark):
    rows = [(1, 1, [1.0, 0.0], 0, 0.2), (2, 1, [0.0, 1.0], 1, 0.9), (3, 1, [0.1, 0.9], -1, 0.5), (4, 2, [1.0, 0.0], -1, None)]
    df = spark.createDataFrame(rows, "id long, project_id long, embedding array<double>, cluster_label int, generality_score double")
    fixed = cluster.reassign_noise(df, dim=2)
    assert {r["id"]: r["cluster_label"] for r in fixed.collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    assert {r["id"]: r["parent_concept_id"] for r in cluster.hierarchy(fixed).collect()} == {1: None, 2: None, 3: 2, 4: None}
    assert {r["id"]: r["parent_id"] for r in cluster.greedy_hierarchy(df, 0.2, 0.6).collect()}[3] == 2


def test_average_linkage_threshold():
    v = np.array([[1, 0], [0.8, 0.6], [0, 1.0]])
    assert resolve.average_linkage(v, 0.72).tolist() == [0, 0, 2]
    assert resolve.average_linkage(v, 0.8).tolist() == [0, 1, 2]  # at the threshold nothing merges
    assert resolve.average_linkage(v, 0.25).tolist() == [0, 0, 0]


def test_normalize_merges_and_remaps(spark):
    rows = [(1, 1, "The Net", "short", [1.0, 0.0], 0.5, None, None), (2, 1, "net", "a much longer description of the very same net", [0.9, 0.1], 0.4, None, 1), (3, 1, "Other", "o", [0.0, 1.0], 0.3, None, 2), (4, 1, "network", None, [0.99, 0.05], 0.3, None, None)]
    concepts = spark.createDataFrame(rows, CONCEPT + ", parent_concept_id long")
    claims = spark.createDataFrame([(1, 10, 1), (2, 11, 2), (3, 12, 4), (4, 12, 3)], "id long, document_id long, concept_id long")
    rel = spark.createDataFrame([(1, 2, 3), (2, 1, 4)], "id long, source_concept_id long, target_concept_id long")
    out = resolve.normalize({"concepts": concepts, "claims": claims, "relationships": rel}, 4)
    got = {r["id"]: r for r in out["concepts"].collect()}
    assert sorted(got) == [1, 3]
    assert got[1]["coverage_score"] == 0.75 and got[3]["parent_concept_id"] == 1
    assert got[1]["description"].startswith("a much longer") and sorted(got[1]["merged_from_ids"]) == [2, 4]
    assert {(r["source_concept_id"], r["target_concept_id"]) for r in out["relationships"].collect()} == {(1, 3), (1, 1)}
    assert {r["old_id"]: r["new_id"] for r in out["aliases"].collect()} == {2: 1, 4: 1}


def test_greedy_merge_and_claim_targets(spark):
    rows = [(1, 1, "x", None, [1.0, 0.0], None, None), (2, 1, "y", None, [0.9, 0.1], None, None), (3, 1, "z", None, [0.0, 1.0], None, None), (4, 1, "the z", None, None, None, None), (5, 1, " ", None, None, None, None)]
    got = {r["id"]: r["group_id"] for r in resolve.greedy_merge(spark.createDataFrame(rows, CONCEPT)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
    claims = spark.createDataFrame([(1, 1, "Net"), (2, 1, "deep net theory"), (3, 1, "unknown"), (4, 2, "net")], "claim_id long, batch long, related_concept string")
    concepts = spark.createDataFrame([(7, 1, "deep net"), (8, 1, "net")], "id long, batch long, name string")
    assert {r["claim_id"]: r["concept_id"] for r in resolve.claim_targets(claims, concepts).collect()} == {1: 8, 2: 7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 40), (41, 50), (60, 60)]
    got = {r["node"]: r["component"] for r in label_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in (40, 41, 50)} == {40} and got[60] == 60


def test_gaps(spark):
    rows = [(1, 1, "a", [1.0, 0.0], 0, 0.9, 0.1, False, False), (2, 1, "b", [0.8, 0.6], 1, 0.5, 0.1, False, False), (3, 1, "c", [0.0, 1.0], 2, 0.9, None, False, False), (4, 1, "old", None, None, 0.9, 0.0, True, True)]
    df = spark.createDataFrame(rows, "id long, project_id long, name string, embedding array<double>, cluster_label int, generality_score double, coverage_score double, is_gap boolean, is_synthetic_gap boolean")
    rel = spark.createDataFrame([(2, 3)], "source_concept_id long, target_concept_id long")
    clean = gaps.clear_gaps(df)
    assert sorted(r["id"] for r in clean.collect()) == [1, 2, 3]
    weak = {r["id"]: r for r in gaps.weak_coverage(clean, 10).collect()}
    assert sorted(weak) == [1, 3] and weak[1]["approx_docs"] == 1 and "of 10" in weak[1]["suggestions"][1]
    assert gaps.weak_coverage(clean, 4).count() == 0
    assert {r["id"] for r in gaps.flag_weak(clean, 10).where("is_gap").collect()} == {1, 3}
    found = gaps.bridge_candidates(clean, rel, 0.55, 2, dim=2).collect()
    assert [(r["a"], r["b"], round(r["sim"], 6), r["head_a"]) for r in found] == [(0, 1, 0.8, "a")]
    made = gaps.bridging_gaps(gaps.bridge_candidates(clean, rel, 0.55, 2, dim=2)).first()
    assert made["gap_subtype"] == "bridging" and made["related_to"] == ["a", "b"] and np.linalg.norm(made["embedding"]) == pytest.approx(1)
    topics = [(1, 1, " New ", "d", ["x", "y"], "CRITICAL"), (1, 2, "new", "d", None, "critical"), (1, 3, "A", "", None, "critical"), (1, 4, "meh", "", None, "odd")]
    got = gaps.expected_topics(spark.createDataFrame(topics, "project_id long, seq long, name string, description string, related_to array<string>, importance string"), clean).collect()
    assert [(r["name"], len(r["suggestions"])) for r in got] == [("New", 3)]


def test_search_bounds_and_zero_id(spark):
    chunks = spark.createDataFrame([(0, 0, [1.0, 0.0], "x"), (1, 1, [0.0, 1.0], "y"), (2, 1, None, "z")], "id long, document_id long, embedding array<double>, content string")
    docs = spark.createDataFrame([(0, "a"), (1, "b")], "id long, filename string")
    assert [r["id"] for r in search.search_chunks(chunks, docs, [1.0, 0.0], 5, 0.0, document_id=0).collect()] == [0]
    for k, t in ((0, 0.5), (101, 0.5), (5, 1.5)):
        with pytest.raises(ValueError):
            search.search_chunks(chunks, docs, [1.0, 0.0], k, t)
    assert search.chat_confidence(chunks.where("false").withColumn("similarity", F.lit(1.0))).first()[0] == 0.3


def test_catalog_ownership_and_cascade(spark):
    rooms = spark.createDataFrame([(1, "r", "u1"), (2, "s", "u2")], "id long, name string, user_id string")
    assert catalog.owned(rooms, 1, "u1").count() == 1
    for room, user in ((1, "u2"), (9, "u1")):
        with pytest.raises(catalog.NotFound):
            catalog.owned(rooms, room, user)
    tables = {
        "projects": rooms, "documents": spark.createDataFrame([(1, 1), (2, 2)], "id long, project_id long"), "chunks": spark.createDataFrame([(1, 1), (2, 2)], "id long, document_id long"),
        "concepts": spark.createDataFrame([(1, 1, None), (2, 2, 1)], "id long, project_id long, parent_concept_id long"), "claims": spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "id long, document_id long, concept_id long"),
        "relationships": spark.createDataFrame([(1, 1, 2), (2, 2, 2)], "id long, source_concept_id long, target_concept_id long"), "brain_state": spark.createDataFrame([(1, 1)], "id long, project_id long"),
    }
    left = catalog.delete_project(tables, 1)
    assert {t: left[t].count() for t in tables} == {"projects": 1, "documents": 1, "chunks": 1, "concepts": 1, "claims": 1, "relationships": 1, "brain_state": 0}
    assert left["concepts"].first()["parent_concept_id"] is None


def test_empty_map(spark):
    schema = "id long, project_id long, name string, coverage_score double, consensus_score double, generality_score double, is_gap boolean, gap_type string, parent_concept_id long, cluster_label int, importance string, gap_subtype string"
    shown = graphmap.map_concepts(spark.createDataFrame([], schema))
    edges = graphmap.map_edges(shown, spark.createDataFrame([], "id long, source_concept_id long, target_concept_id long, relationship_type string, strength double, confidence double"))
    row = graphmap.map_metadata(shown, edges).first()
    assert (row["total_concepts"], row["total_relationships"], row["total_gaps"], row["num_clusters"], row["has_clustering"]) == (0, 0, 0, 0, False)


def test_match_concepts_in_order(spark):
    existing = spark.createDataFrame([(1, 1, "Graph", None, [1.0, 0.0], None, None), (2, 1, "Other", None, None, None, None)], CONCEPT)
    new = spark.createDataFrame([(10, 1, "the graph", None, [0.0, 1.0], None, None), (11, 1, "near", None, [0.9, 0.1], None, None), (12, 1, "fresh", None, [0.0, 1.0], None, None), (13, 1, "fresh", None, None, None, None), (14, 1, "like fresh", None, [0.1, 0.9], None, None)], CONCEPT)
    got = {r["id"]: (r["concept_id"], r["is_new"]) for r in resolve.match_concepts(new, existing).collect()}
    assert got == {10: (1, False), 11: (1, False), 12: (12, True), 13: (12, False), 14: (12, False)}


def test_numbering_goes_on(spark):
    rows = spark.createDataFrame([(4, 1, 2)], "id long, a long, b long")
    fresh = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = catalog.append_new(rows, fresh, ["a", "b"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(4, 54)) and [r["a"] for r in got[1:]] == [0, *range(2, 50)]
