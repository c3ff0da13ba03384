"""What larger tables showed: edges of bands, near copies, and sizes that must not grow with the square of the input."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import consensus
from quillgraph.plans.queries import ORACLES, QUERIES


def near_copies(folder, n=150, copies=4, dim=64, seed=5):
    """Vectors with near copies (similarity over 0.85), as the table ``embeddings``."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    x = np.concatenate([base + rng.normal(size=base.shape) * 0.05 for _ in range(copies)]).astype(np.float32)
    pdf = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x), "label": (np.arange(len(x)) % 10).astype(np.int32)})
    con = duckdb.connect()
    con.execute(f"copy (select vec_id::bigint as vec_id, embedding::float[] as embedding, label from pdf) to '{folder}/embeddings.parquet'")
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    return con, str(folder)


def equal(spark, con, folder, name):
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    got, want = (x[columns].sort_values([c for c in columns if x[c].dtype.kind in "iO"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=1.1e-6)
    return len(want)


def test_scores_on_the_edge_of_a_band(spark):
    """60 of 75 is 0.8, which isn't strong; a sum of these weights as doubles is a little more."""
    kinds = ["supports"] * 49 + ["extends"] * 15 + ["complements"] + ["contradicts"] * 15
    claims = spark.createDataFrame([(k, 7, kind) for k, kind in enumerate(kinds)], "id long, concept_id long, claim_type string").coalesce(1)
    concepts = spark.createDataFrame([(7, 1)], "id long, project_id long")
    scored = consensus.consensus_by_concept(concepts, claims)
    assert scored.first()["consensus_score"] == 0.8
    assert scored.select(consensus.band(F.col("consensus_score")).alias("b")).first()["b"] == "contested"


def test_parents_are_no_near_copies(spark, tmp_path):
    """Pairs of more than 0.85 are no candidates in the SQL."""
    con, folder = near_copies(tmp_path)
    assert equal(spark, con, folder, "greedy_hierarchy") == 600


def shuffled(spark, run):
    """Bytes that the executors shuffle while ``run`` runs."""
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    run()
    return written() - before


def many(spark, n, dim=64):
    x = np.random.default_rng(n).normal(size=(n, dim))
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "project_id": 1, "embedding": [v.tolist() for v in x]}))


def test_pairs_of_blocks_are_not_shuffled(spark):
    """Four times the blocks shuffle about four times as much, not sixteen."""
    from quillgraph.functions.vectors import similar_pairs

    few, much = (shuffled(spark, lambda df=many(spark, n): similar_pairs(df, 0.9, 1.0, block=16).count()) for n in (640, 2560))
    assert much < 7 * few


@pytest.mark.parametrize("name", ["candidate_pairs_window", "fresh_pairs_antijoin", "infer_relationship_type", "shared_docs", "relationship_strength", "bridge_pairs"])
def test_candidates_are_not_joined(spark, sf, name):
    """What pairs need of their concepts goes with the vectors; nothing is shuffled or joined after the pairs are made."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in after and "Join" not in after


def test_pairs_carry_what_their_concepts_have(spark):
    from quillgraph.functions.vectors import similar_pairs

    x = np.random.default_rng(3).normal(size=(60, 4))
    lists = [[int(v) for v in np.random.default_rng(k).integers(0, 40, k % 9)] if k % 7 else None for k in range(60)]
    rows = [(100 - k, k % 2, x[k].tolist(), f"n{k}" if k % 5 else None, lists[k]) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, project_id long, embedding array<double>, name string, seen array<long>")
    known = spark.createDataFrame([(41, [42, 43, 44, 45, 99, 1000])], "id long, known array<long>")
    got = similar_pairs(df.join(known, "id", "left"), 0.2, 0.9, block=7, carry=("name",), shared=("seen",), without="known").collect()
    at = {r[0]: r for r in rows}
    u = {r[0]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    want = {(a, b) for a in at for b in at if a < b and at[a][1] == at[b][1] and 0.2 <= u[a] @ u[b] <= 0.9 and not (a == 41 and b in (42, 43, 44, 45, 99))}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert (r["name_a"], r["name_b"]) == (at[r["a"]][3], at[r["b"]][3])
        assert r["seen"] == len(set(at[r["a"]][4] or ()) & set(at[r["b"]][4] or ()))


def test_folds_agree_with_all_pairs(spark, monkeypatch):
    """Rows that tasks fold are those of a window over all pairs."""
    from quillgraph.functions import vectors
    from quillgraph.operators import cluster, relate

    monkeypatch.setattr(vectors, "FOLD_ROWS", 50)
    df = many(spark, 300, 4).withColumn("project_id", F.col("id") % 3).withColumn("generality_score", (F.col("id") % 11) / 11.0)
    pairs = relate.candidate_pairs(df).toPandas().sort_values(["project_id", "sim", "a", "b"], ascending=[True, False, True, True])
    top = relate.top_candidates(df, 20).toPandas()
    want = pairs.groupby("project_id").head(20)
    assert sorted(zip(top["a"], top["b"])) == sorted(zip(want["a"], want["b"]))
    parents = {r["id"]: r["parent_id"] for r in cluster.greedy_hierarchy(df, 0.2, 0.3, 0.85).collect()}
    for i in range(300):
        others = [b if a == i else a for a, b in zip(pairs["a"], pairs["b"]) if i in (a, b)]
        others = [o for o in others if (o % 11) / 11.0 - (i % 11) / 11.0 > 0.2]
        assert parents[i] == (max(others, key=lambda o: (o % 11, -o)) if others else None)


def test_density_shuffles_no_pairs_of_blocks(spark, monkeypatch):
    from quillgraph.operators import cluster

    monkeypatch.setattr(cluster, "BLOCK", 16)
    few, much = (shuffled(spark, lambda df=many(spark, n): cluster.cluster_concepts(df, most=5).count()) for n in (400, 1600))
    assert much < 7 * few


def test_chunks_are_made_a_document_at_a_time(spark, monkeypatch):
    """A batch of 20 MB of texts takes a few MB of a worker's objects."""
    import tracemalloc

    import pyarrow as pa

    from quillgraph.functions import text

    docs = spark.createDataFrame([(1, "a b")], "id long, content_text string")
    found = []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, lambda self, f, schema, name=name: found.append((name, f)))
    text.section_chunks(docs)
    (name, cut), = found
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(["word " * 1000] * 4000), pa.nulls(4000)], ["id", "content_text", "sections"])
    tracemalloc.start()
    rows = sum(len(x) if name == "mapInPandas" else x.num_rows for x in cut(iter([batch.to_pandas() if name == "mapInPandas" else batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 8000 and peak < 12_000_000


def test_large_components_merge_as_small_ones(spark, monkeypatch):
    """Rounds of nearest groups, and chains, give the groups of plain average linkage; no task makes a matrix of a large component."""
    from quillgraph.operators import resolve

    r = np.random.default_rng(6)
    x = r.normal(size=(160, 5))
    x[80:] = x[:80] + r.normal(size=(80, 5)) * 0.3
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    names = "id long, project_id long, name string, embedding array<double>"
    df = spark.createDataFrame([(3 * k, k % 2, f"name {k}", x[k].tolist()) for k in range(160)], names)
    want = {}
    for p in (0, 1):
        own = np.arange(p, 160, 2)
        want |= {3 * int(own[k]): 3 * int(own[g]) for k, g in enumerate(resolve.average_linkage(unit[own], 0.6))}
    assert 2 < len(set(want.values())) < 100
    monkeypatch.setattr(resolve, "LINKED", 4)
    for few in (0, 40):
        monkeypatch.setattr(resolve, "CHAINED", few)
        assert {r["id"]: r["group_id"] for r in resolve.merge_similar(df, 0.6).collect()} == want
    for t in (0.3, 0.6, 0.9):
        assert resolve.chain_linkage(unit, np.ones(160), t).tolist() == resolve.average_linkage(unit, t).tolist()
