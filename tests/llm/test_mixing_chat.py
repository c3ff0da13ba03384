"""Mixing and chat rotation against SQL and brute force."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chat, mixing
from quillgraph.llm.queries import op2_source_mixing, op9_chat_rotation
from quillgraph.llm.sql import OP2, OP9


@pytest.mark.parametrize("query, sql", [(op2_source_mixing, OP2), (op9_chat_rotation, OP9)])
def test_query_equals_sql(spark, sf, query, sql):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want[list(got.columns)].to_numpy().tolist()))


def pour(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by rounds: what is above a cap is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 1, None: 5}, {"a": 0, "b": 3}, {None: 7}, {"é": 5, "z": 50, "Z": 500, "a": 5000, "\U0001f600": 50, "￿": 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in pour(sizes).items()}


def test_mix_emits_copies(spark, odd, none):
    plan = defaultdict(list)
    for r in mixing.mixing_plan(odd).collect():
        plan[r["doc_id"], r["text"]].append(r)
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns
    got = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert all(r["size"] == r["doc_id"] for r in mixed.collect())  # a column of the documents, not the plan's
    assert got == +Counter({k: sum(r["copies"] for r in rows) for k, rows in plan.items()})
    assert Counter((r["doc_id"], r["text"]) for r in odd.collect()) == {k: len(rows) for k, rows in plan.items()}
    assert plan[(2, None)][0]["size"] == 0 and plan[(7, "  \t\n \v")][0]["size"] == 0 and plan[(4, plan_text(plan))][0]["size"] == 60_000
    assert mixing.mixing_plan(none).count() == 0 and mixing.mix_sources(none).count() == 0


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_null_and_repeated_ids_are_drawn_one_by_one(spark, monkeypatch, broadcast):
    """A source of rows without ids, one of a single repeated row and one of plain rows; the draws are those of the numbers from 1."""
    monkeypatch.setattr(mixing, "BROADCAST_KEYS", broadcast)
    n = 3000
    ids = F.when(F.col("id") < n, None).when(F.col("id") < 2 * n, F.lit(5)).otherwise(F.col("id"))
    texts = F.when(F.col("id") < n, F.concat(F.lit("a b "), F.col("id").cast("string"))).otherwise(F.lit("a b c"))
    docs = spark.range(3 * n).repartition(7).select(ids.alias("doc_id"), texts.alias("text"), F.floor(F.col("id") / n).cast("string").alias("source"))
    rows = mixing.mixing_plan(docs).collect()
    for source in "012":
        own = [r for r in rows if r["source"] == source]
        assert len(own) == n and abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) < 0.05 * own[0]["target"]
    rate = next(r["target"] / r["source_size"] for r in rows if r["source"] == "1")
    key = hashlib.md5(b"5:a b c").hexdigest()
    draws = [int(hashlib.md5(f"17:{key}:{k}".encode()).hexdigest()[:13], 16) / (1 << 52) for k in range(1, n + 1)]
    assert sum(r["copies"] for r in rows if r["source"] == "1") == sum(int(rate) + (d < rate % 1) for d in draws)


def plan_text(plan):
    return next(t for i, t in plan if i == 4)


def test_salted_join_gives_the_same(spark, docs, monkeypatch):
    want = sorted(map(tuple, mixing.mixing_plan(docs).select("doc_id", "target", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted(map(tuple, mixing.mixing_plan(docs).select("doc_id", "target", "copies").collect())) == want


def test_taken_words_come_near_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    rows = mixing.mixing_plan(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] - r["t"]) < 0.05 * r["t"] for r in rows)


def brute_chat(rows, part=chat.PART_TURNS):
    talks, people = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in rows:
        role = "unknown" if role is None else role
        people[conv].add(role)
        talks[conv].append((turn is not None, turn or 0, role, text or "", None if turn is None else turn // part))
    out = {}
    for conv, turns in talks.items():
        for speaker in people[conv]:
            whole = ""
            for _, _, role, said, p in sorted(turns, key=lambda t: t[:4]):
                n, own, start, text, mask = out.setdefault((conv, p, speaker), (0, 0, len(whole), "", []))
                head = "<|im_start|>assistant\n" if role == speaker else f"<|im_start|>user name={role}\n"
                piece = head + said + "<|im_end|>\n"
                if role == speaker:
                    mask = [*mask, (len(whole) + len(head), len(whole) + len(piece))]
                whole += piece
                out[conv, p, speaker] = (n + 1, own + (role == speaker), start, text + piece, mask)
    return out


@pytest.mark.parametrize("part", [256, chat.PART_TURNS])
def test_rotation_against_brute_force(spark, sf, part):
    odd = [(1, 0, "user", "hi é"), (1, 1, None, None), (1, 1, None, "x"), (1, 600, "bot", "late"), (2, None, "a", "t"), (None, 0, "a", "n"), (None, 0, "a", "n"), (3, 0, "", ""), (5, 255, "a", "ask"), (5, 256, "b", "say")]
    odd += [(4, i, "ab"[i % 2], "w" * i) for i in range(700)]
    for df in (spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")), spark.read.parquet(f"{sf}/conversations.parquet")):
        got = {(r["conv_id"], r["part"], r["speaker"]): (r["n_turns"], r["n_own"], r["start"], r["text"], [tuple(m) for m in r["mask"]]) for r in chat.rotate_perspectives(df, part).collect()}
        assert got == brute_chat([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()], part)
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pieces_join_to_the_whole_dialogue(spark):
    rows = [(4, i, "abc"[i % 3], f"turn {i} é") for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {r["speaker"]: r for r in chat.rotate_perspectives(df).collect()}
    assert len(whole) == 3 and all(r["n_turns"] == 900 and r["start"] == 0 for r in whole.values())
    pieces = sorted(chat.rotate_perspectives(df, 256).collect(), key=lambda r: r["part"])
    for speaker, r in whole.items():
        own = [p for p in pieces if p["speaker"] == speaker]
        assert len(own) == 4 and "".join(p["text"] for p in own) == r["text"] and [m for p in own for m in p["mask"]] == r["mask"]


def test_native_plans_have_no_python(spark, sf):
    for query in (op2_source_mixing, op9_chat_rotation):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
