import json

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import jsonfix, text, vectors


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(*columns).first()


def test_cosine_rules(spark):
    a, b, z = (F.array(*[F.lit(float(x)) for x in v]) for v in ([3, 4], [4, 3], [0, 0]))
    got = one(spark, vectors.cosine(a, b), vectors.cosine(a, z), vectors.cosine(a, F.array(F.lit(1.0))), vectors.cosine(a, F.lit(None).cast("array<double>")))
    assert tuple(got) == (pytest.approx(0.96), 0.0, 0.0, None)
    assert one(spark, vectors.l2_normalize(a))[0] == pytest.approx([0.6, 0.8])
    assert one(spark, vectors.midpoint(a, b))[0] == pytest.approx([2**-0.5] * 2)


def test_similar_pairs_over_blocks_and_projects(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 2, i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(0, 100, None)]
    df = spark.createDataFrame(rows, "project_id long, id long, embedding array<double>")
    got = {(r["a"], r["b"]): r["sim"] for r in vectors.similar_pairs(df, 0.3, 0.9, block=7).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for p, i, v in rows if v}
    want = {(a, b): unit[a] @ unit[b] for a in unit for b in unit if a < b and a % 2 == b % 2 and 0.3 <= unit[a] @ unit[b] <= 0.9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mean_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0]), (2, None)], "g int, embedding array<double>")
    got = {r["g"]: (r["centroid"], r["n"]) for r in vectors.mean_vectors(df, ["g"]).collect()}
    assert got == {1: ([0.5, 0.5], 2), 2: ([3.0, 4.0], 1)}
    wide = {r["g"]: r["centroid"] for r in vectors.mean_vectors(df, ["g"], dim=10_000).collect()}
    assert wide == {1: [0.5, 0.5], 2: [3.0, 4.0]}


@pytest.mark.parametrize(
    "raw, clean",
    [("The Theory of an Atom", "theory of atom"), ("  A  ", ""), ("Êtude (in) the C-major!", "êtude in cmajor"), ("self-attention", "selfattention"), ("a. an b", "b")],
)
def test_clean_name(spark, raw, clean):
    assert " ".join(one(spark, text.clean_name(F.lit(raw)))[0].split()) == clean


def test_text_functions(spark):
    assert one(spark, text.word_count(F.lit("  a b\n c  ")))[0] == 3
    assert one(spark, text.paragraphs(F.lit("a\n \n\nb\nc")))[0] == ["a", "b\nc"]
    assert one(spark, text.sentences(F.lit('One. Two! "Three" e.g. four? (Five)')))[0] == ["One.", "Two!", '"Three" e.g. four?', "(Five)"]
    assert one(spark, text.truncate(F.lit("abcdefghij"), 6))[0] == "abc..."
    assert [one(spark, text.heading_level(F.lit(s), F.lit(10.0)))[0] for s in (15.0, 12.5, 11.0)] == [1, 2, 3]
    assert one(spark, text.is_page_number(F.lit(" 12 ")), text.is_page_number(F.lit("12345"))) == (True, False)
    assert one(spark, text.table_row(F.array(F.lit("a"), F.lit(None), F.lit(" b "))))[0] == "a |  | b"
    assert one(spark, text.normalize_text(F.lit("ﬁne   “quoted” text")))[0] == "fine quoted text"
    assert one(spark, text.is_heading(F.lit(12.0), F.lit(10.0), F.lit(False), F.lit("x")))[0]
    assert one(spark, text.is_bold_heading(F.array(F.lit(True), F.lit(False)), F.lit("x")))[0] is False


def test_chunks_by_paragraph_sentence_and_word():
    p = " ".join(["w"] * 6)
    assert text.split_section("short text", 10) == ["short text"]
    assert text.split_section(f"{p}\n\n{p}", 10) == [p, p]
    assert text.split_section(f"{p}\n\n{' '.join(['v'] * 4)}\n\n{p}", 10) == [f"{p} v v v v", p]
    assert text.split_section("A b c. D e f. G h i j.", 6) == ["A b c. D e f.", "G h i j."]
    assert [len(c.split()) for c in text.split_section(" ".join(["x"] * 25), 10)] == [10, 10, 5]


def test_section_chunks_overlap_and_number(spark):
    rows = [(1, "ignored", [{"title": "A", "content": " ".join(f"a{i}" for i in range(12)), "level": 1, "page_num": 2}, {"title": "B", "content": " ", "level": 2, "page_num": 3}, {"title": "C", "content": "c", "level": 2, "page_num": None}]), (2, None, None), (3, "plain", None)]
    df = spark.createDataFrame(rows, "id long, content_text string, sections array<struct<title:string,content:string,level:int,page_num:int>>")
    got = [(r["id"], r["chunk_index"], r["content"].split(), r["section_title"]) for r in text.section_chunks(df, 5, 2).orderBy("id", "chunk_index").collect()]
    assert [(g[0], g[1], len(g[2]), g[3]) for g in got] == [(1, 0, 5, "A"), (1, 1, 7, "A"), (1, 2, 4, "A"), (1, 3, 1, "C"), (3, 0, 1, "")]
    assert got[1][2][:3] == ["a3", "a4", "a5"]


@pytest.mark.parametrize(
    "raw, value",
    [
        ('{"a": 1}', {"a": 1}), ('```json\n[1, 2]\n```', [1, 2]), ('[1, 2,]', [1, 2]), ('{"a": True, "b": None}', {"a": True, "b": None}),
        ('Here you are: {"a": "}"} - enjoy', {"a": "}"}), ('[{"a": 1}, {"b": 2', {"a": 1}), ('[{"a": 1}', {"a": 1}), ('{"a": [1]', [1]), ('[{"a": 1', [{"a": 1}]), ("", None), (None, None), ("nothing", None),
        ('{"a": 1} // note', {"a": 1}),
    ],
)
def test_repair(raw, value):
    got = jsonfix.repair(raw)
    assert (None if got is None else json.loads(got)) == value


@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab ", max_size=4), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("xy", min_size=1, max_size=2), c, max_size=3)))
def test_valid_json_is_unchanged(value):
    assert json.loads(jsonfix.repair(json.dumps(value))) == value


def test_typed_rows(spark):
    raw = json.dumps([{"concept_name": " X ", "specificity_level": "BROAD", "confidence": 3}, {"concept_name": ""}, {"concept_name": "Y", "specificity_level": "odd", "confidence": "high"}, {"concept_name": "Z"}])
    got = jsonfix.concept_rows(spark.createDataFrame([(raw,)], "json string")).orderBy("position").collect()
    assert [(r["name"], r["specificity_level"], r["confidence"]) for r in got] == [("X", "broad", 1.0), ("Y", "medium", 0.5), ("Z", "medium", 0.7)]
    claims = json.dumps([{"claim_text": "c", "claim_type": "Extends", "related_concept": "x", "confidence": "0.4"}, {"claim_text": "d", "claim_type": "?"}])
    got = jsonfix.claim_rows(spark.createDataFrame([(claims,)], "json string")).orderBy("position").collect()
    assert [(r["claim_text"], r["claim_type"], r["confidence"]) for r in got] == [("c", "extends", 0.4), ("d", "supports", 0.7)]


def test_sections_from_lines(spark):
    from quillgraph.functions import layout

    rows = [(1, 1, 5.0, 0.0, 10.0, False, "running head", 100.0), (1, 1, 20.0, 0.0, 16.0, False, "Title", 100.0), (1, 1, 30.0, 5.0, 10.0, False, "right", 100.0), (1, 1, 30.0, 0.0, 10.0, None, "left", 100.0), (1, 2, 50.0, 0.0, 10.0, True, "Bold head", 100.0), (1, 2, 60.0, 0.0, 10.0, False, "12", 100.0), (1, 2, 70.0, 0.0, 10.0, False, "body", 100.0)]
    df = spark.createDataFrame(rows, "id long, page_num int, y double, x double, size double, bold boolean, text string, height double")
    got = [tuple(r) for r in layout.sections_from_lines(df).orderBy("section").collect()]
    assert got == [(1, 1, "Title", 1, 1, "left\nright"), (1, 2, "Bold head", 3, 2, "body")]
    tie = spark.createDataFrame([(1, 1, 2.0, 0.0, 9.0), (1, 1, 1.0, 0.0, 11.0)], "id long, page_num int, y double, x double, size double")
    assert layout.body_sizes(tie).first()["body"] == 11.0


def test_small_helpers(spark):
    assert tuple(one(spark, text.safe_divide(F.lit(1.0), F.lit(0.0), 7.0), text.prefixed("concept", F.lit(3)), text.detect_language(F.lit("short")))) == (7.0, "concept_3", "unknown")
