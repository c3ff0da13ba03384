import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.catalog import NotFound
from quillgraph.plans.engine import Engine
from quillgraph.plans.models import HashedWords, RemoteClassifier, RemoteEmbedder, RemoteExtractor, RemoteSuggester, RemoteWriter, ask_json
from quillgraph.sources import parsers
from quillgraph.sources.parsers import check_setup, file_metadata, parse_docx, parse_files, parse_html
from quillgraph.sources.schemas import migrate_dimension
from quillgraph.sources.store import Conflict, Store, shared_dir
from quillgraph.streaming import documents as stream

TEXT = "Neural networks learn representations. Networks need training data. Gradient descent trains networks. " * 12


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(Store(spark, f"file://{tmp_path_factory.mktemp('store')}"))


def files(spark, rows):
    return spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in rows], "path string, length long, content binary")


def test_uploads_are_checked(spark):
    rows = [("d/a.txt", b"hello world"), ("d/b.pdf", b"%PDF nothing"), ("d/c.exe", b"x"), ("d/e.txt", b"  ")]
    got = {r["filename"]: r["status"] for r in parse_files(files(spark, rows), types=(".txt", ".pdf")).collect()}
    assert got == {"a.txt": 200, "b.pdf": 422, "c.exe": 400, "e.txt": 422}
    assert parse_files(files(spark, [("a.txt", b"x" * 11)]), types=(".txt",), p=__import__("quillgraph.params", fromlist=["Params"]).Params(max_file_bytes=10)).first()["status"] == 413
    assert parse_files(files(spark, [("a.txt", b"x")])).first()["status"] == 400


def test_parsers():
    html = b"<h1>Top</h1><p>one</p><script>no</script><h2>Sub</h2><div>two</div>"
    assert [(s["title"], s["content"], s["level"]) for s in parse_html(html)] == [("Top", "one", 1), ("Sub", "two", 2)]
    with pytest.raises(Exception):
        parse_docx(b"no zip")


def test_pages_become_sections():
    line = lambda y, text, size=10.0, bold=False, x=0: {"y": y, "x": x, "size": size, "bold": bold, "text": text}
    one = [line(10, "running head"), line(100, "Title", 16), line(120, "b", x=50), line(120, "a"), line(130, "7"), line(140, "A Part", 13), line(150, "Bold words", bold=True), line(160, "text"), line(790, "foot")]
    got = parsers.sections_of([{"height": 800, "lines": one, "tables": [[["x", None], ["", ""], ["1", "2"]]]}, {"height": 800, "lines": [line(400, "more")]}])
    assert [(s["title"], s["level"], s["content"], s["page_num"]) for s in got] == [("Title", 1, "a\nb", 1), ("A Part", 2, "", 1), ("Bold words", 3, "text\n[Tables]\nx | \n1 | 2\nmore", 1)]
    assert parsers.sections_of([]) == []


def test_docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="", bold="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>' if style else ''}<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{text}</w:t></w:r></w:p>"
    body = p("Intro", "Heading2") + p("text") + p("Bold", bold="1") + "<w:tbl><w:tr><w:tc>" + p("x") + "</w:tc><w:tc>" + p("y") + "</w:tc></w:tr></w:tbl>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    assert [(s["title"], s["level"], s["content"]) for s in parse_docx(data.getvalue())] == [("Intro", 2, "text"), ("Bold", 3, "x | y")]


def test_room_life(engine, spark):
    a = engine.create_room("mine", "u1")
    b = engine.create_room("other", "u2")
    assert {r["id"] for r in engine.rooms("u1").collect()} == {a}
    with pytest.raises(NotFound):
        engine.room(b, "u1")
    engine.delete_room(b, "u2")
    with pytest.raises(NotFound):
        engine.room(b, "u2")
    assert engine.process_all(a)["message"].startswith("No documents")
    assert engine.run_status(a) == {"phase": "idle"}


def test_pipeline_end_to_end(engine, spark):
    room = engine.create_room("papers", "u3")
    long = TEXT * 10
    status = engine.upload(files(spark, [("a.txt", TEXT.encode()), ("b.txt", long.encode()), ("c.exe", b"x")]), room)
    assert {r["filename"]: r["status"] for r in status.collect()} == {"a.txt": 200, "b.txt": 200, "c.exe": 400}
    listed = {r["filename"]: r["chunk_count"] for r in engine.documents(room).collect()}
    assert listed["a.txt"] == 1 and listed["b.txt"] > 1
    done = engine.process_all(room)
    assert not [k for k in done if k.endswith("_error")], done
    assert done["documents_processed"] == 2
    assert engine.concepts(room).count() > 0
    shown = engine.concept_map(room)
    assert shown["nodes"].count() == shown["metadata"].first()["total_concepts"] > 0
    found = engine.search("gradient descent", 3).collect()
    assert found and found[0]["filename"] == "b.txt"
    answer = engine.chat(room, "what trains networks?")
    assert "networks" in answer["answer"].lower() and 0 < answer["confidence"] <= 1
    assert engine.status(room).first()["documents"] == 2
    again = engine.process_all(room)
    assert again["documents_processed"] == 0  # nothing is extracted twice
    ids = [r["id"] for r in engine.documents(room).collect()]
    engine.delete_document(ids[0])
    assert engine.documents(room).count() == 1
    with pytest.raises(NotFound):
        engine.delete_document(99999)


def test_writers_of_one_version_conflict(spark, tmp_path):
    one, two = Store(spark, f"file://{tmp_path}/s"), Store(spark, f"file://{tmp_path}/s")
    row = lambda i, p: spark.createDataFrame([(i, p, f"c{i}")], "id long, project_id long, name string")
    one.append("concepts", row(1, 1))
    assert one.read("concepts").count() == two.read("concepts").count() == 1
    one.append("concepts", row(2, 1))
    with pytest.raises(Conflict):
        two.append("concepts", row(3, 1))
    assert {r["id"] for r in two.read("concepts").collect()} == {1, 2}
    two.append("concepts", row(3, 2))
    assert {r["id"] for r in two.read("concepts").collect()} == {1, 2, 3}


def test_changes_write_their_own_rows(spark, tmp_path, monkeypatch):
    from quillgraph.sources import store as module

    store, folder = Store(spark, f"file://{tmp_path}/s"), f"{tmp_path}/s/concepts"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "id long, project_id long")
    store.append("concepts", rows(*[(i, i % 3) for i in range(9)], (99, None)))
    before = {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in os.listdir(folder) if f.startswith("rows-")}
    old = store.read("concepts")
    store.replace("concepts", 1, rows((50, 1)))
    assert {f: os.stat(f"{folder}/{f}").st_mtime_ns for f in before} == before  # nothing of others is rewritten
    assert {r["id"] for r in store.read("concepts").collect()} == {0, 2, 3, 5, 6, 8, 50, 99} and old.count() == 10
    store.replace("concepts", 1, rows((51, 1)))
    assert {r["id"] for r in store.read("concepts").where("project_id = 1").collect()} == {51}
    monkeypatch.setattr(module, "MOST_FOLDERS", 3)
    store.append("concepts", rows((60, 2)))
    assert len(store._current("concepts")) == 1 and store.read("concepts").count() == 9
    assert store.vacuum() > 0 and store.read("concepts").count() == 9
    assert len([f for f in os.listdir(folder) if f.startswith("rows-")]) == 1


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"applicationId": "none-of-this", "master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_answers_are_asked_for_twice_at_most():
    asked = []

    def call(prompt):
        asked.append(prompt)
        return {"a": "```json\n[1,]\n```", "b": "no json", "c": "", "d": "{}"}[prompt]

    assert ask_json(call, "a", "d") == "[1]" and asked == ["a"]
    assert ask_json(call, "b", "d") == "{}" and ask_json(call, "b", "b") is None
    asked.clear()
    assert ask_json(call, "c", "d") is None and asked == ["c"]  # an empty answer isn't asked for again


def model():
    """A function that workers get by value: a model that answers all texts but broken ones."""

    def answers(prompt):
        if "BROKEN" in prompt:
            raise TimeoutError("no answer")
        concepts = [{"concept_name": "Deep Nets", "description": "nets", "specificity_level": "BROAD", "confidence": 0.9}, {"concept_name": "guess", "confidence": 0.2}, "odd", {"concept_name": " "}]
        kind = "contradicts" if "DENY" in prompt else "supports"
        claims = [{"claim_text": "nets learn", "related_concept": "the deep nets", "claim_type": kind, "confidence": 2}, {"claim_text": "x", "related_concept": "unheard of", "claim_type": "supports"}, {"claim_text": "part", "related_concept": "nets", "claim_type": "odd"}]
        return "```json\n" + json.dumps({"concepts": concepts, "claims": claims}) + "\n```"

    return answers


def test_extraction_with_contradictions_and_a_failure(spark, tmp_path):
    engine = Engine(Store(spark, f"file://{tmp_path}/s"), extractor=RemoteExtractor(model()))
    room, other = engine.create_room("r", "u"), engine.create_room("o", "u")
    engine.upload(files(spark, [("a.txt", b"yes " * 60), ("b.txt", b"DENY " * 60), ("c.txt", b"BROKEN " * 60), ("d.txt", b"short but small and whole")]), room)
    engine.upload(files(spark, [("e.txt", b"yes " * 60)]), other)
    engine.build = lambda project_id: {}  # the end-to-end test builds
    done = engine.process_all(room)
    engine.build_brain(room)
    assert (done["documents_processed"], done["documents_failed"], done["chunks_failed"]) == (3, 1, 1)
    assert len(done["errors"]) == 1 and done["errors"][0].startswith("c.txt") and "TimeoutError" in done["errors"][0]
    concepts = engine.concepts(room, is_gap=False).collect()
    assert [r["name"] for r in concepts] == ["Deep Nets"] and engine.store.read("concepts").where("project_id = " + str(other)).count() == 0
    claims = engine.store.read("claims").collect()
    assert sorted((r["claim_text"], r["claim_type"], r["confidence"]) for r in claims) == sorted([("nets learn", "supports", 1.0)] * 2 + [("nets learn", "contradicts", 1.0)] + [("part", "supports", 0.7)] * 3)
    assert concepts[0]["consensus_score"] == pytest.approx(5 / 6)
    open_ = engine.store.read("chunks").where("extraction_status is null").join(engine.store.read("documents").withColumnRenamed("id", "document_id"), "document_id")
    assert {r["filename"] for r in open_.collect()} == {"c.txt", "e.txt"}
    engine.extractor = RemoteExtractor((lambda known: lambda p: known(p.replace("BROKEN", "mended")))(model()))
    again = engine.extract(room)
    assert (again["documents"], again["documents_failed"], again["concepts"]) == (1, 0, 0)
    only = engine.store.read("documents").where("filename = 'e.txt'").first()["id"]
    assert engine.process_document(only)["documents_processed"] == 1 and engine.add_document_and_update(only)["documents_processed"] == 0
    with pytest.raises(NotFound):
        engine.process_document(12345)


def test_levels_become_generality(spark, tmp_path):
    engine = Engine(Store(spark, f"file://{tmp_path}/s"), extractor=RemoteExtractor(model()))
    room = engine.create_room("r", "u")
    engine.upload(files(spark, [("a.txt", b"yes " * 60), ("b.txt", b"yes " * 70)]), room)
    engine.extract(room)
    assert [r["generality_score"] for r in engine.store.read("concepts").collect()] == [0.8]
    assert engine.extract_merged(room) == 2 and engine.store.read("concepts").count() == 3  # Deep Nets and guess, merged among themselves alone


def test_runs_can_be_watched_cancelled_cleared_and_limited(spark, tmp_path):
    engine = Engine(Store(spark, f"file://{tmp_path}/s"), writer=RemoteWriter(lambda prompt: "written"))
    assert engine.health()["status"] == "healthy" and check_setup(spark)["spark"]
    engine.build = lambda project_id: {}  # the end-to-end test builds
    room = engine.create_room("r", "u")
    engine.upload(files(spark, [("a.txt", TEXT.encode()), ("b.txt", b"Trees have leaves. Leaves fall in autumn. " * 20)]), room)
    first = engine.documents(room).where("filename = 'a.txt'").select("id")
    assert engine.process_all(room, first)["documents_processed"] == 1
    assert engine.process_all(room, clear=True)["documents_processed"] == 2
    assert engine.store.read("documents").where("embedding is null").count() == 0
    engine.build_brain(room)
    assert engine.status(room).first()["summary_text"] == "written" and engine.chat(room, "what of leaves?")["answer"] == "written"
    asked = engine.chat(room, "leaves")
    assert asked["sources"] == sorted(asked["sources"], key=lambda f: f != "b.txt") and "[Full Doc 1] (b.txt)" in asked["prompt"] and "- [" in asked["prompt"]
    assert engine.start(room, clear=True)["phase"] in ("running", "completed") and engine.start(room)["phase"] in ("running", "completed")
    assert engine.cancel(room)["phase"] in ("cancelled", "completed")
    for _ in range(120):
        if not engine._runs[room]["thread"].is_alive():
            break
        time.sleep(0.5)
    assert engine.run_status(room)["phase"] in ("cancelled", "completed")


def test_remote_classes_and_topics(spark):
    from quillgraph.operators import gaps, relate

    concepts = spark.createDataFrame([(i, 1, n, "d", [1.0, 0.0], 0.5, 0.1) for i, n in ((1, "a"), (2, "b"), (3, "BROKEN"))], "id long, project_id long, name string, description string, embedding array<double>, generality_score double, coverage_score double")
    pairs = spark.createDataFrame([(1, 1, 2, 0.5, 1), (1, 1, 3, 0.5, 2)], "project_id long, a long, b long, sim double, rank int")

    def classes(prompt):
        if "BROKEN" in prompt:
            raise TimeoutError
        return 'Sure: {"relationship_type": "Extends", "direction": "b_to_a", "confidence": "0.8", "reasoning": "why"}'

    got = {(r["a"], r["b"]): (r["type"], r["direction"], r["confidence"]) for r in RemoteClassifier(classes).classify(pairs, concepts).collect()}
    assert got == {(1, 2): ("extends", "b_to_a", 0.8), (1, 3): ("none", "a_to_b", 0.7)}
    assert [(r["source_concept_id"], r["relationship_type"]) for r in relate.resolve_direction(RemoteClassifier(classes).classify(pairs, concepts)).collect()] == [(2, "builds_on")]
    topics = RemoteSuggester(lambda prompt: '[{"name": "New", "importance": "critical", "related_to": ["a"]}, 7, {"name": "b", "importance": "critical"}]').suggest(spark.createDataFrame([(1, ["a", "b"], "a")], "project_id long, concepts array<string>, domain string"))
    assert [r["name"] for r in gaps.expected_topics(topics, concepts).collect()] == ["New"]
    assert RemoteSuggester(lambda prompt: 1 / 0).suggest(spark.createDataFrame([(1, ["a"], "a")], "project_id long, concepts array<string>, domain string")).count() == 0


def test_embedding_is_tried_again(spark, tmp_path):
    count = f"{tmp_path}/calls"

    def call(texts):
        with open(count, "a") as f:
            f.write("x")
        if os.path.getsize(count) < 3:
            raise TimeoutError
        return [[1.0, 0.0]] * len(texts)

    rows = spark.createDataFrame([(1, "a")], "id long, content string")
    assert RemoteEmbedder(call, 2, wait=0.0).embed(rows).first()["embedding"] == [1.0, 0.0] and os.path.getsize(count) == 3


def test_file_heads(spark, tmp_path):
    rows = [("d/a.HTML", b"<html><title> A page </title>"), ("d/b.txt", b"First line\nsecond")]
    got = {r["filename"]: (r["file_type"], r["length"], r["title"]) for r in file_metadata(files(spark, rows)).collect()}
    assert got == {"a.HTML": (".html", 29, "A page"), "b.txt": (".txt", 17, "First line")}


def test_embedders(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None)], "id long, content string")
    got = {r["id"]: r["embedding"] for r in HashedWords(8).embed(rows).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1) and got[3] is None and got[4] is None
    remote = RemoteEmbedder(lambda texts: [[float(len(t)), 1.0] if t != "bad" else None for t in texts], 2, attempts=1)
    rows = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "abc "), (4, "")], "id long, content string")
    got = {r["id"]: r["embedding"] for r in remote.embed(rows).collect()}
    assert got[1] == got[3] == [3.0, 1.0] and got[2] is None and got[4] is None


def test_dimension_migration(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in migrate_dimension(rows, 2).collect()} == {1: [1.0, 2.0], 2: None}


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "id long, content_text string").withColumn("arrived", F.current_timestamp())
    docs.write.parquet(f"{tmp_path}/in")
    seen = []
    once = stream.distinct_texts(stream.read_documents(spark, f"{tmp_path}/in"))
    query = stream.start(stream.chunk_stream(once.drop("hash")), f"{tmp_path}/check", lambda df, _: seen.extend(r["content"] for r in df.collect()))
    query.awaitTermination(60)
    assert sorted(seen) == ["one two", "three"]
