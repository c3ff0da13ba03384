"""The models of quality take long texts, and texts of many lines, without much memory."""

import tracemalloc

from quillgraph.llm import line_crf, mil_quality
from quillgraph.llm.common import PORTION_BYTES, portions


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_features_of_a_long_text_take_little_memory():
    assert peak_mb(lambda: mil_quality.passage_features([("a" * 60 + " ") * 130_000])) < 150


def test_features_of_many_lines_take_little_memory():
    assert peak_mb(lambda: line_crf.line_features([b"a"] * 200_000, [200_000])) < 60


def test_portions():
    assert list(portions([])) == [] and list(portions([1] * 300)) == [(0, 128), (128, 128), (256, 44)]
    assert list(portions([None, 5, PORTION_BYTES, 2 * PORTION_BYTES, 1, 2])) == [(0, 2), (2, 1), (3, 1), (4, 2)]


def test_a_sample_makes_no_other_features(spark):
    documents = spark.createDataFrame([(1, "ab", 1), (1, "ab", 1), (2, "a" * 50, 0), (3, None, 1), (4, "abc", 0)], "doc_id long, text string, y int")

    def describe(texts):
        assert max(map(len, texts)) < 50
        return [t.encode() for t in texts]

    assert mil_quality.training_sample(documents, describe, lambda t: len(t or ""), 10, 20) == [(1, 1, b"ab"), (4, 0, b"abc")]
    assert len(mil_quality.training_sample(documents, describe, lambda t: len(t or ""), 10, 4)) == 1
    for text in (None, "", "a b\n\nc\n \n", "é " * 100):
        assert [len(x) for x in mil_quality.bag_bytes([text])] == [mil_quality.bag_size(text)]
        if line_crf.sequence_size(text):
            assert [len(x) for x in line_crf.sequence_bytes([text])] == [line_crf.sequence_size(text)]
