"""Encoding, packing, token counts and token files against the tokenizer and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillgraph.llm import packing, token_counts, token_files
from quillgraph.llm.queries import op1_best_fit_packing, op3_token_counts, op7_token_files
from quillgraph.llm.tokens import Encoder, vocabulary_path

BYTE, WORD = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("word_bpe_49k.json")


def whole(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(rng):
    fixed = ["", " ", "  a  b ", "\n\n x", "a\n \nb", "end \n", "a\tb", "it's  we'll", "<|endoftext|> a<|endoftext|>", "x\x1cy\x00z \x1f", "é   　z", "İI Σας", "日本 語", "!!! a) b). c...", "1234 5 a1b2", "\r\n x\r\n"]
    return fixed + ["".join(rng.choice(" \n\tab'sé1.\r ,A 　\x1ć!") for _ in range(rng.randint(0, 16))) for _ in range(1500)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_tokenizer(path, rng, docs):
    texts = odd_texts(rng) + [r["text"] for r in docs.select("text").limit(60).collect()]
    encoder = Encoder(path)
    for _ in range(2):  # once to learn the parts, once from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == whole(encoder, texts)


def test_spans_cover_the_text(rng):
    encoder = Encoder(BYTE)
    for text in odd_texts(rng):
        e = encoder.tokenizer.encode(text, add_special_tokens=False)
        first, last = encoder.spans(text, np.array(e.ids, np.int64))
        for (a, b), x, y in zip(e.offsets, first, last):  # the tokenizer leaves out spaces before a word
            assert y == b and text[x:a].strip(" ") == "" and x <= a


@pytest.mark.parametrize("n, pieces", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)]), (2500, [(0, 452), (452, 1024), (1476, 1024)])])
def test_cut(n, pieces):
    assert packing.cut(n, 1024) == pieces


def test_best_fit_against_brute_force(rng):
    fit, open_bins, closed = packing.BestFit(50, 6), {}, 0
    for _ in range(2000):
        length = rng.randint(1, 50)
        found, offset = fit.place(length)
        fitting = [f for f in open_bins.values() if f >= length]
        if fitting:
            assert open_bins[found] == min(fitting) and offset == 50 - min(fitting)
        else:
            assert found not in open_bins and offset == 0
            if len(open_bins) >= 6 and length < 50:
                del open_bins[min((f, 0) for f in open_bins.values()) and next(k for k, f in open_bins.items() if f == min(open_bins.values()) and k not in [b for s in fit.stacks for b in s])]
                closed += 1
            open_bins[found] = 50
        open_bins[found] -= length
        if not open_bins[found]:
            del open_bins[found]
        assert sorted(open_bins) == sorted(b for s in fit.stacks for b in s) and len(open_bins) <= 6
    assert closed


def check_packing(rows, texts, capacity=1024):
    """Pieces rebuild the documents, and sequences hold them without gaps."""
    encoder = Encoder(BYTE)
    want = sorted((zlib.crc32(np.array(ids + [2], "<u4").tobytes()[4 * s : 4 * (s + n)]), k, s, n) for ids in whole(encoder, texts) for k, (s, n) in enumerate(packing.cut(len(ids) + 1, capacity)))
    assert sorted((r["ids_crc32"], r["piece"], r["start"], r["length"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_op1_on_the_small_table(spark, sf, docs):
    rows = op1_best_fit_packing(spark, sf).collect()
    n = check_packing(rows, [r["text"] for r in docs.collect()])
    least = -(-sum(r["length"] for r in rows) // 1024)
    assert n <= 1.08 * least
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd).collect()
    check_packing(rows, [r["text"] for r in odd.collect()])
    assert packing.pack_documents(none).count() == 0
    again = {(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in packing.pack_documents(odd).collect()}
    assert again == {(r["doc_id"], r["piece"], r["sequence_id"], r["offset"]) for r in rows}


def brute_counts(encoder, text, sections, rule):
    out, crossing, lost = [0] * len(sections), [0] * len(sections), 0
    e = encoder.tokenizer.encode(text, add_special_tokens=False)
    first, last = encoder.spans(text, np.array(e.ids, np.int64))
    for a, b in zip(first.tolist(), last.tolist()):
        shared = [max(0, min(b, y) - max(a, x)) if rule == "most" or x <= a else 0 for x, y in sections]
        k = max(range(len(sections)), key=lambda i: (shared[i], -i)) if sections else None
        if k is None or not shared[k]:
            lost += 1
        else:
            out[k] += 1
            crossing[k] += shared[k] < b - a
    return out, crossing, lost


@pytest.mark.parametrize("rule", ["most", "start"])
def test_counts_of_given_sections(spark, rng, rule):
    encoder, rows, want = Encoder(BYTE), [], {}
    for i in range(40):
        text = "".join(rng.choice(["alpha", "beta ", "日本", "\n", " x", "!!", "é"]) for _ in range(30))
        cuts = sorted(rng.sample(range(len(text)), 6))
        spans = [(cuts[0], cuts[1]), (cuts[1], cuts[2]), (cuts[3], cuts[5])]
        rows.append((i, text, [(k, a, b) for k, (a, b) in enumerate(spans)]))
        want[i] = brute_counts(encoder, text, spans, rule)
    df = spark.createDataFrame(rows, "doc_id long, text string, sections array<struct<id:int,first:int,last:int>>")
    got = {i: ([0] * 3, [0] * 3, [0]) for i in want}
    for r in token_counts.count_tokens(df, "sections", rule=rule).collect():
        if r["section"] is None:
            got[r["doc_id"]][2][0] = r["n_tokens"]
        else:
            got[r["doc_id"]][0][r["section"]], got[r["doc_id"]][1][r["section"]] = r["n_tokens"], r["n_crossing"]
    assert {i: (a, b, c[0]) for i, (a, b, c) in got.items()} == want


def test_op3_adds_up_to_the_documents(spark, sf, docs):
    encoder, total = Encoder(BYTE), defaultdict(int)
    for r in op3_token_counts(spark, sf).collect():
        total[r["doc_id"]] += r["n_tokens"]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert dict(total) == {i: len(x) for i, x in zip(texts, whole(encoder, texts.values())) if x}


def test_counts_of_odd_rows(spark, odd, none):
    got = token_counts.count_tokens(odd)
    assert {r["doc_id"] for r in got.collect()} == {1, None, 4, 5, 6, 7, 8, 9}
    assert token_counts.count_tokens(none).count() == 0
    blank = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, sections array<struct<id:int,first:int,last:int>>")
    assert [(r["section"], r["n_tokens"]) for r in token_counts.count_tokens(blank, "sections").collect()] == [(None, 2)]


def check_files(rows, table):
    encoder = Encoder(WORD)
    table = sorted(table, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at, want = 0, []
    for r, ids in zip(table, whole(encoder, [r["text"] for r in table])):
        raw = np.array(ids + [2], "<u4").tobytes()
        want.append((r["doc_id"], at, len(ids) + 1, zlib.crc32(raw)))
        at += len(ids) + 1
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want


def test_op7_round_trip(spark, sf, docs):
    check_files(op7_token_files(spark, sf).collect(), docs.collect())


def test_files_of_odd_rows(odd, none):
    rows = [r for r in odd.collect() if r["doc_id"] != 6]  # repeated rows are alike
    check_files(token_files.round_trip(odd.where("doc_id is null or doc_id <> 6")).collect(), rows)
    assert token_files.round_trip(odd).count() == odd.count()
    assert token_files.round_trip(none).count() == 0
