"""The classifier, the rules and the language model: gradients, brute force, held-out accuracy."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import gru, line_crf, mil_quality, recurrent_lm
from quillgraph.llm.queries import op4_recurrent_lm, op6_mil_quality, op10_line_crf

LABELS = "doc_id long, quality int, toxic int"


def test_mil_gradients():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(9, mil_quality.FEATURES)), np.array([2, 4, 3]), np.array([1.0, 0, 1])
    w = {"encode": (mil_quality.FEATURES, 24), "encode_bias": (24,), "v": (24, 12), "u": (24, 12), "attend": (12,), "out": (24,), "out_bias": (1,)}
    w = {k: rng.normal(size=s) * 0.2 for k, s in w.items()}

    def loss():
        z = mil_quality.forward(x, counts, w)["logit"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    for k, g in mil_quality.gradients(x, counts, y, w).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        down = loss()
        w[k][at] += 1e-5
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_op6_on_held_out_documents(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in op6_mil_quality(spark, sf).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    hold = [(rows[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert len(hold) > 5 and np.mean([a == b for a, b in hold]) >= 0.9


def plain_quality(model, text):
    """The classifier's score, passage by passage."""
    words = text.split()
    x, _ = mil_quality.passage_features([text])
    assert len(x) == max(1, -(-len(words) // mil_quality.PASSAGE_WORDS))
    w, encoded, raw = model.weights, [], []
    for row in (x - model.mean) / model.scale:
        h = np.tanh(row @ w["encode"] + w["encode_bias"])
        encoded.append(h)
        raw.append(sum(np.tanh(h @ w["v"][:, k]) / (1 + np.exp(-(h @ w["u"][:, k]))) * w["attend"][k] for k in range(mil_quality.GATE)))
    share = np.exp(raw) / np.exp(raw).sum()
    z = sum(a * h for a, h in zip(share, encoded))
    return 1 / (1 + np.exp(-(z @ w["out"] + w["out_bias"][0])))


def test_op6_scores_are_those_of_a_plain_loop(spark, docs, sf):
    model = mil_quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in mil_quality.score_quality(docs, model).collect()}
    for r in docs.collect():
        assert scores[r["doc_id"]] == pytest.approx(plain_quality(model, r["text"]), abs=1e-4)


def plain_verdict(field, text):
    """Share of bytes in lines that the best labelling calls content, by a table of best ways."""
    lines = [x for x in text.encode().split(b"\n") if x.split()]
    x = line_crf.line_features(lines, [len(lines)]).astype(float)
    best = [[(field.start[0], []), (field.start[1] + x[0] @ field.emit, [])]]
    for row in x[1:]:
        gain = (0.0, row @ field.emit)
        best.append([max(((best[-1][a][0] + field.step[a][b] + gain[b], [*best[-1][a][1], a]) for a in (0, 1)), key=lambda t: t[0]) for b in (0, 1)])
    last = max((0, 1), key=lambda b: best[-1][b][0])
    labels = [*best[-1][last][1], last]
    return sum(len(s) for s, k in zip(lines, labels) if k) / sum(map(len, lines))


def test_op10_verdicts_are_those_of_a_plain_loop(spark, docs, sf):
    field = line_crf.fit_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r for r in line_crf.apply_rules(docs, field).collect()}
    for r in docs.collect():
        got, share = rows[r["doc_id"]], plain_verdict(field, r["text"])
        assert got["content_share"] == pytest.approx(share, abs=1e-9)
        assert got["kept"] == (not got["base_failed"] and share >= line_crf.CONTENT_SHARE)


def test_quality_of_odd_rows(spark, odd, none, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (5, None, None), (8, 1, 1)], LABELS)
    model = mil_quality.fit_quality(odd, labels)
    rows = mil_quality.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 7)}) == 1  # texts without words
    assert mil_quality.score_quality(none, model).count() == 0
    assert mil_quality.keep_good(odd, model).columns == odd.columns
    unlabelled = mil_quality.fit_quality(odd, labels.limit(0))
    assert {r["score"] for r in mil_quality.score_quality(odd, unlabelled).collect()} == {0.5}
    ones = mil_quality.fit_quality(odd, labels.where("quality = 1"))
    assert {r["predicted"] for r in mil_quality.score_quality(odd, ones).collect()} == {1}


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    field = line_crf.Field(rng.normal(size=3), rng.normal(size=2), rng.normal(size=(2, 2)))
    counts = np.array([0, 5, 1, 7, 0, 3])
    x = rng.normal(size=(counts.sum(), 3))
    got, at = field.viterbi(x, counts), 0
    for n in counts:
        if n:
            score = x[at : at + n] @ field.emit
            value = lambda p: field.start[p[0]] + sum(field.step[a, b] for a, b in zip(p, p[1:])) + sum(s for s, k in zip(score, p) if k)  # noqa: E731, B023
            best = max(itertools.product((0, 1), repeat=int(n)), key=value)
            assert got[at : at + n].astype(int).tolist() == list(best)
        at += n
    assert not len(field.viterbi(np.zeros((0, 3)), np.zeros(0, int)))


def brute_counts(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        dup += line in seen and bool(line.strip(" \t\n\v\f\r"))
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_counts(rng, docs):
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "#", "\t", "é ", "　", "\x1c"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [r["text"] for r in docs.limit(50).collect()] + [None, "", "a b c a b c", "a a a a", "a b c"]
    for t in texts:
        assert line_crf.base_counts(t) == brute_counts(t), t


def test_op10_on_the_small_table(spark, sf, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = op10_line_crf(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = brute_counts(texts[r["doc_id"]])
        failed = n < 50 or 100 * repeat > 50 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (n, chars, symbols, dup, repeat, failed)
        assert not (r["kept"] and failed)
        if labels.get(r["doc_id"]) == 1:
            assert r["kept"] or failed
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert np.mean(junk) < 0.3


def test_rules_on_odd_rows(spark, odd, none):
    field = line_crf.fit_rules(odd, spark.createDataFrame([(1, 1, 0)], LABELS))
    assert np.array_equal(field.emit, line_crf.prior_field().emit)
    rows = {(r["doc_id"], r["n_words"]): r for r in line_crf.apply_rules(odd, field).collect()}
    assert rows[2, 0]["base_failed"] and rows[2, 0]["content_share"] == 0 and rows[4, 60_000]["n_repeat_words"] == 60_000
    assert line_crf.apply_rules(none, field).count() == 0 and line_crf.keep_content(odd, field).columns == odd.columns
    clean = "The quick brown fox jumps over the lazy dog near the old river bank while many small birds sing. "
    text = "\n".join(clean.replace("fox", f"fox{i}").replace("dog", f"dog{i}").replace("old", f"old{i}").replace("small", f"s{i}") for i in range(8))
    assert line_crf.judge([text], line_crf.prior_field())[0][6] == 1.0
    assert line_crf.judge([text.upper().replace(" ", "!! ")], line_crf.prior_field())[0][6] == 0.0


def test_field_learns():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, line_crf.FEATURES))
    y = np.repeat((rng.random(40) < 0.5).astype(int), 10)
    x[:, 2] += 3 * (2 * y - 1)
    field = line_crf.fit_field(x, np.full(40, 10), y)
    assert (field.viterbi(x, np.full(40, 10)) == (y == 1)).mean() > 0.98


def test_gru_gradients():
    rng = np.random.default_rng(3)
    w = {k: (v + rng.normal(size=v.shape) * 0.1).astype(np.float32) for k, v in gru.initial(rng.random(gru.IDS) * 50, 1).items()}
    before, ids, live = rng.integers(0, gru.IDS, (5, 4)), rng.integers(0, 150, (5, 4)), np.ones((5, 4), bool)
    before[0], before[3, 1], live[4, 0] = -1, -1, False
    h = np.zeros((gru.HIDDEN, 4), np.float32)
    got, _, _ = gru.gradients(w, before, ids, live, h)

    def loss():
        p = gru.log_probability(w, gru.advance(w, before, h).reshape(gru.HIDDEN, -1), ids.ravel())
        return float(-(p * live.ravel()).sum() / live.sum())

    for k, g in got.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[k][at] += 1e-2
        up = loss()
        w[k][at] -= 2e-2
        down = loss()
        w[k][at] += 1e-2
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=0.03, abs=1e-4)


def test_gru_is_a_distribution_and_starts_as_unigrams():
    counts = np.random.default_rng(1).random(gru.IDS) * 100
    w = gru.initial(counts, 2)
    states = np.random.default_rng(5).normal(size=(gru.HIDDEN, 1)).astype(np.float32)
    p = np.exp(gru.log_probability(w, np.repeat(states, gru.IDS, 1), np.arange(gru.IDS)).astype(float))
    assert p.sum() == pytest.approx(1, abs=1e-4)
    assert np.allclose(p, (counts + 0.5) / (counts + 0.5).sum(), rtol=1e-3)


def test_streams_hold_every_token_once():
    rng = np.random.default_rng(9)
    texts = [np.append(rng.integers(1, gru.IDS, n), 0) for n in (0, 300, 3, 1, 77)]
    before, target, live, leads = gru.streams(texts, 4)
    assert target.T[live.T].tolist() == np.concatenate(texts).tolist()
    assert before.T[live.T].tolist() == [x for t in texts for x in [-1, *t[:-1].tolist()]]
    assert leads[-1, 1] == before[-1, 0] and (leads[:, 0] == -1).all()


def test_training_sees_whole_texts(spark, odd):
    frame = recurrent_lm._frame(odd)
    lex = recurrent_lm.build_lexicon(recurrent_lm.word_counts(frame))
    encoded = recurrent_lm.encode_documents(frame, "whole", spark.sparkContext.broadcast(lex)).collect()
    assert sum(len(r["ids"]) // 2 for r in encoded if not r["held_out"]) == lex.tokens
    assert all(len(r["ids"]) == 2 * r["n_tokens"] for r in encoded)
    sample = spark.range(1000).selectExpr("id / 1000.0D as place")
    for often in (1.0, 1.4, 2.0, 3.0, 7.7, 30.0):
        each = [sum(x) for x in sample.select(*[recurrent_lm.times(sample.place, t, often / recurrent_lm.ROUNDS) for t in range(recurrent_lm.ROUNDS)]).collect()]
        assert min(each) >= math.floor(often + 1e-9) and max(each) <= math.ceil(often - 1e-9) and abs(sum(each) / 1000 - often) < 0.01


def test_training_never_falls_as_the_corpus_grows():
    total = [n * recurrent_lm.visits(n) for n in sorted({*range(1, 40_000_000, 9_973), 13_823_999, 13_824_000, 13_824_001})]
    assert all(b >= a * (1 - 1e-12) for a, b in zip(total, total[1:]))


def test_lanes_score_as_single_texts():
    rng = np.random.default_rng(6)
    w = gru.initial(rng.random(gru.IDS) * 10, 3)
    texts = [np.append(rng.integers(1, gru.IDS, n), 0).astype(np.int32) for n in (0, 1, 40, 7, 130, 64, 3)]
    alone = [recurrent_lm.score_texts(w, [t])[0] for t in texts]
    assert np.allclose(recurrent_lm.score_texts(w, texts), alone, rtol=1e-4)
    recurrent_lm.LANES, lanes = 2, recurrent_lm.LANES
    assert np.allclose(recurrent_lm.score_texts(w, texts), alone, rtol=1e-4)
    recurrent_lm.LANES = lanes


def brute_base(rows):
    counts, train = Counter(), 0
    tokens = [(i, [("w", w) for w in (t or "").encode().lower().split()] + ["end"]) for i, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in tokens]
    for (_, t), h in zip(tokens, held):
        if not h:
            counts.update(t)
            train += len(t)
    size = train + len(counts) + 1 if counts else 1
    return [(i, h, len(t), sum(counts[w] > 0 for w in t), train, sum(math.log10((counts[w] + 1) / size) for w in t)) for (i, t), h in zip(tokens, held)]


def key(r):
    return (r[0] is not None, r[0] or 0, r[2])


@pytest.mark.parametrize("known", [None, 300])
def test_op4_base_and_score(spark, sf, docs, monkeypatch, known):
    if known:  # most counts come by the join
        monkeypatch.setattr(recurrent_lm, "KNOWN", known)
    rows = sorted(map(tuple, op4_recurrent_lm(spark, sf).collect()), key=key)
    want = sorted(brute_base([(r["doc_id"], r["text"]) for r in docs.collect()]), key=key)
    for got, b in zip(rows, want, strict=True):
        assert got[:5] == b[:5] and got[5] == pytest.approx(b[5], rel=1e-9)
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # the network beats counts on unseen documents


def plain_score(w, lex, counts, text):
    """The network and the shares of classes, word by word and unit by unit."""
    n, words = gru.HIDDEN, [x.encode() for x in counts]
    own = {word: k + 1 for k, word in enumerate(lex.words.split(b"\n")[: gru.HEAD - 1])} if words else {}
    numbers = {s: k for k, s in enumerate(lex.suffixes)}
    sums, kinds = np.zeros(gru.TAIL), np.zeros(gru.TAIL)
    of = lambda word: numbers.get(word.decode()[-2:], gru.TAIL - 1)
    for word in words:
        if word not in own:
            sums[of(word)] += counts[word.decode()]
            kinds[of(word)] += 1
    h, before, total = np.zeros(n), 0, 0.0  # before a text is the end of another
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for word in [*(text or "").encode().lower().split(), None]:
        x = w["bias"].astype(float) + w["input"][:, before]
        u = w["hidden"].astype(float) @ h
        update, reset = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
        h = h + update * (np.tanh(x[2 * n :] + reset * u[2 * n :]) - h)
        before = 0 if word is None else own.get(word, gru.HEAD + of(word))
        scores = w["to_class"].astype(float) @ h + w["class_bias"]
        k = before // gru.PER_CLASS if before < gru.HEAD else before - gru.HEAD + gru.HEAD_CLASSES
        total += scores[k] - np.log(np.exp(scores).sum())
        if before < gru.HEAD:
            inner = w["to_word"][k].astype(float) @ h + w["word_bias"][k]
            total += inner[before % gru.PER_CLASS] - np.log(np.exp(inner).sum())
        else:
            total += np.log((counts.get(word.decode(), 0) + 1) / (sums[of(word)] + kinds[of(word)] + 1))
    return total / np.log(10)


@pytest.mark.parametrize("known", [300_000, 1500])
def test_scores_are_those_of_a_plain_loop(spark, docs, monkeypatch, known):
    monkeypatch.setattr(recurrent_lm, "KNOWN", known)
    some, trained, lexicons = docs.orderBy("doc_id").limit(40), [], []
    for name, found in (("train", trained), ("build_lexicon", lexicons)):
        monkeypatch.setattr(recurrent_lm, name, lambda *a, f=getattr(recurrent_lm, name), found=found: (found.append(f(*a)), found[-1])[1])
    rows = {r["doc_id"]: r for r in recurrent_lm.score_documents(some).collect()}
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    counts = Counter(x.decode() for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in t.encode().lower().split())
    for i, text in texts.items():
        assert rows[i]["score"] == pytest.approx(plain_score(trained[0], lexicons[0], counts, text), rel=1e-4)


def test_language_model_on_odd_rows(spark, odd, none):
    rows = sorted(map(tuple, recurrent_lm.score_documents(odd).collect()), key=key)
    want = sorted(brute_base([(r["doc_id"], r["text"]) for r in odd.collect()]), key=key)
    for got, b in zip(rows, want, strict=True):
        assert got[:5] == b[:5] and got[5] == pytest.approx(b[5], rel=1e-9, abs=1e-12) and math.isfinite(got[6])
    assert recurrent_lm.score_documents(none).count() == 0


