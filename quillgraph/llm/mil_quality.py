"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded; gated attention
weights, learned from the documents' labels alone, say how much each counts; a logistic
unit scores the weighted sum of the encodings. The whole text is scored.

The model is fitted on the driver on at most ``max_labelled`` labelled documents, taken in
order of a hash of the id while their features come to no more than ``SAMPLE_BYTES``; executors compute these, so that no text
comes to the driver. Labels are looked up by ``doc_id``; documents held out
(crc32 of the id as text, modulo 5, is 0) are never learned from. Of repeated labels the
smallest counts; null labels count as none. With labels of one kind only, or none, every
document scores the share of ones (0.5 if there are none).

Null and empty texts are a passage without words, and get its score. Repeated rows score
the same. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.byte_classes import N_KINDS, kind_shares
from quillgraph.llm.common import PORTION_BYTES, id_crc, portions

PASSAGE_WORDS = 64
#: Documents at most that the model is fitted on.
MAX_LABELLED = 6000
#: Bytes of features that the driver takes; a document with more by itself isn't learned from.
SAMPLE_BYTES = 96 << 20
THRESHOLD = 0.3
FEATURES = N_KINDS + N_KINDS * N_KINDS + 4
HIDDEN, GATE = 24, 12


def passage_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the number of passages of each text (1 at least)."""
    done, pieces, extra, counts, size = [], [], [], [], 0

    def described() -> np.ndarray:
        return np.concatenate([kind_shares(pieces), np.array(extra, np.float32).reshape(-1, 4)], 1)

    for text in texts:
        words = text.encode("utf-8", "replace").split() if text else []
        bags = [words[i : i + PASSAGE_WORDS] for i in range(0, len(words), PASSAGE_WORDS)] or [[]]
        counts.append(len(bags))
        for bag in bags:
            piece = b" ".join(bag)
            n = len(bag)
            pieces.append(piece)
            extra.append((len(set(bag)) / n if n else 0, len(piece) / (10 * n) if n else 0, sum(map(bytes.__eq__, bag[1:], bag)) / n if n else 0, n / PASSAGE_WORDS))
            size += len(piece)
            if size >= PORTION_BYTES:
                done.append(described())
                pieces, extra, size = [], [], 0
    if pieces or not done:
        done.append(described())
    return np.concatenate(done), np.array(counts, np.int64)


@dataclass
class Model:
    """Weights; ``base`` is the score where nothing could be learned."""

    base: float
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(counts), self.base)
        return 1 / (1 + np.exp(-forward((x - self.mean) / self.scale, counts, self.weights)["logit"].astype(np.float64)))


def forward(x: np.ndarray, counts: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    first = np.cumsum(counts) - counts
    h = np.tanh(x @ w["encode"] + w["encode_bias"])
    v, u = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    e = (v * u) @ w["attend"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), counts))
    a = e / np.repeat(np.add.reduceat(e, first), counts)
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ w["out"] + w["out_bias"][0], "first": first}


def gradients(x: np.ndarray, counts: np.ndarray, y: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the mean log loss."""
    f = forward(x, counts, w)
    d = (1 / (1 + np.exp(-f["logit"])) - y) / len(y)
    dz = np.repeat(d[:, None] * w["out"], counts, 0)
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), counts))
    dgate = de[:, None] * w["attend"]
    dv, du = dgate * f["u"] * (1 - f["v"] ** 2), dgate * f["v"] * f["u"] * (1 - f["u"])
    dh = (f["a"][:, None] * dz + dv @ w["v"].T + du @ w["u"].T) * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ dh, "encode_bias": dh.sum(0), "v": f["h"].T @ dv, "u": f["h"].T @ du,
        "attend": (f["v"] * f["u"]).T @ de, "out": f["z"].T @ d, "out_bias": np.array([d.sum()]),
    }


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4) -> Model:
    """Adam on documents' log loss. ``x`` is overwritten, as a copy would be most of the driver's memory."""
    mean, scale = x.mean(0), np.concatenate([x[:, k : k + 16].std(0) for k in range(0, FEATURES, 16)]) + 0.02
    if len(np.unique(y)) < 2:
        return Model(float(y.mean()) if len(y) else 0.5, mean, scale, None)
    rng = np.random.default_rng(seed)
    x -= mean
    x /= scale
    shape = {"encode": (FEATURES, HIDDEN), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "attend": (GATE,), "out": (HIDDEN,)}
    w = {k: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32) for k, s in shape.items()}
    w |= {"encode_bias": np.zeros(HIDDEN, np.float32), "out_bias": np.array([np.log(y.mean() / (1 - y.mean()))], np.float32)}
    m, s, t, first = {k: 0 * v for k, v in w.items()}, {k: 0 * v for k, v in w.items()}, 0, np.cumsum(counts) - counts
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            docs = order[i : i + batch]
            rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
            t += 1
            for k, g in gradients(x[rows], counts[docs], y[docs], w).items():
                g = g + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return Model(float(y.mean()), mean, scale, w)


def training_documents(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int, hold_out: bool) -> DataFrame:
    """``doc_id, text, y`` of the first labelled documents by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.where(id_crc() % 5 != 0) if hold_out else known
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    known = known.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(max_labelled)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")


def training_sample(
    documents: DataFrame, describe: Callable[[list[str | None]], list[bytes]], size: Callable[[str | None], int], max_labelled: int, most_bytes: int = SAMPLE_BYTES
) -> list[tuple[int, int, bytes]]:
    """``doc_id, y, x`` of the ``documents(doc_id, text, y)`` that are learned from, on the driver: the first by the hash, within both bounds. Equal rows are learned from once.

    ``describe`` makes the features of texts, ``size`` says how many bytes a text's take (0: it has none). Only sizes are collected to choose; no other document's features are made.
    """
    rows = documents.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.drop_columns(["text"]).append_column("n", pa.array([size(x.as_py()) for x in batch.column("text")], pa.int64()))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(*p) for p in portions(pc.binary_length(batch.column("text")).to_pylist(), 64)):
                yield part.drop_columns(["text"]).append_column("x", pa.array(describe(part.column("text").to_pylist()), pa.binary()))

    sizes = rows.mapInArrow(measured, "doc_id long, y int, h long, n long").where("n > 0").dropDuplicates(["doc_id", "y", "h"])
    total, chosen = 0, []
    for r in sizes.orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id", "h").limit(max_labelled).collect():
        if total + r["n"] <= most_bytes:
            total += r["n"]
            chosen.append((r["doc_id"], r["y"], r["h"]))
    if not chosen:
        return []
    keys = documents.sparkSession.createDataFrame(chosen, "doc_id long, y int, h long")
    features = rows.join(F.broadcast(keys), ["doc_id", "y", "h"], "left_semi").select("doc_id", "text", "y", "h").mapInArrow(described, "doc_id long, y int, h long, x binary")
    found = features.dropDuplicates(["doc_id", "y", "h"]).select("doc_id", "y", "x").toArrow()
    return sorted(zip(*(c.to_pylist() for c in found.columns)))


def bag_bytes(texts: list[str | None]) -> list[bytes]:
    """Features of each text's passages, as half floats."""
    x, counts = passage_features(texts)
    return [r.tobytes() for r in np.split(x.astype(np.float16), np.cumsum(counts)[:-1])]


def bag_size(text: str | None) -> int:
    """Bytes of these."""
    return 2 * FEATURES * max(1, -(-len(text.encode("utf-8", "replace").split()) // PASSAGE_WORDS) if text else 1)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fits the model on ``docs(doc_id, text)`` that ``labels(doc_id, <label>)`` marks 0 or 1."""
    sample = training_sample(training_documents(docs, labels, label, max_labelled, True), bag_bytes, bag_size, max_labelled)
    if not sample:
        return Model(0.5, np.zeros(FEATURES), np.ones(FEATURES), None)
    y = np.array([k for _, k, _ in sample], np.float32).clip(0, 1)
    counts = np.array([len(v) // (2 * FEATURES) for _, _, v in sample])
    x, end = np.empty((counts.sum(), FEATURES), np.float32), len(counts)
    for at in np.cumsum(counts)[::-1].tolist():  # what is copied is let go
        end -= 1
        x[at - counts[end] : at] = np.frombuffer(sample.pop()[2], np.float16).reshape(-1, FEATURES)
    return fit(x, counts, y)


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(*p) for p in portions(pc.binary_length(batch.column(2)).to_pylist())):
                score = model.score(*passage_features(part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_crc() % 5 == 0).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model doesn't reject, with their columns."""

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        out, texts = [np.zeros(0, bool)], [x if isinstance(x, str) else None for x in texts]
        for at, n in portions(len(x or "") for x in texts):
            out.append(model.score(*passage_features(texts[at : at + n])) >= threshold)
        return pd.Series(np.concatenate(out))

    return docs.where(good(F.col("text").cast("string")))
