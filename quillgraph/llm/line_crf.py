"""Quality rules: lines labelled as content or boilerplate by a linear-chain CRF.

A line is described by the shares of its kinds of characters, its length, how its words
repeat and whether it equals an earlier line. Viterbi decoding labels the whole sequence
of a document's lines; the share of characters in lines of content decides whether the
document stays. The field is fitted by maximum likelihood (forward and backward sums) on
lines of at most ``max_labelled`` labelled documents and ``SAMPLE_BYTES`` of features, in windows of 48 lines, where a
document's label stands for its lines'. Executors compute the features of these.

Besides, plain rules count words and fail documents that are short or repeat themselves.

Null and empty texts have no word and fail. A document without labelled lines has content share 0.
Without labels of both kinds the field keeps its prior weights, by which lines with more signs, bars, capitals
or exclamations than letters are boilerplate. Repeated rows are decided alike. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.byte_classes import N_KINDS, kind_shares
from quillgraph.llm.common import PORTION_BYTES, portions
from quillgraph.llm.mil_quality import training_documents, training_sample

MAX_LABELLED = 1500
#: Bytes of lines' features that the driver takes; fitting holds some twenty times as much.
SAMPLE_BYTES = 8 << 20
CONTENT_SHARE = 0.5
WINDOW = 48
FEATURES = N_KINDS + 6
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def line_features(lines: list[bytes], counts: list[int]) -> np.ndarray:
    """Features of the lines of several documents, one after the other."""
    done, extra, at, begun, size = [], [], 0, 0, 0

    def described() -> np.ndarray:
        return np.concatenate([kind_shares(lines[begun : begun + len(extra)], pairs=False), np.array(extra, np.float32).reshape(-1, 6)], 1)

    for n in counts:
        seen: set[bytes] = set()
        for line in lines[at : at + n]:
            if size >= PORTION_BYTES:
                done.append(described())
                begun, extra, size = begun + len(extra), [], 0
            size += len(line) + 32  # some, for what a line without letters takes
            words = line.split()
            k = len(words)
            extra.append((1.0, min(len(line), 400) / 400, k / (len(line) + 1) * 4, len(set(words)) / k if k else 0, line in seen, sum(map(bytes.__eq__, words[1:], words)) / k if k else 0))
            seen.add(line)
        at += n
    return np.concatenate([*done, described()])


@dataclass
class Field:
    """State 0 is boilerplate, 1 content. ``emit`` scores content against boilerplate."""

    emit: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def viterbi(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best states of each sequence; sequences advance together, the longest first."""
        score = x @ self.emit
        first = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        longest, out = counts[order], np.zeros(len(x), bool)
        live = int((longest > 0).sum())
        if not live:
            return out
        rows = first[order]
        best = np.stack([np.full(live, self.start[0]), self.start[1] + score[rows[:live]]], 1)
        back: list[np.ndarray] = []
        final = np.zeros(live, np.int64)
        for t in range(1, int(longest[0])):
            n = int(np.searchsorted(-longest, -t, "left"))  # sequences with more than t lines
            final[n : len(best)] = best[n:].argmax(1)
            way = best[:n, :, None] + self.step
            back.append(way.argmax(1))
            best = way.max(1)
            best[:, 1] += score[rows[:n] + t]
        final[: len(best)] = best.argmax(1)
        state = final
        for t in range(int(longest[0]) - 1, 0, -1):
            n = int(np.searchsorted(-longest, -t, "left"))
            out[rows[:n] + t] = state[:n] == 1
            state[:n] = back[t - 1][np.arange(n), state[:n]]
        out[rows[:live]] = state == 1
        return out


def prior_field() -> Field:
    """Weights before any are learned."""
    emit = np.zeros(FEATURES)
    emit[[0, 11, 12]] = 4.0  # lower-case and accented letters
    emit[[1, 7, 8, 9]] = -8.0, -12.0, -16.0, -16.0  # capitals, exclamations, bars, signs
    emit[N_KINDS] = -1.0
    emit[N_KINDS + 4 :] = -1.0, -4.0  # repeated lines, repeated words
    return Field(emit, np.zeros(2), np.array([[0.7, 0.0], [0.0, 0.7]]))


def fit_field(x: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.1, decay: float = 1e-3) -> Field:
    """Maximum likelihood with Adam, from the prior weights; ``y`` has a state for each line."""
    field = prior_field()
    if len(np.unique(y)) < 2:
        return field
    n, longest = len(counts), int(counts.max())
    first = np.cumsum(counts) - counts
    inside = np.arange(longest) < counts[:, None]
    at = np.minimum(first[:, None] + np.arange(longest), len(x) - 1)
    states = y[at]
    theta = np.concatenate([field.emit, field.start, field.step.ravel()])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    pair = inside[:, 1:]
    true_step = np.stack([((states[:, :-1] == a) & (states[:, 1:] == b) & pair).sum() for a in (0, 1) for b in (0, 1)])
    true_start = np.array([(states[:, 0] == 0).sum(), (states[:, 0] == 1).sum()])
    for t in range(1, rounds + 1):
        emit, start, step = theta[:FEATURES], theta[FEATURES : FEATURES + 2], theta[FEATURES + 2 :].reshape(2, 2)
        e = np.where(inside, (x @ emit)[at], 0.0)
        up = np.empty((n, longest, 2))
        up[:, 0] = start + np.stack([np.zeros(n), e[:, 0]], 1)
        for k in range(1, longest):
            new = np.logaddexp.reduce(up[:, k - 1, :, None] + step, 1)
            new[:, 1] += e[:, k]
            up[:, k] = np.where(inside[:, k, None], new, up[:, k - 1])
        total = np.logaddexp.reduce(up[:, -1], 1)
        down = np.zeros((n, longest, 2))
        expected = np.zeros(4)
        for k in range(longest - 2, -1, -1):
            follow = down[:, k + 1] + np.stack([np.zeros(n), e[:, k + 1]], 1)
            joint = np.exp(up[:, k, :, None] + step + follow[:, None, :] - total[:, None, None]) * pair[:, k, None, None]
            expected += joint.sum(0).ravel()
            down[:, k] = np.where(pair[:, k, None], np.logaddexp.reduce(step + follow[:, None, :], 2), 0.0)
        content = np.where(inside, np.exp(up[:, :, 1] + down[:, :, 1] - total[:, None]), 0.0)
        error = np.zeros(len(x))
        np.add.at(error, at[inside], (states - content)[inside])
        p0 = np.exp(up[:, 0] + down[:, 0] - total[:, None]).sum(0)
        g = -np.concatenate([x.T @ error, true_start - p0, true_step - expected]) / len(x) + decay * theta
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Field(theta[:FEATURES], theta[FEATURES : FEATURES + 2], theta[FEATURES + 2 :].reshape(2, 2))


def content_lines(text: str | None) -> list[bytes]:
    """Lines with a word."""
    return [x for x in (text or "").encode("utf-8", "replace").split(b"\n") if x.split()]


def sequence_bytes(texts: list[str | None]) -> list[bytes]:
    """Features of each text's lines, as half floats."""
    return [line_features(own, [len(own)]).astype(np.float16).tobytes() for own in map(content_lines, texts)]


def sequence_size(text: str | None) -> int:
    """Bytes of these."""
    return 2 * FEATURES * len(content_lines(text))


def fit_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Field:
    """Fits the field on ``docs(doc_id, text)`` that ``labels(doc_id, <label>)`` marks 0 or 1."""
    found = training_sample(training_documents(docs, labels, label, max_labelled, False), sequence_bytes, sequence_size, max_labelled, SAMPLE_BYTES)
    if not found:
        return prior_field()
    x = [np.frombuffer(v, np.float16).reshape(-1, FEATURES) for _, _, v in found]
    counts = [min(WINDOW, len(v) - k) for v in x for k in range(0, len(v), WINDOW)]
    y = np.concatenate([np.full(len(v), int(k > 0)) for v, (_, k, _) in zip(x, found)])
    return fit_field(np.concatenate(x).astype(np.float64), np.array(counts), y)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    k = len(number)
    if k < 1 << 20:
        key = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # numbers of pairs first, so that keys stay within 64 bits
        key = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1][:-1] * k + ids[2:]
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    often = times[which] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : shift + n - 2] |= often
    return int(inside.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines and words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(SPACES))
        else:
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


def content_shares(texts: list[str | None], field: Field) -> np.ndarray:
    """Share of characters (bytes) in lines labelled content; 0 without lines."""
    lines, counts = [], []
    for text in texts:
        own = content_lines(text)
        lines += own
        counts.append(len(own))
    if not lines:
        return np.zeros(len(texts))
    number = np.array(counts, np.int64)
    content = field.viterbi(line_features(lines, counts).astype(np.float64), number)
    size = np.fromiter(map(len, lines), np.float64, len(lines))
    doc = np.repeat(np.arange(len(texts)), number)
    whole = np.bincount(doc, size, len(texts))
    return np.bincount(doc, size * content, len(texts)) / np.maximum(whole, 1)


def judge(texts: list[str | None], field: Field, least_words: int = 50, most_repeat: int = 50, least_content: float = CONTENT_SHARE) -> list[tuple]:
    """Per text the counts, whether the rules failed it, its content share and whether it stays."""
    out = []
    for text, share in zip(texts, content_shares(texts, field).tolist()):
        n, chars, symbols, dup, repeat = base_counts(text)
        failed = n < least_words or 100 * repeat > most_repeat * n
        out.append((n, chars, symbols, dup, repeat, failed, share, not failed and share >= least_content))
    return out


def apply_rules(docs: DataFrame, field: Field, **limits) -> DataFrame:
    """Counts and verdict of every document of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RULES.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches:
            for part in (batch.slice(*p) for p in portions(pc.binary_length(batch.column(1)).to_pylist())):
                rows = [(i, *r) for i, r in zip(part.column(0).to_pylist(), judge(part.column(1).to_pylist(), field, **limits))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RULES)


def keep_content(docs: DataFrame, field: Field, **limits) -> DataFrame:
    """The documents that stay, with their columns."""
    import pandas as pd

    @F.pandas_udf("boolean")
    def stays(texts):
        out, texts = [], [x if isinstance(x, str) else None for x in texts]
        for at, n in portions(len(x or "") for x in texts):
            out += [r[-1] for r in judge(texts[at : at + n], field, **limits)]
        return pd.Series(out, dtype=bool)

    return docs.where(stays(F.col("text").cast("string")))
