"""Language-model scoring of whole documents by a gated recurrent network.

1. Words of all training documents are counted (in executors, then added up by word).
2. Words that occur often, at most ``KNOWN``, go to all workers with their counts; the most
   frequent of them are the network's words. The others fall into classes by their last two
   characters, and have their add-one share of their class's count.
3. Texts are read once into ids, which are stored; learning and scoring read those.
4. All training texts are learned from, whole. Trainers take shares of them and learn by truncated
   backpropagation, the state carried through each text, from common weights, and their weights are
   averaged; so for some rounds. Trainers grow with the tokens, each with a bounded share; many
   weights are added up in executors first. Every text is visited once at least; small corpora are
   visited more often, so that the tokens visited in all never fall as the corpus grows.
5. Every text is scored as a whole, its state carried from window to window. Counts of
   words that workers don't know are joined from the table of all counts.

Documents with crc32(id as text) mod 7 = 2 are held out. A null text is empty: one end. A
null id counts as the empty text and its row is scored. Repeated rows are counted and scored
each. An empty table gives an empty result; without training documents the network keeps
its initial weights. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import gru
from quillgraph.llm.common import id_crc, materialize, words_lower

#: Words whose counts all workers hold, none longer than ``KNOWN_BYTES``.
KNOWN, KNOWN_BYTES = 300_000, 48
#: Rounds, and visits of a token, of all rounds, at most; they are fewer where ``VISITED`` tokens are visited in all.
ROUNDS, VISITS, VISITED = 3, 30, 13_824_000
#: Trainers of small corpora, tokens that one has at least and at most, about, and sums of weights that come to the driver at once.
TRAINERS, LEAST_TOKENS, MOST_TOKENS, SUMS = 6, 200_000, 4_000_000, 24
#: Texts that advance together.
LANES, BATCH_WORDS = 256, 600_000
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _frame(docs: DataFrame) -> DataFrame:
    crc = id_crc()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc % 7 == 2).alias("held_out"), crc.alias("crc"), F.col("text").cast("string").alias("text"))


def word_counts(frame: DataFrame) -> DataFrame:
    """``word, c`` over training documents; the null word counts the ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        ends = 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(found)
            for at in range(0, len(words), 1 << 16):
                some = words[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), pa.array([found[w] for w in some], pa.int64())], ["word", "c"])
            found.clear()

        for batch in batches:
            for text in batch.column(0):
                found.update(words_lower(text.as_py()))
                ends += 1
                if len(found) > 400_000:
                    yield from flush()
        yield from flush()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([ends], pa.int64())], ["word", "c"])

    return frame.where(~F.col("held_out")).select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What all workers know. ``words`` are joined by line feeds, the most frequent first; ids of the network follow from places."""

    words: bytes
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    suffixes: list[str]
    tail_tokens: np.ndarray
    tail_distinct: np.ndarray

    def tail(self, word: bytes, numbers: dict[str, int]) -> int:
        return numbers.get(word.decode("utf-8", "replace")[-2:], gru.TAIL - 1)


def _last_two(word: str = "word"):
    return F.substring(word, -2, 2)


def build_lexicon(counts: DataFrame) -> Lexicon:
    """From the table of counts; what comes to the driver is bounded."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.where("word is null").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words = counts.where("word is not null")
    short = words.where(F.octet_length("word") <= KNOWN_BYTES)
    # The least count that at most KNOWN words reach, to 3 %.
    step = F.floor(F.log(F.col("c").cast("double")) * 32)
    at_least, total = None, 0
    for row in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        total += row["count"]
        if total > KNOWN:
            break
        at_least = row["step"]
    known = short.where(step >= at_least).toPandas() if at_least is not None else short.limit(0).toPandas()
    known = known.sort_values(["c", "word"], ascending=[False, True])
    tails = words.groupBy(_last_two().alias("suffix")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).orderBy(F.desc("c"), "suffix").limit(gru.TAIL - 1).toPandas()
    numbers = {s: k for k, s in enumerate(tails["suffix"])}
    tail_c, tail_v = np.zeros(gru.TAIL, np.int64), np.zeros(gru.TAIL, np.int64)
    tail_c[: len(tails)], tail_v[: len(tails)] = tails["c"], tails["v"]
    tail_c[-1], tail_v[-1] = n - ends - tail_c[:-1].sum(), v - (ends > 0) - tail_v[:-1].sum()
    for word, c in zip(known["word"][: gru.HEAD - 1], known["c"][: gru.HEAD - 1]):  # the network's own words leave their classes
        k = numbers.get(word[-2:], gru.TAIL - 1)
        tail_c[k] -= c
        tail_v[k] -= 1
    return Lexicon("\n".join(known["word"]).encode(), known["c"].to_numpy(np.int64), int(ends), int(n), int(v), list(numbers), tail_c, tail_v)


class Reader:
    """The lexicon as a worker uses it: each known word's id, and logarithms of its shares."""

    def __init__(self, lex: Lexicon):
        self.lex = lex
        words = lex.words.split(b"\n") if len(lex.counts) else []
        self.place = dict(zip(words, range(len(words))))
        self.numbers = {s: k for k, s in enumerate(lex.suffixes)}
        own = gru.HEAD - 1
        self.unseen_base = -math.log10((lex.tokens + 1.0) if not lex.distinct else lex.tokens + lex.distinct + 1.0)
        self.unseen_tail = -np.log10(lex.tail_tokens + lex.tail_distinct + 1.0)
        self.ids = np.array([k + 1 if k < own else gru.HEAD + lex.tail(w, self.numbers) for k, w in enumerate(words)], np.int32)
        c = np.log10(lex.counts + 1.0)
        self.base = self.unseen_base + c
        self.inner = np.where(np.arange(len(words)) < own, 0.0, c + self.unseen_tail[np.maximum(self.ids - gru.HEAD, 0)]) if len(words) else c
        self.end_base = self.unseen_base + math.log10(lex.ends + 1.0)

    def id_counts(self) -> np.ndarray:
        out = np.zeros(gru.IDS)
        out[0] = self.lex.ends
        own = min(gru.HEAD - 1, len(self.lex.counts))
        out[1 : own + 1] = self.lex.counts[:own]
        out[gru.HEAD :] = self.lex.tail_tokens
        return out

    def read(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of the words (-1: not known), their ids, and the words not known."""
        place = np.fromiter(map(self.place.get, words, [-1] * len(words)), np.int64, len(words))
        if not len(self.ids):
            ids = np.zeros(len(words), np.int32)
        else:
            ids = self.ids[place]
        missing = np.flatnonzero(place < 0)
        rest = [words[k] for k in missing.tolist()]
        ids[missing] = [gru.HEAD + self.lex.tail(w, self.numbers) for w in rest]
        return place, ids, rest


_READERS: dict[str, Reader] = {}


def _reader(key: str, shared: Broadcast) -> Reader:
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(shared.value)
    return _READERS[key]


ENCODED = "uid binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, ids binary, rest array<string>"


def encode_documents(frame: DataFrame, key: str, shared: Broadcast) -> DataFrame:
    """Each text as ``ids``, 2-byte integers that end with 0, and what doesn't depend on the network: ``n_tokens``, ``n_known`` and ``base``
    from the words that workers know, ``inner``, the logarithm of words' shares of their classes, and ``rest``, the other words. ``uid`` names the row."""
    kinds = [pa.binary(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.string())]
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(key, shared)
        ends_known = reader.lex.ends > 0
        for batch in batches:
            rows = []
            for doc_id, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = words_lower(text.as_py())
                place, ids, rest = reader.read(words)
                known, lost = place[place >= 0], ids[place < 0] - gru.HEAD
                base = float(reader.base[known].sum()) + reader.end_base + len(rest) * reader.unseen_base
                inner = float(reader.inner[known].sum()) + float(reader.unseen_tail[lost].sum())
                rows.append((uuid.uuid4().bytes, doc_id, held_out, len(words) + 1, len(known) + ends_known, base, inner, np.append(ids, 0).astype("<i2").tobytes(), [x.decode() for x in rest]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    return frame.select("doc_id", "held_out", "text").mapInArrow(read, ENCODED)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of a task's weights, by the tokens that each was learned from."""
    n, total = 0, None
    for batch in batches:
        for k, w in zip(batch.column(0).to_pylist(), batch.column(1)):
            w = np.frombuffer(w.as_py(), "<f4").astype(np.float64) * k
            n, total = n + k, w if total is None else total + w
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype("<f4").tobytes()], pa.binary())], ["n", "w"])


def visits(tokens: int) -> float:
    """How often each token is visited; visits of all tokens never fall as these grow."""
    return max(1.0, min(VISITS, VISITED / max(1, tokens)))


def times(place, turn: int, part: float):
    """Visits in a round of a text at a place from 0 to 1: rounds take ``part`` of the circle of all texts, one after the other."""
    return F.ceil(F.lit((turn + 1) * part) - place) - F.ceil(F.lit(turn * part) - place)


def train(sample: DataFrame, weights: gru.Weights, seed: int = 11, rate: float = 0.01) -> gru.Weights:
    """Rounds of learning apart and averaging over ``sample(ids)``; all rounds together see every text."""
    n = sample.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0] // 2
    if not n:
        return weights
    trainers = max(1, min(TRAINERS, n // LEAST_TOKENS), n // MOST_TOKENS)
    part = visits(n) / ROUNDS
    names = list(weights)
    place = F.pmod(F.xxhash64("ids"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    for turn in range(ROUNDS):
        now = weights

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts, often = [], []
            for b in batches:
                texts += [np.frombuffer(x.as_py(), "<i2") for x in b.column(0)]
                often += b.column(1).to_pylist()
            if texts:
                w = gru.train(now, texts, np.array(often), rate * 0.6**turn, seed + turn)
                flat = np.concatenate([w[k].ravel() for k in names]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, texts))]), pa.array([flat.tobytes()], pa.binary())], ["n", "w"])

        share = sample.select("ids", times(place, turn, part).cast("int").alias("times")).where("times > 0")
        learned = share.repartition(trainers).mapInArrow(learn, "n long, w binary")
        if trainers > SUMS:
            learned = learned.repartition(SUMS).mapInArrow(add_up, "n long, w binary")
        results = learned.toArrow().to_pylist()
        if not results:
            continue
        results.sort(key=lambda r: (r["n"], r["w"]))
        mean = sum(np.frombuffer(r["w"], "<f4").astype(np.float64) * r["n"] for r in results) / sum(r["n"] for r in results)
        weights, at = {}, 0
        for k in names:
            weights[k] = mean[at : at + now[k].size].reshape(now[k].shape).astype(np.float32)
            at += now[k].size
    return weights


def score_texts(w: gru.Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each sequence of ids, which end with 0. Lanes take one text after the other, the longest first."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    # Fewer lanes where one text outweighs the rest, so that no more than eight times the tokens are laid out.
    total, longest = sum(map(len, texts)), len(texts[order[0]])
    lanes: list[list[int]] = [[] for _ in range(max(1, min(LANES, len(texts), 8 * total // longest)))]
    heap = [(0, k) for k in range(len(lanes))]
    for k in order:
        size, lane = heapq.heappop(heap)
        lanes[lane].append(k)
        heapq.heappush(heap, (size + len(texts[k]), lane))
    lanes.sort(key=lambda own: -sum(len(texts[k]) for k in own))
    sizes = np.array([sum(len(texts[k]) for k in own) for own in lanes])
    out = np.zeros(len(texts))
    h = np.zeros((gru.HIDDEN, len(lanes)), np.float32)
    steps, width = int(sizes[0]), 32
    target, before, owner = (np.zeros((len(lanes), steps), np.int32) for _ in range(3))
    for lane, own in enumerate(lanes):
        at = 0
        for k in own:
            ids = texts[k]
            target[lane, at : at + len(ids)] = ids
            before[lane, at] = -1
            before[lane, at + 1 : at + len(ids)] = ids[:-1]
            owner[lane, at : at + len(ids)] = k
            at += len(ids)
    for t in range(0, steps, width):
        live = int(np.searchsorted(-sizes, -t, "left"))
        stop = min(t + width, steps)
        states = gru.advance(w, before[:live, t:stop].T, h[:, :live])
        h, flat = states[:, -1], states.reshape(gru.HIDDEN, -1)
        ids, owners = target[:live, t:stop].T.ravel(), owner[:live, t:stop].T.ravel()
        if sizes[live - 1] < stop:
            inside = np.flatnonzero((np.arange(t, stop)[:, None] < sizes[:live]).ravel())
            flat, ids, owners = np.take(flat, inside, axis=1), ids[inside], owners[inside]
        out += np.bincount(owners, gru.log_probability(w, flat, ids), len(texts))
    return out


def score_encoded(encoded: DataFrame, weights: Broadcast) -> DataFrame:
    """``uid`` and the other columns of ``encoded`` but its words, with ``score`` as far as workers know the words."""
    columns = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "inner"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value

        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            natural = score_texts(w, [np.frombuffer(x.as_py(), "<i2") for x in table.column("ids")])
            score = table.column("inner").to_numpy() + natural / math.log(10)
            return table.drop_columns(["ids", "inner"]).append_column("score", pa.array(score)).to_batches()[0]

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                held.append(batch.slice(at, 1024))
                size += sum(held[-1].column("n_tokens").to_pylist())
                if size >= BATCH_WORDS:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    schema = "uid binary, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    return encoded.select(*columns, "ids").mapInArrow(score, schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains on ``docs(doc_id, text)`` but the held-out rows, and scores all."""
    frame, spark = _frame(docs), docs.sparkSession
    counts = materialize(word_counts(frame), "word-counts")
    lex, key = build_lexicon(counts), uuid.uuid4().hex
    first = gru.initial(Reader(lex).id_counts(), 7)
    encoded = materialize(encode_documents(frame, key, spark.sparkContext.broadcast(lex)), "encoded")
    weights = spark.sparkContext.broadcast(train(encoded.where(~F.col("held_out")).select("ids"), first))
    # Words not known to the workers: each document's, with how often, joined with all counts.
    words = encoded.select("uid", F.explode("rest").alias("word"))
    found = words.join(counts.where("word is not null").withColumnRenamed("c", "n"), "word")
    sums = found.groupBy("uid").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count("*").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    return score_encoded(encoded, weights).join(sums, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )
