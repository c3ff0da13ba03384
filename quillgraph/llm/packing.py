"""Best-fit packing of token sequences into fixed-length training sequences.

Bounded-space online best fit: every packing task keeps a fixed number of open bins,
indexed by their free space with a bitset. A piece goes to the open bin with the least
free space that holds it; where none does and all bins are open, the fullest closes.
Only piece lengths are dealt out for packing, never texts.

Nulls and empty texts are documents of the end token alone. Repeated rows are packed as
often as they occur. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tokens import encoder, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"
#: Texts that are encoded at once.
SLICE = 128
#: Tasks at least that rows with the same id may go to.
SALTS = 64


class BestFit:
    """Open bins by free space: ``stacks[f]`` holds bins with f free, bit f of ``bits`` says there are any."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.bins = 0, 0, 0

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        found = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of the next piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.bins
            self.bins += 1
            if length < free and self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
        rest = free - length
        if rest:
            self.stacks[rest].append(found)
            self.bits |= 1 << rest
            self.open += 1
        return found, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of ``n`` tokens: all full, but the first may be shorter."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def document_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encodes whole texts, adds the end token and cuts what is longer than ``capacity``."""
    end = end_id.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cols: list[list] = [[], [], [], [], []]
                for doc_id, ids in zip(part.column(0).to_pylist(), tokens.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        for col, x in zip(cols, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                            col.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def place_pieces(pieces: DataFrame, capacity: int, open_bins: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. Pieces are dealt and ordered by a hash, so reruns over the same files agree;
    adaptive execution joins small partitions, so that few bins stay half empty."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [fit.place(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    order = F.xxhash64("doc_id", "piece", "length")
    # Rows of one id, or without one, may be many: their places in the input part them.
    salted = pieces.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    dealt = salted.repartition("doc_id", "piece", "ids_crc32", "salt").sortWithinPartitions(order, "doc_id", "piece", "length", "ids_crc32")
    return dealt.select("doc_id", "piece", "start", "length", "ids_crc32").mapInArrow(pack, PLACED)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2, capacity: int = 1024, open_bins: int = 1024) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens; one row per piece."""
    return place_pieces(document_pieces(docs, vocabulary or vocabulary_path("byte_bpe_50k.json"), end_id, capacity), capacity, open_bins)
