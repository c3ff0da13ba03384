"""Token counts of parts of documents, by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens' character spans are joined with the
spans of its sections, and a token that crosses a border is allotted by a rule:

* ``most``: to the section with most of its characters, the earlier one on ties;
* ``start``: to the section with its first character.

Tokens without a character in any section go to section null. So the counts of a document
add up to its tokens. Sections are given as ``array<struct<id:int, first:int, last:int>>``
(in characters, past-the-end, ascending, without overlap); ``line_sections`` makes one of each line, the
line feed outside. Null and empty texts have no token and no row. Repeated rows are counted
each. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.tokens import encoder, vocabulary_path

COUNTS = "doc_id long, section int, first_char long, last_char long, n_tokens long, n_crossing long"
SLICE = 128


def allot(first: np.ndarray, last: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Each token's section (its place, -1 for none) and whether the token has characters outside it.

    A sorted merge: the first section that ends after the token's start, and those after it.
    """
    n = len(starts)
    if not n:
        return np.full(len(first), -1), np.zeros(len(first), bool)
    at = np.searchsorted(stops, first, "right")
    best, most = np.full(len(first), -1), np.zeros(len(first), np.int64)
    todo, k = np.arange(len(first)), at
    while len(todo):  # as often as sections meet one token
        inside = k < n
        todo, k = todo[inside], k[inside]
        shared = np.minimum(last[todo], stops[k]) - np.maximum(first[todo], starts[k])
        if rule == "start":
            shared = np.where(starts[k] <= first[todo], shared, 0)
        better = shared > most[todo]
        best[todo[better]], most[todo[better]] = k[better], shared[better]
        more = stops[k] < last[todo]
        todo, k = todo[more], k[more] + 1
    return best, most < last - first


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end characters of the lines."""
    size = np.array([len(x) for x in text.split("\n")], np.int64)
    stops = np.cumsum(size + 1) - 1
    return stops - size, stops


def count_tokens(docs: DataFrame, sections: str | Column | None = None, vocabulary: str | None = None, rule: str = "most") -> DataFrame:
    """Tokens of each section of ``docs(doc_id, text)``; sections with no token have a row with 0.

    ``sections`` names the column of spans; lines if None. ``n_crossing`` counts the tokens
    allotted to the section that have characters outside it.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    spans = F.lit(None).cast("array<struct<id:int,first:int,last:int>>") if sections is None else (F.col(sections) if isinstance(sections, str) else sections)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column(1).to_pylist()
                given = part.column(2).to_pylist() if sections is not None else [None] * len(texts)
                cols: list[list] = [[], [], [], [], [], []]
                for doc_id, text, raw, own in zip(part.column(0).to_pylist(), texts, tokens.encode(texts), given, strict=True):
                    if not text:
                        continue
                    first, last = tokens.spans(text, np.frombuffer(raw, "<u4"))
                    if sections is None:
                        starts, stops = line_spans(text)
                        ids = list(range(len(starts)))
                    else:
                        starts, stops = (np.array([x[k] for x in own or []], np.int64) for k in ("first", "last"))
                        ids = [x["id"] for x in own or []]
                    to, crossing = allot(first, last, starts, stops, rule)
                    n = len(ids)
                    counts = np.bincount(np.where(to < 0, n, to), minlength=n + 1)
                    crossed = np.bincount(np.where(to < 0, n, to), crossing & (to >= 0), minlength=n + 1).astype(np.int64)
                    for col, x in zip(cols, ([doc_id] * n, ids, starts.tolist(), stops.tolist(), counts[:n].tolist(), crossed[:n].tolist()), strict=True):
                        col.extend(x)
                    if counts[n]:
                        for col, x in zip(cols, (doc_id, None, None, None, int(counts[n]), 0), strict=True):
                            col.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                names = [x.split()[0] for x in COUNTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), spans.alias("spans")).mapInArrow(count, COUNTS)
