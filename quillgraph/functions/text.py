"""Text functions, as column expressions.

Word characters are ``[\\p{L}\\p{N}_]``, which Java and RE2 read alike.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that are no keywords.
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those",
    "i", "you", "he", "she", "it", "we", "they", "them", "their",
)


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def clean_name(name: Column) -> Column:
    """Lower case, without articles and punctuation; spaces collapse before punctuation goes."""
    c = F.trim(F.lower(name))
    c = F.regexp_replace(c, r"(?U)\b(the|a|an)\b", "")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", ""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), F.trim), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r'(?<=[.!?])\s+(?=[A-Z"(\[])'), F.trim), lambda s: s != "")


def reading_minutes(text: Column) -> Column:
    return F.round(word_count(text) / F.lit(200.0), 1)


def truncate(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - len(suffix))), F.lit(suffix))).otherwise(text)


def snippet(text: Column, n: int) -> Column:
    """The first characters, on one line."""
    return F.regexp_replace(F.left(text, F.lit(n)), "\n", " ")


def heading_level(size: Column, body: Column) -> Column:
    ratio = F.try_divide(size, body)
    return F.when(ratio >= 1.5, 1).when(ratio >= 1.25, 2).otherwise(3)


def is_heading(size: Column, body: Column, bold: Column, text: Column) -> Column:
    return (size >= body * 1.15) | (bold & (size >= body) & (word_count(text) <= 15))


def is_bold_heading(runs_bold: Column, text: Column) -> Column:
    """A short paragraph of which all runs are bold."""
    return (F.trim(text) != "") & (word_count(text) <= 15) & (F.size(runs_bold) > 0) & F.forall(runs_bold, lambda b: b)


def is_page_number(line: Column) -> Column:
    return F.trim(line).rlike(r"^\d{1,4}$")


def table_row(cells: Column) -> Column:
    """Cells between bars; null for rows without any text."""
    filled = F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    return F.when(F.exists(filled, lambda c: c != ""), F.array_join(filled, " | "))


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def normalize_text(text: Column) -> Column:
    """Spaces collapse, unusual signs go, letters are decomposed (no built-in function does that)."""
    c = F.regexp_replace(text, r"\s+", " ")
    c = F.regexp_replace(c, r"[^\p{L}\p{N}_\s.,;:!?-]", "")
    return F.trim(_decomposed(c))


def contains_folded(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def window_chunks(docs: DataFrame, size: int = 500, step: int = 450) -> DataFrame:
    """``id, chunk_index, content``: fixed windows of words, every ``step`` words."""
    w = words(F.col("content_text"))
    n = docs.select("id", w.alias("w")).where("size(w) > 0")
    at = n.select("id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("chunk_index", "at"))
    return at.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), F.array_join(F.slice("w", F.col("at") + 1, size), " ").alias("content"))


def keywords(docs: DataFrame, n: int = 10) -> DataFrame:
    """``id, rank, keyword, n``: the most frequent long words of each text, the earlier first on ties. Words are counted where their text is; nothing is shuffled."""
    import re

    blank, odd, stop = re.compile(r"[ \t\n\x0b\f\r]+"), re.compile(r"\W"), frozenset(STOPWORDS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = Counter(w if w.isalnum() else odd.sub("", w) for w in blank.split(text.as_py() or ""))  # in order of their first places
                best = sorted(((w, c) for w, c in found.items() if len(w) > 3 and w not in stop), key=lambda x: -x[1])[:n]
                rows += [(i, k, w, c) for k, (w, c) in enumerate(best, 1)]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["id", "rank", "keyword", "n"])

    return docs.select(F.col("id").cast("long").alias("id"), F.lower("content_text")).mapInArrow(count, "id long, rank long, keyword string, n long")


# --- section-aware chunks ---------------------------------------------------


def _fold(pieces: list[list[str]], size: int) -> list[list[str]]:
    """Joins pieces of words until the next would pass ``size``; longer ones are cut hard."""
    out: list[list[str]] = []
    now: list[str] = []
    for piece in pieces:
        if now and len(now) + len(piece) > size:
            out.append(now)
            now = []
        if len(piece) > size:
            out += [piece[i : i + size] for i in range(0, len(piece), size)]
        else:
            now = now + piece
    return [*out, now] if now else out


def split_section(text: str, size: int) -> list[str]:
    """A section's chunks before they overlap: whole if it fits, else by paragraphs, sentences, words."""
    import re

    if len(text.split()) <= size:
        return [text]
    blocks = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    out: list[str] = []
    group: list[list[str]] = []

    def flush() -> None:
        out.extend(" ".join(c) for c in _fold(group, size))
        group.clear()

    for block in blocks:
        w = block.split()
        if len(w) <= size:
            group.append(w)
            continue
        flush()
        parts = [s.split() for s in re.split(r'(?<=[.!?])\s+(?=[A-Z"(\[])', block) if s.strip()]
        out.extend(" ".join(c) for c in _fold(parts, size))
    flush()
    return out or [text]


#: Characters of chunks, about, that a task sends on at once.
CHUNK_BYTES = 1 << 20
CHUNKS = "id long, chunk_index long, content string, section_title string, section_level int, page_num int, n_words long"


def section_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of ``docs(id, content_text, sections)``; ``sections`` (array of title, content, level, page_num) may be null.

    Within a section a chunk begins with the last words of the one before. Numbers go on
    across sections. Blank sections have no chunk; a document without any falls back to its text.
    """
    if "sections" not in docs.columns:
        docs = docs.withColumn("sections", F.lit(None).cast("array<struct<title:string,content:string,level:int,page_num:int>>"))

    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def made() -> pa.RecordBatch:
            nonlocal held
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            held = 0
            return out

        # A document at a time: rows of a batch, as objects and with their chunks, would take many times its size.
        for batch in batches:
            for doc, text, sections in zip(*(batch.column(c) for c in range(3))):
                doc, text, sections = doc.as_py(), text.as_py(), sections.as_py()
                own = [s for s in sections or [] if (s["content"] or "").strip()]
                own = own or ([{"title": "", "content": text, "level": 1, "page_num": None}] if (text or "").strip() else [])
                k = 0
                for s in own:
                    before: list[str] = []
                    for part in split_section(s["content"], size):
                        content = " ".join([*before, part]) if before else part
                        rows.append((doc, k, content, s["title"], s["level"], s["page_num"], len(content.split())))
                        before = part.split()[-overlap:] if overlap else []
                        k, held = k + 1, held + len(content)
                        if held >= CHUNK_BYTES:
                            yield made()
        if rows:
            yield made()

    return docs.select(F.col("id").cast("long").alias("id"), "content_text", "sections").mapInArrow(cut, CHUNKS)


def context_window(chunks: DataFrame, n: int = 1) -> DataFrame:
    """``id, chunk_index, context``: each chunk with its ``n`` neighbours on either side."""
    around = W.partitionBy("id").orderBy("chunk_index").rowsBetween(-n, n)
    return chunks.select("id", "chunk_index", F.array_join(F.collect_list("content").over(around), "\n\n").alias("context"))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b; the default where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def prefixed(kind: str, i: Column) -> Column:
    """An id with its kind before it, as ``concept_7``."""
    return F.concat(F.lit(f"{kind}_"), i.cast("string"))


def detect_language(texts: Column, least_words: int = 20, sample: int = 3000) -> Column:
    """The language by the optional ``langdetect``; ``unknown`` for short texts and where that isn't installed."""

    @F.pandas_udf(T.StringType())
    def detect(batch):
        try:
            from langdetect import detect as find
        except ImportError:
            return pd.Series(["unknown"] * len(batch), index=batch.index)

        def one(t):
            try:
                return find(t[:sample])
            except Exception:  # texts without letters
                return "unknown"

        return batch.map(one)

    return F.when(F.coalesce(word_count(texts), F.lit(0)) < least_words, "unknown").otherwise(detect(F.coalesce(texts, F.lit(""))))
