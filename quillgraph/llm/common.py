"""Helpers that the training-data operators share.

* Words are ``[^\\x20\\x09-\\x0D]+``: ``bytes.split()`` cuts at exactly those six bytes.
* Results that are read more than once are written to the folder that the session names in
  ``spark.checkpoint.dir`` and reread (``materialize``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.store import scratch
from quillgraph.sources.store import stored as materialize

__all__ = ["PORTION_BYTES", "WORD", "id_crc", "materialize", "portions", "read_table", "scratch", "words_lower"]

#: Words as a Java / RE2 regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Text at most, about, that models of quality describe at once; arrays over it take some forty times as much.
PORTION_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def portions(sizes: Iterable[int | None], most_rows: int = 128) -> Iterator[tuple[int, int]]:
    """First row and number of rows of consecutive portions of at most ``most_rows`` rows and ``PORTION_BYTES``; a larger row is one by itself."""
    first = rows = total = 0
    for size in sizes:
        if rows and (rows >= most_rows or total + (size or 0) > PORTION_BYTES):
            yield first, rows
            first, rows, total = first + rows, 0, 0
        rows, total = rows + 1, total + (size or 0)
    if rows:
        yield first, rows


def words_lower(text: str | None) -> list[bytes]:
    """Words of a text (null: none), A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
