"""Lines of laid-out pages as sections: body size, headings, reading order.

``lines`` has ``id, page_num, y, x, size, bold, text`` and, to drop running heads, ``height`` of the page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.text import heading_level, is_heading, is_page_number

#: Share of a page at its top and bottom that holds running heads.
BAND = 0.08


def body_sizes(lines: DataFrame, order: tuple[str, ...] = ("page_num", "y", "x")) -> DataFrame:
    """``id, body``: each document's most frequent size, to a tenth; of sizes as frequent, that seen first."""
    sized = lines.groupBy("id", F.round("size", 1).alias("size")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = sized.groupBy("id").agg(F.max("n").alias("n"))
    return sized.join(best, ["id", "n"]).groupBy("id").agg(F.min_by("size", "first").alias("body"))


def text_lines(lines: DataFrame) -> DataFrame:
    """Lines without blank ones, page numbers and those in the bands at a page's top and bottom."""
    out = lines.where((F.trim("text") != "") & ~is_page_number(F.col("text")))
    if "height" in lines.columns:
        out = out.where(F.col("height").isNull() | F.col("y").between(F.col("height") * BAND, F.col("height") * (1 - BAND)))
    return out


def sections_from_lines(lines: DataFrame) -> DataFrame:
    """``id, section, title, level, page_num, content``: a heading begins a section; what is before the first has no title.

    A document's lines are ordered in one task each; nothing joins documents.
    """
    kept = text_lines(lines).join(body_sizes(lines), "id")
    heading = is_heading(F.col("size"), F.col("body"), F.coalesce(F.col("bold"), F.lit(False)), F.col("text"))
    order = W.partitionBy("id").orderBy("page_num", "y", "x")
    marked = kept.withColumn("h", heading).withColumn("section", F.sum(F.col("h").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    line = F.struct("page_num", "y", "x", F.trim("text").alias("text"))
    grouped = marked.groupBy("id", "section").agg(
        F.max(F.when(F.col("h"), F.trim("text"))).alias("title"), F.max(F.when(F.col("h"), heading_level(F.col("size"), F.col("body")))).alias("level"), F.min("page_num").alias("page_num"),
        F.array_sort(F.collect_list(F.when(~F.col("h"), line))).alias("lines"),
    )
    return grouped.select("id", "section", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("level", F.lit(1)).alias("level"), "page_num", F.array_join(F.transform("lines", lambda s: s["text"]), "\n").alias("content"))
