"""Files as documents: checks, parsers by type, and what is rejected and why."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import reading_minutes, word_count
from quillgraph.params import DEFAULTS, Params

SECTIONS = "array<struct<title:string,content:string,level:int,page_num:int>>"
Section = dict
Parser = Callable[[bytes], list[Section]]


class _Html(HTMLParser):
    """Headings begin sections; scripts and styles are left out."""

    def __init__(self) -> None:
        super().__init__()
        self.sections: list[Section] = [{"title": "", "content": "", "level": 1, "page_num": None}]
        self.skip, self.heading = 0, 0

    def handle_starttag(self, tag, attrs) -> None:
        self.skip += tag in ("script", "style")
        if re.fullmatch("h[1-6]", tag):
            self.heading = min(int(tag[1]), 3)
            self.sections.append({"title": "", "content": "", "level": self.heading, "page_num": None})
        elif tag in ("p", "div", "li", "tr", "br"):
            self.sections[-1]["content"] += "\n"

    def handle_endtag(self, tag) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0
        if re.fullmatch("h[1-6]", tag):
            self.heading = 0

    def handle_data(self, data) -> None:
        if not self.skip:
            self.sections[-1]["title" if self.heading else "content"] += data


def parse_html(data: bytes) -> list[Section]:
    parser = _Html()
    parser.feed(data.decode("utf-8", "replace"))
    out = [s | {"title": s["title"].strip(), "content": re.sub(r"\s*\n\s*", "\n", s["content"]).strip()} for s in parser.sections]
    return [s for s in out if s["title"] or s["content"]]


def parse_text(data: bytes) -> list[Section]:
    text = data.decode("utf-8", "replace").strip()
    return [{"title": "", "content": text, "level": 1, "page_num": None}] if text else []


# Shares of the body's size from which a line is a heading, and a heading of the first and second level; the words of a bold one.
HEADING, LEVELS, BOLD_WORDS = 1.15, (1.5, 1.25), 15


def sections_of(pages: list[dict], band: float = 0.08) -> list[Section]:
    """Sections of pages ``{height, lines, tables}``; a line has ``y, x, size, bold, text``, a table rows of cells.

    The most frequent size is the body's, of sizes as frequent that seen first. Lines in the bands at a page's top and bottom
    and page numbers are left out; lines are read from top to bottom, then from left to right.
    """
    kept = []
    for k, page in enumerate(pages, 1):
        inside = [s for s in page["lines"] if s["text"].strip() and band * page["height"] <= s["y"] <= (1 - band) * page["height"] and not re.fullmatch(r"\d{1,4}", s["text"].strip())]
        kept.append((k, sorted(inside, key=lambda s: (s["y"], s["x"])), page.get("tables") or []))
    sizes = Counter(round(s["size"], 1) for _, lines, _ in kept for s in lines)
    body = max(sizes, key=sizes.get) if sizes else 0  # the first of the greatest
    out: list[Section] = [{"title": "", "content": "", "level": 1, "page_num": 1}]
    for k, lines, tables in kept:
        for s in lines:
            text, size = s["text"].strip(), s["size"]
            if size >= HEADING * body or s["bold"] and size >= body and len(text.split()) <= BOLD_WORDS:
                ratio = size / body if body else 0
                out.append({"title": text, "content": "", "level": 1 + sum(ratio < x for x in LEVELS), "page_num": k})
            else:
                out[-1]["content"] += ("\n" if out[-1]["content"] else "") + text
        rows = [" | ".join((c or "").strip() for c in row) for table in tables for row in table if any((c or "").strip() for c in row)]
        if rows:
            out[-1]["content"] += "\n[Tables]\n" + "\n".join(rows)
    return [s for s in out if s["title"] or s["content"]]


def recognise(page, scale: int = 2) -> str:
    """Text of a page's picture by the optional Tesseract, at twice its size; empty without it or where it fails."""
    try:
        import io

        import pytesseract
        from PIL import Image

        picture = page.get_pixmap(matrix=__import__("fitz").Matrix(scale, scale))
        return pytesseract.image_to_string(Image.open(io.BytesIO(picture.tobytes("png")))).strip()
    except Exception:  # recognition is a help, not a condition
        return ""


def parse_pdf(data: bytes) -> list[Section]:
    """Needs the optional PyMuPDF. Pages without text are recognised from their picture where Tesseract is installed."""
    try:
        import fitz
    except ImportError as error:
        raise RuntimeError("PDF files need PyMuPDF") from error
    pages = []
    with fitz.open(stream=data, filetype="pdf") as pdf:
        if pdf.needs_pass:
            raise RuntimeError("the file needs a password")
        for page in pdf:
            lines = []
            for block in page.get_text("dict")["blocks"]:
                for line in block.get("lines", ()):
                    spans = [s for s in line["spans"] if s["text"].strip()]
                    if spans:
                        lines.append({"y": line["bbox"][1], "x": line["bbox"][0], "size": max(s["size"] for s in spans), "bold": all(s["flags"] & 16 for s in spans), "text": " ".join(s["text"].strip() for s in spans)})
            height = page.rect.height
            if not lines and (text := recognise(page)):
                lines = [{"y": height / 2 + k * 1e-3, "x": 0, "size": 10, "bold": False, "text": t} for k, t in enumerate(text.split("\n"))]
            pages.append({"height": height, "lines": lines, "tables": [t.extract() for t in page.find_tables().tables] if lines else []})
    return sections_of(pages)


def parse_docx(data: bytes) -> list[Section]:
    """Paragraphs of a word-processing file, by its XML; heading styles begin sections, tables are rows between bars."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    out: list[Section] = [{"title": "", "content": "", "level": 1, "page_num": None}]
    for block in body if body is not None else []:
        if block.tag == f"{ns}tbl":
            for row in block.iter(f"{ns}tr"):
                cells = ["".join(t.text or "" for t in cell.iter(f"{ns}t")).strip() for cell in row.iter(f"{ns}tc")]
                if any(cells):
                    out[-1]["content"] += "\n" + " | ".join(cells)
            continue
        text = "".join(t.text or "" for t in block.iter(f"{ns}t")).strip()
        style = next((s.get(f"{ns}val", "") for s in block.iter(f"{ns}pStyle")), "")
        runs = [r for r in block.iter(f"{ns}r") if "".join(t.text or "" for t in r.iter(f"{ns}t")).strip()]
        bold = bool(runs) and all(any(True for _ in r.iter(f"{ns}b")) for r in runs)
        heading = re.match(r"(?i)heading\s*(\d)", style)
        if text and (heading or bold and len(text.split()) <= 15):
            out.append({"title": text, "content": "", "level": int(heading[1]) if heading else 3, "page_num": None})
        elif text:
            out[-1]["content"] += "\n" + text
    return [s | {"content": s["content"].strip()} for s in out if s["title"] or s["content"].strip()]


PARSERS: dict[str, Parser] = {".txt": parse_text, ".md": parse_text, ".html": parse_html, ".htm": parse_html, ".pdf": parse_pdf, ".docx": parse_docx, ".doc": parse_docx}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def parse_files(files: DataFrame, p: Params = DEFAULTS, types: tuple[str, ...] | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``filename, file_type, content_text, sections, is_small, word_count, reading_time_minutes, status, reason`` of every file.

    Status is 200, or 400 for a type that isn't taken, 413 for too large a file, 422 for one that can't be
    parsed or holds no text. Files that fail the first two checks aren't read.
    """
    known = parsers or PARSERS
    taken = types or p.file_types
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    early = F.when(~kind.isin(*taken), 400).when(F.col("length") > p.max_file_bytes, 413).otherwise(200)
    rows = files.select(name.alias("filename"), kind.alias("file_type"), early.alias("status"), F.when(early == 200, F.col("content")).alias("content"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for filename, file_type, status, content in zip(pdf["filename"], pdf["file_type"], pdf["status"], pdf["content"]):
                sections, reason = [], {400: "file type", 413: "file size"}.get(status, "")
                if status == 200:
                    try:
                        sections = known[file_type](bytes(content))
                        reason = "" if sections else "no text"
                    except Exception as error:  # a bad file is a row, not a failed job
                        reason = f"{type(error).__name__}: {error}"
                    status = 422 if reason else 200
                text = "\n\n".join("\n".join(x for x in (s["title"], s["content"]) if x) for s in sections)
                out.append((filename, file_type, text or None, sections, int(status), reason))
            yield pd.DataFrame(out, columns=["filename", "file_type", "content_text", "sections", "status", "reason"])

    parsed = rows.mapInPandas(parse, f"filename string, file_type string, content_text string, sections {SECTIONS}, status int, reason string")
    text = F.col("content_text")
    return parsed.withColumn("is_small", F.length(text) <= p.small_doc_chars).withColumn("word_count", word_count(text)).withColumn("reading_time_minutes", reading_minutes(text))


#: Bytes of a file that its title is looked for in.
HEAD = 65536


def _title(kind: str, head: bytes) -> str:
    """A title from the first bytes of a file; empty if they tell none."""
    import html
    import io
    import zipfile

    if kind in (".html", ".htm"):
        found = re.search(r"(?is)<title[^>]*>(.*?)</title>", head.decode("utf-8", "replace"))
        return html.unescape(found[1]).strip() if found else ""
    if kind == ".pdf":
        found = re.search(rb"/Title\s*\(((?:\\.|[^\\()])*)\)", head)
        return re.sub(rb"\\(.)", rb"\1", found[1]).decode("latin-1").strip() if found else ""
    if kind in (".docx", ".doc"):
        try:
            with zipfile.ZipFile(io.BytesIO(head)) as z:
                found = re.search(rb"(?s)<dc:title>(.*?)</dc:title>", z.read("docProps/core.xml"))
        except (zipfile.BadZipFile, KeyError):  # a file longer than its head has no directory in it
            return ""
        return html.unescape(found[1].decode("utf-8", "replace")).strip() if found else ""
    return head.decode("utf-8", "replace").lstrip().split("\n", 1)[0].strip()[:200]


def file_metadata(files: DataFrame) -> DataFrame:
    """``filename, file_type, length, title`` from the heads of files alone; no file is parsed."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))

    @F.pandas_udf("string")
    def title(kinds: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([_title(k, bytes(h or b"")) for k, h in zip(kinds, heads)], index=kinds.index, dtype=object)

    return files.select(name.alias("filename"), kind.alias("file_type"), "length", title(kind, F.substring("content", 1, HEAD)).alias("title"))


def check_setup(spark: SparkSession) -> dict[str, bool]:
    """Whether what the engine needs is there: Python, Arrow, the shared folder, and optional parsers."""
    import importlib.util
    import sys

    def has(name: str) -> bool:
        return importlib.util.find_spec(name) is not None

    return {
        "python": sys.version_info >= (3, 10), "arrow": has("pyarrow"), "pandas": has("pandas"), "spark": spark.range(1).count() == 1,
        "shared_folder": bool(spark.conf.get("spark.checkpoint.dir", None)), "pdf_optional": has("fitz"), "language_optional": has("langdetect"),
    }
