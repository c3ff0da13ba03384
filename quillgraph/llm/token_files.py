"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt into ranges of ``doc_id`` and ordered; each task encodes its range as
it comes and writes three files: ``.bin`` has all ids, unsigned, of 16 bits if the
vocabulary allows it and of 32 otherwise; ``.idx`` has where each document begins, and the
end, as unsigned 64-bit counts of ids; ``.ids`` has the document ids as signed 64-bit
integers (a null id as the least). All are little-endian. File names are fresh in each
attempt and only those in the manifest count, so lost tasks leave nothing that is read.
A range's first place among all ids is the sum of the ranges before it.

Files are written through the file system of the folder's URI and read back by mapping
them into memory where they are local, by ranges elsewhere.

Null and empty texts are the end token alone. Null ids come first; repeated ids are ordered by their texts.
An empty table gives no file and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, scratch
from quillgraph.llm.tokens import encoder, vocabulary_path

NO_ID = -(1 << 63)
SLICE = 128
MANIFEST = "part long, stem string, width int, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(uri: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes ``docs(doc_id, text)`` and returns the manifest: a row per range, with ``base``, its first place."""
    vocabulary = vocabulary or vocabulary_path("word_bpe_49k.json")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        tokens = encoder(vocabulary)
        width = 2 if max(tokens.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end, offsets, ids = end_id.to_bytes(4, "little"), [0], []
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        with files.open_output_stream(f"{path}/{stem}.bin") as out:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                for at in range(0, batch.num_rows, SLICE):
                    some = batch.slice(at, SLICE)
                    coded = [x + end for x in tokens.encode(some.column(1).to_pylist())]
                    flat = np.frombuffer(b"".join(coded), "<u4")
                    out.write((flat.astype("<u2") if width == 2 else flat).tobytes())
                    for x in coded:
                        offsets.append(offsets[-1] + len(x) // 4)
                    ids += [NO_ID if x is None else x for x in some.column(0).to_pylist()]
                batch = next(batches, None)
        for suffix, data in ((".idx", np.array(offsets, "<u8")), (".ids", np.array(ids, "<i8"))):
            with files.open_output_stream(f"{path}/{stem}{suffix}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "stem": stem, "width": width, "n_docs": len(ids), "n_tokens": offsets[-1]}], pa.schema([("part", pa.int64()), ("stem", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    parts = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(write, MANIFEST), "manifest")
    # One row per file.
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document where it starts among all ids, how many it has, and their crc32 as unsigned 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        local = files.type_name == "local"
        opened = (lambda name: pa.memory_map(name)) if local else files.open_input_file
        for batch in batches:
            for row in batch.to_pylist():
                with opened(f"{path}/{row['stem']}.idx") as f, opened(f"{path}/{row['stem']}.ids") as g, opened(f"{path}/{row['stem']}.bin") as h:
                    for at in range(0, row["n_docs"], 4096):
                        n = min(4096, row["n_docs"] - at)
                        offsets = np.frombuffer(f.read_at(8 * (n + 1), 8 * at), "<u8").astype(np.int64)
                        ids = np.frombuffer(g.read_at(8 * n, 8 * at), "<i8")
                        flat = np.frombuffer(h.read_at(row["width"] * int(offsets[-1] - offsets[0]), row["width"] * int(offsets[0])), f"<u{row['width']}").astype("<u4", copy=False)
                        here = (offsets - offsets[0]).tolist()
                        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(here, here[1:])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=ids == NO_ID), pa.array(offsets[:-1] + row["base"]), pa.array(np.diff(offsets)), pa.array(crcs, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    n = max(1, manifest.count())
    return manifest.repartition(n, "part").mapInArrow(read, READ)


def round_trip(docs: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """Writes the files, to the shared folder unless another is given, and reads them back."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, **parameters), folder)
