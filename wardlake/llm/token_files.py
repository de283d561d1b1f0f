"""Token ids as flat binary files with 64-bit document offsets, read back through memory maps.

Documents are dealt into chunks that ascend with their id. A task encodes the texts of its
chunks in order and streams, for each chunk, three files into the shared folder: ``.ids``
(unsigned integers, 16 bits wide where the vocabulary fits, else 32), ``.offsets`` (n + 1
signed 64-bit token offsets within the chunk) and ``.docs`` (signed 64-bit document ids). A
manifest row tells a chunk's counts and files. File names hold a random part and only
manifest rows of committed tasks count, so a repeated task does no harm. The base of each chunk is
the prefix sum of the token counts before it.

Defined results: a null text is an empty one and has the end id alone; documents without an
id come first, with a null id; rows of one id are ordered by text; an empty table gives an
empty manifest and no rows; further columns are left out.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import bytebpe
from wardlake.llm.tables import kept, order_chunk, shuffle_width
from wardlake.session import shared_folder

END_ID = 0
MANIFEST = "chunk int, n_docs long, n_tokens long, n_null long, width int, files string"
READ_DOCS = 4_096


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


class _Chunk:
    """The open files of one chunk."""

    def __init__(self, folder: str, chunk: int) -> None:
        self.chunk, self.n_docs, self.n_tokens, self.n_null, self.width = chunk, 0, 0, 0, 0
        self.files = f"{folder}/chunk-{chunk:06d}-{uuid.uuid4().hex}"
        self.system, path = _place(self.files)
        self.system.create_dir(path.rpartition("/")[0], recursive=True)
        self.ids, self.offsets, self.docs = (self.system.open_output_stream(f"{path}.{x}") for x in ("ids", "offsets", "docs"))
        self.offsets.write(np.zeros(1, "<i8").tobytes())

    def add(self, docs: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents in order; ends are token offsets within ``ids``."""
        self.width = ids.dtype.itemsize
        self.ids.write(ids.astype(ids.dtype.newbyteorder("<"), copy=False).tobytes())
        self.offsets.write((ends + self.n_tokens).astype("<i8").tobytes())
        self.docs.write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.n_null += docs.null_count
        self.n_docs += len(docs)
        self.n_tokens += len(ids)

    def close(self) -> pa.RecordBatch:
        for f in (self.ids, self.offsets, self.docs):
            f.close()
        names = ("chunk", "n_docs", "n_tokens", "n_null", "width", "files")
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_pydict({n: pa.array([getattr(self, n)], k) for n, k in zip(names, kinds, strict=True)})


def ended(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each document, and the new offsets."""
    return np.insert(ids, offsets[1:], END_ID), offsets + np.arange(len(offsets))


def write(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes all documents and writes the files; returns the manifest, one row for each chunk, with bases.

    The manifest has at most a few thousand rows, whatever the number of documents.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("chunk", order_chunk(rows, "doc_id").cast("int"))
    rows = rows.repartition(shuffle_width(spark), "chunk").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Chunk | None = None
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now is not None and now.chunk != int(chunks[a]):
                    yield now.close()
                    now = None
                now = now or _Chunk(folder, int(chunks[a]))
                part = batch.slice(a, b - a)
                for i, j, ids, offsets in bytebpe.encoded(part.column("text"), vocabulary):
                    ids, offsets = ended(ids, offsets)
                    now.add(part.column("doc_id").slice(i, j - i), ids, offsets[1:])
        if now is not None:
            yield now.close()

    manifest = kept(rows.mapInArrow(work, MANIFEST), "token-manifest")
    base, rows_out = 0, []
    for r in sorted(manifest.collect(), key=lambda r: r["chunk"]):
        rows_out.append((*r, base))
        base += r["n_tokens"]
    return spark.createDataFrame(rows_out, MANIFEST + ", base long")


def _mapped(path: str, dtype: str, count: int) -> np.ndarray:
    """A file's numbers: a memory map where the folder is a local or mounted one, else read."""
    system, place = _place(path)
    if count == 0:
        return np.zeros(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(place, dtype, mode="r", shape=(count,))
    with system.open_input_file(place) as f:
        return np.frombuffer(f.read_buffer(count * np.dtype(dtype).itemsize), dtype)


def read(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens and the crc of its ids as 32-bit integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = r["n_docs"]
                ids = _mapped(r["files"] + ".ids", f"<u{r['width'] or 4}", r["n_tokens"])
                offsets = _mapped(r["files"] + ".offsets", "<i8", n + 1)
                docs = _mapped(r["files"] + ".docs", "<i8", n)
                for a in range(0, n, READ_DOCS):
                    b = min(n, a + READ_DOCS)
                    at = np.asarray(offsets[a : b + 1])
                    crc = [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(at.tolist(), at[1:].tolist(), strict=False)]
                    null = np.arange(a, b) < r["n_null"]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.asarray(docs[a:b]), mask=null), "start": pa.array(at[:-1] + r["base"]),
                        "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    spark: SparkSession = manifest.sparkSession
    spread = manifest.repartition(shuffle_width(spark), "chunk")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
