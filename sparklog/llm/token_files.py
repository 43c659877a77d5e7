"""Token ids in flat files of unsigned integers, with 64-bit document offsets, to be memory-mapped.

One folder per data set.  Part ``p`` of the range-sorted documents has

    ids-<p>.bin      the ids, little-endian, 2 bytes each if all ids of the vocabulary fit, else 4
    offsets-<p>.bin  n + 1 unsigned 64-bit offsets into the ids of this part
    docs-<p>.bin     n signed 64-bit document ids, ascending

Where a part begins in the whole is the prefix sum of the parts before it.
Files are written under another name and renamed, so a task that runs again,
or twice at once, leaves one whole file.  The folder must be a mounted path
that all executors share, as memory-mapping needs one.

Null texts count as empty and give the end id alone.  Null ids are written as the
smallest 64-bit integer and sort first.  Repeated ids stay, in order of their text.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm.common import by_bytes, shared_dir, shuffle_parts
from sparklog.llm.pieces import PieceCache
from sparklog.llm.token_counts import BATCH_BYTES, library, special_strings, splits_at_blanks

_NO_ID = -(1 << 63)


def mounted(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return path
    raise ValueError(f"token files are memory-mapped and need a mounted shared folder, not {path}")


def id_type(path: str) -> np.dtype:
    return np.dtype("<u2") if library(path).get_vocab_size() <= 1 << 16 else np.dtype("<u4")


@cache
def _id_cache(path: str) -> PieceCache:
    t, kind = library(path), id_type(path)
    return PieceCache(lambda words: [np.asarray(e.ids, kind).tobytes() for e in t.encode_batch_fast(words, add_special_tokens=False)], b"".join, special_strings(t))


def encoded(path: str, texts: list[str]) -> Iterator[bytes]:
    if splits_at_blanks(path):
        return map(b"".join, _id_cache(path).batch(texts))
    kind = id_type(path)
    return (np.asarray(e.ids, kind).tobytes() for e in library(path).encode_batch_fast(texts, add_special_tokens=False))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order; the manifest: part, n_docs, n_tokens."""
    spark = docs.sparkSession
    to = mounted(folder)
    kind = id_type(path)
    end = np.asarray([end_id], kind).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, own = task.partitionId(), f".{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.tmp"
        os.makedirs(to, exist_ok=True)
        names = [f"{to}/{k}-{part:06d}.bin" for k in ("ids", "offsets", "docs")]
        n_docs = n_ids = 0
        with open(names[0] + own, "wb") as ids, open(names[1] + own, "wb") as offsets, open(names[2] + own, "wb") as doc_ids:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in by_bytes(batches, "text", BATCH_BYTES):
                doc_ids.write(np.asarray(batch.column(0).fill_null(_NO_ID), "<i8").tobytes())
                at = []
                for row in encoded(path, [t or "" for t in batch.column(1).to_pylist()]):
                    ids.write(row)
                    ids.write(end)
                    n_ids += len(row) // kind.itemsize + 1
                    at.append(n_ids)
                offsets.write(np.asarray(at, "<u8").tobytes())
                n_docs += batch.num_rows
        for name in names:
            os.replace(name + own, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_tokens": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(write, "part long, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, bases: list[tuple[int, int]], path: str, folder: str) -> DataFrame:
    """Per document, from the memory-mapped files: doc_id, start, n_tokens, ids_crc32.

    ``bases`` has a pair for each part: its number, and the ids before it.
    """
    at, kind = mounted(folder), id_type(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                offsets = np.fromfile(f"{at}/offsets-{part:06d}.bin", "<u8")
                if len(offsets) < 2:
                    continue
                doc_ids = np.fromfile(f"{at}/docs-{part:06d}.bin", "<i8")
                ids = np.memmap(f"{at}/ids-{part:06d}.bin", kind, "r")
                for k in range(0, len(doc_ids), 4096):
                    own, some = doc_ids[k : k + 4096], offsets[k : k + 4097]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, pa.int64(), mask=own == _NO_ID),
                            pa.array((some[:-1] + np.uint64(base)).astype(np.int64)),
                            pa.array(np.diff(some).astype(np.int64)),
                            pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(some[:-1].tolist(), some[1:].tolist(), strict=True)], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    parts = spark.createDataFrame(bases, "part long, base long").repartitionById(max(1, len(bases)), F.expr("cast(part as int)"))
    return parts.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7(docs: DataFrame, path: str) -> DataFrame:
    """Write the files to the shared folder, add up where each part begins, and read them back."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    base, bases = 0, []
    # One small row per part, whatever the number of documents.
    for row in sorted(write_token_files(docs, path, folder).collect()):
        bases.append((row.part, base))
        base += row.n_tokens
    return read_token_files(spark, bases, path, folder)
