"""Token counts of whole texts, in Arrow functions that return lengths only.

Batches are balanced by bytes, long texts are cut where no pre-token can span
(``pieces.cut``), and lengths of pieces met before come from a bounded cache.

Null and empty texts count 0 tokens and 0 bytes.  Repeated rows give repeated
results, other columns pass through, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.llm.common import by_bytes
from sparklog.llm.pieces import PieceCache

#: Bytes of text that one Python batch holds.
BATCH_BYTES = 4 << 20


@functools.cache
def library(path: str):
    """The tokenizer of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file, single-threaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def special_strings(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def splits_at_blanks(path: str) -> bool:
    """Whether the file's pre-tokens are those of the byte-level pattern, so that texts may be cut."""
    import json

    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    added = made.get("added_tokens") or []
    return made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in added)


@functools.cache
def _length_cache(path: str) -> PieceCache:
    t = library(path)
    return PieceCache(lambda words: [len(e) for e in t.encode_batch_fast(words, add_special_tokens=False)], sum, special_strings(t))


def lengths(path: str, texts: list[str]) -> list[int]:
    """Number of tokens of each text, as the library gives it."""
    if path.endswith(".model"):
        return [len(x) for x in library(path).encode(texts, num_threads=1)]
    if splits_at_blanks(path):
        return [sum(row) for row in _length_cache(path).batch(texts)]
    return [len(e) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the token count of column ``text`` in column ``out`` (replaced if it is there)."""
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.LongType())])
    names = [f.name for f in schema.fields]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, BATCH_BYTES):
            n = lengths(path, [t or "" for t in batch.column(names.index(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=names)

    return df.select(*kept).mapInArrow(count, schema)


def op8(df: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document.

    Texts themselves don't leave Python again: ``token_counts`` would return them, so the
    byte length is taken beside the count.
    """
    schema = "doc_id long, n_bytes long, n_tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            n = lengths(path, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
