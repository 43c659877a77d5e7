"""A training corpus from ``documents``: toxic documents and repeated lines go, one of each near-duplicate
group stays, documents that hold test items go, the rest is encoded.

Each stage gets all that the stage before kept, and is written as Parquet before the next reads it; what the
stage before wrote is deleted then.

Null texts count as empty: they hold no toxic term, no line, no shingle and no test item, so they stay to the
end, as do empty ones (documents that had words and lost all in line dedup go).  Repeated rows: each of them is
kept or goes as its text does, but near-dedup keeps one id of a group, with all rows of that id.  Ties in a group
go to the least id.  Texts are read whole.  Empty tables give an empty result of the same columns; other columns
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from sparklog.llm.common import discard, materialize, table, tokenizer_path

#: SQL can't express the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled examples don't call them toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line matches; n_chars follows the text.

    Documents that lose all their words with those lines are repeated as a whole and go; those
    that had none before stay.
    """
    kept = line_dedup.without_repeated_lines(docs, n_removed="lines gone")
    kept = kept.where(F.col("lines gone").eqNullSafe(0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop("lines gone")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids by byte-level BPE, and back: doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return bpe.bpe_round_trip(docs, tokenizer_path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_test_items),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spent = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if spent is not None:
            discard(spent)
        spent = docs
    return docs
