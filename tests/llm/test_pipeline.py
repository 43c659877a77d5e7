"""The pipeline's stages, each against brute force on its own input."""

import sys

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from sparklog.llm import decontaminate, toxicity  # noqa: E402

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_duplicates import brute, line_brute  # noqa: E402


def brute_leaks(text, index, percent=75):
    own = decontaminate.words(text)
    grams = {tuple(own[i : i + n]) for n in range(1, 6) for i in range(len(own) - n + 1)}
    enough = lambda x, least: 100 * len(x & grams) >= least * len(x)
    return any(enough(q, percent) and enough(a, 50) or enough(whole, percent) for q, a, whole in index.shingles)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        held[name] = ([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in out.collect()], out.columns)
        docs = out
    before, after, columns = held["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.op4(spark.createDataFrame(before, "doc_id long, text string"), labels).collect()}
    assert {r[0] for r in after} == {d for d, s in scores.items() if s < toxicity.TOXIC}
    before, after, columns = held["line dedup"]
    expected = {d: x for d, x in line_brute(before).items() if not x[2] or x[0].strip(" \t\n\r\x0b\x0c")}
    assert {r[0]: r[1] for r in after} == {d: t for d, (t, _, _) in expected.items()} and columns == held["toxicity"][2]
    assert all(r[columns.index("n_chars")] == len(r[1]) for r in after)
    before, after, _ = held["near-dedup"]
    assert {r[0] for r in after} == {d for d, (_, _, kept) in brute(before).items() if kept}
    before, after, _ = held["decontamination"]
    index = decontaminate.ItemIndex([tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()])
    assert {r[0] for r in after} == {d for d, t in before if not brute_leaks(t, index)}
    before, after, _ = held["byte-level BPE"]
    assert {r[0] for r in after} == {d for d, _ in before}


def test_run_is_the_stages_together(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def odd_documents(spark):
    same = "one two three four five six seven eight"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, same), (4, same), (5, same), (None, "a row without an id"), (6, "long " * 60_000)]
    return spark.createDataFrame([(d, t, None, None, None, 0.5, "clash") for d, t in rows], SCHEMA)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_documents(spark, sf_dir, name, stage):
    """Nulls, empty and very long texts, repeated rows, ties and clashing columns; and an empty table."""
    docs = odd_documents(spark)
    out = stage(spark, docs, sf_dir)
    found = out.select("doc_id").collect()
    ids = {r.doc_id for r in found}
    assert {1, 2, 3, 4, 6} <= ids
    if name == "byte-level BPE":
        assert len(found) == 8
    else:
        assert out.columns == docs.columns
    if name in ("toxicity", "decontamination"):
        assert len(found) == 8
    if name == "near-dedup":
        assert 5 not in ids and sum(r.doc_id == 4 for r in found) == 2
    empty = stage(spark, docs.limit(0), sf_dir)
    assert empty.columns == out.columns and empty.count() == 0
