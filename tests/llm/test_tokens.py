"""Token counts, files and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from sparklog.llm import bpe, pieces, token_counts, token_files
from sparklog.llm.common import tokenizer_path

SCHEMA = "doc_id long, text string, n_tokens string"
TEXTS = ["", None, "  a  b   c \n  d\t e", "'s don't   I'll\n\n  x <|endoftext|> y<|endoftext|>", "日本語 한국어 😀😀   x", "a" * 5000, "ab" * 3000, "  ", "\n \n", "a \x1c b\x1c c \x85 d", "x\0 y \0z", "same text", "same text"]


def texts():
    random.seed(1)
    return TEXTS + ["".join(random.choice("ab '\n\t.1é<|endoftext|> ") for _ in range(200)) for _ in range(60)]


def docs(spark, values=None):
    return spark.createDataFrame([(i * 3, t, "clash") for i, t in enumerate(texts() if values is None else values)], SCHEMA)


def test_pieces_join_to_the_text():
    for t in texts():
        assert "".join(map(pieces.piece_of, pieces.cut(t or ""))) == (t or "")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(spark, name):
    path = tokenizer_path(name)
    lib = token_counts.library(path)
    got = {r.doc_id: r for r in token_counts.op8(docs(spark), path, 10).collect()}
    for i, t in enumerate(texts()):
        n = len(lib.encode(t or "")) if name.endswith(".model") else len(lib.encode(t or "", add_special_tokens=False).ids)
        r = got[i * 3]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((t or "").encode()), n > 10)


def test_counts_keep_other_columns(spark):
    out = token_counts.token_counts(docs(spark), tokenizer_path("byte_bpe_50k.json"))
    assert out.columns == ["doc_id", "text", "n_tokens"] and out.count() == len(texts())
    assert token_counts.op8(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_token_files(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    lib = token_counts.library(path)
    got = sorted(token_files.op7(docs(spark), path).collect())
    start = 0
    for r, (i, t) in zip(got, enumerate(texts()), strict=True):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 0]
        assert tuple(r) == (i * 3, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.op7(docs(spark, []), path).count() == 0


def test_token_files_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "b"), (5, "a"), (5, "a"), (-1, None)], "doc_id long, text string")
    got = sorted(token_files.op7(df, tokenizer_path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -1, 5, 5] and [r.start for r in got] == [0, 2, 3, 5]


def test_bpe_round_trip(spark):
    import tiktoken

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=pieces.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.bpe_round_trip(docs(spark), path, keep_ids=True).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode_ordinary(t or "")
        r = got[i * 3]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(docs(spark, []), path).count() == 0


def test_very_long_pre_token():
    import tiktoken

    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    v = bpe.vocabulary(path)
    random.seed(2)
    word = "".join(random.choice("etaoinshrd") for _ in range(50_000))
    lib = tiktoken.Encoding("own", pat_str=pieces.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    assert list(v.merge(word.encode())) == lib.encode_ordinary(word)


def test_merges_of_any_vocabulary():
    """Ranks that come up while a bucket is worked on go first, as in the library."""
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(2)
    cases = [([b"bcbc", b"abc", b"bc"], [b"abcbc", b"", b"a"])]
    for _ in range(60):
        letters = b"abc"[: rng.choice([1, 2, 3])]
        word = lambda most: bytes(rng.choice(letters) for _ in range(rng.randint(1, most)))
        cases.append((list({word(5) for _ in range(rng.randint(1, 25))} - {bytes([b]) for b in letters}), [word(60) for _ in range(40)]))
    for tokens, words in cases:
        ranks = {bytes([i]): i for i in range(256)} | {t: 300 + i for i, t in enumerate(tokens)}
        lib = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        v = bpe.Vocabulary(ranks)
        expected = [lib._encode_single_piece(w) if w else [] for w in words]
        for many in (1, 3, bpe._MANY):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(bpe, "_MANY", many)
                assert [np.frombuffer(x, np.int32).tolist() for x in v.merge_all(words)] == expected
