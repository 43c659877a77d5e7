"""Manifests of files as Spark's readers see them."""

import hashlib
import os
import random
import tempfile

from sparklog.sources import files


def test_manifest_of_long_files(spark, monkeypatch):
    """Files over a length are read as lines and a batch at a time: bytes of any kind, whatever they begin and end with."""
    monkeypatch.setattr(files, "WHOLE", 8, raising=False)
    # before, a file over this length was an error, as one over 2 GB
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 20)
    rng, folder, mark = random.Random(3), tempfile.mkdtemp(prefix="spark-"), b"\xef\xbb\xbf"
    noise = bytes(rng.choice([10, 13, 0, 255, rng.randrange(256)]) for _ in range(200_000))
    made = {"short": b"ab\n\n", "lines": b"\n" * 30, "one": b"x" * 30, "ended": b"a\r\nb\n\nc" * 9 + b"\n", "noise": noise, "ended noise": noise + b"\n\n", "mark": mark + noise[:1000] + b"x", "mark and end": mark + mark + noise + b"\n", "a%20[b] c": noise[:99]}
    made = {f"{k}.parquet": v for k, v in made.items()}
    os.mkdir(f"{folder}/part.parquet")
    for name, data in made.items():
        with open(f"{folder}/{'part.parquet/' if name == 'noise.parquet' else ''}{name}", "wb") as f:
            f.write(data)
    try:
        found = sorted(map(tuple, files.manifest(spark, f"{folder}/*.parquet").collect()))
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert found == sorted((k, len(v), hashlib.sha256(v).hexdigest()) for k, v in made.items())
