"""Column functions on odd texts."""

from math import log2

from pyspark.sql import functions as F

from sparklog.functions import scalars as S


def one(spark, value, of):
    return spark.createDataFrame([(value,)], "c string").select(of(F.col("c"))).first()[0]


def test_xml_text_shows_what_xml_cannot_hold(spark):
    assert one(spark, 'a<b & "c"\x01\x1f\n\ufffe é', S.xml_text) == "a&lt;b &amp; &quot;c&quot;\\x01\\x1F\n\\xFFFE é"
    assert one(spark, None, S.xml_text) is None and one(spark, "", S.xml_text) == ""


def test_entropy(spark):
    assert one(spark, "", S.entropy) == 0.0 and one(spark, "aaaa", S.entropy) == 0.0
    text = "a.b\n😀😀|é"
    n = len(text)
    want = -sum(text.count(c) / n * log2(text.count(c) / n) for c in set(text))
    assert abs(one(spark, text, S.entropy) - want) < 1e-9
