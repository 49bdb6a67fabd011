"""Awkward documents shared by the operators' tests."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, "the cat sat on the mat and then the cat ran", "en", None, 1),
    (4, "the cat sat on the mat and then the cat ran", "en", "a", 1),
    (4, "the cat sat on the mat and then the cat ran", "en", "a", 1),
    (5, "one", "en", "a", 1),
    (6, " \t\n ", "en", "a", 1),
    (7, "12345 --- !!!", "de", "a", 1),
    (8, "été ñandú straße  double  spaces \n\n and lines ", "fr", "a", 1),
    (None, "a row without an id", "en", "a", 1),
    (9, "long " * 30_000 + "end", "en", "a", 1),
    (10, " odd\x1cseparators\x85 and 日本語 text 😀", "ja", "a", 1),
]


def awkward(spark, extra: bool = False):
    df = spark.createDataFrame(AWKWARD, DOCS)
    if extra:  # names that operators use inside
        from pyspark.sql import functions as F

        for name in ("id", "fp", "component", "node", "label", "length", "shard", "rank", "score", "n", "ids", "start", "url_hash"):
            df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
