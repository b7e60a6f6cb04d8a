"""Small tables that hold the awkward cases: nulls, empty and long texts, repeated rows, clashing columns."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, row string"


def documents(spark: SparkSession, *texts, source=lambda i: f"s{i % 3}") -> DataFrame:
    rows = [(i, t, "en", source(i), len(t or ""), 0.5, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark: SparkSession) -> DataFrame:
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(20_000))
    rows = [
        (1, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, None, None, None),
        (3, " \t\n ", "en", "a", 4, None, None, None),
        (4, long, "en", None, len(long), 1.0, "x", "y"),
        (5, "the quick brown fox jumps over the lazy dog", "en", "b", 43, 1.0, "x", "y"),
        (5, "the quick brown fox jumps over the lazy dog", "en", "b", 43, 1.0, "x", "y"),
        (None, "a row without an id, mail me at joe@example.com", "en", "b", 47, 1.0, "x", "y"),
        (6, "é中文 😀 ñandú́ token=abcdefabcdef123456 x", "es", "c", 40, 1.0, "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
