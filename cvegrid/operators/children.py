"""Sub-records of retrieved CVEs: packages, exploits, references.

They stay one row per sub-record. Lists and texts per CVE are only built where
their size is known to be bounded.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import shorten

CHILD_COLUMNS = ["cve_id", "kind", "key1", "key2", "key3", "value1", "value2", "segment"]


def _given(col: Column, before: str, after: str = "") -> Column:
    """``before + col + after``, or '' where the value is missing or empty."""
    return F.when(col != "", F.concat(F.lit(before), col, F.lit(after))).otherwise("")


def package_segment() -> Column:
    """``name (ecosystem) versions V — patched in P``."""
    return F.concat(
        F.col("package_name"),
        _given(F.col("ecosystem"), " (", ")"),
        _given(F.col("vulnerable_versions"), " versions "),
        _given(F.col("patched_version"), " — patched in "),
    )


def exploit_segment() -> Column:
    """``source: url``, else ``source: description`` shortened, else ``source``."""
    return F.concat(
        F.col("source"),
        F.when(F.col("url") != "", F.concat(F.lit(": "), "url")).otherwise(
            _given(shorten(F.col("description"), 120), ": ")
        ),
    )


def children_of(
    winners: DataFrame, packages: DataFrame, exploits: DataFrame, references: DataFrame
) -> DataFrame:
    """All sub-records of the retrieved CVEs, one row each.

    ``key1..3`` are the natural key and the order inside a CVE, ``value1..2``
    the remaining fields, ``segment`` the text used in a context block.
    """
    ids = winners.select("cve_id").distinct()

    def rows(table: DataFrame, kind: str, keys: list[str], values: list[str], segment: Column) -> DataFrame:
        text = [F.coalesce(F.col(k), F.lit("")) for k in keys] + [F.lit("")] * (3 - len(keys))
        return table.join(ids, "cve_id", "left_semi").select(
            "cve_id",
            F.lit(kind).alias("kind"),
            *[t.alias(f"key{i + 1}") for i, t in enumerate(text)],
            *[F.col(v).alias(f"value{i + 1}") for i, v in enumerate(values)],
            segment.alias("segment"),
        )

    return reduce(DataFrame.unionByName, [
        rows(packages, "package", ["ecosystem", "package_name", "source"],
             ["vulnerable_versions", "patched_version"], package_segment()),
        rows(exploits, "exploit", ["source", "source_id"], ["url", "description"], exploit_segment()),
        rows(references.withColumn("_none", F.lit(None).cast("string")), "reference", ["url"],
             ["_none", "_none"], F.col("url")),
    ])


def sizes(children: DataFrame) -> DataFrame:
    """Number and total text length of a CVE's sub-records per kind."""
    return children.groupBy("cve_id", "kind").agg(
        F.count("*").alias("n"), F.sum(F.length("segment")).alias("chars")
    )
