"""Daily exploit-probability snapshot: gzip CSV with comment lines."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import parse_float
from .base import Source, arrival, conform

SCHEMA = "cve STRING, epss STRING, percentile STRING"


def unpack(landed: DataFrame) -> DataFrame:
    return landed.where(F.col("cve") != "").select(
        F.col("cve").alias("cve_id"), F.struct("cve", "epss", "percentile").alias("payload"), arrival().alias("arrival")
    )


def since(raw: DataFrame, start, now) -> DataFrame:
    """Every snapshot is complete, so nothing is skipped."""
    return raw


def normalize(raw: DataFrame, seq: Column) -> DataFrame:
    return conform(
        raw,
        "epss",
        seq,
        F.col("cve_id"),
        epss_score=parse_float(F.col("payload.epss")),
        epss_percentile=parse_float(F.col("payload.percentile")),
    )


EPSS = Source("epss", SCHEMA, "csv", unpack, since, normalize, {"header": "true", "comment": "#"},
              every=86_400, snapshot=True)
