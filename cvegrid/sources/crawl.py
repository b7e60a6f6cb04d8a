"""Landed crawl results: fetched pages and vectors."""

from pyspark.sql import DataFrame, functions as F

from ..functions.text import html_text
from ..schemas import EMBEDDING_WIDTH, MAX_BODY_BYTES


def fetched(pages: DataFrame) -> DataFrame:
    """Pages ``(cve_id, url, status, body)`` to ``(cve_id, url, body, error)``.

    Only status 200 counts as fetched; bodies are cut at the transfer limit.
    """
    ok = F.col("status") == 200
    return pages.select(
        "cve_id",
        "url",
        F.when(ok, F.substring(F.col("body"), 1, MAX_BODY_BYTES)).alias("body"),
        F.when(~ok, F.format_string("HTTP %d for %s", "status", "url")).alias("error"),
    )


def extracted(pages: DataFrame) -> DataFrame:
    """Adds ``text`` to fetched pages; '' means that the page gave nothing."""
    body = F.make_valid_utf8(F.col("body").cast("string"))
    return pages.withColumn("text", F.when(F.col("error").isNull(), html_text(body)).otherwise(""))


def valid_vectors(vectors: DataFrame, width: int = EMBEDDING_WIDTH) -> DataFrame:
    """Vectors of the wrong width are no vectors."""
    return vectors.where(F.size("embedding") == width)
