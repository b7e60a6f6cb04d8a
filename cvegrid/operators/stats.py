"""Counts and status reports."""

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..schemas import REFRESH_SECONDS


def corpus_counts(vulns: DataFrame, packages: DataFrame, exploits: DataFrame, references: DataFrame) -> DataFrame:
    """``(metric, value)`` rows; the CVE table is read once for both its figures."""
    main = vulns.agg(
        F.count("*").alias("vulnerabilities"), F.count_if(F.col("cisa_kev")).alias("kev_entries")
    ).select(F.expr("stack(2, 'vulnerabilities', vulnerabilities, 'kev_entries', kev_entries) AS (metric, value)"))
    others = {"affected_packages": packages, "exploits": exploits, "cve_references": references}
    counts = [t.agg(F.count("*").alias("value")).select(F.lit(n).alias("metric"), "value") for n, t in others.items()]
    return reduce(DataFrame.unionByName, counts, main)


def severity_histogram(vulns: DataFrame) -> DataFrame:
    known = vulns.where(F.col("severity").isNotNull())
    return known.groupBy("severity").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "severity")


def source_contribution(vulns: DataFrame) -> DataFrame:
    """CVEs per contributing feed."""
    each = vulns.select(F.explode("raw_sources").alias("source"))
    return each.groupBy("source").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "source")


def sync_metadata(run_log: DataFrame) -> DataFrame:
    """Last sync and accumulated record count per feed."""
    return run_log.groupBy("source_name").agg(
        F.max("synced_at").alias("last_successful_sync"), F.sum("records").alias("records_synced")
    )


def sync_status(metadata: DataFrame) -> DataFrame:
    """Report ordered by feed; a feed that never synced says so."""
    last = F.date_format("last_successful_sync", "yyyy-MM-dd HH:mm:ss 'UTC'")
    return metadata.select(
        "source_name", F.coalesce(last, F.lit("never")).alias("last_sync"),
        F.coalesce("records_synced", F.lit(0)).alias("records_synced"),
    ).orderBy("source_name")


def sources_due(
    metadata: DataFrame, now: datetime, intervals: dict[str, int] | None = None, forced: list[str] | None = None
) -> DataFrame:
    """Feeds to run now: never run, or last run at least an interval ago.

    ``forced`` names feeds to run whatever their last sync.
    """
    rows = list((REFRESH_SECONDS if intervals is None else intervals).items())
    known = metadata.sparkSession.createDataFrame(rows, "source_name STRING, every_seconds INT")
    table = known.join(metadata.select("source_name", "last_successful_sync"), "source_name", "left")
    if forced is not None:
        return table.where(F.col("source_name").isin(forced))
    elapsed = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("last_successful_sync")) / 1e6
    return table.where(F.col("last_successful_sync").isNull() | (elapsed >= F.col("every_seconds")))


def funnel(jobs: DataFrame) -> DataFrame:
    """Stage counters of crawl jobs ``(fetched, error, text, embedding, stored)``.

    A fetch that ended in an error counts as fetched too.
    """
    got_text = F.coalesce("text", F.lit("")) != ""
    return jobs.agg(
        F.count("*").alias("discovered"),
        F.count_if("fetched").alias("fetched"),
        F.count_if(F.col("fetched") & F.col("error").isNotNull()).alias("fetch_errors"),
        F.count_if(got_text).alias("extracted"),
        F.count_if(got_text & F.col("embedding").isNotNull()).alias("embedded"),
        F.count_if("stored").alias("stored"),
    )
