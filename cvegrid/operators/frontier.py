"""Crawl frontier: new addresses, claims and their fetch schedule."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import content_type, crawl_priority, domain_of
from ..schemas import CLAIM_LIMIT, DOMAIN_RATE


def new_addresses(references: DataFrame, progress: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References without a progress row as pending jobs, and those without a
    web address, which cannot be crawled, for quarantine."""
    fresh = (
        references.select("cve_id", "url").distinct()
        .join(progress.select("cve_id", "url"), ["cve_id", "url"], "left_anti")
        .withColumn("domain", domain_of(F.col("url")))
    )
    jobs = fresh.where(F.col("domain").isNotNull()).select(
        "cve_id", "url", "domain", F.lit("pending").alias("status"), F.lit(0).alias("attempts")
    )
    return jobs, fresh.where(F.col("domain").isNull()).select("cve_id", "url")


def claim(
    progress: DataFrame, vulns: DataFrame, limit: int = CLAIM_LIMIT, by_page_kind: bool = False
) -> DataFrame:
    """The most urgent pending jobs. Jobs of unknown CVEs are never claimed.

    ``by_page_kind`` takes vendor pages before advisories, blogs and exploits.
    """
    ranking = vulns.select("cve_id", F.coalesce("cisa_kev", F.lit(False)).alias("cisa_kev"), "epss_score", "cvss_score")
    order = [
        F.col("cisa_kev").desc(),
        F.col("epss_score").desc_nulls_last(),
        F.col("cvss_score").desc_nulls_last(),
        *([crawl_priority(F.col("url"))] if by_page_kind else []),
        "cve_id",
        "url",
    ]
    return (
        progress.where(F.col("status") == "pending")
        .join(ranking, "cve_id")
        .orderBy(*order)
        .limit(limit)
        .withColumn("content_type", content_type(F.col("url")))
    )


def schedule(claimed: DataFrame, rate: float = DOMAIN_RATE) -> DataFrame:
    """Earliest start in seconds that keeps each domain at ``rate`` fetches a
    second. A claimed batch is bounded by the claim limit."""
    order = Window.partitionBy("domain").orderBy(
        F.col("cisa_kev").desc(), F.col("epss_score").desc_nulls_last(),
        F.col("cvss_score").desc_nulls_last(), "cve_id", "url",
    )
    slot = F.row_number().over(order)
    return claimed.withColumn("slot", slot).withColumn("not_before", (F.col("slot") - 1) / F.lit(rate))
