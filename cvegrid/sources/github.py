"""Reviewed package advisories: arrays of advisory records."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import blank_to_null, parse_instant
from ..functions.severity import known_level
from .base import Source, arrival, conform

_SCORE = "STRUCT<score: DOUBLE, vector_string: STRING>"

SCHEMA = (
    "ghsa_id STRING, cve_id STRING, type STRING, summary STRING, description STRING, severity STRING, "
    f"cvss_severities STRUCT<cvss_v3: {_SCORE}, cvss_v4: {_SCORE}>, "
    "epss STRUCT<percentage: DOUBLE, percentile: DOUBLE>, published_at STRING, updated_at STRING, "
    "vulnerabilities ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>, "
    "vulnerable_version_range: STRING, first_patched_version: STRING>>, references ARRAY<STRING>"
)

_FIELDS = [
    "ghsa_id", "cve_id", "type", "summary", "description", "severity", "cvss_severities", "epss",
    "published_at", "updated_at", "vulnerabilities", "references",
]


def unpack(landed: DataFrame) -> DataFrame:
    """Only reviewed advisories that name a CVE; files without a type are reviewed already."""
    reviewed = F.coalesce(F.col("type"), F.lit("reviewed")) == "reviewed"
    return landed.where((F.col("cve_id") != "") & reviewed).select(
        "cve_id", F.struct(*_FIELDS).alias("payload"), arrival().alias("arrival")
    )


def since(raw: DataFrame, start, now) -> DataFrame:
    return raw.where(parse_instant(F.col("payload.updated_at")).between(F.lit(start), F.lit(now)))


def normalize(raw: DataFrame, seq: Column) -> DataFrame:
    p = lambda name: F.col(f"payload.{name}")
    v3, v4 = p("cvss_severities.cvss_v3"), p("cvss_severities.cvss_v4")

    def labelled(entry: Column, version: str) -> Column:
        return F.when(
            entry.getField("score").isNotNull(),
            F.struct(
                entry.getField("score").alias("score"),
                entry.getField("vector_string").alias("vector"),
                F.lit(version).alias("version"),
            ),
        )

    raw = raw.withColumn("_cvss", F.coalesce(labelled(v3, "3.1"), labelled(v4, "4.0")))
    return conform(
        raw,
        "github",
        seq,
        F.col("cve_id"),
        description=F.coalesce(blank_to_null(p("description")), p("summary")),
        cvss_score=F.col("_cvss.score"),
        cvss_vector=F.col("_cvss.vector"),
        cvss_version=F.col("_cvss.version"),
        epss_score=p("epss.percentage") / 100.0,
        epss_percentile=p("epss.percentile") / 100.0,
        severity=known_level(p("severity")),
        published_at=parse_instant(p("published_at")),
        modified_at=parse_instant(p("updated_at")),
        affected_packages=F.transform(
            F.filter(p("vulnerabilities"), lambda v: v["package"]["name"] != ""),
            lambda v: F.struct(
                v["package"]["ecosystem"].alias("ecosystem"),
                v["package"]["name"].alias("package_name"),
                v["vulnerable_version_range"].alias("vulnerable_versions"),
                v["first_patched_version"].alias("patched_version"),
            ),
        ),
        # a reference that is an object arrives as its JSON text
        references=F.transform(
            F.filter(p("references"), lambda r: ~r.startswith("{") & ~r.startswith("[")),
            lambda r: F.struct(r.alias("url"), F.lit(None).cast("string").alias("ref_type")),
        ),
    )


GITHUB = Source("github", SCHEMA, "json", unpack, since, normalize, {"multiLine": "true"})
