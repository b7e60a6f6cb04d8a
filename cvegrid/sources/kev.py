"""Catalog of vulnerabilities known to be exploited."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import parse_day, parse_iso_date
from .base import Source, arrival, conform

ENTRY = (
    "STRUCT<cveID: STRING, vendorProject: STRING, product: STRING, vulnerabilityName: STRING, "
    "dateAdded: STRING, shortDescription: STRING, requiredAction: STRING, dueDate: STRING, "
    "knownRansomwareCampaignUse: STRING, notes: STRING>"
)

SCHEMA = f"title STRING, catalogVersion STRING, count INT, vulnerabilities ARRAY<{ENTRY}>"


def unpack(landed: DataFrame) -> DataFrame:
    items = landed.select("_landed_at", "_file_id", "_block", F.posexplode("vulnerabilities").alias("item", "payload"))
    return items.where(F.col("payload.cveID") != "").select(
        F.col("payload.cveID").alias("cve_id"), "payload", arrival(F.col("item")).alias("arrival")
    )


def since(raw: DataFrame, start, now) -> DataFrame:
    """Entries whose date is missing or unreadable are kept."""
    added = parse_day(F.col("payload.dateAdded"))
    return raw.where(added.isNull() | (added >= F.lit(start)))


def normalize(raw: DataFrame, seq: Column) -> DataFrame:
    p = lambda name: F.col(f"payload.{name}")
    note = F.struct(p("notes").alias("url"), F.lit("advisory").alias("ref_type"))
    return conform(
        raw,
        "cisa_kev",
        seq,
        F.col("cve_id"),
        description=p("shortDescription"),
        cisa_kev=F.lit(True),
        cisa_kev_due_date=parse_iso_date(p("dueDate")),
        published_at=parse_day(p("dateAdded")),
        references=F.when(p("notes").startswith("http"), F.array(note)),
    )


KEV = Source("cisa_kev", SCHEMA, "json", unpack, since, normalize, {"multiLine": "true"}, every=86_400)
