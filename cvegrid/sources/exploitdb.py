"""Exploit records derived from references that point at the exploit archive."""

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import ARRIVAL
from .base import arrival_seq, conform

# Address pattern and canonical address of an exploit record.
PATTERN = r"exploit-db\.com/exploits/(\d+)"
CANONICAL = "https://www.exploit-db.com/exploits/"


def scan(references: DataFrame) -> DataFrame:
    """(cve_id, exploit number) of every matching reference, once each."""
    # the plain substring test can reach the scan; the pattern alone could not
    hits = references.where(F.col("url").contains("exploit-db.com/exploits/")).select(
        "cve_id", F.regexp_extract("url", PATTERN, 1).alias("number")
    )
    return hits.where(F.col("number") != "").distinct()


def normalize(found: DataFrame, seq: Column) -> DataFrame:
    """One record per exploit. Merging keys on the exploit, so there is no need
    to collect the exploits of a CVE into one record first."""
    return conform(
        found,
        "exploitdb",
        seq,
        F.col("cve_id"),
        exploits=F.array(F.struct(
            F.lit("exploitdb").alias("source"),
            F.col("number").alias("source_id"),
            F.concat(F.lit(CANONICAL), F.col("number")).alias("url"),
            F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("timestamp").alias("discovered_at"),
        )),
    )


def records(references: DataFrame, synced_at) -> DataFrame:
    """Normalized records from the stored references."""
    found = scan(references).withColumn(
        "arrival",
        F.struct(
            F.lit(synced_at).cast("timestamp"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"),
            F.lit(0).cast("bigint"), F.lit(0),
        ).cast(ARRIVAL),
    )
    return normalize(found, arrival_seq("exploitdb", F.lit(synced_at)))
