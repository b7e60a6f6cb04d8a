"""Open-source advisories: one JSON document per advisory, landed as files or archives."""

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import blank_to_null, parse_instant
from ..functions.severity import known_level
from .base import Source, arrival, conform, first, last_present

RECORD = (
    "id STRING, aliases ARRAY<STRING>, summary STRING, details STRING, "
    "severity ARRAY<STRUCT<type: STRING, score: STRING>>, "
    "affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>, "
    "ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<STRUCT<introduced: STRING, fixed: STRING>>>>, "
    "ecosystem_specific: STRUCT<severity: STRING>, database_specific: STRUCT<severity: STRING>>>, "
    "references ARRAY<STRUCT<type: STRING, url: STRING>>, published STRING, modified STRING"
)

_MEMBERS = "_landed_at TIMESTAMP, _file_id BIGINT, _block BIGINT, item INT, json STRING"
_BATCH = 2_000


def open_archives(landed: DataFrame) -> DataFrame:
    """Zip archives to one row per JSON member.

    An archive cannot be split, so one task opens each; the members are then
    spread over the cluster before anything is parsed.
    """
    archives = landed.select("content", "_landed_at", "_file_id", "_block")
    return archives.mapInPandas(_members, _MEMBERS).repartition("_file_id", "item")


def _members(batches):
    """Archive members as JSON text, a bounded batch at a time."""
    for archives in batches:
        columns = (archives[c] for c in ("content", "_landed_at", "_file_id", "_block"))
        for content, landed_at, file_id, block in zip(*columns):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                names = [n for n in archive.namelist() if n.endswith(".json")]
                for start in range(0, len(names), _BATCH):
                    part = names[start:start + _BATCH]
                    yield pd.DataFrame({
                        "_landed_at": landed_at,
                        "_file_id": file_id,
                        "_block": block,
                        "item": range(start, start + len(part)),
                        "json": [archive.read(n).decode("utf-8") for n in part],
                    })


def parse(members: DataFrame) -> DataFrame:
    return members.withColumn("payload", F.from_json("json", RECORD)).drop("json")


def _cve_aliases(aliases: Column) -> Column:
    return F.filter(aliases, lambda a: a.startswith("CVE-"))


def fan_out(records: DataFrame, first_alias_only: bool = False) -> DataFrame:
    """One row per CVE alias; without aliases the record's own CVE id, else no row.

    ``first_alias_only`` files every copy under the first alias.
    """
    aliases = F.coalesce(_cve_aliases(F.col("payload.aliases")), F.array().cast("array<string>"))
    own = F.when(F.col("payload.id").startswith("CVE-"), F.array("payload.id"))
    ids = F.when(F.size(aliases) > 0, aliases).otherwise(own)
    if first_alias_only:
        ids = F.transform(ids, lambda _: first(ids))
    return records.select(F.explode(ids).alias("cve_id"), "payload", "arrival")


def unpack(landed: DataFrame) -> DataFrame:
    members = parse(open_archives(landed))
    return fan_out(members.select("payload", arrival(row=F.col("item")).alias("arrival")))


_FIELDS = ["id", "aliases", "summary", "details", "severity", "affected", "references", "published", "modified"]


def unpack_files(landed: DataFrame) -> DataFrame:
    """Advisories landed one per line or file instead of in an archive."""
    return fan_out(landed.select(F.struct(*_FIELDS).alias("payload"), arrival().alias("arrival")))


def since(raw: DataFrame, start, now) -> DataFrame:
    """Records without a modification time are kept."""
    modified = parse_instant(F.col("payload.modified"))
    return raw.where(F.col("payload.modified").isNull() | (F.col("payload.modified") == "") | (modified >= F.lit(start)))


def version_ranges(ranges: Column) -> Column:
    """Text and last fix of a package's ecosystem ranges, as (patched, parts).

    A range without a fix takes over the fix of the ranges before it.
    """
    def step(acc, r):
        introduced = last_present(F.transform(r.events, lambda e: e.introduced))
        fixed = F.coalesce(last_present(F.transform(r.events, lambda e: e.fixed)), acc.patched)
        lower = F.when(introduced == "0", F.lit("*")).otherwise(F.concat(F.lit(">="), introduced))
        upper = F.when(fixed != "", F.concat(F.lit(", <"), fixed)).otherwise(F.lit(""))
        grown = F.concat(acc.parts, F.array(F.concat(lower, upper)))
        return F.struct(
            fixed.alias("patched"),
            F.when(introduced.isNotNull(), grown).otherwise(acc.parts).alias("parts"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("patched"), F.array().cast("array<string>").alias("parts")
    )
    usable = F.filter(
        F.coalesce(ranges, F.array().cast(
            "array<struct<type:string,events:array<struct<introduced:string,fixed:string>>>>"
        )),
        lambda r: r.type == "ECOSYSTEM",
    )
    return F.aggregate(usable, start, step)


def _package(affected: Column) -> Column:
    found = version_ranges(affected.ranges)
    return F.struct(
        affected["package"]["ecosystem"].alias("ecosystem"),
        affected["package"]["name"].alias("package_name"),
        F.nullif(F.array_join(found.getField("parts"), ", "), F.lit("")).alias("vulnerable_versions"),
        found.getField("patched").alias("patched_version"),
    )


def normalize(raw: DataFrame, seq: Column) -> DataFrame:
    p = lambda name: F.col(f"payload.{name}")
    raw = raw.withColumn(
        "_affected",
        F.filter(p("affected"), lambda a: (a["package"]["ecosystem"] != "") & (a["package"]["name"] != "")),
    ).withColumn("_score", first(F.filter(p("severity"), lambda s: s.score != "")))
    levels = F.transform(
        F.col("_affected"),
        lambda a: known_level(F.coalesce(
            blank_to_null(a["ecosystem_specific"]["severity"]), a["database_specific"]["severity"]
        )),
    )
    return conform(
        raw,
        "osv",
        seq,
        F.col("cve_id"),
        description=F.coalesce(blank_to_null(p("details")), p("summary")),
        cvss_vector=F.col("_score.score"),
        cvss_version=F.when(F.col("_score.type") == "CVSS_V3", "3.1").when(F.col("_score.type") == "CVSS_V4", "4.0"),
        severity=first(F.filter(levels, lambda x: x.isNotNull())),
        published_at=parse_instant(p("published")),
        modified_at=parse_instant(p("modified")),
        affected_packages=F.transform("_affected", _package),
        references=F.transform(
            F.filter(p("references"), lambda r: r.url != ""),
            lambda r: F.struct(r.url.alias("url"), blank_to_null(F.lower(r.type)).alias("ref_type")),
        ),
    )


OSV = Source("osv", "", "binaryFile", unpack, since, normalize, {"pathGlobFilter": "*.zip"})
OSV_FILES = Source("osv", RECORD, "json", unpack_files, since, normalize)
