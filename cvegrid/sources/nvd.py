"""National vulnerability feed: pages of CVE records."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parsing import blank_to_null, parse_instant, parse_iso_date
from ..schemas import NVD_TAG_TYPES
from .base import Source, arrival, conform, first

_METRICS = (
    "ARRAY<STRUCT<type: STRING, baseSeverity: STRING, cvssData: STRUCT<baseScore: DOUBLE, "
    "vectorString: STRING, version: STRING, baseSeverity: STRING>>>"
)

CVE = (
    "STRUCT<id: STRING, vulnStatus: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>, "
    f"metrics: STRUCT<cvssMetricV31: {_METRICS}, cvssMetricV40: {_METRICS}, cvssMetricV2: {_METRICS}>, "
    "published: STRING, lastModified: STRING, cisaActionDue: STRING, "
    "references: ARRAY<STRUCT<url: STRING, tags: ARRAY<STRING>>>>"
)

SCHEMA = f"totalResults INT, vulnerabilities ARRAY<STRUCT<cve: {CVE}>>"


def unpack(landed: DataFrame) -> DataFrame:
    items = landed.select("_landed_at", "_file_id", "_block", F.posexplode("vulnerabilities").alias("item", "v"))
    return items.where(F.col("v.cve.id") != "").select(
        F.col("v.cve.id").alias("cve_id"), F.col("v.cve").alias("payload"), arrival(F.col("item")).alias("arrival")
    )


def since(raw: DataFrame, start, now) -> DataFrame:
    """The feed's server-side window on the last modification."""
    return raw.where(parse_instant(F.col("payload.lastModified")).between(F.lit(start), F.lit(now)))


def _primary(metrics: Column) -> Column:
    return F.coalesce(first(F.filter(metrics, lambda m: m.type == "Primary")), first(metrics))


def _ref_type(tags: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in NVD_TAG_TYPES.items() for x in kv])
    known = F.filter(tags, lambda t: t.isin(*NVD_TAG_TYPES))
    return F.try_element_at(table, first(known))


def normalize(raw: DataFrame, seq: Column) -> DataFrame:
    p = lambda name: F.col(f"payload.{name}")
    metric = F.coalesce(
        _primary(p("metrics.cvssMetricV31")),
        _primary(p("metrics.cvssMetricV40")),
        _primary(p("metrics.cvssMetricV2")),
    )
    raw = raw.withColumn("_metric", metric)
    chosen = F.coalesce(first(F.filter(p("descriptions"), lambda d: d.lang == "en")), first(p("descriptions")))
    return conform(
        raw,
        "nvd",
        seq,
        F.col("cve_id"),
        description=chosen.getField("value"),
        cvss_score=F.col("_metric.cvssData.baseScore"),
        cvss_vector=F.col("_metric.cvssData.vectorString"),
        cvss_version=F.col("_metric.cvssData.version"),
        severity=F.coalesce(blank_to_null(F.col("_metric.cvssData.baseSeverity")), F.col("_metric.baseSeverity")),
        cisa_kev=p("cisaActionDue").isNotNull(),
        cisa_kev_due_date=parse_iso_date(p("cisaActionDue")),
        published_at=parse_instant(p("published")),
        modified_at=parse_instant(p("lastModified")),
        # any status: a later one takes a rejection back
        record_status=F.upper(blank_to_null(p("vulnStatus"))),
        references=F.transform(
            F.filter(p("references"), lambda r: r.url != ""),
            lambda r: F.struct(r.url.alias("url"), _ref_type(r.tags).alias("ref_type")),
        ),
    )


NVD = Source("nvd", SCHEMA, "json", unpack, since, normalize, {"multiLine": "true"})
