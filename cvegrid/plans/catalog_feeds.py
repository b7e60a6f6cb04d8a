"""Registered queries: feeds, built as landed JSON from the tables and normalized back."""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import canonical_ecosystem
from ..schemas import ECOSYSTEM_ALIASES
from ..sources import epss, github, kev, nvd, osv
from ..sources.base import arrival, arrival_seq
from .corpus import NOW, Corpus
from .registry import query

_STAMP = "yyyy-MM-dd HH:mm:ss"
_SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"
_SINCE = datetime(2024, 6, 1, tzinfo=timezone.utc)
_SINCE_SQL = "TIMESTAMP '2024-06-01 00:00:00'"

#: Records per landed page.
_PAGE = 200


def _s(col: str) -> Column:
    return F.col(col).cast("string")


def _landed(df: DataFrame, schema: str) -> DataFrame:
    """JSON text, as it would lie in a landing folder, read with the feed's schema.

    Its fields come out of a generator: else a filter on them would write and parse the text again for every field it names.
    """
    parsed = df.select("page", F.inline(F.array(F.from_json("json", schema))))
    return parsed.select(
        *[c for c in parsed.columns if c != "page"],
        F.lit(None).cast("timestamp").alias("_landed_at"),
        F.col("page").cast("bigint").alias("_file_id"),
        F.lit(0).cast("bigint").alias("_block"),
    )


def _paged(records: DataFrame, key: str, item: Column, envelope: str) -> DataFrame:
    """Records collected into pages of a fixed size."""
    pages = records.groupBy(F.floor(F.col(key) / _PAGE).alias("page")).agg(
        F.array_join(F.collect_list(item), ",").alias("items")
    )
    return pages.select("page", F.concat(F.lit(f'{{"{envelope}":['), "items", F.lit("]}")).alias("json"))


def _flat(records: DataFrame) -> DataFrame:
    """Normalized records with plain columns only."""
    texts = {
        "affected_packages": lambda p: F.concat_ws(
            "|", p.ecosystem, p.package_name, F.coalesce(p.vulnerable_versions, F.lit("-")),
            F.coalesce(p.patched_version, F.lit("-"))),
        "references": lambda r: F.concat_ws("|", r.url, F.coalesce(r.ref_type, F.lit("-"))),
    }
    return records.select(
        "cve_id", "description", "cvss_score", "cvss_vector", "cvss_version", "epss_score", "epss_percentile",
        "severity", "cisa_kev", "record_status",
        F.col("cisa_kev_due_date").cast("string").alias("cisa_kev_due_date"),
        F.date_format("published_at", _STAMP).alias("published_at"),
        F.date_format("modified_at", _STAMP).alias("modified_at"),
        *[F.array_join(F.transform(n, f), ";").alias(n) for n, f in texts.items()],
    )


_NOTHING = {
    "description": "NULL::VARCHAR", "cvss_score": "NULL::DOUBLE", "cvss_vector": "NULL::VARCHAR",
    "cvss_version": "NULL::VARCHAR", "epss_score": "NULL::DOUBLE", "epss_percentile": "NULL::DOUBLE",
    "severity": "NULL::VARCHAR", "cisa_kev": "false", "record_status": "NULL::VARCHAR",
    "cisa_kev_due_date": "NULL::VARCHAR", "published_at": "NULL::VARCHAR", "modified_at": "NULL::VARCHAR",
    "affected_packages": "''", "\"references\"": "''",
}


def _select(cve_id: str, source: str, **columns: str) -> str:
    named = {("\"references\"" if k == "references" else k): v for k, v in columns.items()}
    cols = {**_NOTHING, **named}
    return f"SELECT {cve_id} AS cve_id, " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM {source}"


# --- NVD ------------------------------------------------------------------------------

def nvd_pages(c: Corpus) -> DataFrame:
    """Landed pages ``(page, json)``."""
    key, size, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_type")

    def metric(score: Column, version: str, severity_inside: bool, role: Column) -> Column:
        level = F.when(size > 25, "HIGH").otherwise("LOW")
        return F.struct(
            role.alias("type"),
            F.when(F.lit(not severity_inside), level).alias("baseSeverity"),
            F.struct(
                score.alias("baseScore"), F.concat(F.lit(f"CVSS:{version}/"), "p_brand").alias("vectorString"),
                F.lit(version).alias("version"), F.when(F.lit(severity_inside), level).alias("baseSeverity"),
            ).alias("cvssData"),
        )

    second, first = F.lit("Secondary"), F.lit("Primary")
    v31 = F.when(kind == "PROMO", F.array(metric(size / 10, "3.1", True, second), metric(size / 5, "3.1", True, first)))
    v40 = F.when(kind.isin("PROMO", "LARGE"), F.array(metric(size / 8, "4.0", True, second)))
    v2 = F.when(kind.isin("PROMO", "LARGE", "SMALL"), F.array(metric(size / 7, "2.0", False, first))).otherwise(F.array())
    day = F.date_format(F.make_dt_interval((key % 365).cast("int")) + F.lit(datetime(2024, 1, 1)), "yyyy-MM-dd")
    refs = F.array(
        F.struct(F.concat(F.lit("https://a.example/"), key.cast("string")).alias("url"),
                 F.array(F.lit("Broken Link"), F.lit("Vendor Advisory"), F.lit("Patch")).alias("tags")),
        F.struct(F.lit("").alias("url"), F.array(F.lit("Patch")).alias("tags")),
        F.struct(F.concat(F.lit("https://b.example/"), key.cast("string")).alias("url"),
                 F.array(F.lit("Press/Media Coverage")).alias("tags")),
    )
    cve = F.struct(F.struct(
        F.when(key % 50 != 0, F.concat(F.lit("CVE-2024-"), key.cast("string"))).otherwise("").alias("id"),
        F.when(key % 41 == 0, "Rejected").otherwise("Analyzed").alias("vulnStatus"),
        F.when(key % 4 == 0, F.array(F.struct(F.lit("es").alias("lang"), F.upper("p_name").alias("value"))))
        .otherwise(F.array(
            F.struct(F.lit("es").alias("lang"), F.upper("p_name").alias("value")),
            F.struct(F.lit("en").alias("lang"), F.col("p_name").alias("value")),
        )).alias("descriptions"),
        F.struct(v31.alias("cvssMetricV31"), v40.alias("cvssMetricV40"), v2.alias("cvssMetricV2")).alias("metrics"),
        F.concat(day, F.lit("T10:15:30.000")).alias("published"),
        F.when(key % 9 != 0, F.concat(day, F.lit("T11:00:00.000"))).alias("lastModified"),
        F.when(key % 97 == 0, "2024-11-08").alias("cisaActionDue"),
        refs.alias("references"),
    ).alias("cve"))
    return _paged(c.table("part"), "p_partkey", F.to_json(cve), "vulnerabilities")


def nvd_landed(c: Corpus) -> DataFrame:
    return _landed(nvd_pages(c), nvd.SCHEMA)


_NVD_DAY = "TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER))"
_NVD_MODIFIED = f"CASE WHEN p_partkey % 9 <> 0 THEN {_NVD_DAY} + INTERVAL 11 HOUR END"
_NVD_SQL = _select(
    "'CVE-2024-' || CAST(p_partkey AS VARCHAR)", "part WHERE p_partkey % 50 <> 0",
    description="CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END",
    cvss_score="CASE p_type WHEN 'PROMO' THEN p_size / 5 WHEN 'LARGE' THEN p_size / 8 WHEN 'SMALL' THEN p_size / 7 END",
    cvss_vector="CASE p_type WHEN 'PROMO' THEN 'CVSS:3.1/' || p_brand WHEN 'LARGE' THEN 'CVSS:4.0/' || p_brand "
                "WHEN 'SMALL' THEN 'CVSS:2.0/' || p_brand END",
    cvss_version="CASE p_type WHEN 'PROMO' THEN '3.1' WHEN 'LARGE' THEN '4.0' WHEN 'SMALL' THEN '2.0' END",
    severity="CASE WHEN p_type IN ('PROMO', 'LARGE', 'SMALL') THEN CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END END",
    cisa_kev="p_partkey % 97 = 0",
    record_status="CASE WHEN p_partkey % 41 = 0 THEN 'REJECTED' ELSE 'ANALYZED' END",
    cisa_kev_due_date="CASE WHEN p_partkey % 97 = 0 THEN '2024-11-08' END",
    published_at=f"strftime({_NVD_DAY} + INTERVAL 36930 SECOND, {_SQL_STAMP})",
    modified_at=f"strftime({_NVD_MODIFIED}, {_SQL_STAMP})",
    references="'https://a.example/' || CAST(p_partkey AS VARCHAR) || '|advisory;https://b.example/' || "
               "CAST(p_partkey AS VARCHAR) || '|-'",
)


@query("normalize_nvd", _NVD_SQL)
def normalize_nvd(c: Corpus) -> DataFrame:
    return _flat(nvd.NVD.records(nvd_landed(c), NOW))


@query("scan_nvd_window", f"""SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id FROM part
WHERE p_partkey % 50 <> 0 AND {_NVD_MODIFIED} BETWEEN {_SINCE_SQL} AND TIMESTAMP '2024-12-31 06:00:00'""")
def scan_nvd_window(c: Corpus) -> DataFrame:
    return nvd.NVD.since(nvd.NVD.unpack(nvd_landed(c)), _SINCE, NOW).select("cve_id")


# --- GitHub -----------------------------------------------------------------------------

def github_landed(c: Corpus) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    score = lambda s, v: F.struct(s.alias("score"), v.alias("vector_string"))
    none = F.lit(None)
    package = lambda name, rng: F.struct(
        F.struct(F.lit("pip").alias("ecosystem"), name.alias("name")).alias("package"),
        rng.alias("vulnerable_version_range"), F.lit("3.4.6").alias("first_patched_version"))
    advisory = F.struct(
        F.concat(F.lit("GHSA-"), _s("p_partkey")).alias("ghsa_id"),
        F.when(key % 20 != 0, F.concat(F.lit("CVE-2024-"), _s("p_partkey"))).alias("cve_id"),
        F.when(key % 3 != 0, F.when(key % 30 == 1, "unreviewed").otherwise("reviewed")).alias("type"),
        F.col("p_name").alias("summary"),
        F.when(key % 2 == 0, F.concat(F.lit("About "), "p_name")).otherwise("").alias("description"),
        F.when(size % 5 == 0, "unknown").when(size % 5 == 1, "critical").when(size % 5 == 2, "Low").alias("severity"),
        F.struct(
            score(F.when(size > 30, size / 5.0), F.concat(F.lit("V3/"), "p_brand")).alias("cvss_v3"),
            score(F.when(size > 10, size / 6.0), F.concat(F.lit("V4/"), "p_brand")).alias("cvss_v4"),
        ).alias("cvss_severities"),
        F.struct((size * 2.0).alias("percentage"), F.when(size > 9, size * 1.5).alias("percentile")).alias("epss"),
        F.date_format(F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((key % 365).cast("int")), "yyyy-MM-dd'T'08:00:00'Z'")
        .alias("published_at"),
        F.date_format(F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((key % 365).cast("int")), "yyyy-MM-dd'T'09:30:00'Z'")
        .alias("updated_at"),
        F.array(
            package(F.concat(F.lit("lib"), _s("p_size")), F.lit(">=3.1.0, <3.4.6")),
            package(F.lit(""), F.lit("< 1")),
            package(F.lit("tool"), none.cast("string")),
        ).alias("vulnerabilities"),
    )
    refs = F.concat(
        F.lit('"references":["https://r.example/'), _s("p_partkey"), F.lit('",{"url":"https://ignored.example"}]}'))
    text = F.to_json(advisory)
    json = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(","), refs)
    # pages are dealt while their rows are narrow: a table of few megabytes is read by one task, which would build them all
    rows = c.table("part").withColumn("page", F.floor(key / _PAGE)).repartition("page").sortWithinPartitions("page", "p_partkey")
    return _landed(rows.select(json.alias("json"), "page"), github.SCHEMA)


_GH_DAY = "TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER))"
_GH_FROM = "part WHERE p_partkey % 20 <> 0 AND NOT (p_partkey % 3 <> 0 AND p_partkey % 30 = 1)"


@query("normalize_github", _select(
    "'CVE-2024-' || CAST(p_partkey AS VARCHAR)", _GH_FROM,
    description="CASE WHEN p_partkey % 2 = 0 THEN 'About ' || p_name ELSE p_name END",
    cvss_score="CASE WHEN p_size > 30 THEN p_size / 5.0 WHEN p_size > 10 THEN p_size / 6.0 END",
    cvss_vector="CASE WHEN p_size > 30 THEN 'V3/' || p_brand WHEN p_size > 10 THEN 'V4/' || p_brand END",
    cvss_version="CASE WHEN p_size > 30 THEN '3.1' WHEN p_size > 10 THEN '4.0' END",
    epss_score="p_size * 2.0::DOUBLE / 100",
    epss_percentile="CASE WHEN p_size > 9 THEN p_size * 1.5::DOUBLE / 100 END",
    severity="CASE p_size % 5 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'LOW' END",
    published_at=f"strftime({_GH_DAY} + INTERVAL 8 HOUR, {_SQL_STAMP})",
    modified_at=f"strftime({_GH_DAY} + INTERVAL 34200 SECOND, {_SQL_STAMP})",
    affected_packages="'pip|lib' || CAST(p_size AS VARCHAR) || '|>=3.1.0, <3.4.6|3.4.6;pip|tool|-|3.4.6'",
    references="'https://r.example/' || CAST(p_partkey AS VARCHAR) || '|-'",
))
def normalize_github(c: Corpus) -> DataFrame:
    return _flat(github.GITHUB.records(github_landed(c), NOW))


@query("scan_github_window", f"""SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id FROM {_GH_FROM}
AND {_GH_DAY} + INTERVAL 34200 SECOND BETWEEN {_SINCE_SQL} AND TIMESTAMP '2024-12-31 06:00:00'""")
def scan_github_window(c: Corpus) -> DataFrame:
    return github.GITHUB.since(github.GITHUB.unpack(github_landed(c)), _SINCE, NOW).select("cve_id")


# --- OSV --------------------------------------------------------------------------------

def osv_members(c: Corpus) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"))
    none = F.lit(None).cast("string")
    rng = lambda kind, *events: F.struct(F.lit(kind).alias("type"), F.array(*events).alias("events"))
    n = _s("p_size")
    affected = lambda eco, name, ranges, es, ds: F.struct(
        F.struct(eco.alias("ecosystem"), name.alias("name")).alias("package"), ranges.alias("ranges"),
        F.struct(es.alias("severity")).alias("ecosystem_specific"), F.struct(ds.alias("severity")).alias("database_specific"))
    record = F.struct(
        F.when(key % 7 == 0, F.concat(F.lit("CVE-2023-"), _s("p_partkey"))).otherwise(
            F.concat(F.lit("OSV-"), _s("p_partkey"))).alias("id"),
        F.when(key % 3 == 0, F.array(F.lit("GHSA-x"), F.concat(F.lit("CVE-2024-"), _s("p_partkey")),
                                     F.concat(F.lit("CVE-2025-"), _s("p_partkey")))).alias("aliases"),
        F.col("p_name").alias("summary"),
        F.when(key % 2 == 0, "").otherwise(F.concat(F.lit("Details of "), "p_name")).alias("details"),
        F.array(F.struct(F.lit("CVSS_V2").alias("type"), F.lit("").alias("score")),
                F.struct(F.when(size % 3 == 0, "CVSS_V3").when(size % 3 == 1, "CVSS_V4").otherwise("Ubuntu").alias("type"),
                         F.concat(F.lit("S/"), "p_brand").alias("score"))).alias("severity"),
        F.array(
            affected(F.lit(""), F.lit("nameless"), F.array(rng("ECOSYSTEM", event(F.lit("1"), none))),
                     F.lit("CRITICAL"), none),
            affected(F.lit("PyPI"), F.concat(F.lit("pkg"), n), F.array(
                rng("GIT", event(F.lit("abc"), F.lit("def"))),
                rng("ECOSYSTEM", event(F.lit("0"), none), event(none, n)),
                rng("ECOSYSTEM", event(F.concat(n, F.lit(".5")), none)),
            ), F.when(size % 2 == 0, "unknown").otherwise(""), F.when(size % 4 == 1, "moderate")),
            affected(F.lit("npm"), F.concat(F.lit("js"), n), F.array(
                rng("SEMVER", event(F.lit("1"), F.lit("2")))), none, F.when(size > 25, "high")),
        ).alias("affected"),
        F.array(F.struct(F.lit("WEB").alias("type"), F.concat(F.lit("https://w.example/"), _s("p_partkey")).alias("url")),
                F.struct(F.lit("").alias("type"), F.lit("https://plain.example").alias("url"))).alias("references"),
        F.date_format(F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((key % 365).cast("int")), "yyyy-MM-dd'T'01:00:00'Z'")
        .alias("published"),
        F.when(key % 5 != 0, F.date_format(F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((key % 365).cast("int")),
                                           "yyyy-MM-dd'T'02:00:00")).alias("modified"),
    )
    return c.table("part").select(
        F.to_json(record).alias("json"), F.lit(None).cast("timestamp").alias("_landed_at"),
        F.floor(key / _PAGE).alias("_file_id"), F.lit(0).cast("bigint").alias("_block"), (key % _PAGE).cast("int").alias("item"),
    )


def osv_raw(c: Corpus, first_alias_only: bool = False) -> DataFrame:
    members = osv.parse(osv_members(c))
    return osv.fan_out(members.select("payload", arrival(row=F.col("item")).alias("arrival")), first_alias_only)


_OSV_IDS = """ids AS (
  SELECT *, unnest(CASE WHEN p_partkey % 3 = 0 THEN ['CVE-2024-' || CAST(p_partkey AS VARCHAR),
      'CVE-2025-' || CAST(p_partkey AS VARCHAR)]
    WHEN p_partkey % 7 = 0 THEN ['CVE-2023-' || CAST(p_partkey AS VARCHAR)] ELSE [] END) AS cve,
    TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) AS day, CAST(p_size AS VARCHAR) AS n FROM part)"""
_OSV_MODIFIED = "CASE WHEN p_partkey % 5 <> 0 THEN day + INTERVAL 2 HOUR END"


@query("normalize_osv", f"WITH {_OSV_IDS} " + _select(
    "cve", "ids",
    description="CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Details of ' || p_name END",
    cvss_vector="'S/' || p_brand",
    cvss_version="CASE p_size % 3 WHEN 0 THEN '3.1' WHEN 1 THEN '4.0' END",
    severity="CASE WHEN p_size % 4 = 1 THEN 'MODERATE' WHEN p_size > 25 THEN 'HIGH' END",
    published_at=f"strftime(day + INTERVAL 1 HOUR, {_SQL_STAMP})",
    modified_at=f"strftime({_OSV_MODIFIED}, {_SQL_STAMP})",
    affected_packages="'PyPI|pkg' || n || '|*, <' || n || ', >=' || n || '.5, <' || n || '|' || n || ';npm|js' || n || '|-|-'",
    references="'https://w.example/' || CAST(p_partkey AS VARCHAR) || '|web;https://plain.example|-'",
))
def normalize_osv(c: Corpus) -> DataFrame:
    return _flat(osv.normalize(osv_raw(c), arrival_seq("osv", F.lit(NOW))))


@query("osv_first_alias_only", f"""WITH {_OSV_IDS}
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'CVE-2024-' || CAST(p_partkey AS VARCHAR) ELSE cve END AS cve_id, n AS size
FROM ids""")
def osv_first_alias(c: Corpus) -> DataFrame:
    """The variant that files all copies of a record under its first alias."""
    name = F.get("payload.affected", F.lit(1))["package"]["name"]
    return osv_raw(c, True).select("cve_id", F.regexp_extract(name, r"(\d+)$", 1).alias("size"))


@query("scan_osv_since", f"""WITH {_OSV_IDS}
SELECT cve AS cve_id FROM ids WHERE p_partkey % 5 = 0 OR {_OSV_MODIFIED} >= {_SINCE_SQL}""")
def scan_osv_since(c: Corpus) -> DataFrame:
    return osv.since(osv_raw(c), _SINCE, NOW).select("cve_id")


# --- KEV --------------------------------------------------------------------------------

def kev_landed(c: Corpus) -> DataFrame:
    key = F.col("p_partkey")
    day = F.lit(datetime(2024, 1, 1)) + F.make_dt_interval((key % 365).cast("int"))
    entry = F.struct(
        F.when(key % 40 != 0, F.concat(F.lit("CVE-2024-"), _s("p_partkey"))).alias("cveID"),
        F.when(key % 11 == 0, "not-a-date").when(key % 11 == 1, "").when(key % 11 == 2, F.date_format(day, "yyyy-M-d"))
        .otherwise(F.date_format(day, "yyyy-MM-dd")).alias("dateAdded"),
        F.col("p_name").alias("shortDescription"),
        F.when(key % 6 == 0, "2025-01").otherwise(F.date_format(day + F.make_dt_interval(F.lit(21)), "yyyy-MM-dd"))
        .alias("dueDate"),
        F.when(key % 3 == 0, F.concat(F.lit("https://n.example/"), _s("p_partkey"))).when(key % 3 == 1, "see vendor")
        .otherwise("").alias("notes"),
    )
    return _landed(_paged(c.table("part"), "p_partkey", F.to_json(entry), "vulnerabilities"), kev.SCHEMA)


_KEV_DAY = "TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER))"


@query("normalize_kev", _select(
    "'CVE-2024-' || CAST(p_partkey AS VARCHAR)", "part WHERE p_partkey % 40 <> 0",
    description="p_name",
    cisa_kev="true",
    cisa_kev_due_date=f"CASE WHEN p_partkey % 6 <> 0 THEN strftime({_KEV_DAY} + INTERVAL 21 DAY, '%Y-%m-%d') END",
    published_at=f"CASE WHEN p_partkey % 11 > 1 THEN strftime({_KEV_DAY}, {_SQL_STAMP}) END",
    references="CASE WHEN p_partkey % 3 = 0 THEN 'https://n.example/' || CAST(p_partkey AS VARCHAR) || '|advisory' ELSE '' END",
))
def normalize_kev(c: Corpus) -> DataFrame:
    return _flat(kev.KEV.records(kev_landed(c), NOW))


@query("scan_kev_since", f"""SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id FROM part
WHERE p_partkey % 40 <> 0 AND (p_partkey % 11 <= 1 OR {_KEV_DAY} >= {_SINCE_SQL})""")
def scan_kev_since(c: Corpus) -> DataFrame:
    return kev.KEV.since(kev.KEV.unpack(kev_landed(c)), _SINCE, NOW).select("cve_id")


# --- EPSS -------------------------------------------------------------------------------

@query("normalize_epss", _select(
    "'CVE-2024-' || CAST(l_partkey AS VARCHAR)", "lineitem WHERE l_linenumber <> 7",
    epss_score="CASE WHEN l_returnflag <> 'R' THEN l_discount END",
    epss_percentile="CASE WHEN l_linestatus = 'O' THEN l_tax END",
))
def normalize_epss(c: Corpus) -> DataFrame:
    rows = c.table("lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.concat(F.lit("CVE-2024-"), _s("l_partkey"))).alias("cve"),
        F.when(F.col("l_returnflag") == "R", F.concat(_s("l_discount"), F.lit("d"))).otherwise(_s("l_discount")).alias("epss"),
        F.when(F.col("l_linestatus") == "O", _s("l_tax")).otherwise("n/a").alias("percentile"),
        F.lit(None).cast("timestamp").alias("_landed_at"), F.lit(0).cast("bigint").alias("_file_id"),
        F.lit(0).cast("bigint").alias("_block"),
    )
    return _flat(epss.EPSS.records(rows, NOW))


# --- Names ------------------------------------------------------------------------------

_ALIAS_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ECOSYSTEM_ALIASES.items())


@query("canonical_ecosystems", f"""
SELECT name, CASE lower(name) {_ALIAS_SQL} ELSE name END AS canonical, count(*) AS n FROM (
  SELECT ['Python', 'golang', 'Rust', 'npm', '.NET', 'PHP', 'Elixir', 'cobol'][o_orderkey % 8 + 1] AS name FROM orders)
GROUP BY name""")
def canonical_ecosystems(c: Corpus) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Python", "golang", "Rust", "npm", ".NET", "PHP", "Elixir", "cobol")])
    rows = c.table("orders").groupBy(F.get(names, (F.col("o_orderkey") % 8).cast("int")).alias("name")).agg(
        F.count("*").alias("n")
    )
    return rows.withColumn("canonical", canonical_ecosystem(F.col("name")))
