"""A vulnerability corpus projected from general-purpose tables.

``part`` stands for CVEs, ``lineitem`` for what feeds report about them,
``pages`` and ``events`` for crawling, ``customer`` for questions and projects.
Each projection exists twice: as a DataFrame and as the SQL with the same name
in ``SQL``, so that results can be checked against another engine.
"""

from datetime import datetime, timezone
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import merge
from ..operators.crawl_state import fold_progress
from ..session import scratch

#: The instant questions are asked at.
NOW = datetime(2024, 12, 31, 6, tzinfo=timezone.utc)
NOW_SQL = "TIMESTAMP '2024-12-31 06:00:00'"

_SEQ = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

SQL = {
    "vulns": """vulns AS (
  SELECT p_partkey AS part, 'CVE-2024-' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS cve_id, p_name AS description,
    CASE WHEN p_type <> 'ECONOMY' THEN p_size / 5.0 END AS cvss_score,
    'CVSS:3.1/' || p_brand AS cvss_vector,
    CASE p_type WHEN 'PROMO' THEN 'CRITICAL' WHEN 'LARGE' THEN 'HIGH' WHEN 'MEDIUM' THEN 'MEDIUM'
      WHEN 'SMALL' THEN 'LOW' END AS severity,
    CASE WHEN p_partkey % 10 <> 0 THEN (p_retailprice - 900) / 100 END AS epss_score,
    CASE WHEN p_partkey % 10 <> 0 THEN p_size / 50.0 END AS epss_percentile,
    p_partkey % 97 = 0 AS cisa_kev,
    CASE WHEN p_partkey % 13 <> 0
      THEN TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 365 AS INTEGER)) END AS published_at
  FROM part)""",
    "package_rows": """package_rows AS (
  SELECT 'CVE-2024-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS cve_id,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'PyPI' WHEN 'AO' THEN 'npm' WHEN 'NF' THEN 'Maven'
      WHEN 'NO' THEN 'Go' WHEN 'RF' THEN 'crates.io' ELSE 'NuGet' END AS ecosystem,
    'Pkg-' || CAST(l_suppkey AS VARCHAR) AS package_name,
    CASE l_linestatus WHEN 'F' THEN 'github' ELSE 'osv' END AS source,
    CASE WHEN l_discount <> 0 THEN '>=' || CAST(l_linenumber AS VARCHAR) || '.' ||
      CAST(CAST(l_quantity AS INTEGER) % 10 AS VARCHAR) || ', <' || CAST(l_linenumber + 1 AS VARCHAR) || '.0' END
      AS vulnerable_versions,
    CASE WHEN l_tax <> 0 THEN CAST(l_linenumber + 1 AS VARCHAR) || '.0' END AS patched_version,
    row(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem)""",
    "packages": """packages AS (
  SELECT cve_id, ecosystem, package_name, source, v.vulnerable_versions AS vulnerable_versions,
    v.patched_version AS patched_version, lower(ecosystem) AS ecosystem_lc, lower(package_name) AS package_lc
  FROM (SELECT cve_id, ecosystem, package_name, source,
          arg_max({'vulnerable_versions': vulnerable_versions, 'patched_version': patched_version}, seq) AS v
        FROM package_rows GROUP BY ALL))""",
    "exploit_rows": """exploit_rows AS (
  SELECT 'CVE-2024-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS cve_id,
    CASE l_linestatus WHEN 'F' THEN 'exploitdb' ELSE 'github_poc' END AS source,
    CASE WHEN l_linenumber <> 1 THEN 'x' || CAST(l_suppkey % 10 AS VARCHAR) ELSE '' END AS source_id,
    CASE WHEN l_discount >= 0.03 THEN 'https://poc.example/' || CAST(l_orderkey AS VARCHAR) END AS url,
    CASE WHEN l_tax >= 0.03 THEN repeat('exploit detail ', l_linenumber * 2) || CAST(l_orderkey AS VARCHAR) END
      AS description,
    CASE WHEN l_quantity >= 10 THEN l_shipdate END AS discovered_at,
    row(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem WHERE l_returnflag = 'R')""",
    "exploits": """exploits AS (
  SELECT cve_id, source, source_id, arg_max(url, seq) FILTER (WHERE url IS NOT NULL) AS url,
    arg_max(description, seq) FILTER (WHERE description IS NOT NULL) AS description,
    arg_max(discovered_at, seq) FILTER (WHERE discovered_at IS NOT NULL) AS discovered_at
  FROM exploit_rows GROUP BY cve_id, source, source_id)""",
    "reference_rows": """reference_rows AS (
  SELECT 'CVE-2024-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS cve_id,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
      THEN 'https://www.exploit-db.com/exploits/' || CAST(l_orderkey AS VARCHAR)
      ELSE 'https://vendor' || CAST(l_suppkey % 20 AS VARCHAR) || '.example.com/advisory/' ||
        CAST(l_orderkey % 50 AS VARCHAR) END AS url,
    CASE l_linenumber % 3 WHEN 0 THEN 'advisory' WHEN 1 THEN 'patch' END AS ref_type,
    CASE l_linestatus WHEN 'F' THEN 'nvd' ELSE 'osv' END AS source,
    row(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem)""",
    "refs": """refs AS (
  SELECT cve_id, url, arg_max(ref_type, seq) FILTER (WHERE ref_type IS NOT NULL) AS ref_type,
    arg_max(source, seq) AS source
  FROM reference_rows GROUP BY cve_id, url)""",
    "page_refs": """page_refs AS (
  SELECT page_id, 'CVE-2024-' || lpad(CAST(page_id * 9 AS VARCHAR), 12, '0') AS cve_id, url FROM pages)""",
    "observations": """observations AS (
  SELECT 'CVE-2024-' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS cve_id,
    CASE WHEN l_returnflag = 'A' THEN 'nvd' WHEN l_returnflag = 'N' THEN 'github'
      WHEN l_linestatus = 'F' THEN 'osv' ELSE 'epss' END AS source,
    CASE WHEN l_returnflag = 'A' THEN 'order ' || CAST(l_orderkey AS VARCHAR) END AS description,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN l_quantity / 5 END AS cvss_score,
    CASE WHEN l_returnflag = 'A' THEN 'CVSS:3.1/' || CAST(l_suppkey AS VARCHAR) END AS cvss_vector,
    CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linenumber < 4 THEN '3.1' ELSE '4.0' END END AS cvss_version,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_discount END AS epss_score,
    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_tax END AS epss_percentile,
    l_tax = 0.08 AND l_discount = 0.1 AS cisa_kev,
    CASE WHEN l_tax = 0.08 THEN CAST(l_shipdate AS DATE) END AS cisa_kev_due_date,
    CASE WHEN l_returnflag = 'N' THEN CASE l_linenumber % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH'
      WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END END AS severity,
    CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS published_at,
    l_shipdate AS modified_at,
    CASE WHEN l_linenumber = 7 AND l_discount = 0 THEN 'REJECTED' END AS record_status,
    row(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem)""",
    "merged": """merged AS (
  SELECT cve_id, """ + ", ".join(
        f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in merge.MERGED_COLUMNS
    ) + """, bool_or(cisa_kev) AS cisa_kev, list_sort(list(DISTINCT source)) AS raw_sources
  FROM observations GROUP BY cve_id)""",
    "intents": """intents AS (
  SELECT 'q' || CAST(c_custkey AS VARCHAR) AS intent_id, c_custkey,
    CASE WHEN c_nationkey > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
      THEN ['PYPI', 'npm', 'maven', 'go', 'Crates.io', 'nuget'][c_nationkey % 6 + 1] END AS ecosystem,
    CASE WHEN c_nationkey > 0 AND c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')
      THEN 'PKG-' || CAST(c_nationkey AS VARCHAR) END AS package,
    CASE WHEN c_nationkey > 0 AND c_mktsegment = 'FURNITURE'
      THEN 'CVE-2024-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS cve1,
    CASE WHEN c_nationkey > 0 AND c_mktsegment = 'FURNITURE'
      THEN 'CVE-2024-' || lpad(CAST(c_custkey * 3 AS VARCHAR), 12, '0') END AS cve2,
    CASE WHEN c_nationkey > 0 THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'HIGH+' WHEN 'HOUSEHOLD' THEN 'medium+'
      WHEN 'AUTOMOBILE' THEN CASE WHEN c_nationkey % 2 = 0 THEN 'critical' END END END AS severity_filter,
    CASE WHEN c_nationkey > 0 THEN CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'last ' || CAST(c_nationkey AS VARCHAR) || ' weeks'
      WHEN 'MACHINERY' THEN 'in the Last ' || CAST(c_nationkey AS VARCHAR) || ' months'
      WHEN 'FURNITURE' THEN CASE WHEN c_nationkey % 3 = 0 THEN 'since January' END END END AS date_range,
    CASE WHEN c_nationkey > 0 THEN CASE c_mktsegment WHEN 'HOUSEHOLD' THEN c_nationkey * 7
      WHEN 'MACHINERY' THEN c_nationkey * 30 END END AS days
  FROM customer)""",
    "crawl_events": """crawl_events AS (
  SELECT user_id AS job, ts, event_id,
    CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'claim'
      WHEN 'click' THEN 'release' ELSE 'seed' END AS event
  FROM events)""",
    "dependencies": """dependencies AS (
  SELECT 'project-' || CAST(o_custkey AS VARCHAR) AS project, CAST(o_orderdate AS DATE) AS day,
    ['pypi', 'NPM', 'maven', 'go', 'crates.io', 'NuGet'][o_orderkey % 6 + 1] AS ecosystem,
    'pkg-' || CAST(o_custkey % 100 AS VARCHAR) AS package,
    CASE WHEN o_orderkey % 11 = 0 THEN '2.x' ELSE CAST(o_orderkey % 7 + 1 AS VARCHAR) || '.' ||
      CAST(o_orderkey % 10 AS VARCHAR) || '.0' END AS version
  FROM orders)""",
}

#: Tables already written in this application.
_PATHS: dict[tuple[str, str, str], str] = {}

_NEEDS = {
    "packages": ["package_rows"],
    "exploits": ["exploit_rows"],
    "refs": ["reference_rows"],
    "merged": ["observations"],
}


def with_sql(names: str, body: str) -> str:
    """``body`` over the named projections."""
    wanted: list[str] = []
    for name in names.split():
        for each in [*_NEEDS.get(name, []), name]:
            if each not in wanted:
                wanted.append(each)
    return "WITH " + ",\n".join(SQL[n] for n in wanted) + "\n" + body


def cve(key: Column) -> Column:
    text = key.cast("string")
    return F.concat(F.lit("CVE-2024-"), F.lpad(text, F.greatest(F.length(text), F.lit(12)), F.lit("0")))


def _text(col: str) -> Column:
    return F.col(col).cast("string")


class Corpus:
    """The projections over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _stored(self, name: str, rows: DataFrame, *layout: str) -> DataFrame:
        """A merged table as questions find it: written once, each part of the fold sorted for their filters."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _PATHS:
            path = scratch(self.spark, name)
            rows.sortWithinPartitions(*layout).write.parquet(path)
            _PATHS[key] = path
        return self.spark.read.parquet(_PATHS[key])

    @cached_property
    def vulns(self) -> DataFrame:
        key, kind = F.col("p_partkey"), F.col("p_type")
        scored = key % 10 != 0
        return self.table("part").select(
            cve(key).alias("cve_id"),
            F.col("p_name").alias("description"),
            F.when(kind != "ECONOMY", F.col("p_size") / 5.0).alias("cvss_score"),
            F.concat(F.lit("CVSS:3.1/"), "p_brand").alias("cvss_vector"),
            F.when(kind == "PROMO", "CRITICAL").when(kind == "LARGE", "HIGH").when(kind == "MEDIUM", "MEDIUM")
            .when(kind == "SMALL", "LOW").alias("severity"),
            F.when(scored, (F.col("p_retailprice") - 900) / 100).alias("epss_score"),
            F.when(scored, F.col("p_size") / 50.0).alias("epss_percentile"),
            (key % 97 == 0).alias("cisa_kev"),
            F.when(
                key % 13 != 0,
                F.lit(datetime(2024, 1, 1, tzinfo=timezone.utc)) + F.make_dt_interval((key % 365).cast("int")),
            ).alias("published_at"),
        )

    def _lines(self, *columns: Column) -> DataFrame:
        return self.table("lineitem").select(
            cve(F.col("l_partkey")).alias("cve_id"), *columns, F.struct(*_SEQ).alias("seq")
        )

    @cached_property
    def package_rows(self) -> DataFrame:
        flag = F.concat("l_returnflag", "l_linestatus")
        line = F.col("l_linenumber")
        fixed = F.concat((line + 1).cast("string"), F.lit(".0"))
        return self._lines(
            F.when(flag == "AF", "PyPI").when(flag == "AO", "npm").when(flag == "NF", "Maven").when(flag == "NO", "Go")
            .when(flag == "RF", "crates.io").otherwise("NuGet").alias("ecosystem"),
            F.concat(F.lit("Pkg-"), _text("l_suppkey")).alias("package_name"),
            F.when(F.col("l_linestatus") == "F", "github").otherwise("osv").alias("source"),
            F.when(
                F.col("l_discount") != 0,
                F.concat(F.lit(">="), line.cast("string"), F.lit("."),
                         (F.col("l_quantity").cast("int") % 10).cast("string"), F.lit(", <"), fixed),
            ).alias("vulnerable_versions"),
            F.when(F.col("l_tax") != 0, fixed).alias("patched_version"),
        )

    @cached_property
    def packages(self) -> DataFrame:
        return self._stored("packages", self.merged_packages(), "ecosystem_lc", "package_lc", "cve_id")

    def merged_packages(self) -> DataFrame:
        return merge.package_table(merge.fold_observed_packages(self.package_rows))

    @cached_property
    def exploit_rows(self) -> DataFrame:
        rows = self._lines(
            F.col("l_returnflag"),
            F.when(F.col("l_linestatus") == "F", "exploitdb").otherwise("github_poc").alias("source"),
            F.when(F.col("l_linenumber") != 1, F.concat(F.lit("x"), (F.col("l_suppkey") % 10).cast("string")))
            .alias("source_id"),
            F.when(F.col("l_discount") >= 0.03, F.concat(F.lit("https://poc.example/"), _text("l_orderkey"))).alias("url"),
            F.when(
                F.col("l_tax") >= 0.03,
                F.concat(F.repeat(F.lit("exploit detail "), F.col("l_linenumber") * 2), _text("l_orderkey")),
            ).alias("description"),
            F.when(F.col("l_quantity") >= 10, F.col("l_shipdate").cast("timestamp")).alias("discovered_at"),
        )
        return rows.where(F.col("l_returnflag") == "R").drop("l_returnflag")

    @cached_property
    def exploits(self) -> DataFrame:
        return self._stored("exploits", self.merged_exploits(), "cve_id")

    def merged_exploits(self) -> DataFrame:
        return merge.exploit_table(merge.fold_observed_exploits(self.exploit_rows))

    @cached_property
    def reference_rows(self) -> DataFrame:
        third = F.col("l_linenumber") % 3
        return self._lines(
            F.when(
                (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"),
                F.concat(F.lit("https://www.exploit-db.com/exploits/"), _text("l_orderkey")),
            ).otherwise(F.concat(
                F.lit("https://vendor"), (F.col("l_suppkey") % 20).cast("string"), F.lit(".example.com/advisory/"),
                (F.col("l_orderkey") % 50).cast("string"),
            )).alias("url"),
            F.when(third == 0, "advisory").when(third == 1, "patch").alias("ref_type"),
            F.when(F.col("l_linestatus") == "F", "nvd").otherwise("osv").alias("source"),
        )

    @cached_property
    def references(self) -> DataFrame:
        return self._stored("references", self.merged_references(), "cve_id")

    def merged_references(self) -> DataFrame:
        return merge.reference_table(merge.fold_observed_references(self.reference_rows))

    @cached_property
    def page_references(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", cve(F.col("page_id") * 9).alias("cve_id"), "url", F.col("html")
        )

    @cached_property
    def observations(self) -> DataFrame:
        flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
        shipped, tax = F.col("l_shipdate").cast("timestamp"), F.col("l_tax")
        nvd, epss = flag == "A", (flag == "R") & (status == "O")
        return self._lines(
            F.when(nvd, "nvd").when(flag == "N", "github").when(status == "F", "osv").otherwise("epss").alias("source"),
            F.when(nvd, F.concat(F.lit("order "), _text("l_orderkey"))).alias("description"),
            F.when(nvd & (status == "F"), F.col("l_quantity") / 5).alias("cvss_score"),
            F.when(nvd, F.concat(F.lit("CVSS:3.1/"), _text("l_suppkey"))).alias("cvss_vector"),
            F.when(nvd, F.when(line < 4, "3.1").otherwise("4.0")).alias("cvss_version"),
            F.when(epss, F.col("l_discount")).alias("epss_score"),
            F.when(epss, tax).alias("epss_percentile"),
            ((tax == 0.08) & (F.col("l_discount") == 0.1)).alias("cisa_kev"),
            F.when(tax == 0.08, F.col("l_shipdate").cast("date")).alias("cisa_kev_due_date"),
            F.when(
                flag == "N",
                F.when(line % 4 == 0, "CRITICAL").when(line % 4 == 1, "HIGH").when(line % 4 == 2, "MEDIUM").otherwise("LOW"),
            ).alias("severity"),
            F.when(flag != "R", shipped).alias("published_at"),
            shipped.alias("modified_at"),
            F.when((line == 7) & (F.col("l_discount") == 0), "REJECTED").alias("record_status"),
        )

    @cached_property
    def merged(self) -> DataFrame:
        return self._stored("merged", self.merged_vulns(), "cve_id")

    def merged_vulns(self, columns=tuple(merge.MERGED_COLUMNS)) -> DataFrame:
        """Merged CVE table, or these columns of it, without the sync times, which the projection has none of."""
        return merged_view(merge.fold_observed_vulnerabilities(self.observations, columns), columns)

    @cached_property
    def intents(self) -> DataFrame:
        key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")
        asked = nation > 0
        names = F.array(*[F.lit(x) for x in ("PYPI", "npm", "maven", "go", "Crates.io", "nuget")])
        n = nation.cast("string")
        return self.table("customer").select(
            F.concat(F.lit("q"), key.cast("string")).alias("intent_id"),
            F.when(asked & segment.isin("BUILDING", "MACHINERY"), F.array(F.get(names, nation % 6))).alias("ecosystems"),
            F.when(asked & segment.isin("AUTOMOBILE", "MACHINERY"), F.array(F.concat(F.lit("PKG-"), n)))
            .alias("package_names"),
            F.when(asked & (segment == "FURNITURE"), F.array(cve(key), cve(key * 3))).alias("cve_ids"),
            F.when(asked, F.when(segment == "BUILDING", "HIGH+").when(segment == "HOUSEHOLD", "medium+")
                   .when((segment == "AUTOMOBILE") & (nation % 2 == 0), "critical")).alias("severity_filter"),
            F.when(asked, F.when(segment == "HOUSEHOLD", F.concat(F.lit("last "), n, F.lit(" weeks")))
                   .when(segment == "MACHINERY", F.concat(F.lit("in the Last "), n, F.lit(" months")))
                   .when((segment == "FURNITURE") & (nation % 3 == 0), "since January")).alias("date_range"),
            F.lit("general_search").alias("query_type"),
            F.col("c_name").alias("raw_search_query"),
        )

    @cached_property
    def crawl_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("user_id").alias("job"), "ts", "event_id",
            F.when(kind == "error", "fail").when(kind == "purchase", "complete").when(kind == "view", "claim")
            .when(kind == "click", "release").otherwise("seed").alias("event"),
        )

    @cached_property
    def crawl_progress(self) -> DataFrame:
        return fold_progress(self.crawl_events, keys=("job",), at=("ts", "event_id"))

    @cached_property
    def dependencies(self) -> DataFrame:
        key = F.col("o_orderkey")
        names = F.array(*[F.lit(x) for x in ("pypi", "NPM", "maven", "go", "crates.io", "NuGet")])
        return self.table("orders").select(
            F.concat(F.lit("project-"), _text("o_custkey")).alias("project"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.get(names, (key % 6).cast("int")).alias("ecosystem"),
            F.concat(F.lit("pkg-"), (F.col("o_custkey") % 100).cast("string")).alias("package"),
            F.when(key % 11 == 0, "2.x").otherwise(F.concat(
                (key % 7 + 1).cast("string"), F.lit("."), (key % 10).cast("string"), F.lit(".0")
            )).alias("version"),
        )


def merged_view(folded: DataFrame, columns=tuple(merge.MERGED_COLUMNS)) -> DataFrame:
    return folded.select("cve_id", *[F.col(f"{c}.value").alias(c) for c in columns], "cisa_kev", "raw_sources")
