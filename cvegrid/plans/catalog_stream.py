"""Registered queries: streams, batch syncs and crawl rounds over landed files."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, functions as F

from ..operators.crawl_state import content_table, log_rows
from ..session import scratch
from ..sources import EPSS, OSV_FILES
from ..streaming.crawl import crawl_stream, current_queue
from ..streaming.ingest import ingest, sync_name
from ..streaming.store import Store
from ..streaming.watch import alerted, watch
from .catalog_feeds import nvd_pages, osv_members
from .corpus import NOW, Corpus, with_sql
from .enrich import read_log, run_round
from .registry import query
from .sync import sync_all


def _land_snapshot(c: Corpus, path: str, mark: str) -> str:
    """Exploit probabilities as gzip CSV: the highest discount seen per part."""
    best = c.table("lineitem").groupBy("l_partkey").agg(F.max("l_discount").alias("d"), F.min("l_tax").alias("t"))
    rows = best.select(
        F.concat(F.lit(mark), F.col("l_partkey").cast("string")).alias("cve"),
        F.col("d").cast("string").alias("epss"), F.col("t").cast("string").alias("percentile"),
    )
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return path


_SNAPSHOT = """snapshot AS (
  SELECT 'CVE-2024-' || CAST(l_partkey AS VARCHAR) AS cve_id, max(l_discount) AS epss_score, min(l_tax) AS epss_percentile
  FROM lineitem GROUP BY l_partkey)"""

_OSV_SIDE = """osv_side AS (
  SELECT unnest(CASE WHEN p_partkey % 3 = 0 THEN ['CVE-2024-' || CAST(p_partkey AS VARCHAR),
      'CVE-2025-' || CAST(p_partkey AS VARCHAR)]
    WHEN p_partkey % 7 = 0 THEN ['CVE-2023-' || CAST(p_partkey AS VARCHAR)] ELSE [] END) AS cve_id,
    CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'Details of ' || p_name END AS description,
    CASE WHEN p_size % 4 = 1 THEN 'MODERATE' WHEN p_size > 25 THEN 'HIGH' END AS severity FROM part)"""

_COLUMNS = ["cve_id", "description", "severity", "epss_score", "epss_percentile", "cisa_kev"]


@query("stream_merge", f"""WITH {_SNAPSHOT}, {_OSV_SIDE}
SELECT coalesce(o.cve_id, s.cve_id) AS cve_id, description, severity, epss_score, epss_percentile, false AS cisa_kev,
  concat_ws(',', CASE WHEN s.cve_id IS NOT NULL THEN 'epss' END, CASE WHEN o.cve_id IS NOT NULL THEN 'osv' END) AS raw_sources
FROM osv_side o FULL JOIN snapshot s ON s.cve_id = o.cve_id""")
def stream_merge(c: Corpus) -> DataFrame:
    """Two feeds streamed in micro-batches; the older stream goes on after a compaction of both."""
    root = scratch(c.spark, "stream")
    members = osv_members(c).select("json")
    later = F.pmod(F.xxhash64("json"), F.lit(3)) == 0
    landing, checkpoint = f"{root}/landing/osv", f"{root}/checkpoint/osv"
    members.where(~later).repartition(3).write.text(landing)
    _land_snapshot(c, f"{root}/landing/epss", "CVE-2024-")
    store = Store(c.spark, f"{root}/store", 8)
    started = datetime(2024, 7, 1, tzinfo=timezone.utc)
    ingest(store, OSV_FILES, landing, checkpoint, started, 2).awaitTermination()
    ingest(store, EPSS, f"{root}/landing/epss", f"{root}/checkpoint/epss", started + timedelta(hours=1)).awaitTermination()
    store.compact()
    members.where(later).repartition(1).write.mode("append").text(landing)
    ingest(store, OSV_FILES, landing, checkpoint, started, 2).awaitTermination()
    return store.table("vulnerabilities").select(*_COLUMNS, F.array_join("raw_sources", ",").alias("raw_sources"))


_CHANGED = """snapshot AS (
  SELECT 'CVE-2024-' || CAST(l_partkey AS VARCHAR) AS cve_id, CASE WHEN l_partkey % 40 = 7 THEN 0.5 ELSE max(l_discount) END
    AS epss_score, CASE WHEN l_partkey % 40 = 7 THEN 0.25 ELSE min(l_tax) END AS epss_percentile
  FROM lineitem GROUP BY l_partkey)"""


@query("feed_sync", f"""WITH {_CHANGED},
nvd_side AS (
  SELECT 'CVE-2024-' || CAST(p_partkey AS VARCHAR) AS cve_id,
    CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS description,
    CASE WHEN p_type IN ('PROMO', 'LARGE', 'SMALL') THEN CASE WHEN p_size > 25 THEN 'HIGH' ELSE 'LOW' END END AS severity,
    p_partkey % 97 = 0 AS cisa_kev FROM part WHERE p_partkey % 50 <> 0)
SELECT coalesce(n.cve_id, s.cve_id) AS cve_id, description, severity, epss_score, epss_percentile,
  coalesce(n.cisa_kev, false) AS cisa_kev,
  concat_ws(',', CASE WHEN s.cve_id IS NOT NULL THEN 'epss' END, CASE WHEN n.cve_id IS NOT NULL THEN 'nvd' END) AS raw_sources
FROM nvd_side n FULL JOIN snapshot s ON s.cve_id = n.cve_id""")
def feed_sync(c: Corpus) -> DataFrame:
    """Two rounds of batch syncs of landed feeds; the second finds changed scores in the snapshot and logs these alone."""
    root = scratch(c.spark, "sync")
    nvd_pages(c).write.partitionBy("page").text(f"{root}/landing/nvd")
    landings = {"nvd": f"{root}/landing/nvd", "epss": _land_snapshot(c, f"{root}/landing/epss", "CVE-2024-")}
    store = Store(c.spark, f"{root}/store", 8)
    sync_all(store, landings, NOW)
    store.compact()
    changed = c.table("lineitem").where(F.col("l_partkey") % 40 == 7).select(
        F.concat(F.lit("CVE-2024-"), F.col("l_partkey").cast("string")).alias("cve"), F.lit("0.5").alias("epss"),
        F.lit("0.25").alias("percentile")).distinct()
    changed.write.mode("append").option("header", True).option("compression", "gzip").csv(landings["epss"])
    sync_all(store, landings, NOW + timedelta(hours=25))
    store.compact()
    rows = store.published("vulnerabilities")
    return rows.select(*_COLUMNS, F.array_join("raw_sources", ",").alias("raw_sources"))


@query("store_buckets", f"""WITH scored AS (
  SELECT l_partkey, max(l_discount) AS d, min(l_tax) AS t, max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS r,
    min(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS rt FROM lineitem GROUP BY l_partkey)
SELECT 'CVE-2024-' || CAST(l_partkey AS VARCHAR) AS cve_id,
  CASE WHEN l_partkey % 40 = 3 THEN 0.5 WHEN l_partkey % 40 = 7 THEN coalesce(r, d) ELSE d END AS epss_score,
  CASE WHEN l_partkey % 40 = 3 THEN 0.25 WHEN l_partkey % 40 = 7 THEN coalesce(rt, t) ELSE t END AS epss_percentile,
  CASE WHEN l_partkey % 40 = 3 THEN 3 WHEN l_partkey % 40 = 7 AND r IS NOT NULL THEN 2 ELSE 1 END AS round FROM scored""")
def store_buckets(c: Corpus) -> DataFrame:
    """A snapshot and two partial ones, each folded into the buckets it touches, then all but the last version retired."""
    root = scratch(c.spark, "buckets")
    store, lines = Store(c.spark, f"{root}/store", 8), c.table("lineitem")
    name = F.concat(F.lit("CVE-2024-"), F.col("l_partkey").cast("string")).alias("cve")
    best = F.max("l_discount").cast("string").alias("epss"), F.min("l_tax").cast("string").alias("percentile")
    some = F.col("l_partkey") % 40
    rounds = [
        lines.groupBy("l_partkey").agg(*best),
        lines.where((some == 7) & (F.col("l_returnflag") == "R")).groupBy("l_partkey").agg(*best),
        lines.where(some == 3).select("l_partkey", F.lit("0.5").alias("epss"), F.lit("0.25").alias("percentile")).distinct(),
    ]
    for number, scores in enumerate(rounds, 1):
        path, at = f"{root}/landing/{number}", NOW + timedelta(days=number)
        scores.select(name, "epss", "percentile").write.option("header", True).csv(path)
        store.append(EPSS.records(EPSS.read(c.spark, path), at), EPSS.name, sync_name(at))
        store.compact()
    store.retire(keep=1)
    days = F.date_diff(F.col("updated_in_db").cast("date"), F.lit(NOW).cast("date"))
    return store.published("vulnerabilities").select("cve_id", "epss_score", "epss_percentile", days.alias("round"))


@query("store_deletions", f"""WITH {_SNAPSHOT}
SELECT cve_id, CASE WHEN part % 10 = 0 THEN 0.5 ELSE epss_score END AS epss_score,
  CASE WHEN part % 10 = 0 THEN NULL ELSE epss_percentile END AS epss_percentile, CASE WHEN part % 10 = 0 THEN 3 ELSE 0 END AS since
FROM (SELECT *, CAST(split_part(cve_id, '-', 3) AS BIGINT) AS part FROM snapshot) WHERE part % 5 <> 0 OR part % 10 = 0""")
def store_deletions(c: Corpus) -> DataFrame:
    """A snapshot, of which every fifth CVE is deleted; the same snapshot in an overlap; half of the deleted come back later."""
    root = scratch(c.spark, "deletions")
    store, part = Store(c.spark, f"{root}/store", 8), F.col("l_partkey")
    landing = _land_snapshot(c, f"{root}/landing/epss", "CVE-2024-")
    name = F.concat(F.lit("CVE-2024-"), part.cast("string"))

    def log(path: str, at: datetime) -> None:
        store.append(EPSS.records(EPSS.read(c.spark, path), at), EPSS.name, sync_name(at))

    log(landing, NOW)
    store.compact()
    deleted = NOW + timedelta(days=2)
    store.delete(c.table("lineitem").where(part % 5 == 0).select(name.alias("cve_id")), deleted, sync_name(deleted))
    log(landing, NOW)  # logged again, as synced before the deletion
    store.compact()
    back = c.table("lineitem").where(part % 10 == 0).select(name.alias("cve"), F.lit("0.5").alias("epss"), F.lit("").alias("percentile"))
    back.distinct().write.option("header", True).csv(f"{root}/landing/back")
    log(f"{root}/landing/back", NOW + timedelta(days=3))
    store.compact()
    days = F.date_diff(F.col("created_in_db").cast("date"), F.lit(NOW).cast("date"))
    return store.published("vulnerabilities").select("cve_id", "epss_score", "epss_percentile", days.alias("since"))


@query("watch_alerts", """WITH scores AS (SELECT l_partkey, max(l_discount) AS score FROM lineitem GROUP BY l_partkey)
SELECT 'C' || CAST(c_custkey AS VARCHAR) AS project, 'pypi' AS ecosystem, 'pkg' || CAST(p_partkey AS VARCHAR) AS package,
  '1.5rc1' AS version, 'CVE-2025-' || CAST(p_partkey AS VARCHAR) AS cve_id, 'affected' AS status, '2' AS patched_version,
  CASE WHEN p_size > 40 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, false AS cisa_kev, score AS epss_score
FROM customer JOIN part ON p_partkey = c_custkey JOIN scores ON l_partkey = p_partkey
WHERE c_custkey % 3 <> 0 AND p_size > 25 AND score > 0.08""")
def watch_alerts(c: Corpus) -> DataFrame:
    """Watch mode over three syncs: packages, then the scores that make them alert, then the same scores again."""
    root = scratch(c.spark, "watch")
    store, out = Store(c.spark, f"{root}/store", 8), f"{root}/alerts"
    key = F.col("p_partkey").cast("string")
    fixed = F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(
        F.struct(F.lit("1").alias("introduced"), F.lit(None).cast("string").alias("fixed")),
        F.struct(F.lit(None).cast("string").alias("introduced"), F.lit("2").alias("fixed"))).alias("events"))
    level = F.when(F.col("p_size") > 40, "CRITICAL").when(F.col("p_size") > 25, "HIGH").otherwise("LOW")
    affected = F.struct(
        F.struct(F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("pkg"), key).alias("name")).alias("package"),
        F.struct(level.alias("severity")).alias("database_specific"), F.array(fixed).alias("ranges"))
    advisory = F.struct(
        F.concat(F.lit("OSV-"), key).alias("id"), F.array(F.concat(F.lit("CVE-2025-"), key)).alias("aliases"),
        F.lit("2024-06-01T00:00:00Z").alias("modified"), F.array(affected).alias("affected"))
    c.table("part").select(F.to_json(advisory).alias("value")).write.text(f"{root}/landing/osv")
    _land_snapshot(c, f"{root}/landing/epss", "CVE-2025-")
    customer = F.col("c_custkey")
    projects = c.table("customer").select(
        F.concat(F.lit("C"), customer.cast("string")).alias("project"), F.lit("pypi").alias("ecosystem"),
        F.concat(F.lit("pkg"), customer.cast("string")).alias("package"),
        F.when(customer % 3 == 0, "2.0").otherwise("1.5rc1").alias("version"))
    for hour, source in enumerate((OSV_FILES, EPSS, EPSS)):
        at = NOW + timedelta(hours=hour)
        landed = source.read(c.spark, f"{root}/landing/{source.name}")
        store.append(source.records(landed, at), source.name, sync_name(at))
        watch(store, projects, out, f"{root}/checkpoint", min_epss=0.08).awaitTermination()
    return alerted(c.spark, out)


#: Claims of a round: fewer than there are pages, so that the order of claims decides.
_LIMIT = 60
_CLAIMED = f""", claimed AS (SELECT r.cve_id, r.url FROM page_refs r JOIN vulns v ON v.cve_id = r.cve_id
  ORDER BY v.cisa_kev DESC, v.epss_score DESC NULLS LAST, v.cvss_score DESC NULLS LAST, r.cve_id, r.url LIMIT {_LIMIT})"""


def _two_rounds(c: Corpus) -> tuple[str, DataFrame]:
    """A round whose claims are lost, and one that frees them by a lease, claims again and stores what was fetched."""
    refs, tenth = c.page_references, F.col("page_id") % 10
    known = refs.where(F.col("page_id") % 3 == 0).withColumn("domain", F.regexp_extract("url", r"https?://([^/]+)", 1))
    path = scratch(c.spark, "crawl")
    log_rows(known, "seed", NOW - timedelta(days=3), F.col("domain")).write.parquet(f"{path}/step=0-seeds")
    landed = refs.where(tenth != 9).select(
        "cve_id", "url", F.when(tenth == 8, 404).otherwise(200).alias("status"), F.encode("html", "UTF-8").alias("body")
    )
    vectors = refs.where(F.col("page_id") % 4 == 0).select(
        "cve_id", "url", F.array_repeat(F.lit(0.5).cast("float"), 8).alias("embedding")
    )
    nothing = landed.limit(0)
    run_round(c.spark, path, refs, c.vulns, nothing, vectors, NOW - timedelta(days=2), _LIMIT, 24, 8)
    return path, run_round(c.spark, path, refs, c.vulns, landed, vectors, NOW, _LIMIT, 24, 8)


@query("crawl_round", with_sql("vulns page_refs", _CLAIMED + """
SELECT r.cve_id, r.url, CASE WHEN c.url IS NULL THEN 'pending' WHEN page_id % 10 = 9 THEN 'claimed'
    WHEN page_id % 10 = 8 THEN 'pending' WHEN page_id % 4 = 0 THEN 'complete' ELSE 'claimed' END AS status,
  CASE WHEN c.url IS NOT NULL AND page_id % 10 = 8 THEN 1 ELSE 0 END AS attempts,
  nullif(regexp_extract(r.url, 'https?://([^/]+)', 1), '') AS domain
FROM page_refs r LEFT JOIN claimed c ON c.cve_id = r.cve_id AND c.url = r.url"""))
def crawl_round(c: Corpus) -> DataFrame:
    """The work queue after two rounds with a lease."""
    return _two_rounds(c)[1]


@query("stored_pages", with_sql("vulns page_refs", _CLAIMED + """
SELECT r.cve_id, r.url, 8 AS width, 'complete' AS status FROM page_refs r JOIN claimed c ON c.cve_id = r.cve_id AND c.url = r.url
WHERE page_id % 10 < 8 AND page_id % 4 = 0"""))
def stored_pages(c: Corpus) -> DataFrame:
    """Pages stored by the rounds, each with its vector and the state of its job."""
    path, queue = _two_rounds(c)
    pages = content_table(read_log(c.spark, path)).where(F.col("content") != "")
    return pages.join(queue, ["cve_id", "url"]).select("cve_id", "url", F.size("embedding").alias("width"), "status")


@query("crawl_stream", with_sql("crawl_events", """
SELECT job, attempts, CASE WHEN last = 'complete' THEN 'complete' WHEN last = 'claim' THEN 'claimed'
  WHEN last = 'fail' AND attempts >= 3 THEN 'dead' ELSE 'pending' END AS status
FROM (SELECT job, arg_max(event, row(ts, event_id)) AS last,
        CAST(count(*) FILTER (WHERE event = 'fail') AS INTEGER) AS attempts
      FROM crawl_events GROUP BY job)"""))
def crawl_queue_stream(c: Corpus) -> DataFrame:
    """The work queue kept as a stream's state; it goes on after a restart, with events older than those it has seen."""
    root = scratch(c.spark, "queue")
    events = c.crawl_events.withColumnRenamed("ts", "at")
    for part in (1, 0):
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{root}/landing")
        landed = c.spark.readStream.schema(events.schema).parquet(f"{root}/landing")
        crawl_stream(landed, f"{root}/jobs", f"{root}/checkpoint", ["job"], F.col("event_id")).awaitTermination()
    return current_queue(c.spark.read.parquet(f"{root}/jobs"), ["job"])
