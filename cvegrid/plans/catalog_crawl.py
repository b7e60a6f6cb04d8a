"""Registered queries: frontier, crawl state, page text, vectors."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from ..functions.text import content_type, domain_of, estimate_tokens, html_text
from ..operators import crawl_state, frontier, semantic
from ..operators.retrieval import retrieve_many
from ..operators.stats import funnel
from .corpus import NOW, NOW_SQL, Corpus, cve, with_sql
from .enrich import outcomes
from .registry import query

_DOMAIN = "nullif(regexp_extract(url, 'https?://([^/]+)', 1), '')"

#: Every third page has been seen before.
_SEED = """
, seen AS (SELECT cve_id, url FROM page_refs WHERE page_id % 3 = 0),
all_refs AS (
  SELECT cve_id, url FROM page_refs UNION ALL
  SELECT cve_id, 'ftp://files.example/' || CAST(page_id AS VARCHAR) FROM page_refs),
fresh AS (SELECT DISTINCT cve_id, url, """ + _DOMAIN + """ AS domain FROM all_refs r
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.cve_id = r.cve_id AND s.url = r.url))"""


def _frontier(c: Corpus) -> tuple[DataFrame, DataFrame]:
    refs = c.page_references.select("cve_id", "url", "page_id")
    seen = refs.where(F.col("page_id") % 3 == 0)
    odd = refs.select("cve_id", F.concat(F.lit("ftp://files.example/"), F.col("page_id").cast("string")).alias("url"))
    return frontier.new_addresses(refs.select("cve_id", "url").unionByName(odd), seen)


@query("domain_frontier_seed", with_sql("page_refs", _SEED + """
SELECT cve_id, url, domain, CASE WHEN domain IS NULL THEN 'quarantine' ELSE 'pending' END AS status FROM fresh"""))
def frontier_seed(c: Corpus) -> DataFrame:
    jobs, aside = _frontier(c)
    return jobs.select("cve_id", "url", "domain", "status").unionByName(
        aside.select("cve_id", "url", F.lit(None).cast("string").alias("domain"), F.lit("quarantine").alias("status"))
    )


_CLAIM = """
, claimed AS (SELECT f.cve_id, f.url, f.domain, v.cisa_kev, v.epss_score, v.cvss_score
  FROM fresh f JOIN vulns v ON v.cve_id = f.cve_id WHERE f.domain IS NOT NULL
  ORDER BY v.cisa_kev DESC, v.epss_score DESC NULLS LAST, v.cvss_score DESC NULLS LAST, f.cve_id, f.url LIMIT 500)"""


@query("claim_priority", with_sql("vulns page_refs", _SEED + _CLAIM + "SELECT cve_id, url, domain FROM claimed"))
def claim_priority(c: Corpus) -> DataFrame:
    return frontier.claim(_frontier(c)[0], c.vulns).select("cve_id", "url", "domain")


@query("fetch_schedule", with_sql("vulns page_refs", _SEED + _CLAIM + """
SELECT cve_id, url, slot, (slot - 1) / 2.0::DOUBLE AS not_before FROM (
  SELECT cve_id, url, CAST(row_number() OVER (PARTITION BY domain ORDER BY cisa_kev DESC, epss_score DESC NULLS LAST,
    cvss_score DESC NULLS LAST, cve_id, url) AS INTEGER) AS slot FROM claimed)"""))
def fetch_schedule(c: Corpus) -> DataFrame:
    rows = frontier.schedule(frontier.claim(_frontier(c)[0], c.vulns))
    return rows.select("cve_id", "url", "slot", "not_before")


@query("crawl_state_fold", with_sql("crawl_events", """
SELECT job, attempts, CASE WHEN last = 'complete' THEN 'complete' WHEN last = 'claim' THEN 'claimed'
  WHEN last = 'fail' AND attempts >= 3 THEN 'dead' ELSE 'pending' END AS status
FROM (SELECT job, arg_max(event, row(ts, event_id)) AS last,
        CAST(count(*) FILTER (WHERE event = 'fail') AS INTEGER) AS attempts
      FROM crawl_events GROUP BY job)"""))
def crawl_state_fold(c: Corpus) -> DataFrame:
    return c.crawl_progress


@query("expired_claims", with_sql("crawl_events", """
SELECT job FROM (SELECT job, arg_max(event, row(ts, event_id)) AS last, max(ts) AS last_at FROM crawl_events GROUP BY job)
WHERE last = 'claim' AND last_at < TIMESTAMP '2024-01-30 12:00:00'"""))
def expired_claims(c: Corpus) -> DataFrame:
    """Jobs whose claim is over a day old at the end of January."""
    log = c.crawl_events.select(
        F.lit("-").alias("cve_id"), F.col("job").cast("string").alias("url"), "event", F.col("ts").cast("timestamp").alias("at")
    )
    late = crawl_state.expired_claims(log, datetime(2024, 1, 31, 12, tzinfo=timezone.utc), 24)
    return late.select(F.col("url").cast("bigint").alias("job"))


@query("page_kinds", f"""
SELECT kind, domain, count(*) AS n FROM (
  SELECT {_DOMAIN} AS domain, CASE WHEN regexp_matches(lower({_DOMAIN}), '^(.*\\.)?blog\\.') OR
    regexp_matches(lower(url), '://[^/]+/(.*/)?blog/') THEN 'blog_post' ELSE 'vendor_advisory' END AS kind FROM pages)
GROUP BY kind, domain""")
def page_kinds(c: Corpus) -> DataFrame:
    url = F.col("url")
    return c.table("pages").groupBy(content_type(url).alias("kind"), domain_of(url).alias("domain")).agg(
        F.count("*").alias("n")
    )


_TEXT = """regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '<script(\\s[^>]*)?>.*?</script\\s*>|<style(\\s[^>]*)?>.*?</style\\s*>|<nav(\\s[^>]*)?>.*?</nav\\s*>|<header(\\s[^>]*)?>.*?</header\\s*>|<footer(\\s[^>]*)?>.*?</footer\\s*>|<noscript(\\s[^>]*)?>.*?</noscript\\s*>|<iframe(\\s[^>]*)?>.*?</iframe\\s*>',
  '', 'gis')"""
_TEXT = f"regexp_extract({_TEXT}, '(?is)<body(\\s[^>]*)?>(.*?)(</body\\s*>|$)', 2)"
_TEXT = f"regexp_replace({_TEXT}, '<[/!?a-zA-Z][^>]*>', '', 'g')"
_TEXT = f"replace(replace(replace(replace({_TEXT}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_TEXT = f"trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))"


@query("html_text", f"SELECT page_id, {_TEXT} AS text FROM pages")
def page_text(c: Corpus) -> DataFrame:
    return c.table("pages").select("page_id", html_text(F.col("html"), max_bytes=None).alias("text"))


@query("funnel_counts", """
WITH jobs AS (
  SELECT page_id, page_id % 10 <> 9 AS fetched, page_id % 10 = 8 AS failed, page_id % 4 = 0 AS has_vector FROM pages)
SELECT count(*) AS discovered, count(*) FILTER (WHERE fetched) AS fetched,
  count(*) FILTER (WHERE fetched AND failed) AS fetch_errors, count(*) FILTER (WHERE fetched AND NOT failed) AS extracted,
  count(*) FILTER (WHERE fetched AND NOT failed AND has_vector) AS embedded,
  count(*) FILTER (WHERE fetched AND NOT failed AND has_vector) AS stored FROM jobs""")
def funnel_counts(c: Corpus) -> DataFrame:
    """Counters of one crawl round; some pages are missing, some failed, some lack a vector."""
    refs = c.page_references
    tenth = F.col("page_id") % 10
    landed = refs.where(tenth != 9).select(
        "cve_id", "url", F.when(tenth == 8, 404).otherwise(200).alias("status"), F.encode("html", "UTF-8").alias("body")
    )
    vectors = refs.where(F.col("page_id") % 4 == 0).select(
        "cve_id", "url", F.array_repeat(F.lit(0.5).cast("float"), 8).alias("embedding")
    )
    return funnel(outcomes(refs, landed, vectors, width=8))


@query("changed_pages", """
WITH old AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || 'x' ELSE html END AS html FROM pages)
SELECT p.page_id FROM pages p JOIN old o ON o.page_id = p.page_id WHERE sha256(o.html) <> sha256(p.html)""")
def changed_pages(c: Corpus) -> DataFrame:
    """Pages whose stored copy is outdated."""
    now = c.page_references.select("page_id", "cve_id", "url", F.col("html").alias("content"))
    old = now.withColumn("content", F.when(F.col("page_id") % 5 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))
    return crawl_state.changed_pages(old, now).select("page_id")


@query("embed_queue", """
SELECT page_id FROM pages WHERE page_id % 2 = 0 AND page_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)""")
def embed_queue(c: Corpus) -> DataFrame:
    """Summarized pages without a vector."""
    pages = c.page_references.withColumn("summary", F.when(F.col("page_id") % 2 == 0, F.col("url")))
    ids = c.table("embeddings").where(F.col("label") < 5).select(F.col("vec_id").alias("page_id"))
    return crawl_state.to_embed(pages, pages.join(ids, "page_id")).select("page_id")


@query("embeddable_texts", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents WHERE length(text) // 4 > 200")
def embeddable_texts(c: Corpus) -> DataFrame:
    rows = semantic.embeddable(c.table("documents").withColumnRenamed("text", "description"))
    return rows.select("doc_id", estimate_tokens(F.col("description")).alias("tokens"))


# --- vectors ----------------------------------------------------------------------------

_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"


@query("cosine_topk", f"""
SELECT query_id, item_id, similarity, rank FROM (
  SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(v.vec_id AS VARCHAR) AS item_id, {_COS} AS similarity,
    CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, CAST(v.vec_id AS VARCHAR)) AS INTEGER) AS rank
  FROM embeddings q, embeddings v) WHERE rank <= 10""")
def cosine_topk(c: Corpus) -> DataFrame:
    """Ten nearest vectors of every vector."""
    table = c.table("embeddings")
    return semantic.nearest(
        table.select(F.col("vec_id").alias("query_id"), "embedding"),
        table.select(F.col("vec_id").alias("item_id"), "embedding"),
    )


_CENTRES = """centres AS (
  SELECT label, list(m ORDER BY i) AS embedding FROM (
    SELECT label, i, avg(x) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label)"""


def _centres(c: Corpus) -> DataFrame:
    """Mean vector per label, as question vectors."""
    each = c.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # one entry per dimension, so the list is as long as a vector
    lists = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("l"))
    return lists.select(F.col("label").cast("string").alias("query_id"), F.transform("l", lambda e: e.m).alias("embedding"))


def _asked(c: Corpus) -> DataFrame:
    """One question per label, without filters yet."""
    none = F.lit(None).cast("array<string>")
    return c.table("embeddings").select(F.col("label").cast("string").alias("intent_id")).distinct().select(
        "intent_id", none.alias("ecosystems"), none.alias("package_names"), none.alias("cve_ids"),
        F.lit(None).cast("string").alias("severity_filter"), F.lit(None).cast("string").alias("date_range"),
    )


def _semantic(c: Corpus, intents: DataFrame) -> DataFrame:
    queries = _centres(c).withColumnRenamed("query_id", "intent_id")
    vectors = _vectors(c).withColumnRenamed("item_id", "cve_id")
    found = semantic.nearest_filtered(intents, queries, vectors, c.vulns, c.packages, NOW)
    return found.select(F.col("intent_id").alias("query_id"), F.col("cve_id").alias("item_id"), "similarity", "rank")


def _vectors(c: Corpus) -> DataFrame:
    return c.table("embeddings").select(cve(F.col("vec_id")).alias("item_id"), "embedding")


_VECTORS = """vectors AS (
  SELECT 'CVE-2024-' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS item_id, embedding FROM embeddings)"""


@query("semantic_filtered", with_sql("vulns", f"""
, {_CENTRES}, {_VECTORS},
pairs AS (SELECT q.label, v.item_id, {_COS} AS similarity FROM centres q, vectors v
  JOIN vulns u ON u.cve_id = v.item_id
  WHERE u.published_at >= {NOW_SQL} - to_days(CAST(30 * (q.label + 1) AS INTEGER))
    AND (q.label % 2 = 0 OR u.severity IN ('CRITICAL', 'HIGH')))
SELECT CAST(label AS VARCHAR) AS query_id, item_id, similarity,
  CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, item_id) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 10"""))
def semantic_filtered(c: Corpus) -> DataFrame:
    """Nearest advisories per question, each within its own window and levels."""
    label = F.col("intent_id").cast("int")
    intents = _asked(c).withColumns({
        "date_range": F.concat(F.lit("last "), (label + 1).cast("string"), F.lit(" months")),
        "severity_filter": F.when(label % 2 == 1, "HIGH+"),
    })
    return _semantic(c, intents)


@query("semantic_in_ecosystem", with_sql("packages", f"""
, {_CENTRES}, {_VECTORS},
asked AS (SELECT *, ['pypi', 'npm', 'maven', 'go', 'crates.io', 'nuget'][label % 6 + 1] AS eco FROM centres),
pairs AS (SELECT q.label, v.item_id, {_COS} AS similarity FROM asked q
  JOIN (SELECT DISTINCT cve_id, ecosystem_lc FROM packages) p ON p.ecosystem_lc = q.eco
  JOIN vectors v ON v.item_id = p.cve_id)
SELECT CAST(label AS VARCHAR) AS query_id, item_id, similarity,
  CAST(row_number() OVER (PARTITION BY label ORDER BY similarity DESC, item_id) AS INTEGER) AS rank
FROM pairs QUALIFY rank <= 10"""))
def semantic_in_ecosystem(c: Corpus) -> DataFrame:
    """Nearest advisories per question among those of its ecosystem."""
    names = F.array(*[F.lit(x) for x in ("pypi", "npm", "maven", "go", "crates.io", "nuget")])
    name = F.get(names, F.col("intent_id").cast("int") % 6)
    return _semantic(c, _asked(c).withColumn("ecosystems", F.array(F.upper(name))))


@query("hybrid_merge", with_sql("vulns exploits", f"""
, {_CENTRES}, {_VECTORS},
near AS (SELECT CAST(q.label AS VARCHAR) AS intent_id, v.item_id AS cve_id, {_COS} AS similarity FROM centres q, vectors v
  QUALIFY row_number() OVER (PARTITION BY q.label ORDER BY {_COS} DESC, v.item_id) <= 10),
strict AS (SELECT CAST(q.label AS VARCHAR) AS intent_id, v.cve_id FROM centres q JOIN vulns v
    ON v.severity = 'CRITICAL' OR (q.label % 2 = 1 AND v.severity = 'HIGH')
  QUALIFY row_number() OVER (PARTITION BY q.label ORDER BY v.cisa_kev DESC, v.epss_score DESC NULLS LAST,
    v.cvss_score DESC NULLS LAST, v.published_at DESC NULLS LAST, v.cve_id) <= 50),
both_hits AS (
  SELECT intent_id, cve_id, NULL::DOUBLE AS similarity, true AS from_sql FROM strict
  UNION ALL SELECT intent_id, cve_id, similarity, false FROM near),
merged AS (SELECT intent_id, cve_id, max(similarity) AS similarity, bool_or(from_sql) AS from_sql FROM both_hits GROUP BY 1, 2),
scored AS (SELECT m.*, v.cisa_kev, v.epss_score, v.cvss_score, v.published_at,
    m.cve_id IN (SELECT cve_id FROM exploits) AS has_exploit FROM merged m JOIN vulns v ON v.cve_id = m.cve_id),
final AS (SELECT *, round(coalesce(similarity, 0) + CASE WHEN cisa_kev THEN 0.5 ELSE 0 END::DOUBLE +
    CASE WHEN has_exploit THEN 0.25 ELSE 0 END::DOUBLE + 0.25::DOUBLE * coalesce(epss_score, 0), 6) AS relevance FROM scored)
SELECT intent_id, cve_id, similarity, from_sql, has_exploit, relevance,
  CAST(row_number() OVER (PARTITION BY intent_id ORDER BY relevance DESC, cisa_kev DESC, epss_score DESC NULLS LAST,
    cvss_score DESC NULLS LAST, published_at DESC NULLS LAST, cve_id) AS INTEGER) AS rank FROM final"""))
def hybrid_merge(c: Corpus) -> DataFrame:
    """Structured hits and semantic hits of each question in one ranking."""
    centres = _centres(c)
    near = semantic.nearest(centres, _vectors(c)).select(
        F.col("query_id").alias("intent_id"), F.col("item_id").alias("cve_id"), "similarity"
    )
    odd = F.col("intent_id").cast("int") % 2 == 1
    intents = _asked(c).withColumn("severity_filter", F.when(odd, "HIGH+").otherwise("CRITICAL"))
    strict = retrieve_many(intents, c.vulns, c.packages, NOW)
    merged = semantic.hybrid(strict, near, c.vulns, c.exploits)
    return merged.select("intent_id", "cve_id", "similarity", "from_sql", "has_exploit", "relevance", "rank")
