"""Registered queries: filters, ranking, sub-records, contexts, answers."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.severity import allowed_levels
from ..operators import answers, children, context, retrieval, semantic
from ..operators.intents import Intent, cutoff, has_filter, phrase_days, with_filters
from ..schemas import CHARS_PER_TOKEN
from ..session import cut
from .ask import ask
from .corpus import NOW, NOW_SQL, Corpus, with_sql
from .registry import query

_STAMP = "yyyy-MM-dd HH:mm:ss"
_SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"

#: The ranking in SQL; ``v`` is the CVE row.
_RISK = """v.cisa_kev DESC, v.epss_score DESC NULLS LAST, v.cvss_score DESC NULLS LAST,
  v.published_at DESC NULLS LAST, v.cve_id"""

_ROW = f"""v.cve_id, v.description, v.cvss_score, v.cvss_vector, v.severity, v.epss_score, v.epss_percentile,
  v.cisa_kev, strftime(v.published_at, {_SQL_STAMP}) AS published_at"""

FLAGSHIP = Intent(ecosystems=["pypi", "npm"], severity_filter="HIGH+", date_range="last 10 months")


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumn("published_at", F.date_format("published_at", _STAMP))


@query("ranked_retrieval", with_sql("vulns packages", f"""
SELECT {_ROW}, row_number() OVER (ORDER BY {_RISK}) AS rank FROM vulns v
WHERE v.severity IN ('CRITICAL', 'HIGH') AND v.published_at >= {NOW_SQL} - INTERVAL 300 DAY
  AND EXISTS (SELECT 1 FROM packages p WHERE p.cve_id = v.cve_id AND p.ecosystem_lc IN ('pypi', 'npm'))
ORDER BY {_RISK} LIMIT 50"""))
def ranked_retrieval(c: Corpus) -> DataFrame:
    return _plain(retrieval.ranked(retrieval.retrieve(c.vulns, c.packages, FLAGSHIP, NOW)))


@query("retrieve_by_package", with_sql("vulns packages", f"""
SELECT {_ROW} FROM vulns v
WHERE EXISTS (SELECT 1 FROM packages p WHERE p.cve_id = v.cve_id AND p.package_lc IN ('pkg-1', 'pkg-2')
  AND p.ecosystem_lc = 'maven')
ORDER BY {_RISK} LIMIT 50"""))
def retrieve_by_package(c: Corpus) -> DataFrame:
    """Both package conditions hold on one package row; case does not matter."""
    intent = Intent(package_names=["PKG-1", "pkg-2"], ecosystems=["Maven"])
    return _plain(retrieval.retrieve(c.vulns, c.packages, intent, NOW))


@query("retrieve_by_cve", with_sql("vulns", f"""
SELECT {_ROW} FROM vulns v
WHERE v.cve_id IN ('CVE-2024-000000000001', 'CVE-2024-000000000097', 'cve-2024-000000000002') LIMIT 50"""))
def retrieve_by_cve(c: Corpus) -> DataFrame:
    """Identifiers match exactly, case included."""
    ids = ["CVE-2024-000000000001", "CVE-2024-000000000097", "cve-2024-000000000002"]
    return _plain(retrieval.retrieve(c.vulns, c.packages, Intent(cve_ids=ids), NOW))


@query("retrieve_unparsed_date", with_sql("vulns", f"SELECT {_ROW} FROM vulns v ORDER BY {_RISK} LIMIT 50"))
def retrieve_unparsed_date(c: Corpus) -> DataFrame:
    """A phrase that is no window filters nothing: the top of the whole corpus returns."""
    return _plain(retrieval.retrieve(c.vulns, c.packages, Intent(date_range="since January 2025"), NOW))


@query("rank_with_exploits", with_sql("vulns exploits", f"""
SELECT {_ROW}, EXISTS (SELECT 1 FROM exploits e WHERE e.cve_id = v.cve_id) AS has_exploit FROM vulns v
WHERE v.severity = 'MEDIUM'
ORDER BY v.cisa_kev DESC, has_exploit DESC, v.epss_score DESC NULLS LAST, v.cvss_score DESC NULLS LAST,
  v.published_at DESC NULLS LAST, v.cve_id LIMIT 50"""))
def rank_with_exploits(c: Corpus) -> DataFrame:
    flagged = retrieval.with_exploit_flag(c.vulns, c.exploits)
    return _plain(retrieval.retrieve(flagged, c.packages, Intent(severity_filter="medium"), NOW, with_exploit=True))


@query("severity_at_least", with_sql("vulns intents", """
SELECT i.intent_id, count(v.cve_id) AS matching FROM intents i LEFT JOIN (
    SELECT severity, cve_id FROM vulns) v
  ON CASE i.severity_filter WHEN 'HIGH+' THEN v.severity IN ('CRITICAL', 'HIGH')
    WHEN 'medium+' THEN v.severity IN ('CRITICAL', 'HIGH', 'MEDIUM')
    WHEN 'critical' THEN v.severity = 'CRITICAL' END
WHERE i.severity_filter IS NOT NULL GROUP BY i.intent_id"""))
def severity_at_least(c: Corpus) -> DataFrame:
    """CVEs admitted by each question's severity filter; counted per level first."""
    levels = c.vulns.groupBy("severity").agg(F.count("*").alias("n"))
    asked = c.intents.where(F.col("severity_filter").isNotNull()).select(
        "intent_id", F.explode(allowed_levels(F.col("severity_filter"))).alias("severity")
    )
    return asked.join(levels, "severity", "left").groupBy("intent_id").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matching")
    )


@query("intent_filters", with_sql("intents", f"""
SELECT intent_id, days, severity_filter, strftime({NOW_SQL} - to_days(CAST(days AS INTEGER)), {_SQL_STAMP}) AS cutoff,
  date_range IS NOT NULL AND days IS NULL AS date_range_ignored
FROM (SELECT intent_id, severity_filter, date_range, CAST(days AS BIGINT) AS days FROM intents
  WHERE c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey > 0)
    AND (ecosystem IS NOT NULL OR package IS NOT NULL OR cve1 IS NOT NULL OR severity_filter IS NOT NULL
      OR date_range IS NOT NULL))"""))
def intent_filters(c: Corpus) -> DataFrame:
    """Questions that pass the gate, with their window in days."""
    kept = with_filters(c.intents).select("intent_id", "days", "date_range_ignored")
    return kept.join(c.intents.select("intent_id", "severity_filter"), "intent_id").select(
        "intent_id", "days", "severity_filter",
        F.date_format(cutoff(F.col("days"), NOW), _STAMP).alias("cutoff"), "date_range_ignored",
    )


@query("gate", with_sql("intents", """
SELECT intent_id, (ecosystem IS NOT NULL OR package IS NOT NULL OR cve1 IS NOT NULL OR severity_filter IS NOT NULL
  OR date_range IS NOT NULL) AS retrieves FROM intents"""))
def gate(c: Corpus) -> DataFrame:
    return c.intents.select("intent_id", has_filter().alias("retrieves"))


@query("date_phrases", with_sql("intents", """
SELECT date_range, CAST(days AS BIGINT) AS days, count(*) AS questions FROM intents
WHERE date_range IS NOT NULL GROUP BY date_range, days"""))
def date_phrases(c: Corpus) -> DataFrame:
    phrases = c.intents.where(F.col("date_range").isNotNull()).groupBy("date_range").agg(F.count("*").alias("questions"))
    return phrases.withColumn("days", phrase_days(F.col("date_range")))


_MATCHES = f"""
, affected AS (
  SELECT DISTINCT i.intent_id, p.cve_id FROM intents i JOIN packages p
    ON (i.ecosystem IS NULL OR p.ecosystem_lc = lower(i.ecosystem))
    AND (i.package IS NULL OR p.package_lc = lower(i.package))
  WHERE i.ecosystem IS NOT NULL OR i.package IS NOT NULL),
candidates AS (
  SELECT intent_id, cve_id FROM affected
  UNION ALL SELECT intent_id, v.cve_id FROM intents i JOIN vulns v ON v.cve_id IN (i.cve1, i.cve2)
  WHERE i.ecosystem IS NULL AND i.package IS NULL
  UNION ALL SELECT intent_id, v.cve_id FROM intents i, vulns v
  WHERE i.ecosystem IS NULL AND i.package IS NULL AND i.cve1 IS NULL
    AND (i.severity_filter IS NOT NULL OR i.date_range IS NOT NULL)),
hits AS (
  SELECT i.intent_id, v.*, i.date_range IS NOT NULL AND i.days IS NULL AS date_range_ignored,
    row_number() OVER (PARTITION BY i.intent_id ORDER BY {_RISK}) AS rank
  FROM candidates x JOIN intents i ON i.intent_id = x.intent_id JOIN vulns v ON v.cve_id = x.cve_id
  WHERE CASE i.severity_filter WHEN 'HIGH+' THEN v.severity IN ('CRITICAL', 'HIGH')
      WHEN 'medium+' THEN v.severity IN ('CRITICAL', 'HIGH', 'MEDIUM')
      WHEN 'critical' THEN v.severity = 'CRITICAL' ELSE true END
    AND (i.days IS NULL OR v.published_at >= {NOW_SQL} - to_days(CAST(i.days AS INTEGER)))
  QUALIFY rank <= 50)"""


@query("batch_retrieval_topk", with_sql("vulns packages intents", _MATCHES + f"""
SELECT v.intent_id, CAST(v.rank AS INTEGER) AS rank, v.date_range_ignored, {_ROW} FROM hits v"""))
def batch_retrieval(c: Corpus) -> DataFrame:
    return _plain(retrieval.retrieve_many(c.intents, c.vulns, c.packages, NOW))


#: Sub-record text per CVE in SQL, as (cve_id, kind, sort keys, segment).
_CHILDREN = """
, kids AS (
  SELECT cve_id, 'package' AS kind, ecosystem AS key1, package_name AS key2, source AS key3,
    vulnerable_versions AS value1, patched_version AS value2,
    package_name || ' (' || ecosystem || ')' || coalesce(' versions ' || vulnerable_versions, '') ||
      coalesce(' — patched in ' || patched_version, '') AS segment FROM packages
  UNION ALL
  SELECT cve_id, 'exploit', source, source_id, '', url, description,
    source || CASE WHEN url IS NOT NULL THEN ': ' || url WHEN description IS NOT NULL THEN ': ' ||
      CASE WHEN length(description) > 120 THEN left(description, 120) || '...' ELSE description END ELSE '' END
    FROM exploits
  UNION ALL SELECT cve_id, 'reference', url, '', '', NULL, NULL, url FROM refs)"""


@query("enrich_children", with_sql("vulns packages exploits refs", f"""
, winners AS (SELECT v.cve_id FROM vulns v
  WHERE v.severity IN ('CRITICAL', 'HIGH') AND v.published_at >= {NOW_SQL} - INTERVAL 300 DAY
    AND EXISTS (SELECT 1 FROM packages p WHERE p.cve_id = v.cve_id AND p.ecosystem_lc IN ('pypi', 'npm'))
  ORDER BY {_RISK} LIMIT 50)
{_CHILDREN} SELECT * FROM kids WHERE cve_id IN (SELECT cve_id FROM winners)"""))
def enrich_children(c: Corpus) -> DataFrame:
    """All sub-records of one question's result."""
    winners = retrieval.retrieve(c.vulns, c.packages, FLAGSHIP, NOW)
    return children.children_of(winners, c.packages, c.exploits, c.references)


def _all_blocks(c: Corpus, budget_tokens: int) -> DataFrame:
    kids = cut(children.children_of(c.vulns, c.packages, c.exploits, c.references))
    return context.blocks(c.vulns, kids, budget_tokens * CHARS_PER_TOKEN)


_BLOCKS = """
, texts AS (
  SELECT cve_id, kind, CASE kind WHEN 'reference' THEN string_agg(segment, ', ' ORDER BY key1, key2, key3, segment)
      ELSE string_agg(segment, '; ' ORDER BY key1, key2, key3, segment) END AS txt,
    CAST(sum(length(segment)) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM kids GROUP BY cve_id, kind),
totals AS (SELECT cve_id, CAST(sum(chars) AS BIGINT) AS chars FROM texts GROUP BY cve_id),
blocks AS (
  SELECT v.cve_id, CASE WHEN coalesce(t.chars, 0) <= {budget} THEN
    '[' || v.cve_id || '] (' || concat_ws(' | ', v.severity, 'CVSS ' || printf('%.1f', v.cvss_score),
      'EPSS ' || printf('%.2f', v.epss_score), CASE WHEN v.cisa_kev THEN 'KEV: Yes' ELSE 'KEV: No' END,
      CASE WHEN e.txt IS NOT NULL THEN 'Exploit: Yes' ELSE 'Exploit: No' END) || ')' ||
    coalesce(chr(10) || 'Affects: ' || p.txt, '') || coalesce(chr(10) || 'Description: ' || v.description, '') ||
    coalesce(chr(10) || 'Exploits: ' || e.txt, '') || coalesce(chr(10) || 'Sources: ' || r.txt, '') END AS block
  FROM vulns v LEFT JOIN totals t ON t.cve_id = v.cve_id
    LEFT JOIN texts p ON p.cve_id = v.cve_id AND p.kind = 'package'
    LEFT JOIN texts e ON e.cve_id = v.cve_id AND e.kind = 'exploit'
    LEFT JOIN texts r ON r.cve_id = v.cve_id AND r.kind = 'reference')"""


@query("context_blocks", with_sql("vulns packages exploits refs", _CHILDREN + """
SELECT v.cve_id, 0 AS line, 1 AS pos,
  '[' || v.cve_id || '] (' || concat_ws(' | ', v.severity, 'CVSS ' || printf('%.1f', v.cvss_score),
    'EPSS ' || printf('%.2f', v.epss_score), CASE WHEN v.cisa_kev THEN 'KEV: Yes' ELSE 'KEV: No' END,
    CASE WHEN v.cve_id IN (SELECT cve_id FROM kids WHERE kind = 'exploit') THEN 'Exploit: Yes' ELSE 'Exploit: No' END) || ')' AS text
FROM vulns v
UNION ALL SELECT cve_id, 2, 1, description FROM vulns WHERE description <> ''
UNION ALL SELECT cve_id, CASE kind WHEN 'package' THEN 1 WHEN 'exploit' THEN 3 ELSE 4 END,
  CAST(row_number() OVER (PARTITION BY cve_id, kind ORDER BY key1, key2, key3, segment) AS INTEGER), segment
FROM kids WHERE cve_id IN (SELECT cve_id FROM vulns)"""))
def context_blocks(c: Corpus) -> DataFrame:
    """The text block of every CVE, whatever its size, as ordered parts."""
    kids = children.children_of(c.vulns, c.packages, c.exploits, c.references)
    return context.block_lines(c.vulns, kids)


_BUDGET = 3_000


@query("context_budget", with_sql("vulns packages exploits refs", _CHILDREN
       + _BLOCKS.replace("{budget}", str(_BUDGET * CHARS_PER_TOKEN)) + f"""
, ranked AS (
  SELECT v.description AS intent_id, v.cve_id, row_number() OVER (PARTITION BY v.description ORDER BY {_RISK}) AS rank
  FROM vulns v QUALIFY rank <= 50),
summed AS (
  SELECT r.intent_id, r.cve_id, CAST(r.rank AS INTEGER) AS rank, b.block,
    CAST(sum(coalesce(length(b.block), {_BUDGET * CHARS_PER_TOKEN + 1})) OVER (PARTITION BY r.intent_id ORDER BY r.rank)
      AS BIGINT) AS used_chars
  FROM ranked r JOIN blocks b ON b.cve_id = r.cve_id)
SELECT * FROM summed WHERE used_chars <= {_BUDGET * CHARS_PER_TOKEN}"""))
def context_budget(c: Corpus) -> DataFrame:
    """CVEs of each product name packed by rank into a small budget."""
    order = Window.partitionBy("description").orderBy(*retrieval.risk_order())
    ranks = c.vulns.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 50)
    texts = _all_blocks(c, _BUDGET).select("cve_id", "block")
    rows = ranks.select(F.col("description").alias("intent_id"), "cve_id", "rank").join(texts, "cve_id")
    return context.pack(rows, _BUDGET)


@query("ask_contexts", with_sql("vulns packages intents exploits refs", _MATCHES + _CHILDREN
       + _BLOCKS.replace("{budget}", str(_BUDGET * CHARS_PER_TOKEN)) + f"""
, summed AS (
  SELECT h.intent_id, h.rank, b.block,
    sum(coalesce(length(b.block), {_BUDGET * CHARS_PER_TOKEN + 1})) OVER (PARTITION BY h.intent_id ORDER BY h.rank)
      AS used_chars
  FROM hits h JOIN blocks b ON b.cve_id = h.cve_id),
joined AS (
  SELECT intent_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS blocks
  FROM summed WHERE used_chars <= {_BUDGET * CHARS_PER_TOKEN} GROUP BY intent_id)
SELECT i.intent_id, coalesce(context, '') AS context, coalesce(blocks, 0) AS blocks,
  CASE WHEN context IS NULL THEN 'conversational' ELSE 'grounded' END AS mode
FROM intents i LEFT JOIN joined j ON j.intent_id = i.intent_id"""))
def ask_contexts(c: Corpus) -> DataFrame:
    """The whole read path for a table of questions."""
    return ask(c.intents, c.vulns, c.packages, c.exploits, c.references, NOW, _BUDGET)


@query("keyword_search", with_sql("vulns", f"SELECT {_ROW} FROM vulns v WHERE v.description ILIKE '%RED%'"))
def keyword_search(c: Corpus) -> DataFrame:
    return _plain(semantic.keyword_search(c.vulns, "RED"))


# --- answers ------------------------------------------------------------------------

_PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, u.text AS context, a.text AS answer FROM conversations a
  JOIN conversations u ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE a.role = 'assistant' AND u.role = 'user')"""

#: The texts hold no CVE ids; capitalized words stand for identifiers.
_WORDS = "[A-Z][a-z]{3,}"


def _pairs(c: Corpus) -> DataFrame:
    turns = c.table("conversations")
    said = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context")
    )
    return said.join(asked, ["conv_id", "turn"])


@query("grounding_check", f"WITH {_PAIRS}" + f"""
, ids AS (SELECT conv_id, turn, context, list_sort(list_distinct(regexp_extract_all(context, '{_WORDS}'))) AS seen,
  list_sort(list_distinct(regexp_extract_all(answer, '{_WORDS}'))) AS said FROM pairs)
SELECT conv_id, turn,
  CASE WHEN context <> '' THEN array_to_string(list_filter(said, lambda x: NOT list_contains(seen, x)), ',') ELSE '' END
    AS not_in_context,
  CASE WHEN context <> '' THEN array_to_string(list_filter(seen, lambda x: NOT list_contains(said, x)), ',') ELSE '' END
    AS not_cited FROM ids""")
def grounding_check(c: Corpus) -> DataFrame:
    return answers.grounding(_pairs(c), _WORDS).select(
        "conv_id", "turn", F.array_join("not_in_context", ",").alias("not_in_context"),
        F.array_join("not_cited", ",").alias("not_cited"),
    )


@query("answer_annotation", f"WITH {_PAIRS}" + f"""
, ids AS (SELECT conv_id, turn, context, answer,
  list_sort(list_distinct(regexp_extract_all(context, '{_WORDS}'))) AS seen,
  list_sort(list_distinct(regexp_extract_all(answer, '{_WORDS}'))) AS said FROM pairs),
found AS (SELECT conv_id, turn, answer,
  CASE WHEN context <> '' THEN list_filter(said, lambda x: NOT list_contains(seen, x)) ELSE [] END AS bad,
  CASE WHEN context <> '' THEN list_filter(seen, lambda x: NOT list_contains(said, x)) ELSE [] END AS missed FROM ids)
SELECT conv_id, turn, CAST(len(bad) AS INTEGER) AS claim_count, CAST(len(bad) AS INTEGER) AS unsupported_count,
  answer || CASE WHEN len(bad) > 0 THEN chr(10) || chr(10) || '---' || chr(10) ||
      '**Note:** The following claims could not be verified against the retrieved data and may be inaccurate:' ||
      chr(10) || array_to_string(list_transform(bad, lambda x: '- mentions ' || x || ' (Reason: not in the retrieved data)'), chr(10))
    ELSE '' END ||
    CASE WHEN len(missed) > 0 THEN chr(10) || chr(10) || '---' || chr(10) ||
      '**Additional information** from the retrieved data that may be relevant:' || chr(10) ||
      array_to_string(list_transform(missed, lambda x: '- ' || x), chr(10)) ELSE '' END AS final_answer
FROM found""")
def answer_annotation(c: Corpus) -> DataFrame:
    checked = answers.grounding_claims(answers.grounding(_pairs(c), _WORDS))
    return answers.annotate(checked).select("conv_id", "turn", "claim_count", "unsupported_count", "final_answer")
