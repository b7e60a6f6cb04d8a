"""Filtered, risk-ranked retrieval for one question or for a table of them."""

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.severity import allowed_levels_of
from ..functions.text import canonical_ecosystem
from ..schemas import RESULT_LIMIT
from .intents import Intent, cutoff, days_of, package_tags, wanted_tags, with_filters

RESULT_COLUMNS = [
    "cve_id", "description", "cvss_score", "cvss_vector", "severity",
    "epss_score", "epss_percentile", "cisa_kev", "published_at",
]


def risk_order(with_exploit: bool = False) -> list[Column]:
    """Most urgent first. ``with_exploit`` also weighs a ``has_exploit`` column."""
    return [
        F.coalesce("cisa_kev", F.lit(False)).desc(),
        *([F.col("has_exploit").desc()] if with_exploit else []),
        F.col("epss_score").desc_nulls_last(),
        F.col("cvss_score").desc_nulls_last(),
        F.col("published_at").desc_nulls_last(),
        F.col("cve_id").asc(),
    ]


def with_exploit_flag(vulns: DataFrame, exploits: DataFrame) -> DataFrame:
    """Adds ``has_exploit``."""
    known = exploits.select("cve_id").distinct().withColumn("has_exploit", F.lit(True))
    return vulns.join(known, "cve_id", "left").withColumn("has_exploit", F.coalesce("has_exploit", F.lit(False)))


# --- one question -------------------------------------------------------------------

def _package_filter(packages: DataFrame, intent: Intent) -> DataFrame:
    """Both conditions hold on the same package row."""
    conditions = []
    if intent.package_names:
        conditions.append(F.col("package_lc").isin([n.lower() for n in intent.package_names]))
    if intent.ecosystems:
        conditions.append(F.col("ecosystem_lc").isin([e.lower() for e in intent.ecosystems]))
    return packages.where(reduce(and_, conditions)).select("cve_id")


def retrieve(
    vulns: DataFrame,
    packages: DataFrame,
    intent: Intent,
    now: datetime,
    limit: int = RESULT_LIMIT,
    with_exploit: bool = False,
) -> DataFrame:
    """The top rows for one question; no filter at all gives no rows.

    Packages are only looked at when asked for, and as a semi join: the result
    is one row per CVE however many of its packages match.
    """
    conditions = []
    if intent.cve_ids:
        conditions.append(F.col("cve_id").isin(intent.cve_ids))
    if intent.severity_filter:
        conditions.append(F.col("severity").isin(allowed_levels_of(intent.severity_filter)))
    days = days_of(intent.date_range) if intent.date_range else None
    if days is not None:
        conditions.append(F.col("published_at") >= cutoff(F.lit(days), now))
    if not (conditions or intent.package_names or intent.ecosystems or intent.date_range):
        conditions.append(F.lit(False))
    out = vulns.where(reduce(and_, conditions)) if conditions else vulns
    if intent.package_names or intent.ecosystems:
        out = out.join(_package_filter(packages, intent), "cve_id", "left_semi")
    extra = ["has_exploit"] if with_exploit else []
    return out.select(*RESULT_COLUMNS, *extra).orderBy(*risk_order(with_exploit)).limit(limit)


def ranked(rows: DataFrame) -> DataFrame:
    """Numbers the rows of one question's result (at most the result limit)."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*risk_order())))


# --- a table of questions -----------------------------------------------------------

_RANK_COLUMNS = ["cve_id", "severity", "cisa_kev", "epss_score", "cvss_score", "published_at"]


def _top(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Best rows per key; each task keeps only its own best before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(*risk_order())
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def age_days(now: datetime) -> Column:
    """Whole days back that a date filter must reach to admit the row.

    All filters of one run start a whole number of days before the same
    ``now``, so rows of equal age pass or fail together.
    """
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("published_at")
    age = F.greatest(F.ceil(micros / F.lit(86_400_000_000)), F.lit(0)).cast("bigint")
    # a row without a date passes no date filter
    return F.when(F.col("published_at").isNotNull(), age)


def _passes(filters: DataFrame) -> DataFrame:
    """Severity and date filters of a question against the row's class."""
    level = F.col("levels").isNull() | F.array_contains("levels", F.col("severity"))
    dated = F.col("days").isNull() | (F.col("age") <= F.col("days"))
    return filters.where(level & dated)


def retrieve_many(
    intents: DataFrame,
    vulns: DataFrame,
    packages: DataFrame,
    now: datetime,
    limit: int = RESULT_LIMIT,
) -> DataFrame:
    """Top rows of every question: ``(intent_id, rank, result columns…)``.

    The ranking is the same for all questions, so a question's top rows are
    among the top rows of the classes it admits, a class being rows of equal
    package condition, severity and age in days. Each class is cut to ``limit``
    first; what questions are joined with is bounded by the number of classes
    and not by the size of the corpus. Questions naming CVEs join on the id.
    """
    filters = with_filters(intents)
    found = retrieve_distinct(filters, vulns, packages, now, limit)
    answers = filters.select("intent_id", "signature", "date_range_ignored").join(found, "signature")
    return answers.select("cve_id", "intent_id", "date_range_ignored", "rank", *RESULT_COLUMNS[1:])


def retrieve_distinct(
    filters: DataFrame, vulns: DataFrame, packages: DataFrame, now: datetime, limit: int = RESULT_LIMIT
) -> DataFrame:
    """Top rows of every distinct question of ``with_filters``: ``(signature, rank, result columns…)``.

    However many questions are equal, their rows are one answer's until they are handed out.
    """
    signatures = filters.select(
        "signature", "cve_ids", "packages", "ecosystems", "levels", "days"
    ).dropDuplicates(["signature"])
    corpus = vulns.select(
        "cve_id", "severity", F.coalesce("cisa_kev", F.lit(False)).alias("cisa_kev"),
        "epss_score", "cvss_score", "published_at",
    ).withColumn("age", age_days(now))

    by_class, tagged = F.col("cve_ids").isNull(), F.col("tags").isNotNull()
    signatures = signatures.withColumn("tags", wanted_tags())
    atoms = signatures.select("signature", "cve_ids", "levels", "days", F.explode_outer("tags").alias("tag"))
    tags = package_tags(packages, atoms.where(F.col("tag").isNotNull()))
    parts = [
        _join_classes(atoms.where(by_class & F.col("tag").isNotNull()), tags, corpus, limit),
        _join_severity(signatures.where(by_class & ~tagged), corpus, limit),
        _join_ids(atoms.where(~by_class), tags, corpus),
    ]
    found = reduce(DataFrame.unionByName, parts).dropDuplicates(["signature", "cve_id"])
    best = _top(found, ["signature"], limit).select("signature", "rank", "cve_id")
    return best.join(vulns.select(*RESULT_COLUMNS), "cve_id").select("signature", "rank", *RESULT_COLUMNS)


def _join_classes(atoms: DataFrame, tags: DataFrame, corpus: DataFrame, limit: int) -> DataFrame:
    classes = _top(tags.join(corpus, "cve_id"), ["tag", "severity", "age"], limit).drop("rank")
    return _passes(atoms.join(classes, "tag")).select("signature", *_RANK_COLUMNS)


def _join_severity(signatures: DataFrame, corpus: DataFrame, limit: int) -> DataFrame:
    """Questions without a key to join on: each admitted level is one."""
    classes = _top(corpus, ["severity", "age"], limit).drop("rank")
    any_level = F.array(F.lit("*"))
    wanted = signatures.select(
        "signature", "days", "levels", F.explode(F.coalesce("levels", any_level)).alias("level")
    )
    listed = classes.select("*", F.explode(F.array(F.coalesce("severity", F.lit("")), F.lit("*"))).alias("level"))
    return _passes(wanted.join(listed, "level")).select("signature", *_RANK_COLUMNS)


def _join_ids(atoms: DataFrame, tags: DataFrame, corpus: DataFrame) -> DataFrame:
    """Questions that name CVEs, with their other filters checked afterwards."""
    named = atoms.select("signature", "levels", "days", "tag", F.explode("cve_ids").alias("cve_id"))
    free = named.where(F.col("tag").isNull())
    bound = named.join(tags, ["cve_id", "tag"], "left_semi")
    hits = free.unionByName(bound.select(*free.columns)).drop("tag").distinct()
    return _passes(hits.join(corpus, "cve_id")).select("signature", *_RANK_COLUMNS)


def with_aliases(intents: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions and packages with canonical ecosystem names, for matching across
    feeds that name an ecosystem differently. Without this, names match as they are."""
    asked = intents.withColumn("ecosystems", F.transform("ecosystems", canonical_ecosystem))
    named = packages.withColumn("ecosystem_lc", F.lower(canonical_ecosystem(F.col("ecosystem"))))
    return asked, named
