"""Structured questions: gate, filters and their distinct signatures."""

import re
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.severity import allowed_levels

# Phrase pattern and days per unit.
DATE_PHRASE = r"(?i)last\s+(\d+)\s+(day|week|month|year)s?"
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


@dataclass(frozen=True)
class Intent:
    """One question, already parsed."""

    cve_ids: list[str] = field(default_factory=list)
    package_names: list[str] = field(default_factory=list)
    ecosystems: list[str] = field(default_factory=list)
    severity_filter: str | None = None
    date_range: str | None = None


def phrase_days(phrase: Column) -> Column:
    """Length of ``last N units`` in days; any other phrase gives NULL, i.e. no filter."""
    amount = F.nullif(F.regexp_extract(phrase, DATE_PHRASE, 1), F.lit("")).try_cast("bigint")
    unit = F.lower(F.regexp_extract(phrase, DATE_PHRASE, 2))
    days = F.lit(None).cast("bigint")
    for name, length in UNIT_DAYS.items():
        days = F.when(unit == name, amount * length).otherwise(days)
    return days


def days_of(phrase: str) -> int | None:
    """The same for one literal phrase."""
    found = re.search(DATE_PHRASE, phrase)
    return int(found.group(1)) * UNIT_DAYS[found.group(2).lower()] if found else None


def cutoff(days: Column, now: datetime) -> Column:
    """Instant ``days`` before ``now``."""
    return F.lit(now).cast("timestamp") - F.make_dt_interval(days.cast("int"))


def filled(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def has_filter() -> Column:
    """Whether a question carries at least one structured filter."""
    return (
        filled(F.col("cve_ids"))
        | filled(F.col("package_names"))
        | filled(F.col("ecosystems"))
        | (F.coalesce("severity_filter", F.lit("")) != "")
        | (F.coalesce("date_range", F.lit("")) != "")
    )


def gated(intents: DataFrame) -> DataFrame:
    """Only questions with a structured filter retrieve anything."""
    return intents.where(has_filter())


def _lowered(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(name, F.lower)))


def with_filters(intents: DataFrame) -> DataFrame:
    """Filters in comparable form: sorted lists, allowed levels, days back.

    Equal questions get equal ``signature``, so their retrieval runs once.
    ``date_range_ignored`` marks phrases that give no filter.
    """
    out = gated(intents).select(
        "intent_id",
        F.when(filled(F.col("cve_ids")), F.array_sort(F.array_distinct("cve_ids"))).alias("cve_ids"),
        F.when(filled(F.col("package_names")), _lowered("package_names")).alias("packages"),
        F.when(filled(F.col("ecosystems")), _lowered("ecosystems")).alias("ecosystems"),
        allowed_levels(F.col("severity_filter")).alias("levels"),
        phrase_days(F.col("date_range")).alias("days"),
        (F.coalesce("date_range", F.lit("")) != "").alias("_dated"),
    )
    return out.select(
        "intent_id",
        F.to_json(F.struct("cve_ids", "packages", "ecosystems", "levels", "days")).alias("signature"),
        "cve_ids", "packages", "ecosystems", "levels", "days",
        (F.col("_dated") & F.col("days").isNull()).alias("date_range_ignored"),
    )


# --- package conditions as tags ---------------------------------------------------

def _tag(ecosystem: Column, package: Column) -> Column:
    return F.concat(F.coalesce(ecosystem, F.lit("")), F.lit("\u0001"), F.coalesce(package, F.lit("")))


def wanted_tags() -> Column:
    """One tag per (ecosystem, package) combination a question asks for, NULL
    without a package condition. A missing side of the pair stays empty."""
    any_one = F.array(F.lit(None).cast("string"))
    ecosystems, packages = F.coalesce("ecosystems", any_one), F.coalesce("packages", any_one)
    pairs = F.flatten(F.transform(ecosystems, lambda e: F.transform(packages, lambda p: _tag(e, p))))
    return F.when(F.col("ecosystems").isNotNull() | F.col("packages").isNotNull(), pairs)


def package_tags(packages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct ``(cve_id, tag)`` for the tags in ``wanted``.

    Both conditions of a pair hold on one package row. However many package
    rows a CVE has, it keeps at most one row per wanted tag.
    """
    none = F.lit(None).cast("string")
    eco, pkg = F.col("ecosystem_lc"), F.col("package_lc")
    tags = packages.select("cve_id", F.explode(F.array(_tag(eco, pkg), _tag(eco, none), _tag(none, pkg))).alias("tag"))
    return tags.join(wanted.select("tag").distinct(), "tag", "left_semi").distinct()
