"""Projects' dependencies against affected packages."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.severity import allowed_levels_of
from ..functions.versions import parse_ranges, scheme_of, version_key
from ..schemas import SEVERITY_LADDER
from ..session import cut
from .stabbing import blocks_of_point, blocks_of_range, ranked


def explode_projects(projects: DataFrame) -> DataFrame:
    """``(project, dependencies ARRAY<STRUCT<ecosystem, package, version>>)`` to one row each."""
    return projects.select("project", F.inline("dependencies"))


#: Above every version key, which begin with a digit.
_TOP = "~"


def affected(versions: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Versions ``(keys, version, key)`` with the ``cve_id`` and ``patched_version`` of the ranges that they lie in.

    Bounds and versions are ranked together; a version and a range meet in the block of ranks that they share.
    """
    bounded = ranges.withColumn("hi", F.coalesce("hi", F.lit(_TOP)))
    ends = [bounded.select(*keys, F.col(end).alias("key")) for end in ("lo", "hi")]
    ranks, bits = ranked(versions.select(*keys, "key").unionByName(ends[0]).unionByName(ends[1]), [*keys, "key"])
    low = F.col("low_rank") + F.when(F.col("lo_in"), 0).otherwise(1)
    high = F.col("high_rank") - F.when(F.coalesce("hi_in", F.lit(False)), 0).otherwise(1)
    placed = (
        bounded.join(ranks.withColumnsRenamed({"key": "lo", "rank": "low_rank"}), [*keys, "lo"])
        .join(ranks.withColumnsRenamed({"key": "hi", "rank": "high_rank"}), [*keys, "hi"])
        .select("cve_id", "patched_version", F.inline(blocks_of_range(low, high, bits)))
    )
    points = versions.join(ranks, [*keys, "key"]).select(*keys, "version", F.inline(blocks_of_point(F.col("rank"), bits)))
    return points.join(placed, ["size", "place"]).select(*keys, "version", "cve_id", "patched_version")


def match(
    dependencies: DataFrame, packages: DataFrame, facts: DataFrame | None = None, within: list[str] | None = None
) -> DataFrame:
    """Dependencies ``(project, ecosystem, package, version, ...)`` with the CVEs they may have.

    ``status`` is affected or unknown; a version outside every range gives no
    row. Each distinct version is looked up once, by the order of its ecosystem,
    then handed to its projects with whatever else their rows say.

    ``facts`` ``(cve_id, ...)`` are joined to the CVEs of a version before these
    are handed out, far fewer rows than the matches; CVEs without facts give no
    row. With ``within``, columns of the dependencies, ``again`` says whether a
    CVE may come more than once among the rows of equal values there: never
    where they have one dependency, or one version of each package and a CVE
    of a single package.
    """
    deps = dependencies.withColumns({"ecosystem_lc": F.lower("ecosystem"), "package_lc": F.lower("package")})
    keys = ["ecosystem_lc", "package_lc"]
    scheme = scheme_of(F.col("ecosystem_lc"))
    versions = cut(deps.select(*keys, "version").distinct().withColumn("key", version_key(F.col("version"), scheme)))
    # only packages somebody uses, one row per range; without a range nothing can be told
    ranges = cut(
        packages.join(versions.select(*keys).distinct(), keys, "left_semi")
        .select(*keys, "cve_id", "patched_version", F.explode_outer(parse_ranges(F.col("vulnerable_versions"), scheme)).alias("r"))
        .select(*keys, "cve_id", "patched_version", "r.*")
    )
    found = affected(versions.where("key IS NOT NULL"), ranges.where("known"), keys).withColumn("_level", F.lit(2))
    # what cannot be told: a version without order with all CVEs of its package, any version with those of a range without order
    grouped = lambda rows: rows.groupBy(*keys, "cve_id").agg(F.max("patched_version").alias("patched_version"))
    dark = ranges.where("known IS NULL OR NOT known")
    unclear = (
        versions.where("key IS NULL").join(grouped(ranges), keys)
        .unionByName(versions.where("key IS NOT NULL").join(grouped(dark), keys)).drop("key").withColumn("_level", F.lit(1))
    )
    hits = found.unionByName(unclear).groupBy(*keys, "version", "cve_id").agg(
        F.max("_level").alias("_level"), F.max("patched_version").alias("patched_version"))
    more = []
    if facts is not None:
        hits = hits.join(facts, "cve_id")
        more += [c for c in facts.columns if c != "cve_id"]
    if within:
        several = ranges.select(*keys, "cve_id").distinct().groupBy("cve_id").agg((F.count("*") > 1).alias("_several"))
        hits = hits.join(several.where("_several"), "cve_id", "left")
        deps = deps.withColumn("_same", F.count("*").over(Window.partitionBy(*within, *keys))).withColumn(
            "_all", F.count("*").over(Window.partitionBy(*within)))
        again = (F.col("_all") > 1) & ((F.col("_same") > 1) | F.col("_several").isNotNull())
        more.append(again.alias("again"))
    return deps.join(hits, [*keys, "version"]).select(
        *dependencies.columns, "cve_id",
        F.when(F.col("_level") == 2, "affected").otherwise("unknown").alias("status"), "patched_version", *more,
    )


def alerts(matches: DataFrame, vulns: DataFrame, min_severity: str = "HIGH", min_epss: float = 0.5) -> DataFrame:
    """Matches worth a notice: severe enough, likely exploited, and surely affected."""
    urgent = F.col("severity").isin(allowed_levels_of(f"{min_severity}+")) & (
        F.coalesce("cisa_kev", F.lit(False)) | (F.coalesce("epss_score", F.lit(0.0)) > min_epss)
    )
    facts = vulns.where(urgent).select("cve_id", "severity", "cisa_kev", "epss_score")
    return matches.where(F.col("status") == "affected").join(facts, "cve_id")


#: Parts that the CVEs of a project and day fall into.
_SHARES = 8
_LEVELS = [*[level.lower() for level in SEVERITY_LADDER], "total"]


def level_counts(vulns: DataFrame) -> DataFrame:
    """What a CVE counts for in ``severity_trend``: one row each, its rows per level and in all."""
    return vulns.groupBy("cve_id").agg(
        *[F.count_if(F.col("severity") == level).alias(level.lower()) for level in SEVERITY_LADDER],
        F.count("*").alias("total"),
    )


def severity_trend(matches: DataFrame, vulns: DataFrame, day: str = "day") -> DataFrame:
    """Per project and day: CVEs per level and the change of the total since the day before listed.

    A CVE counts once, whatever it comes from. Matches may bring their ``level_counts`` as facts, and ``again`` for
    equal ``project`` and ``day``: then the tasks that make them add up what comes once, and only the rest is shuffled.
    """
    rows = matches if set(_LEVELS) <= set(matches.columns) else matches.join(level_counts(vulns), "cve_id")
    again = rows.where("again") if "again" in rows.columns else rows
    # dealt as they are: tasks that make them hold few of the same CVE, and would spill looking for them; a project's day
    # falls into several parts, each of which leaves one row
    share = F.pmod(F.xxhash64("cve_id"), F.lit(_SHARES)).alias("_share")
    dealt = again.select("project", day, share, "cve_id", *_LEVELS).repartition("project", day, "_share")
    found = dealt.distinct().drop("_share", "cve_id")
    if again is not rows:
        found = found.unionByName(rows.where("NOT again").select(*found.columns))
    counts = found.groupBy("project", day).agg(*[F.sum(c).alias(c) for c in _LEVELS])
    before = F.lag("total").over(Window.partitionBy("project").orderBy(day))
    return counts.withColumn("change", F.col("total") - F.coalesce(before, F.lit(0)))
