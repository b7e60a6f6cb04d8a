"""Secrets, told apart by who holds them: DataFrame functions only.

Candidates are the findings of fixed patterns and longer strings of mixed characters. Corpus-wide, each candidate's hash
is counted by distinct owners and repositories. What many owners hold is an example that was copied around; what one or
two hold is a live-looking credential of theirs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, stored
from .spans import SPAN

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "owned")
#: More owners than this, or more repositories, make a candidate a copied example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 4
MASK = "[REDACTED]"

_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The lengths that make these two a finding are part of the pattern: shorter runs hold no longer ones.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Other strings long enough for a key, with a digit and both cases.
MIXED = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "owned": MIXED}


def _matches(text: Column, kind: str) -> Column:
    """The matches of a kind's pattern, in order."""
    return F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))


def _holds(kind: str, match: Column) -> Column:
    """Whether a match is a finding."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 12
    if kind == "owned":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def _value(kind: str, match: Column) -> Column:
    """What is hashed: the credential without the name it is assigned to."""
    return F.regexp_extract(match, ASSIGN, 2) if kind == "assign" else match


def _gaps(text: Column, kind: str, matches: Column) -> Column:
    """The lengths of what stands before each match; only texts with matches are split."""
    lengths = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    return F.when(F.size(matches) > 0, F.slice(lengths, 1, F.size(matches))).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source",
         repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One written row per document: id, row number, owner, repository, and each kind's matches with the gaps before."""
    session(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(F.col(f"`{owner}`")).alias("owner"),
        F.xxhash64(*[F.col(f"`{c}`") for c in repository]).alias("repository"),
        t.alias("text"),
    ).select("id", "owner", "repository", "text", *[_matches(F.col("text"), k).alias(f"m_{k}") for k in KINDS])
    rows = found.select("id", "owner", "repository", *[
        F.zip_with(
            _gaps(F.col("text"), k, F.col(f"m_{k}")), F.col(f"m_{k}"),
            lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")),
        ).alias(k)
        for k in KINDS
    ])
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "secrets")


def _places(found: DataFrame) -> DataFrame:
    """One row per finding, with its place in code points; the strings themselves are only hashed."""
    parts = []
    for rank, kind in enumerate(KINDS):
        each = found.where(F.size(kind) > 0).select("row", "owner", "repository", F.posexplode(kind).alias("i", "z"))
        until = Window.partitionBy("row").orderBy("i")
        length = F.length("z.match")
        parts.append(
            each.withColumn("end", F.sum(F.col("z.gap") + length).over(until).cast("int"))
            .select("row", "owner", "repository", (F.col("end") - length).alias("start"), F.lit(rank).alias("rank"), "end",
                    F.lit(kind).alias("kind"), F.xxhash64(_value(kind, F.col("z.match"))).alias("hash"), F.col("z.match").alias("match"))
            .where(_holds(kind, F.col("match")))
        )
    return reduce(DataFrame.unionAll, parts)


def _apart(places: DataFrame) -> DataFrame:
    """Drop mixed strings that overlap a finding of the fixed patterns, by running ends and starts along each text."""
    base = F.col("kind") != "owned"
    forth = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        places.withColumn("reached", F.max(F.when(base, F.col("end"))).over(forth))
        .withColumn("next", F.min(F.when(base, F.col("start"))).over(back))
        .where(base | (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
        .drop("reached", "next")
    )


def ownership(places: DataFrame) -> DataFrame:
    """Per candidate hash: distinct owners and repositories, and how often it occurs.

    Counted by (hash, owner, repository) first, so a string held by a third of all rows leaves each task as one row
    per owner and repository.
    """
    return (
        places.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))
        .withColumn("copied", (F.col("owners") > MAX_OWNERS) | (F.col("repositories") > MAX_REPOSITORIES))
    )


def judged(found: DataFrame) -> DataFrame:
    """All findings with ``copied``. Mixed strings count as findings only where few hold them."""
    places = stored(_apart(_places(found)), "candidates")
    return places.join(ownership(places), "hash").where((F.col("kind") != "owned") | ~F.col("copied"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source",
         repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of ``docs``: its id, ``base`` and ``added`` spans (code points, end exclusive), and how many
    findings are ``n_owned`` and ``n_copied``.

    Null text counts as empty, a null owner as an owner of its own. Repeated rows are scanned each for itself and count
    once per owner; null ids stay null; other columns do not matter; an empty table gives none.
    """
    found = scan(docs, id_col, text, owner, repository)
    span = F.struct(F.col("start"), F.col("rank"), F.col("end"), F.col("kind"))
    base = F.col("kind") != "owned"
    per_row = judged(found).groupBy("row").agg(
        F.collect_list(F.when(base, span)).cast(f"array<{SPAN}>").alias("base"),
        F.collect_list(F.when(~base, span)).cast(f"array<{SPAN}>").alias("added"),
        F.count_if(~F.col("copied")).alias("n_owned"),
        F.count_if("copied").alias("n_copied"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    return found.select("row", F.col("id").alias(id_col)).join(per_row, "row", "left").select(
        id_col,
        F.coalesce("base", none).alias("base"),
        F.coalesce("added", none).alias("added"),
        F.coalesce("n_owned", F.lit(0).cast("long")).alias("n_owned"),
        F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
    )


def _masked(text: Column, kind: str, owned: Column) -> Column:
    """``text`` with the owned findings of a kind masked: pieces and matches are put together again."""
    matches = _matches(text, kind)
    masked = F.transform(matches, lambda m: F.when(F.array_contains(owned, m), F.lit(MASK)).otherwise(m))
    pieces = F.zip_with(F.split(text, PATTERNS[kind], -1), masked, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.when(F.size(matches) > 0, F.array_join(pieces, "")).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source",
           repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """``docs`` with every owner-specific finding replaced by ``MASK``; copied examples and all rows stay.

    Only texts with some match travel to meet their findings. Rows that share an id share what is masked in them.
    """
    session(docs.sparkSession)
    has_match = reduce(
        lambda a, b: a | b, [F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(PATTERNS[k]) for k in KINDS]
    )
    found = scan(docs.where(has_match), id_col, text, owner, repository)
    owned = (
        judged(found).where(~F.col("copied")).join(found.select("row", "id"), "row")
        .groupBy("id").agg(F.collect_set("match").alias("__owned"))
        .withColumnRenamed("id", "__id")
    )
    matched = docs.where(has_match).join(owned, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")), "left")
    masked = matched.withColumn("__text", F.col(f"`{text}`"))
    for kind in KINDS:
        masked = masked.withColumn(
            "__text", F.when(F.col("__owned").isNotNull(), _masked(F.col("__text"), kind, F.col("__owned"))).otherwise(F.col("__text"))
        )
    return masked.withColumn(text, F.col("__text")).select(*[f"`{c}`" for c in docs.columns]).unionAll(docs.where(~has_match))
