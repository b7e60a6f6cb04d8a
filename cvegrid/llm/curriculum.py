"""Mixing sources over time: DataFrame functions only.

Each source has a target of words and a weight that changes linearly over training. Integrating the weight gives the
source's cumulative demand; a document's place in its source's stream, looked up in the inverse, gives the training
position at which its words fall due. Sorting by position makes the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, stored

#: What sources weigh, by code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Each source's weight at the start and end of training, relative to its mean; repeating likewise.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Words of the mix for a word of all sources, and the most that a source's words are repeated.
TOTAL = 1.5
MOST = 2
#: Streams are cut into this many stretches, by the first hexadecimal digits of the documents' hashes.
DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``id``, ``source`` and ``size`` (words) of every document; null text has none."""
    count = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"), count.cast("long").alias("size"))


def _repeating(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """One row per source: size, target and schedule.

    Targets share ``total`` times all words by weight, none above ``most`` times its source; the excess is shared again
    by weight. The level at which that settles is found at once: sources by their bound for a unit of weight, the ones
    below the level filled. Windows run over one row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    ranked = per_source.withColumn("rank", F.row_number().over(by_name) - 1)
    weighed = ranked.select(
        "source", "source_size", _repeating(weights, F.col("rank")).alias("weight"),
        _repeating(tuple(s[0] for s in schedules), F.col("rank")).alias("first"),
        _repeating(tuple(s[1] for s in schedules), F.col("rank")).alias("last"),
        (F.lit(float(most)) * F.col("source_size")).alias("bound"),
    )
    order = [F.col("bound") / F.col("weight"), F.asc_nulls_last("source")]
    everything = Window.partitionBy()
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = (
        weighed.withColumn("filled", F.sum("bound").over(upto) - F.col("bound"))
        .withColumn("lighter", F.sum("weight").over(upto) - F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("level", (F.lit(float(total)) * F.col("all_size") - F.col("filled")) / (F.col("all_weight") - F.col("lighter")))
        # the level counts where it does not fill its own source: there and after it, all get it
        .withColumn("settled", F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct("lighter", "level"))).over(everything))
    )
    share = F.col("settled.level") * F.col("weight")
    return filled.select(
        "source", "source_size", "first", "last",
        F.when(share.isNull() | (share > F.col("bound")), F.col("bound")).otherwise(share).alias("target"),
    )


def position(share: Column, first: Column, last: Column) -> Column:
    """When a source has used a ``share`` (0 to 1) of its words: the inverse of its integrated linear weight."""
    slope = last - first
    steep = (F.sqrt(first * first + F.lit(2.0) * slope * (share * (first + last) / 2)) - first) / slope
    return F.when(slope == 0, share).otherwise(steep)


def _placed(docs: DataFrame, id_col: str, text: str, source: str, weights: tuple, schedules: tuple, total: float, most: float) -> DataFrame:
    """Every document's size, its place ``start`` in its source's stream, its source's goal, and the words ``taken``."""
    session(docs.sparkSession)
    sized = stored(
        sizes(docs, id_col, text, source)
        .withColumn("hash", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("stretch", F.substring("hash", 1, DIGITS)),
        "sized",
    )
    sums = sized.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("stretch").alias("b"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset")
    )
    goals = targets(sized, weights, schedules, total, most).withColumnRenamed("source", "g")
    stretches = starts.join(goals, F.col("s").eqNullSafe(F.col("g"))).drop("g")
    within = Window.partitionBy("source", "stretch").orderBy("hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sized.withColumn("upto", F.sum("size").over(within))
        .join(stretches, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("b")))
        .withColumn("start", F.col("offset") + F.col("upto") - F.col("size"))
    )
    goal = F.round("target").cast("long")
    passes = F.floor(goal / F.greatest("source_size", F.lit(1)))
    rest = F.least(F.greatest(goal - passes * F.col("source_size") - F.col("start"), F.lit(0)), F.col("size"))
    return placed.select(
        "id", "size", "source_size", "target", "start", "first", "last",
        (passes * F.col("size") + rest).cast("long").alias("taken"),
    )


def _due(words_before: Column) -> Column:
    """The position at which the middle of a document falls due that has so many of its source's words before it."""
    share = (words_before + F.col("size") / 2) / F.col("target")
    return position(F.least(share, F.lit(1.0)), F.col("first"), F.col("last"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
         schedules: tuple = SCHEDULES, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """One row per document, sorted by training position: size, its source's size and target, ``taken`` and ``position``.

    A source's stream holds its documents by the MD5 of their id. Of a target, whole passes over the stream are taken,
    then words from its beginning, so the words taken are the target rounded, a document in at most ``most`` passes.
    ``position`` is where the middle of the document's first pass falls due, null if nothing is taken.

    Null text has no words and takes none, a null source is a source of its own, a null id counts as an empty string.
    Equal rows are ordered by size and take what their places give them. An empty table gives none. The stream is cut
    into stretches by hash: a source with a third of all rows is summed up in as many tasks.
    """
    placed = _placed(docs, id_col, text, source, weights, schedules, total, most)
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken",
        F.when(F.col("taken") > 0, _due(F.col("start"))).alias("position"),
    ).orderBy(F.asc_nulls_last("position"), id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS,
        schedules: tuple = SCHEDULES, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``docs`` as the mix takes them: whole, as often as ``taken`` rounds to, each copy at its training position.

    The columns stay; rows are sorted by position. Rows that share an id share the mean of what they take.
    """
    copies = (
        _placed(docs, id_col, text, source, weights, schedules, total, most)
        .groupBy("id").agg(
            F.round(F.coalesce(F.sum("taken") / F.sum("size"), F.lit(0.0))).cast("int").alias("times"),
            F.min_by(F.struct("start", "size", "source_size", "target", "first", "last"), "start").alias("at"),
        )
        .where("times > 0").select("id", "at.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
        .select(F.col("id").alias("__id"), _due(F.col("start") + F.col("pass") * F.col("source_size")).alias("__position"))
    )
    return (
        docs.join(copies, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")))
        .orderBy("__position", "__id").select(*[f"`{c}`" for c in docs.columns])
    )
