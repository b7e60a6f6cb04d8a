"""Which points lie in which ranges, by an equi-join: ranks, and blocks of ranks that double in size.

All distinct points get a number in the order of their group and key. A range of numbers falls into at most two blocks of
each size, a point lies in one block of each size, so a point is in a range exactly if they share one block. Nothing is
compared that does not match, and a large group is spread over its blocks.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut

#: Rows of a partition are numbered below this by ``monotonically_increasing_id``.
_SHIFT = 33


def ranked(points: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """The distinct points with ``rank``, 0, 1, ... in the order of ``by``, and how many bits the ranks need.

    A range sort numbers the rows of its partitions; what the partitions before hold is added, one row a partition.
    """
    ordered = points.select(*by).distinct().repartitionByRange(*by).sortWithinPartitions(*by)
    numbered = cut(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _SHIFT)
    counts = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    ranks = numbered.withColumn("_part", part).join(before, "_part").withColumn(
        "rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    return ranks.select(*by, "rank"), int(total).bit_length()


def blocks_of_point(rank: Column, bits: int) -> Column:
    """The blocks ``(size, place)`` that hold a rank, one of each size."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda k: F.struct(
        k.alias("size"), F.floor(rank / F.pow(F.lit(2.0), k)).cast("long").alias("place")))


def blocks_of_range(low: Column, high: Column, bits: int) -> Column:
    """The fewest blocks that make up the ranks ``low`` to ``high``, both included; none if ``low`` is above ``high``."""
    none = F.array().cast("array<struct<size:int,place:bigint>>")

    def of_size(k: Column) -> Column:
        size = F.pow(F.lit(2.0), k)
        first, end = F.ceil(low / size).cast("long"), F.floor((high + 1) / size).cast("long")
        open_ = first < end
        block = lambda place: F.array(F.struct(k.alias("size"), place.alias("place")))
        return F.concat(
            F.when(open_ & (first % 2 == 1), block(first)).otherwise(none),
            F.when(open_ & (end % 2 == 1), block(end - 1)).otherwise(none))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bits)), of_size))
