"""Severity ladder."""

from pyspark.sql import Column, functions as F

from ..schemas import SEVERITY_LADDER


def known_level(col: Column) -> Column:
    """Upper-case level; empty and UNKNOWN count as absent."""
    up = F.upper(col)
    return F.when(~up.isin("", "UNKNOWN"), up)


def allowed_levels(filter_col: Column) -> Column:
    """Levels a severity filter admits.

    ``HIGH`` -> [HIGH]; ``HIGH+`` -> [CRITICAL, HIGH]. A level outside the
    ladder with ``+`` admits only the top. An absent filter gives NULL.
    """
    level = F.upper(F.rtrim(filter_col, F.lit("+")))
    ladder = F.array(*[F.lit(s) for s in SEVERITY_LADDER])
    depth = F.greatest(F.array_position(ladder, level), F.lit(1)).cast("int")
    return F.when(filter_col.endswith("+"), F.slice(ladder, F.lit(1), depth)).when(
        filter_col != "", F.array(level)
    )


def allowed_levels_of(text: str) -> list[str]:
    """The same rule for one literal filter."""
    level = text.rstrip("+").upper()
    if not text.endswith("+"):
        return [level]
    depth = SEVERITY_LADDER.index(level) + 1 if level in SEVERITY_LADDER else 1
    return SEVERITY_LADDER[:depth]
