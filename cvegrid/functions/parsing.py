"""Text to date, time and number; anything unreadable becomes NULL."""

from pyspark.sql import Column, functions as F

_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def parse_instant(col: Column) -> Column:
    """ISO instant; a value without zone is UTC (the session zone)."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), col.try_cast("timestamp"))


def parse_iso_date(col: Column) -> Column:
    """Calendar date, ``2024-11-08`` or ``20241108``, nothing else."""
    return F.when(
        col.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(col, F.lit("yyyy-MM-dd")).cast("date")
    ).when(
        col.rlike(r"^\d{8}$"), F.try_to_timestamp(col, F.lit("yyyyMMdd")).cast("date")
    )


def parse_day(col: Column) -> Column:
    """Midnight UTC of ``year-month-day``; month and day may be one digit."""
    return F.when(
        col.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(col, F.lit("yyyy-M-d"))
    )


def parse_float(col: Column) -> Column:
    """Double; the pattern keeps out Java spellings such as ``1d``."""
    return F.when(col.rlike(_FLOAT), F.trim(col).try_cast("double"))
