"""Spans of found things as columns: arrays of structs, and their text form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then rank of the kind, comma-joined; no spans give an empty string."""
    text = F.transform(
        F.array_sort(F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(text, ",")


def fingerprint(spans: Column) -> Column:
    return F.sha2(joined(spans).cast("binary"), 256)


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
