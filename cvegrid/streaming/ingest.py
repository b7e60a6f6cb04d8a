"""Feeds as streams: landed files to the corpus log, one folder per micro-batch."""

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.base import Source
from .store import Store


def sync_name(at: datetime, batch: int = 0) -> str:
    """Names that sort by time and batch."""
    return f"{at.astimezone(timezone.utc):%Y%m%dT%H%M%S%f}-{batch:09d}"


def _now() -> datetime:
    return datetime.now(timezone.utc)


def ingest(
    store: Store,
    source: Source,
    landing: str,
    checkpoint: str,
    started: datetime,
    files_per_trigger: int = 100,
    clock: Callable[[], datetime] = _now,
) -> StreamingQuery:
    """Start a stream that logs whatever lands in ``landing`` and then stops.

    Nothing is dropped for being late: there is no watermark, and merging does
    not depend on when a record arrives. ``started`` names the stream's first
    run and stays the same over restarts, so that a retried batch overwrites
    its own folder, and one that was written and recorded is neither written nor
    counted again. Each batch moves the feed's mark like a batch sync.
    """
    def write(landed: DataFrame, batch: int) -> None:
        at, name = clock(), sync_name(started, batch)
        if not store.recorded(source.name, name):
            store.record_run(source.name, at, store.append(source.records(landed, at), source.name, name), name)

    return (
        source.stream(store.spark, landing, files_per_trigger)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
