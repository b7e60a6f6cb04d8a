"""The work queue as keyed state of a stream over crawl events.

Each job's last event and its failures live in the state store, so a batch
costs what arrives with it and nothing reads the log from its beginning. A
batch writes the jobs it changed into a folder of its own; a batch that is
repeated overwrites its folder. Lost claims come back by the release rows that
a round logs: a timer on the clock would keep a stream that stops when all is
read from ever stopping.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.crawl_state import JOB, step
from ..schemas import MAX_CRAWL_ATTEMPTS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "at BIGINT, place BIGINT, event STRING, fails BIGINT"
_CHANGE = [
    T.StructField("event", T.StringType()),
    T.StructField("at", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempts", T.IntegerType()),
]


def _combined(keys: list[str]):
    """Events of a job that lie in one batch of rows become one: the last event, and the number of failures."""
    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            groups = part.sort_values(["at", "place", "event"], kind="stable").groupby(keys, sort=False, dropna=False)
            last = groups.tail(1).set_index(keys)
            last["fails"] = groups["fails"].sum()
            yield last.reset_index()[part.columns]
    return combine


def _status(event: str, fails: int) -> str:
    if event == "fail" and fails >= MAX_CRAWL_ATTEMPTS:
        return "dead"
    return {"complete": "complete", "claim": "claimed"}.get(event, "pending")


class JobQueue(StatefulProcessor):
    """State machine of one job: its last event and its failures."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.job.get() if self.job.exists() else None
        last, fails = (None, 0) if before is None else (tuple(before[:3]), before[3])
        for row in rows:
            fails += row.fails
            last = max(filter(None, (last, (row.at, row.place, row.event))))
        self.job.update((*last, fails))
        yield self._row(key, last, fails)

    def close(self) -> None:
        pass

    def _row(self, key, last: tuple, fails: int) -> Row:
        return Row(*self.columns)(*key, last[2], last[0], _status(last[2], fails), int(fails))


def crawl_stream(
    events: DataFrame, out: str, checkpoint: str, keys=JOB, place=None
) -> StreamingQuery:
    """Start a stream that keeps the queue of ``events`` (keys, ``event``, ``at``) and stops when all are read.

    ``place`` orders events of the same time; by default it is their order
    within a round. Events may arrive in any order, and the latest decides.
    A job that holds many events is combined inside tasks before the shuffle.
    Rows without a time or an event are no events.
    """
    spark, keys = events.sparkSession, list(keys)
    event = F.col("event")
    rows = events.where(event.isNotNull() & F.col("at").isNotNull()).select(
        *keys, F.unix_micros(F.col("at").cast("timestamp")).alias("at"),
        (step(event) if place is None else place).cast("bigint").alias("place"), "event",
        (event == "fail").cast("bigint").alias("fails"),
    )
    schema = T.StructType([*(rows.schema[k] for k in keys), *_CHANGE])
    changes = rows.mapInPandas(_combined(keys), rows.schema).groupBy(*keys).transformWithState(
        JobQueue(schema.fieldNames()), schema, "Update", "None"
    ).withColumn("at", F.timestamp_micros("at"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # a started query keeps the settings it was started with
    try:
        return (
            changes.writeStream.foreachBatch(write).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, provider)


def current_queue(changes: DataFrame, keys=JOB) -> DataFrame:
    """Status and attempts per job from the changes that ``crawl_stream`` wrote, read with their ``batch``."""
    last = F.max_by(F.struct("status", "attempts"), F.col("batch"))
    return changes.groupBy(*keys).agg(last.alias("q")).select(*keys, "q.status", "q.attempts")
