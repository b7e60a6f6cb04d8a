"""What a feed is: how its landed files are read, unpacked, filtered and normalized."""

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import ARRIVAL, MERGED_COLUMNS, NORMALIZED, SOURCE_ORDER


@dataclass(frozen=True)
class Source:
    """A registered feed.

    ``unpack`` turns landed rows into one row per record
    ``(cve_id, payload, arrival)``; ``since`` is the incremental filter on
    those rows; ``normalize`` projects them onto the common record. ``every``
    is the number of seconds between syncs. A ``snapshot`` feed states all its
    values anew each time and has no lists; syncs log what changed in it.
    """

    name: str
    schema: T.StructType | str
    format: str
    unpack: Callable[[DataFrame], DataFrame]
    since: Callable[[DataFrame, datetime, datetime], DataFrame]
    normalize: Callable[[DataFrame, Column], DataFrame]
    options: dict[str, str] = field(default_factory=dict)
    every: int = 21_600
    snapshot: bool = False

    @property
    def rank(self) -> int:
        """Place among feeds that sync at the same instant; further feeds come after the fixed ones."""
        return _rank(self.name)

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """Landed files as rows, each with its file and block for ordering."""
        return _with_file(self._reader(spark.read).load(path))

    def stream(self, spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
        """The same as a stream over a landing folder."""
        reader = self._reader(spark.readStream).option("maxFilesPerTrigger", files_per_trigger)
        return _with_file(reader.load(path))

    def _reader(self, reader):
        reader = reader.format(self.format).options(**self.options)
        return reader if self.format == "binaryFile" else reader.schema(self.schema)

    def records(
        self,
        landed: DataFrame,
        synced_at: datetime,
        since: datetime | None = None,
    ) -> DataFrame:
        """Landed rows to normalized records, stamped with their sync."""
        raw = self.unpack(landed)
        if since is not None:
            raw = self.since(raw, since, synced_at)
        return self.normalize(raw, arrival_seq(self.name, F.lit(synced_at)))


def _rank(source: str) -> int:
    return SOURCE_ORDER.index(source) if source in SOURCE_ORDER else len(SOURCE_ORDER)


def _with_file(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_modification_time").alias("_landed_at"),
        F.xxhash64("_metadata.file_name").alias("_file_id"),  # moving a folder changes nothing
        F.col("_metadata.file_block_start").alias("_block"),
    )


def arrival(item: Column | None = None, row: Column | None = None) -> Column:
    """Arrival position of a record. Rows of one block are read in file order by
    one task, so the row number only has to grow inside the block."""
    row = F.monotonically_increasing_id() if row is None else row
    return F.struct(
        F.col("_landed_at").alias("landed_at"),
        F.col("_file_id").alias("file_id"),
        F.col("_block").alias("block"),
        row.cast("bigint").alias("row"),
        (F.lit(0) if item is None else item).cast("int").alias("item"),
    ).cast(ARRIVAL)


def arrival_seq(source: str, synced_at: Column) -> Column:
    """Arrival order across syncs and feeds, from the record's own ``arrival``."""
    return F.struct(
        synced_at.cast("timestamp").alias("synced_at"),
        F.lit(_rank(source)).alias("source_rank"),
        *[F.col(f"arrival.{f}").alias(f) for f in ARRIVAL.fieldNames()],
    )


def conform(raw: DataFrame, source: str, seq: Column, cve_id: Column, **columns: Column) -> DataFrame:
    """Project onto the common record; whatever a feed lacks is NULL or empty."""
    out = {
        "cve_id": cve_id,
        "source": F.lit(source),
        "cisa_kev": F.lit(False),
        "affected_packages": F.array(),
        "exploits": F.array(),
        "references": F.array(),
        "seq": seq,
        **columns,
    }
    lists = ("affected_packages", "exploits", "references")
    unknown = set(columns) - set(NORMALIZED.fieldNames())
    if unknown:
        raise ValueError(f"not part of the common record: {sorted(unknown)}")
    projected = []
    for f in NORMALIZED.fields:
        col = out.get(f.name, F.lit(None))
        if f.name in lists:
            col = F.coalesce(col.cast(f.dataType), F.array().cast(f.dataType))
        elif f.name in MERGED_COLUMNS or f.name == "cisa_kev":
            col = col.cast(f.dataType)
        projected.append(col.alias(f.name))
    return raw.select(*projected)


def first(items: Column) -> Column:
    """First element, NULL for an empty or missing array."""
    return F.get(items, F.lit(0))


def last_present(items: Column) -> Column:
    """Last element that is not NULL."""
    return first(F.reverse(F.filter(items, lambda x: x.isNotNull())))
