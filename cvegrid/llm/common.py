"""What the operators share: reading, batches, bounded memos, written intermediates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.session import prepare, scratch

ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 4 * 1024 * 1024


def session(spark: SparkSession) -> SparkSession:
    """Plan settings, and Arrow batches that bound a Python worker's memory for long texts too."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    # results go on from what ``stored`` wrote: the shuffle files of a finished step would only fill the disks
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: cuts the lineage, computes once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing will read it again."""
    for df in written:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of it with a number that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the held-out fold; a null id is held out of nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


LONG_KEY = 64


class Memo(dict):
    """A function's results, at most ``2 * limit`` of them, the ones in use surviving.

    Full memos become the old generation; what is asked for again moves back. Long keys are rare and not kept.
    """

    def __init__(self, compute: Callable, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > LONG_KEY:
                return value
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


#: State that lives as long as the Python worker, by a key that names its inputs.
_WORKER_STATE: dict = {}


def worker_state(key: tuple, make: Callable):
    """``make()`` once per worker and key; only the latest few are kept."""
    if key not in _WORKER_STATE:
        while len(_WORKER_STATE) >= 4:
            _WORKER_STATE.pop(next(iter(_WORKER_STATE)))
        _WORKER_STATE[key] = make()
    return _WORKER_STATE[key]


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the ASCII space and U+0009 to U+000D, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
