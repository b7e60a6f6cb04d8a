"""Session settings and shared working folders."""

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every plan here relies on; safe to call again and again."""
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split hot join keys even where that costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # hash instead of sort where every partition of a side is measured small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
        # steps go on from what was written: the shuffle files of a finished one would only fill the disks
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        # for rows of some MB, such as blocks of vectors
        "spark.sql.execution.arrow.maxBytesPerBatch": "4194304",
    }.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and sc.getCheckpointDir():
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="cvegrid-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, without starting Python on executors."""
    fields = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), schema)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Sorted names of the entries of a folder; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []
