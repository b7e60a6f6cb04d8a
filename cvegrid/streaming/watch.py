"""Watch mode: whatever the log gains, against registered dependencies."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dependencies import alerts, match
from .store import Store


def watch(
    store: Store,
    dependencies: DataFrame,
    out: str,
    checkpoint: str,
    min_severity: str = "HIGH",
    min_epss: float = 0.5,
) -> StreamingQuery:
    """Append alerts for the CVEs of whatever the log has gained since the last run.

    A micro-batch names the CVEs to look at; their packages and facts are read
    as they stand now, so a severity, score or exploitation that arrives after
    the package alerts too. Only the states of these CVEs are folded. Batches
    may repeat an alert; ``alerted`` merges them.
    """
    def write(records: DataFrame, batch: int) -> None:
        cves = records.select("cve_id").distinct()
        found = alerts(match(dependencies, store.table("affected_packages", cves)), store.table("vulnerabilities", cves),
                       min_severity, min_epss)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch:09d}")

    log = store.spark.readStream.schema(store.log().schema).parquet(f"{store.root}/log")
    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def alerted(spark: SparkSession, out: str) -> DataFrame:
    """One alert per project, dependency and CVE, with the latest facts."""
    facts = ["status", "patched_version", "severity", "cisa_kev", "epss_score"]
    keys = ["project", "ecosystem", "package", "version", "cve_id"]
    rows = spark.read.parquet(out)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*facts), "batch").alias("f")).select(*keys, "f.*")
