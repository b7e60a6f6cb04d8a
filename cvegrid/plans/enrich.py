"""One crawl round: seed, claim, join what was fetched, append the outcome."""

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.crawl_state import JOB, fold_states, log_rows, log_states, lost_claims, queue, requeued
from ..operators.frontier import claim, new_addresses
from ..operators.merge import union_all
from ..schemas import CLAIM_LIMIT, CRAWL_LOG, EMBEDDING_WIDTH
from ..session import cut, local, names_in
from ..sources.crawl import extracted, fetched, valid_vectors

#: Folder beside the steps for the queues that rounds left; readers of the log skip names of this kind.
_QUEUES = "_queues"


def seed_and_claim(log: DataFrame, references: DataFrame, vulns: DataFrame, now: datetime, **options) -> DataFrame:
    """``next_claims`` of a whole log."""
    return next_claims(fold_states(log_states(log)), references, vulns, now, **options)


def next_claims(
    states: DataFrame,
    references: DataFrame,
    vulns: DataFrame,
    now: datetime,
    limit: int = CLAIM_LIMIT,
    lease_hours: int | None = None,
    refetched: DataFrame | None = None,
) -> DataFrame:
    """Rows to append: new addresses and the most urgent ``limit`` claims.

    With a lease, claims older than it are released first. Completed jobs
    whose page among ``refetched`` (as ``pages`` of a round) is not the stored
    one are queued again first.
    """
    freed = lost_claims(states, now, lease_hours) if lease_hours is not None else None
    changed = None if refetched is None else requeued(states, extracted(fetched(refetched)), now)
    back = [log_states(rows) for rows in (freed, changed) if rows is not None]
    progress = queue(fold_states(union_all(states, *back)))
    jobs, _ = new_addresses(references, progress)
    pending = progress.unionByName(jobs.select(*progress.columns))
    claimed = claim(pending, vulns, limit)
    return union_all(
        freed,
        changed,
        log_rows(jobs, "seed", now, F.col("domain")),
        log_rows(claimed, "claim", now, F.col("domain")),
    )


def outcomes(claimed: DataFrame, pages: DataFrame, vectors: DataFrame, width: int = EMBEDDING_WIDTH) -> DataFrame:
    """Claimed jobs with what is known of them: ``fetched, error, text, embedding, stored, refused``.

    ``pages`` is ``(cve_id, url, status, body)``, ``vectors`` ``(cve_id, url, embedding)``. A page is refused
    where it came with vectors of which none can be stored.
    """
    texts = extracted(fetched(pages)).select("cve_id", "url", "error", "text", F.lit(True).alias("fetched"))
    found = valid_vectors(vectors, width).select("cve_id", "url", "embedding")
    came = vectors.where(F.col("embedding").isNotNull()).select("cve_id", "url", F.lit(True).alias("came")).distinct()
    rows = claimed.select("cve_id", "url")
    for part in (texts, found, came):
        rows = rows.join(part, ["cve_id", "url"], "left")
    has_text, has_vector = F.coalesce("text", F.lit("")) != "", F.col("embedding").isNotNull()
    rows = rows.withColumn("fetched", F.coalesce("fetched", F.lit(False)))
    return rows.withColumns({
        "stored": F.col("fetched") & has_text & has_vector,
        "refused": F.col("fetched") & has_text & ~has_vector & F.coalesce("came", F.lit(False)),
    }).drop("came")


def outcome_rows(jobs: DataFrame, now: datetime) -> DataFrame:
    """Rows to append: failures, pages that could not be stored, and stored pages that complete their job.

    Jobs not fetched yet, or without a vector yet, keep their claim. What could
    not be stored is pending again, its attempts unchanged.
    """
    failed = jobs.where(F.col("fetched") & (F.coalesce("text", F.lit("")) == ""))
    stored = jobs.where("stored")
    return union_all(
        log_rows(failed, "fail", now),
        log_rows(jobs.where("refused"), "unstored", now),
        log_rows(stored, "complete", now, content=F.col("text"), embedding=F.col("embedding")),
    )


def run_round(
    spark: SparkSession,
    path: str,
    references: DataFrame,
    vulns: DataFrame,
    pages: DataFrame,
    vectors: DataFrame,
    now: datetime,
    limit: int = CLAIM_LIMIT,
    lease_hours: int | None = None,
    width: int = EMBEDDING_WIDTH,
    refetched: DataFrame | None = None,
) -> DataFrame:
    """One round on the log at ``path``; returns the work queue after it.

    Each step is one folder named after ``now``, so repeating a round that
    was interrupted writes the same folders again. The round starts from the
    queue that an earlier round left and folds only the steps that this queue
    does not hold; names of steps sort by their time.
    """
    mark = f"{now.astimezone(timezone.utc):%Y%m%dT%H%M%S%f}"
    earlier, held = queue_before(spark, path, mark)
    steps = [f"step={mark}-claims", f"step={mark}-outcomes"]
    claims = next_claims(earlier, references, vulns, now, limit, lease_hours, refetched)
    claims.write.mode("overwrite").parquet(f"{path}/{steps[0]}")
    claimed = _steps(spark, path, steps[:1]).where(F.col("event") == "claim")
    # written first, no more than the claims: a plan in one piece parses all pages before it joins, once for each kind of outcome
    wanted = cut(pages.join(claimed.select(*JOB), list(JOB), "left_semi"))
    jobs = cut(outcomes(claimed, wanted, vectors, width))
    outcome_rows(jobs, now).write.mode("overwrite").parquet(f"{path}/{steps[1]}")
    states = fold_states(union_all(earlier, log_states(_steps(spark, path, steps))))
    kept = f"{path}/{_QUEUES}/at={mark}"
    states.write.mode("overwrite").parquet(f"{kept}/jobs")
    # written last: a queue without its list of steps is not used
    local(spark, [(s,) for s in (*held, *steps)], "step STRING").coalesce(1).write.mode("overwrite").parquet(f"{kept}/steps")
    return queue(spark.read.schema(states.schema).parquet(f"{kept}/jobs"))


def queue_before(spark: SparkSession, path: str, mark: str) -> tuple[DataFrame, list[str]]:
    """Folded states of all steps named before ``mark``, and the names of these steps."""
    steps = [s for s in names_in(spark, path) if s.startswith("step=") and s < f"step={mark}"]
    kept = [
        f"{path}/{_QUEUES}/{q}" for q in names_in(spark, f"{path}/{_QUEUES}")
        if q < f"at={mark}" and "_SUCCESS" in names_in(spark, f"{path}/{_QUEUES}/{q}/steps")
    ]
    if not kept:
        return fold_states(log_states(_steps(spark, path, steps))), steps
    held = {r.step for r in spark.read.schema("step STRING").parquet(f"{kept[-1]}/steps").collect()}
    fresh = log_states(_steps(spark, path, [s for s in steps if s not in held]))
    base = spark.read.schema(fold_states(fresh).schema).parquet(f"{kept[-1]}/jobs")
    return fold_states(union_all(base.select(*fresh.columns), fresh)), steps


def _steps(spark: SparkSession, path: str, steps: list[str]) -> DataFrame:
    paths = [f"{path}/{s}" for s in steps]
    return spark.read.schema(CRAWL_LOG).parquet(*paths) if paths else spark.createDataFrame([], CRAWL_LOG)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All logged crawl events; none before the first round."""
    try:
        return spark.read.schema(CRAWL_LOG).parquet(path).select(*CRAWL_LOG.fieldNames())
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], CRAWL_LOG)
