"""The crawl log and what is read from it: work queue and stored pages.

Every change of a job is one appended row, so a stored page and the job it
completes can never disagree: both are the same row.
"""

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MAX_CRAWL_ATTEMPTS

JOB = ("cve_id", "url")

#: Events of a job, with the order in which they happen within one round. A
#: page that could not be stored is free again without a failure being counted,
#: and so is one whose content has changed since it was stored.
EVENTS = {"seed": 0, "release": 1, "changed": 1, "claim": 2, "fail": 3, "unstored": 3, "complete": 4}


def step(event: Column) -> Column:
    """Place of an event within its round."""
    places = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    return F.coalesce(F.try_element_at(places, event), F.lit(max(EVENTS.values())))


def event_states(events: DataFrame, keys=JOB, at=("at",)) -> DataFrame:
    """One unmerged state per event: the event with its place in time, and whether it counts as a failure."""
    event = F.col("event")
    return events.select(
        *keys,
        F.struct(*at, step(event).alias("step"), event.alias("event")).alias("last"),
        (event == "fail").cast("int").alias("attempts"),
    )


def fold_states(states: DataFrame, keys=JOB) -> DataFrame:
    """States of the same job become one: the last event, and all failures.

    Each task reduces its states first, so one busy job stays one row per task.
    Failures add up, so no event may be folded in twice.
    """
    kept = [F.max(c).alias(c) for c in ("domain", "page") if c in states.columns]
    return states.groupBy(*keys).agg(F.max("last").alias("last"), F.sum("attempts").cast("int").alias("attempts"), *kept)


def queue(states: DataFrame, keys=JOB) -> DataFrame:
    """Status and attempts per job from its folded state; the third failure makes it dead."""
    last, attempts = F.col("last.event"), F.col("attempts")
    return states.select(
        *keys,
        F.when(last == "complete", "complete")
        .when(last == "claim", "claimed")
        .when((last == "fail") & (attempts >= MAX_CRAWL_ATTEMPTS), "dead")
        .otherwise("pending").alias("status"),
        "attempts",
        *[c for c in ("domain",) if c in states.columns],
    )


def fold_progress(events: DataFrame, keys=JOB, at=("at",)) -> DataFrame:
    """Status and attempts per job from its events."""
    return queue(fold_states(event_states(events, keys, at), keys), keys)


def log_states(log: DataFrame) -> DataFrame:
    """States of logged events, with the job's domain and a print of the page stored last."""
    page = F.struct("at", F.sha2("content", 256).alias("print"))
    return event_states(
        log.withColumn("page", F.when(F.col("event") == "complete", page)), (*JOB, "domain", "page")
    )


def progress_table(log: DataFrame) -> DataFrame:
    """Work queue with domains."""
    return queue(fold_states(log_states(log)))


def content_table(log: DataFrame) -> DataFrame:
    """Latest stored page per job."""
    stored = log.where(F.col("event") == "complete")
    page = F.max_by(F.struct("content", "embedding"), F.col("at"))
    return stored.groupBy("cve_id", "url").agg(page.alias("p"), F.max("at").alias("crawled_at")).select(
        "cve_id", "url", "p.content", "p.embedding", "crawled_at"
    )


def log_rows(jobs: DataFrame, event: str, at, domain=None, content=None, embedding=None) -> DataFrame:
    """Rows to append to the log."""
    return jobs.select(
        "cve_id",
        "url",
        (F.lit(None) if domain is None else domain).cast("string").alias("domain"),
        F.lit(event).alias("event"),
        F.lit(at).cast("timestamp").alias("at"),
        (F.lit(None) if content is None else content).cast("string").alias("content"),
        (F.lit(None) if embedding is None else embedding).cast("array<float>").alias("embedding"),
    )


def lost_claims(states: DataFrame, now, lease_hours: int) -> DataFrame:
    """Claims older than the lease, as release rows; otherwise a lost claim would stay claimed."""
    old = F.col("last.at") < F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(lease_hours))
    return log_rows(states.where((F.col("last.event") == "claim") & old), "release", now)


def expired_claims(log: DataFrame, now, lease_hours: int) -> DataFrame:
    """``lost_claims`` of a log."""
    return lost_claims(fold_states(event_states(log)), now, lease_hours)


def requeued(states: DataFrame, fetched: DataFrame, now) -> DataFrame:
    """Rows that free completed jobs whose page, fetched again as ``(cve_id, url, text)``, is not the stored one.

    A page fetched again without text says nothing about the stored one.
    """
    done = states.where((F.col("last.event") == "complete") & (F.col("last.at") < F.lit(now).cast("timestamp")))
    seen = fetched.where(F.coalesce("text", F.lit("")) != "").select(*JOB, F.sha2("text", 256).alias("_print"))
    changed = done.join(seen, list(JOB)).where(F.col("_print") != F.col("page.print"))
    return log_rows(changed.select(*JOB).distinct(), "changed", now)


def changed_pages(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Re-fetched pages whose content differs from the stored one; they need a new summary."""
    old = stored.select("cve_id", "url", F.sha2("content", 256).alias("_old"))
    return fetched.join(old, ["cve_id", "url"]).where(F.sha2("content", 256) != F.col("_old")).drop("_old")


def to_summarize(pages: DataFrame) -> DataFrame:
    """Work queue of the summary stage."""
    return pages.where(F.col("summary").isNull())


def to_embed(pages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Work queue of the embedding stage: summarized pages without a vector."""
    ready = pages.where(F.col("summary").isNotNull())
    return ready.join(embeddings.select("cve_id", "url"), ["cve_id", "url"], "left_anti")
