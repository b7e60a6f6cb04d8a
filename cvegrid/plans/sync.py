"""Batch syncs: which feeds are due, what part of a feed is new, in which order."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from ..operators.stats import sources_due, sync_metadata
from ..schemas import OVERLAP_HOURS, REFRESH_SECONDS
from ..sources import SOURCES, exploitdb
from ..sources.base import Source
from ..streaming.ingest import sync_name
from ..streaming.store import Store


def last_sync(store: Store, name: str) -> datetime | None:
    """High-water mark of a feed, None before its first sync."""
    row = store.runs().where(F.col("source_name") == name).agg(F.max(F.unix_micros("synced_at"))).first()
    return None if row[0] is None else datetime.fromtimestamp(row[0] / 1e6, tz=timezone.utc)


def fetch_since(mark: datetime | None) -> datetime | None:
    """Start of the window to read: an hour before the mark; everything at first."""
    return None if mark is None else mark - timedelta(hours=OVERLAP_HOURS)


def sync_feed(store: Store, source: Source, landing: str, now: datetime) -> int:
    """Log what a feed gained since its last sync; returns the number of records.

    A snapshot is compared with the one of the last recorded sync, whatever
    other feeds have said since about the same columns.
    """
    mark, name = last_sync(store, source.name), sync_name(now)
    records = source.records(source.read(store.spark, landing), now, fetch_since(mark))
    before = None if mark is None else sync_name(mark)
    if source.snapshot:
        records = store.changes(records, source.name, name, before)
    count = store.append(records, source.name, name)
    store.record_run(source.name, now, count, name)
    if source.snapshot and before not in (None, name):
        store.forget_snapshot(source.name, before)
    return count


def sync_exploits(store: Store, now: datetime) -> int:
    """Exploit records from the references merged so far."""
    name = sync_name(now)
    store.append(exploitdb.records(store.table("cve_references"), now), "exploitdb", name)
    count = store.logged("exploitdb", name).select("cve_id").distinct().count()
    store.record_run("exploitdb", now, count, name)
    return count


def sync_all(
    store: Store, landings: dict[str, str], now: datetime, forced: list[str] | None = None,
    sources: dict[str, Source] | None = None,
) -> dict[str, int]:
    """Run the feeds that are due, feeds by rank first and derived exploits after them.

    ``sources`` replaces the registered feeds, say to read advisories as lines.

    A feed that fails leaves its mark where it was and does not stop the rest;
    its error is reported under its name at the end.
    """
    known = SOURCES if sources is None else sources
    intervals = {n: s.every for n, s in known.items()} | {"exploitdb": REFRESH_SECONDS["exploitdb"]}
    due_rows = sources_due(sync_metadata(store.runs()), now, intervals, forced).select("source_name").collect()
    due = {r["source_name"] for r in due_rows}
    done: dict[str, int] = {}
    failed: dict[str, Exception] = {}
    ordered = sorted(known, key=lambda n: (known[n].rank, n)) + ["exploitdb"]
    for name in ordered:
        if name not in due or (name != "exploitdb" and name not in landings):
            continue
        try:
            if name == "exploitdb":
                done[name] = sync_exploits(store, now)
            else:
                done[name] = sync_feed(store, known[name], landings[name], now)
        except Exception as error:  # one feed must not stop the others
            failed[name] = error
    if failed:
        raise ExceptionGroup(f"synced {done}, failed {sorted(failed)}", list(failed.values()))
    return done
