"""Store, streams, batch syncs, watch mode."""

import json
import os
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cvegrid.plans.sync import fetch_since, last_sync, sync_all
from cvegrid.sources import EPSS, OSV_FILES, SOURCES, register
from cvegrid.sources.base import conform
from cvegrid.streaming.ingest import ingest, sync_name
from cvegrid.streaming.store import Store
from cvegrid.streaming.watch import alerted, watch

T0 = datetime(2025, 3, 1, tzinfo=timezone.utc)


def osv(i, modified="2025-01-01T00:00:00Z", severity="HIGH", fixed="2"):
    return {"id": f"OSV-{i}", "aliases": [f"CVE-2025-{i:04d}"], "details": f"text {i} {modified}", "modified": modified,
            "affected": [{"package": {"ecosystem": "PyPI", "name": f"pkg{i}"}, "database_specific": {"severity": severity},
                          "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "1"}, {"fixed": fixed}]}]}],
            "references": [{"type": "WEB", "url": f"https://www.exploit-db.com/exploits/{i}"}]}


def lines(*records):
    return "\n".join(json.dumps(r) for r in records)


def test_stream_equals_batch_and_replay_changes_nothing(spark, land, tmp_path):
    files = {f"f{i}__json": lines(*[osv(j) for j in range(i, i + 4)]) for i in range(6)}
    landing = land("osv", **files)
    store = Store(spark, str(tmp_path / "store"), 4)
    ingest(store, OSV_FILES, landing, str(tmp_path / "cp"), T0, 2).awaitTermination()
    assert store.log().select("sync").distinct().count() == 3
    whole = Store(spark, str(tmp_path / "whole"), 4)
    whole.append(OSV_FILES.records(OSV_FILES.read(spark, landing), T0), "osv", sync_name(T0))
    pick = lambda s, n: sorted(map(str, s.table(n).drop("created_in_db", "updated_in_db").collect()))
    for name in ("vulnerabilities", "affected_packages", "exploits", "cve_references"):
        assert pick(store, name) == pick(whole, name)
    before = pick(store, "vulnerabilities")
    assert store.compact() == 1 and store.compact() == 1  # nothing new, no new version
    # a new stream over the same files logs all of it again
    ingest(store, OSV_FILES, landing, str(tmp_path / "cp2"), T0 + timedelta(hours=1), 3).awaitTermination()
    assert pick(store, "vulnerabilities") == before
    assert store.compact() == 2
    assert sorted(map(str, store.published("vulnerabilities").drop("created_in_db", "updated_in_db").collect())) == before


def test_late_files_are_merged(spark, land, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    for hour, stamp in enumerate(["2025-02-01T00:00:00Z", "2020-01-01T00:00:00Z"]):
        landing = land("osv", **{f"late{hour}__json": lines(osv(1, stamp))})
        ingest(store, OSV_FILES, landing, str(tmp_path / "cp"), T0, clock=lambda h=hour: T0 + timedelta(hours=h)).awaitTermination()
    row = store.table("vulnerabilities").first()
    assert row.description.endswith("2020-01-01T00:00:00Z")  # arrival decides, not the record's own date
    assert (row.created_in_db.hour, row.updated_in_db.hour) == (0, 1)


def test_sync_windows_and_order(spark, land, tmp_path):
    assert fetch_since(None) is None and fetch_since(T0) == T0 - timedelta(hours=1)
    import zipfile

    folder = tmp_path / "zips"
    folder.mkdir()
    with zipfile.ZipFile(folder / "all.zip", "w") as z:
        z.writestr("1.json", json.dumps(osv(1)))
        z.writestr("2.json", json.dumps(osv(2, modified="2025-03-01T05:30:00Z")))
    store = Store(spark, str(tmp_path / "store"), 4)
    # the derived exploits see the references of the same run
    assert sync_all(store, {"osv": str(folder)}, T0) == {"osv": 2, "exploitdb": 2}
    assert last_sync(store, "osv") == T0
    assert sync_all(store, {"osv": str(folder)}, T0 + timedelta(hours=1)) == {}  # not due yet
    # later run: only what changed since an hour before the mark
    assert sync_all(store, {"osv": str(folder)}, T0 + timedelta(hours=6)) == {"osv": 1}
    assert store.table("exploits").count() == 2
    assert store.table("vulnerabilities").where("array_contains(raw_sources, 'exploitdb')").count() == 2


def test_failing_feed_keeps_its_mark(spark, tmp_path, land):
    store = Store(spark, str(tmp_path / "store"), 4)
    csv = land("epss", s__csv="#c\ncve,epss,percentile\nCVE-2025-0001,0.5,0.6\n")
    with pytest.raises(ExceptionGroup):
        sync_all(store, {"osv": str(tmp_path / "missing"), "epss": csv}, T0, forced=["osv", "epss"])
    assert last_sync(store, "osv") is None and last_sync(store, "epss") == T0
    assert EPSS.name in {r.feed for r in store.log().select("feed").distinct().collect()}


def land_osv(spark, store, tmp_path, name, at, *records):
    path = tmp_path / name
    path.mkdir()
    (path / "r.json").write_text(lines(*records))
    store.append(OSV_FILES.records(OSV_FILES.read(spark, str(path)), at), "osv", sync_name(at))


def cves(table):
    return sorted(r.cve_id for r in table.select("cve_id").collect())


def test_nothing_is_lost_after_a_compaction(spark, land, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    first = land("osv", a__json=lines(osv(1)))
    ingest(store, OSV_FILES, first, str(tmp_path / "cp"), T0).awaitTermination()
    land_osv(spark, store, tmp_path, "later", T0 + timedelta(hours=1), osv(2))
    assert store.compact() == 1
    # the older stream goes on under a name that sorts before what is folded
    land("osv", b__json=lines(osv(3)))
    ingest(store, OSV_FILES, first, str(tmp_path / "cp"), T0).awaitTermination()
    assert cves(store.table("vulnerabilities")) == [f"CVE-2025-000{i}" for i in (1, 2, 3)]
    assert store.compact() == 2 and cves(store.published("vulnerabilities")) == [f"CVE-2025-000{i}" for i in (1, 2, 3)]
    # a folder that is folded already is written again, with more in it
    land_osv(spark, store, tmp_path, "again", T0 + timedelta(hours=1), osv(2), osv(4))
    assert cves(store.table("vulnerabilities")) == [f"CVE-2025-000{i}" for i in (1, 2, 3, 4)]
    assert store.compact() == 3 and store.compact() == 3
    assert cves(store.published("vulnerabilities")) == [f"CVE-2025-000{i}" for i in (1, 2, 3, 4)]


def test_streams_move_the_mark(spark, land, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    landing = land("osv", a__json=lines(osv(1)))
    ingest(store, OSV_FILES, landing, str(tmp_path / "cp"), T0, clock=lambda: T0 + timedelta(hours=2)).awaitTermination()
    assert last_sync(store, "osv") == T0 + timedelta(hours=2)


def test_facts_after_the_package_alert_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    deps = spark.createDataFrame([("p", "pypi", "pkg1", "1.5")], "project string, ecosystem string, package string, version string")
    out, checkpoint = str(tmp_path / "alerts"), str(tmp_path / "cp")
    land_osv(spark, store, tmp_path, "one", T0, osv(1))
    watch(store, deps, out, checkpoint, min_epss=0.5).awaitTermination()
    assert alerted(spark, out).count() == 0
    scores = tmp_path / "epss"
    scores.mkdir()
    (scores / "s.csv").write_text("cve,epss,percentile\nCVE-2025-0001,0.9,0.99\nCVE-2025-0002,0.9,0.99\n")
    for hour in (1, 2):
        at = T0 + timedelta(hours=hour)
        store.append(EPSS.records(EPSS.read(spark, str(scores)), at), "epss", sync_name(at))
        watch(store, deps, out, checkpoint, min_epss=0.5).awaitTermination()
    assert [(r.project, r.cve_id, r.epss_score) for r in alerted(spark, out).collect()] == [("p", "CVE-2025-0001", 0.9)]


def test_watch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    deps = spark.createDataFrame([("p", "pypi", "pkg1", "1.5"), ("p", "pypi", "pkg2", "9")],
                                 "project string, ecosystem string, package string, version string")
    out, checkpoint = str(tmp_path / "alerts"), str(tmp_path / "cp")

    def log(*records, at):
        path = tmp_path / f"l{at:%H}"
        path.mkdir()
        (path / "r.json").write_text(lines(*records))
        store.append(OSV_FILES.records(OSV_FILES.read(spark, str(path)), at), "osv", sync_name(at))

    log(osv(1), osv(2), at=T0)
    watch(store, deps, out, checkpoint, min_epss=-1.0).awaitTermination()
    assert [r.cve_id for r in spark.read.parquet(out).collect()] == ["CVE-2025-0001"]
    log(osv(3), at=T0 + timedelta(hours=1))
    watch(store, deps, out, checkpoint, min_epss=-1.0).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def scores(spark, tmp_path, store, at, rows):
    folder = tmp_path / f"scores{at:%d%H}"
    folder.mkdir()
    (folder / "s.csv").write_text("cve,epss,percentile\n" + "".join(f"CVE-2025-{i:04d},{v},0.5\n" for i, v in rows))
    return store.append(EPSS.records(EPSS.read(spark, str(folder)), at), "epss", sync_name(at))


def test_small_batches_rewrite_their_buckets_alone(spark, tmp_path):
    store, T1, T2 = Store(spark, str(tmp_path / "store"), buckets=16), T0 + timedelta(hours=1), T0 + timedelta(hours=2)
    assert scores(spark, tmp_path, store, T0, [(i, 0.1) for i in range(200)]) == 200
    assert store.compact() == 1
    reader = store.published("vulnerabilities")  # planned on version 1, read after version 3
    first = {(r.name, r.bucket): r.made for r in store.manifest(1)}
    assert len(first) == 16 and set(first.values()) == {1}
    scores(spark, tmp_path, store, T1, [(7, 0.2)])
    assert store.compact() == 2
    scores(spark, tmp_path, store, T2, [(7, 0.3), (8, 0.4)])
    assert store.compact() == 3
    made = [r.made for r in store.manifest(3)]
    assert len(made) == 16 and made.count(3) == 2 and made.count(1) == 14
    # the files read by version 3 are the old ones but for two buckets
    files = [f for f in store.published("vulnerabilities").inputFiles()]
    assert sum("version=3" in f for f in files) == 2 and not any("version=2" in f for f in files)
    found = {r.cve_id: r.epss_score for r in store.published("vulnerabilities").collect()}
    assert found == {f"CVE-2025-{i:04d}": {7: 0.3, 8: 0.4}.get(i, 0.1) for i in range(200)}
    assert {r.epss_score for r in reader.collect()} == {0.1}
    assert store.published("vulnerabilities").schema.simpleString() == store.table("vulnerabilities").schema.simpleString()


def test_retired_files_are_needed_by_no_kept_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    store.retire()  # nothing to retire yet
    for hour in range(4):
        scores(spark, tmp_path, store, T0 + timedelta(hours=hour), [(i, hour / 10) for i in range(10 * hour, 40)])
        assert store.compact() == hour + 1
    kept = store.published("vulnerabilities")
    before = {n: sorted(map(str, store.table(n).collect())) for n in ("vulnerabilities", "exploits")}
    store.retire(keep=1)
    store.retire(keep=1)
    assert store.log().count() == 0 and kept.count() == 40
    assert {n: sorted(map(str, store.table(n).collect())) for n in before} == before
    assert not list((tmp_path / "store" / "states").glob("*/version=1/bucket=*/*.parquet")) or any(
        r.made == 1 for r in store.manifest(4))
    # a sync that was folded and retired may be written again, and later ones are folded as ever
    scores(spark, tmp_path, store, T0 + timedelta(hours=30), [(3, 0.9), (99, 0.8)])
    assert store.compact() == 5
    found = {r.cve_id: r.epss_score for r in store.published("vulnerabilities").collect()}
    assert len(found) == 41 and found["CVE-2025-0003"] == 0.9 and found["CVE-2025-0020"] == 0.2


def test_an_empty_sync_makes_an_unchanged_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    assert scores(spark, tmp_path, store, T0, []) == 0
    assert store.compact() == 1 and store.manifest(1) == [] and store.published("exploits").count() == 0
    scores(spark, tmp_path, store, T0 + timedelta(hours=1), [(1, 0.5)])
    assert store.compact() == 2 and cves(store.published("vulnerabilities")) == ["CVE-2025-0001"]


def test_a_replayed_batch_is_neither_written_nor_counted_again(spark, land, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    landing = land("osv", a__json=lines(osv(1), osv(2)))
    for checkpoint in ("cp", "cp2"):  # a lost checkpoint replays the batch under the same name
        ingest(store, OSV_FILES, landing, str(tmp_path / checkpoint), T0).awaitTermination()
    assert [(r.source_name, r.records) for r in store.runs().collect()] == [("osv", 2)]
    assert len(store.log().inputFiles()) == 1
    store.record_run("osv", T0, 2, sync_name(T0))
    assert store.runs().count() == 1


def test_a_repeated_snapshot_logs_its_changes_alone(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store"), 4), tmp_path / "epss"
    folder.mkdir()

    def synced(day, name=None, text=""):
        if name:
            (folder / name).write_text("cve,epss,percentile\n" + text)
            os.utime(folder / name, (1_700_000_000 + day, 1_700_000_000 + day))
        return sync_all(store, {"epss": str(folder)}, T0 + timedelta(days=day), sources={"epss": EPSS})["epss"]

    assert synced(0, "a.csv", "CVE-2025-0001,0.1,0.2\nCVE-2025-0002,0.3,\nCVE-2025-0001,0.1,0.2\n") == 2
    assert [synced(1), synced(2)] == [0, 0] and last_sync(store, "epss") == T0 + timedelta(days=2)
    # a value that comes or goes is a change; NULL does not compete with what is stored
    assert synced(3, "b.csv", "CVE-2025-0002,0.3,0.9\nCVE-2025-0003,,0.5\n") == 2
    assert synced(4) == 0 and store.log().count() == 4
    found = {r.cve_id[-1]: (r.epss_score, r.epss_percentile) for r in store.table("vulnerabilities").collect()}
    assert found == {"1": (0.1, 0.2), "2": (0.3, 0.9), "3": (None, 0.5)}
    assert len(os.listdir(tmp_path / "store" / "snapshots" / "feed=epss")) == 1


def test_a_registered_feed_is_due_synced_and_ranked(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store"), 4), tmp_path / "vendor"
    folder.mkdir()
    (folder / "v.csv").write_text("cve,epss,percentile\nCVE-2025-0001,0.9,\n")
    own = replace(EPSS, name="vendor", every=60, normalize=lambda raw, seq: conform(
        raw, "vendor", seq, F.col("cve_id"), epss_score=F.col("payload.epss").cast("double")))
    register(own)
    try:
        (tmp_path / "epss").mkdir()
        (tmp_path / "epss" / "e.csv").write_text("cve,epss,percentile\nCVE-2025-0001,0.4,0.5\n")
        landings = {"vendor": str(folder), "epss": str(tmp_path / "epss")}
        assert sync_all(store, landings, T0) == {"epss": 1, "vendor": 1, "exploitdb": 0}
        assert sync_all(store, landings, T0 + timedelta(seconds=59)) == {}
        assert sync_all(store, landings, T0 + timedelta(seconds=60)) == {"vendor": 0}
        row = store.table("vulnerabilities").first()
        assert (row.epss_score, row.epss_percentile, row.raw_sources) == (0.9, 0.5, ["epss", "vendor"])
    finally:
        del SOURCES["vendor"]


def test_a_deleted_cve_stays_away_until_a_later_record(spark, tmp_path, land):
    def hour(n):
        return T0 + timedelta(hours=n)

    def log(landing, at):
        return store.append(OSV_FILES.records(OSV_FILES.read(spark, landing), at), "osv", sync_name(at))

    def seen():
        tables = ("vulnerabilities", "affected_packages", "cve_references")
        now = [cves(store.table(t)) for t in tables]
        version = store.version()
        if version is not None and store._files() | store._deletion_files() <= store._held(version):
            assert [cves(store.published(t)) for t in tables] == now
        return now[0], now[1]

    store = Store(spark, str(tmp_path / "store"), buckets=4)
    landing = land("osv", a__json=lines(osv(1), osv(2)))
    log(landing, hour(0))
    one, both = cves(store.table("vulnerabilities"))[1:], cves(store.table("vulnerabilities"))
    assert len(both) == 2 and seen()[0] == both
    store.compact()
    gone = spark.createDataFrame([(both[0],), (both[0],), (None,), ("CVE-0-0",)], "cve_id string")
    store.delete(gone, hour(1), sync_name(hour(1)))
    assert seen()[0] == one  # before a compaction
    store.compact()
    assert seen()[0] == one and set(seen()[1]) == set(one)  # and after it
    assert store.compact() == store.version() == 2
    # an overlap window logs the old record again: by its time it is older than the deletion
    log(landing, hour(0) + timedelta(minutes=5))
    assert seen()[0] == one
    store.compact()
    assert seen()[0] == one
    # a later record brings it back, and nothing of the time before
    scores(spark, tmp_path, store, hour(2), [(1, 0.4)])
    store.compact()
    row = store.published("vulnerabilities").where(F.col("cve_id") == both[0]).first()
    assert (row.epss_score, row.severity, row.description, row.raw_sources) == (0.4, None, None, ["epss"])
    assert set(seen()[1]) == set(one)


def test_deletions_and_records_in_one_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    scores(spark, tmp_path, store, T0, [(1, 0.1), (2, 0.2)])
    both = spark.createDataFrame([("CVE-2025-0001",), ("CVE-2025-0002",)], "cve_id string")
    store.delete(both, T0 + timedelta(hours=1), "d")
    scores(spark, tmp_path, store, T0 + timedelta(hours=2), [(2, 0.3)])
    live = {r.cve_id: r.epss_score for r in store.table("vulnerabilities").collect()}
    store.compact()
    published = {r.cve_id: r.epss_score for r in store.published("vulnerabilities").collect()}
    assert live == published == {"CVE-2025-0002": 0.3}
    assert [(r.cve_id, r.deleted_at is not None) for r in store.deleted().orderBy("cve_id").collect()] == [
        ("CVE-2025-0001", True), ("CVE-2025-0002", True)]
