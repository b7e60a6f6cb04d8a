"""Where synced records live: an append-only log plus tables folded by buckets of CVEs.

A sync or micro-batch is one write of normalized records into a folder of its
own. It covers all four tables at once, and repeating it overwrites itself, so
a retried batch changes nothing. ``compact`` folds what the log has gained into
a new version. CVEs belong to buckets by hash: a version writes the buckets
that the log has gained something about, and its manifest names the version
that wrote each of the others. A version also lists the log files it holds, so
what is logged later is read whatever its name sorts to, also into a folder
that was folded before, and files that a version holds are not read again.

Readers use the last complete version; ``retire`` removes what only older ones
need. The driver handles names of files, buckets and versions, never records.

Layout under the root: ``log/feed=…/sync=…``, ``runs/source_name=…/sync=…``,
``states/<table>/version=…/bucket=…``, ``tables/<table>/version=…/bucket=…``,
``manifest/version=…``, ``held/version=…``, ``versions``, ``snapshots/feed=…/sync=…``,
``deletions/sync=…``.

A deletion is logged like a sync and holds for all that was synced before it,
also where that is logged later: deletions are kept, and applied to what the
log has gained and to the buckets that a deletion has touched.
"""

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession, functions as F, types as T

from ..operators.merge import FOLDS, TABLES, batch_states, deletions, folded_records, merge, without_deleted
from ..schemas import MERGED_COLUMNS, NORMALIZED, RUN_LOG, STORED
from ..session import local

_LOG = T.StructType([
    *NORMALIZED.fields,
    T.StructField("feed", T.StringType()),
    T.StructField("sync", T.StringType()),
])
_VERSIONS = "version INT"
_HELD = "file STRING"
#: ``made`` is the version whose folder holds the bucket; ``buckets`` is how many there are.
_MANIFEST = "name STRING, bucket INT, made INT, buckets INT"
_DELETED = "cve_id STRING, deleted_at TIMESTAMP"
_BUCKET = T.StructField("bucket", T.IntegerType())

#: Columns that stored tables are laid out by, so that filters skip files.
LAYOUT = {
    "vulnerabilities": ["cve_id"],
    "affected_packages": ["ecosystem_lc", "package_lc", "cve_id"],
    "exploits": ["cve_id", "source", "source_id"],
    "cve_references": ["cve_id", "url"],
}


@dataclass(frozen=True)
class Store:
    """Paths of one corpus in shared storage.

    ``buckets`` is taken by the first version and kept by all later ones. A
    bucket is the least that a compaction rewrites: choose the number so that
    it stays well below what is rewritten anyway, and above the cores at work.
    """

    spark: SparkSession
    root: str
    buckets: int = 64

    # --- log and runs ---------------------------------------------------------------

    def append(self, records: DataFrame, feed: str, sync: str) -> int:
        """Write one sync into its own folder and count it on the way; writing it again replaces it."""
        counted = Observation()
        records.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self._sync(feed, sync))
        return counted.get["n"]

    def logged(self, feed: str, sync: str) -> DataFrame:
        """Records of one sync."""
        return self.spark.read.schema(NORMALIZED).parquet(self._sync(feed, sync))

    def log(self) -> DataFrame:
        """Normalized records of all syncs that are still logged."""
        return self._table("log", _LOG)

    def changes(self, records: DataFrame, feed: str, sync: str, before: str | None) -> DataFrame:
        """Of a whole snapshot, one record for each CVE that the snapshot ``before`` lacked or had other values of.

        The snapshot is kept beside the log for the next one to compare with.
        """
        values = [*MERGED_COLUMNS, "cisa_kev"]
        path = f"{self.root}/snapshots/feed={feed}"
        print_of = F.xxhash64(*[F.struct(F.col(c), F.col(c).isNull()) for c in values]).alias("print")
        folded_records(records).select("*", print_of).write.mode("overwrite").parquet(f"{path}/sync={sync}")
        now = self.spark.read.parquet(f"{path}/sync={sync}")
        if before is not None and before != sync and self._exists(f"{path}/sync={before}/_SUCCESS"):
            now = now.join(self.spark.read.parquet(f"{path}/sync={before}").select("cve_id", "print"), ["cve_id", "print"], "left_anti")
        return now.select(*NORMALIZED.fieldNames())

    def forget_snapshot(self, feed: str, sync: str) -> None:
        """Remove a snapshot that a later recorded one replaces."""
        self._remove(f"{self.root}/snapshots/feed={feed}/sync={sync}")

    def record_run(self, source: str, synced_at: datetime, records: int, sync: str) -> None:
        """The high-water mark moves only after all of a sync is written; a sync counts once, however often it is recorded."""
        row = local(self.spark, [(synced_at, records)], "synced_at TIMESTAMP, records BIGINT")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/runs/source_name={source}/sync={sync}")

    def recorded(self, source: str, sync: str) -> bool:
        """Whether a sync was written and recorded."""
        return self._exists(f"{self.root}/runs/source_name={source}/sync={sync}/_SUCCESS")

    def runs(self) -> DataFrame:
        return self._table("runs", RUN_LOG)

    # --- deletions ------------------------------------------------------------------

    def delete(self, cves: DataFrame, at: datetime, sync: str) -> None:
        """Delete CVEs (a column ``cve_id``) with their child rows as of ``at``; later records bring them back."""
        rows = cves.select("cve_id", F.lit(at).cast("timestamp").alias("deleted_at")).distinct()
        rows.write.mode("overwrite").parquet(f"{self.root}/deletions/sync={sync}")

    def deleted(self) -> DataFrame:
        """Last deletion per CVE."""
        return deletions(self._table("deletions", _DELETED))

    def _deletion_files(self) -> set[str]:
        """Deletion files, by a path that no log file has."""
        files = self._table("deletions", _DELETED).inputFiles()
        return {"deletions/" + unquote(f).rsplit("/deletions/", 1)[1] for f in files}

    def _deleted_in(self, files: Iterable[str]) -> DataFrame | None:
        paths = [f"{self.root}/{f}" for f in sorted(files)]
        return self.spark.read.schema(_DELETED).parquet(*paths) if paths else None

    # --- reading --------------------------------------------------------------------

    def version(self) -> int | None:
        """Last complete version."""
        return self._table("versions", _VERSIONS).agg(F.max("version")).first()[0]

    def manifest(self, version: int) -> list[Row]:
        """Where the buckets of a version are: a row for each table and bucket with rows."""
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={version}").collect()

    def states(self, name: str, cves: DataFrame | None = None) -> DataFrame:
        """Folded states of a table, current to the last sync; only of ``cves`` (a column ``cve_id``) where given."""
        current = self.version()
        fresh = self._records(sorted(self._files() - self._held(current)))
        gone = self._deletion_files()
        kept = [] if current is None else [r for r in self.manifest(current) if r.name == name]
        if cves is not None and kept:
            wanted = self._buckets_of(cves, kept[0].buckets)
            kept = [r for r in kept if r.bucket in wanted]
        base = self._read("states", kept)
        if cves is not None:
            fresh = fresh.join(cves, "cve_id", "left_semi")
            base = None if base is None else base.join(cves, "cve_id", "left_semi")
        return merge(name, *self._live(name, fresh, base, gone, gone - self._held(current)))

    def _live(
        self, name: str, fresh: DataFrame, base: DataFrame | None, gone: set[str], new: set[str]
    ) -> tuple[DataFrame, DataFrame | None]:
        """Unfolded states of log records and folded ones of a version, less what is deleted.

        A version's states know of the deletions it holds; only ``new`` ones are applied to them.
        """
        states, removed, since = batch_states(fresh)[name], self._deleted_in(gone), self._deleted_in(new)
        if removed is not None:
            states = without_deleted(name, states, deletions(removed))
        if base is not None and since is not None:
            base = without_deleted(name, base, deletions(since))
        return states, base

    def table(self, name: str, cves: DataFrame | None = None) -> DataFrame:
        """A table current to the last sync."""
        return TABLES[name](self.states(name, cves))

    def published(self, name: str) -> DataFrame:
        """A table as of the last compaction, laid out for filters."""
        current = self.version()
        if current is None:
            return self.table(name)
        rows = self._read("tables", [r for r in self.manifest(current) if r.name == name], STORED[name])
        return self.spark.createDataFrame([], STORED[name]) if rows is None else rows

    # --- compaction -----------------------------------------------------------------

    def compact(self) -> int:
        """Fold what is logged and not yet held into a new version, and return the last version's number.

        The log files to fold are listed first: what is logged meanwhile waits
        for the next version. A version that failed half-way is written anew.
        """
        current = self.version()
        old = [] if current is None else self.manifest(current)
        held, files, gone = self._held(current), self._files(), self._deletion_files()
        if files | gone <= held:
            return current or 0
        number = (current or 0) + 1
        buckets = old[0].buckets if old else self.buckets
        fresh = self._records(sorted(files - held))
        touched = self._buckets_of(fresh, buckets)
        if gone - held:
            touched |= self._buckets_of(self._deleted_in(gone - held), buckets)
        kept = [r for r in old if r.bucket not in touched]

        def fold(name: str) -> list[tuple]:
            base = self._read("states", [r for r in old if r.name == name and r.bucket in touched])
            states = f"{self.root}/states/{name}/version={number}"
            live, base = self._live(name, fresh, base, gone, gone - held)
            schema = self._write(merge(name, live, base), states, buckets)
            written = self.spark.read.schema(schema).parquet(states)
            self._write(TABLES[name](written), f"{self.root}/tables/{name}/version={number}", buckets, LAYOUT[name])
            return [(name, bucket, number, buckets) for bucket in self._buckets_in(states)]

        # the tables do not depend on each other: one's tasks fill the gaps of another's
        with ThreadPoolExecutor(len(FOLDS)) as pool:
            made = [row for rows in pool.map(fold, FOLDS if touched else ()) for row in rows]
        # files that were retired need no mention any more
        self._list([(f,) for f in files | gone], _HELD, f"held/version={number}")
        self._list([*map(tuple, kept), *made], _MANIFEST, f"manifest/version={number}")
        self._list([(number,)], _VERSIONS, "versions", "append")
        return number

    def retire(self, keep: int = 2) -> None:
        """Remove what none of the last ``keep`` versions needs: superseded buckets, and log files all of them hold.

        Readers of a kept version go on undisturbed. Watch mode reads the log
        as a stream: run it before the files it has not seen are retired.
        """
        current = self.version()
        oldest = 0 if current is None else current - keep + 1
        if keep < 1 or oldest < 1:
            return
        needed = {(r.name, r.made, r.bucket) for v in range(oldest, current + 1) for r in self.manifest(v)}
        for version in range(oldest - 1, 0, -1):
            if not self._exists(f"{self.root}/manifest/version={version}"):
                break  # retired before
            for r in self.manifest(version):
                if (r.name, r.made, r.bucket) not in needed:
                    for kind in ("states", "tables"):
                        self._remove(f"{self.root}/{kind}/{r.name}/version={r.made}/bucket={r.bucket}")
        for file in self._held(oldest) & self._files():
            self._remove(f"{self.root}/log/{file}")
        for version in range(oldest - 1, 0, -1):
            if not self._remove(f"{self.root}/held/version={version}"):
                break
            self._remove(f"{self.root}/manifest/version={version}")

    # --- files ----------------------------------------------------------------------

    def _sync(self, feed: str, sync: str) -> str:
        return f"{self.root}/log/feed={feed}/sync={sync}"

    def _files(self) -> set[str]:
        """Files of the log, by their path in it. A file's name holds its job, so a sync written again has new ones."""
        log = self._table("log", _LOG)
        return {"feed=" + unquote(f).rsplit("/log/feed=", 1)[1] for f in log.inputFiles()}

    def _records(self, files: Iterable[str]) -> DataFrame:
        paths = [f"{self.root}/log/{f}" for f in files]
        return self.spark.read.schema(NORMALIZED).parquet(*paths) if paths else self.spark.createDataFrame([], NORMALIZED)

    def _held(self, version: int | None) -> set[str]:
        """The log files that a version holds."""
        if version is None:
            return set()
        return {r.file for r in self.spark.read.schema(_HELD).parquet(f"{self.root}/held/version={version}").collect()}

    def _read(self, kind: str, rows: list[Row], schema: T.StructType | None = None) -> DataFrame | None:
        """Buckets of one table, None if there are none."""
        paths = [f"{self.root}/{kind}/{r.name}/version={r.made}/bucket={r.bucket}" for r in rows]
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else None

    def _write(self, rows: DataFrame, path: str, buckets: int, layout: Iterable[str] = ()) -> T.StructType:
        """Write rows by bucket; a bucket of many rows is split over tasks, small ones share a task."""
        dealt = rows.drop("bucket").withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *layout).write.mode("overwrite").partitionBy("bucket").parquet(path)
        return T.StructType([*rows.drop("bucket").schema.fields, _BUCKET])

    def _buckets_of(self, rows: DataFrame, buckets: int) -> set[int]:
        return {r.bucket for r in rows.select(_bucket(buckets).alias("bucket")).distinct().collect()}

    def _buckets_in(self, path: str) -> list[int]:
        """Buckets that have files under a written path."""
        place, system = self._at(path)
        names = [f.getPath().getName() for f in system.listStatus(place)]
        return [int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")]

    def _list(self, rows: list[tuple], schema: str, path: str, mode: str = "overwrite") -> None:
        local(self.spark, rows, schema).coalesce(1).write.mode(mode).parquet(f"{self.root}/{path}")

    def _table(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def _at(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        place, system = self._at(path)
        return system.exists(place)

    def _remove(self, path: str) -> bool:
        place, system = self._at(path)
        return system.delete(place, True)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("cve_id"), F.lit(buckets)).cast("int")
