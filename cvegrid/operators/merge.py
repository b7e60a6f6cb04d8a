"""Merging observations into the stored tables.

Every mutable column is kept as a *stamped* value ``(seq, value)``. The later
stamp wins and NULL never competes, so merging is ``max`` per column: partial
results can be combined in any order and any number of times.

Stamps are rows, which Spark aggregates by sorting, and a task's share of a
large table does not fit its memory. So observations of a whole table are dealt
by key into parts of bounded size first, while they are narrow, and get their
stamps as they are aggregated. A part that is too large, as a hot CVE's, is
split over tasks, each of which leaves one row of a CVE.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import MERGED_COLUMNS, NORMALIZED


def stamped(value: Column, seq: Column) -> Column:
    """``(seq, value)`` that ignores NULL values."""
    return F.when(value.isNotNull(), F.struct(seq.alias("seq"), value.alias("value")))


def grouped(df: DataFrame, *keys: str):
    """Group by ``keys`` with their hash in front.

    CVE ids share their first bytes, so sorting them compares whole strings;
    the hash decides almost every comparison in one step.
    """
    return df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)


def union_all(*parts: DataFrame | None) -> DataFrame:
    present = [p for p in parts if p is not None]
    return reduce(lambda a, b: a.unionByName(b), present)


def dealt(observations: DataFrame, *keys: str) -> DataFrame:
    """Observations by key, in parts of bounded size: AQE splits a larger one, the rows of one key too.

    They are not dealt by the keys themselves, so that each part is folded before its rows are dealt by these.
    """
    return observations.withColumn("_deal", F.pmod(F.xxhash64(*keys), F.lit(1 << 30))).hint("rebalance", F.col("_deal"))


def folded_once(rows: DataFrame, keys: list[str], *folds: Column) -> DataFrame:
    """Rows with few of a key, which no task could reduce: dealt by key as they are, and folded there.

    Their hash is taken after they were dealt: beside narrow rows it would be a tenth of what is shuffled.
    """
    return grouped(rows.repartition(*keys), *keys).agg(*folds).drop("_hash")


# --- vulnerabilities ------------------------------------------------------------

def _vulnerability_values(columns) -> dict[str, Column]:
    seq = F.col("seq")
    return {c: stamped(F.col(c), seq) for c in columns} | {
        "cisa_kev": F.coalesce("cisa_kev", F.lit(False)), "raw_sources": F.array("source"), "first_seq": seq, "last_seq": seq,
    }


def _vulnerability_fold(state: dict[str, Column], columns) -> list[Column]:
    return [
        *[F.max(state[c]).alias(c) for c in columns],
        F.bool_or(state["cisa_kev"]).alias("cisa_kev"),
        # distinct source lists are few, however many rows carry them
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(state["raw_sources"])))).alias("raw_sources"),
        F.min(state["first_seq"]).alias("first_seq"),
        F.max(state["last_seq"]).alias("last_seq"),
    ]


def vulnerability_states(observations: DataFrame, columns=tuple(MERGED_COLUMNS)) -> DataFrame:
    """One unmerged state per observation ``(cve_id, source, cisa_kev, seq, columns…)``."""
    return observations.select("cve_id", *[v.alias(c) for c, v in _vulnerability_values(columns).items()])


def fold_vulnerabilities(states: DataFrame, columns=tuple(MERGED_COLUMNS)) -> DataFrame:
    """States of the same CVE become one. The flag is sticky, sources accumulate."""
    state = {c: F.col(c) for c in (*columns, "cisa_kev", "raw_sources", "first_seq", "last_seq")}
    return grouped(states, "cve_id").agg(*_vulnerability_fold(state, columns)).drop("_hash")


def fold_observed_vulnerabilities(observations: DataFrame, columns=tuple(MERGED_COLUMNS)) -> DataFrame:
    """``fold_vulnerabilities(vulnerability_states(observations))`` for many observations."""
    rows = dealt(observations.select("cve_id", "source", "cisa_kev", "seq", *columns), "cve_id")
    return grouped(rows, "cve_id").agg(*_vulnerability_fold(_vulnerability_values(columns), columns)).drop("_hash")


def vulnerability_table(folded: DataFrame, columns=tuple(MERGED_COLUMNS)) -> DataFrame:
    """Stored table from folded states; of the last status only a rejection is kept."""
    last = {c: F.col(f"{c}.value") for c in columns}
    if "record_status" in last:
        last["record_status"] = F.when(last["record_status"] == "REJECTED", last["record_status"])
    return folded.select(
        "cve_id",
        *[value.alias(c) for c, value in last.items()],
        "cisa_kev",
        "raw_sources",
        F.col("first_seq.synced_at").alias("created_in_db"),
        F.col("last_seq.synced_at").alias("updated_in_db"),
    )


def folded_records(records: DataFrame) -> DataFrame:
    """Normalized records of one sync without lists, one a CVE: merging them is merging all of them."""
    folded = fold_vulnerabilities(vulnerability_states(records))
    parts = {c: F.col(f"{c}.value") for c in MERGED_COLUMNS}
    parts |= {"cve_id": F.col("cve_id"), "source": F.col("raw_sources")[0], "cisa_kev": F.col("cisa_kev"), "seq": F.col("last_seq")}
    return folded.select(*[
        parts.get(f.name, F.array()).cast(f.dataType).alias(f.name) for f in NORMALIZED.fields
    ])


# --- affected packages ------------------------------------------------------------

PACKAGE_KEY = ["cve_id", "ecosystem", "package_name", "source"]


def package_observations(normalized: DataFrame) -> DataFrame:
    """Package entries of normalized records, in list order."""
    return normalized.select(
        "cve_id", "source", "seq", F.posexplode("affected_packages").alias("pos", "p")
    ).select(
        "cve_id", "p.ecosystem", "p.package_name", "source",
        F.struct("seq", "pos").alias("seq"), "p.vulnerable_versions", "p.patched_version",
    )


def package_states(observations: DataFrame) -> DataFrame:
    """Both version fields travel together: a later entry replaces them, NULL included."""
    return observations.select(*PACKAGE_KEY, _versions().alias("versions"))


def _versions() -> Column:
    return F.struct("seq", F.struct("vulnerable_versions", "patched_version").alias("value"))


def fold_packages(states: DataFrame) -> DataFrame:
    return grouped(states, *PACKAGE_KEY).agg(F.max("versions").alias("versions")).drop("_hash")


def fold_observed_packages(observations: DataFrame) -> DataFrame:
    """``fold_packages(package_states(observations))`` for many observations."""
    rows = observations.select(*PACKAGE_KEY, "seq", "vulnerable_versions", "patched_version")
    return folded_once(rows, PACKAGE_KEY, F.max(_versions()).alias("versions"))


def package_table(folded: DataFrame) -> DataFrame:
    """Stored table, with lower-case copies so that filters reach the files' statistics."""
    return folded.select(
        *PACKAGE_KEY,
        F.col("versions.value.vulnerable_versions"),
        F.col("versions.value.patched_version"),
        F.lower("ecosystem").alias("ecosystem_lc"),
        F.lower("package_name").alias("package_lc"),
    )


# --- exploits ---------------------------------------------------------------------

EXPLOIT_KEY = ["cve_id", "source", "source_id"]
EXPLOIT_VALUES = ["url", "description", "discovered_at"]


def exploit_observations(normalized: DataFrame) -> DataFrame:
    return normalized.select("cve_id", "seq", F.posexplode("exploits").alias("pos", "e")).select(
        "cve_id", "e.source", "e.source_id", F.struct("seq", "pos").alias("seq"),
        *[f"e.{c}" for c in EXPLOIT_VALUES],
    )


def exploit_states(observations: DataFrame) -> DataFrame:
    return observations.select(
        "cve_id",
        "source",
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        *[stamped(F.col(c), F.col("seq")).alias(c) for c in EXPLOIT_VALUES],
    )


def fold_exploits(states: DataFrame) -> DataFrame:
    return grouped(states, *EXPLOIT_KEY).agg(*[F.max(c).alias(c) for c in EXPLOIT_VALUES]).drop("_hash")


def fold_observed_exploits(observations: DataFrame) -> DataFrame:
    """``fold_exploits(exploit_states(observations))`` for many observations."""
    rows = observations.select("cve_id", "source", F.coalesce("source_id", F.lit("")).alias("source_id"), *EXPLOIT_VALUES, "seq")
    return folded_once(rows, EXPLOIT_KEY, *[F.max(stamped(F.col(c), F.col("seq"))).alias(c) for c in EXPLOIT_VALUES])


def exploit_table(folded: DataFrame) -> DataFrame:
    return folded.select(*EXPLOIT_KEY, *[F.col(f"{c}.value").alias(c) for c in EXPLOIT_VALUES])


# --- references -------------------------------------------------------------------

REFERENCE_KEY = ["cve_id", "url"]
REFERENCE_VALUES = ["ref_type", "source"]


def reference_observations(normalized: DataFrame) -> DataFrame:
    return normalized.select("cve_id", "source", "seq", F.posexplode("references").alias("pos", "r")).select(
        "cve_id", "r.url", "r.ref_type", "source", F.struct("seq", "pos").alias("seq")
    )


def reference_states(observations: DataFrame) -> DataFrame:
    return observations.select(
        *REFERENCE_KEY, *[stamped(F.col(c), F.col("seq")).alias(c) for c in REFERENCE_VALUES]
    )


def fold_references(states: DataFrame) -> DataFrame:
    return grouped(states, *REFERENCE_KEY).agg(*[F.max(c).alias(c) for c in REFERENCE_VALUES]).drop("_hash")


def fold_observed_references(observations: DataFrame) -> DataFrame:
    """``fold_references(reference_states(observations))`` for many observations."""
    rows = observations.select(*REFERENCE_KEY, *REFERENCE_VALUES, "seq")
    return folded_once(rows, REFERENCE_KEY, *[F.max(stamped(F.col(c), F.col("seq"))).alias(c) for c in REFERENCE_VALUES])


def reference_table(folded: DataFrame) -> DataFrame:
    return folded.select(*REFERENCE_KEY, *[F.col(f"{c}.value").alias(c) for c in REFERENCE_VALUES])


# --- one normalized batch to all tables -------------------------------------------

def batch_states(normalized: DataFrame) -> dict[str, DataFrame]:
    """Unfolded states of the four tables from one normalized batch."""
    return {
        "vulnerabilities": vulnerability_states(normalized),
        "affected_packages": package_states(package_observations(normalized)),
        "exploits": exploit_states(exploit_observations(normalized)),
        "cve_references": reference_states(reference_observations(normalized)),
    }


FOLDS = {
    "vulnerabilities": fold_vulnerabilities,
    "affected_packages": fold_packages,
    "exploits": fold_exploits,
    "cve_references": fold_references,
}

TABLES = {
    "vulnerabilities": vulnerability_table,
    "affected_packages": package_table,
    "exploits": exploit_table,
    "cve_references": reference_table,
}


#: From observations to folded states, for whole tables of them.
FOLDS_OBSERVED = {
    "vulnerabilities": fold_observed_vulnerabilities,
    "affected_packages": fold_observed_packages,
    "exploits": fold_observed_exploits,
    "cve_references": fold_observed_references,
}


def merge(name: str, states: DataFrame | None, base: DataFrame | None = None) -> DataFrame:
    """Fold a batch of states into the folded base of a table."""
    return FOLDS[name](union_all(base, states))


# --- deletions --------------------------------------------------------------------

def deletions(removed: DataFrame) -> DataFrame:
    """Last deletion per CVE of rows ``(cve_id, deleted_at)``."""
    return removed.where(F.col("cve_id").isNotNull() & F.col("deleted_at").isNotNull()).groupBy("cve_id").agg(
        F.max("deleted_at").alias("deleted_at")
    )


def _later(stamp: Column) -> Column:
    return stamp.isNotNull() & (stamp.getField("synced_at") > F.col("deleted_at"))


def without_deleted(name: str, states: DataFrame, deleted: DataFrame) -> DataFrame:
    """States of a table, folded or not, as if all that was synced up to a CVE's deletion had not been.

    A deletion takes the CVE's values and its child rows; what is synced after
    it comes back, and syncing an older record again does not. Values have
    stamps and go one by one. A folded state's flag and sources have none: they
    go where nothing of the CVE is later than its deletion, so a deletion has
    to be applied before what follows it is folded in.
    """
    kept = states.columns
    rows = states.join(deleted, "cve_id", "left")
    live = F.col("deleted_at").isNull()
    if name == "affected_packages":
        return rows.where(live | _later(F.col("versions.seq.seq"))).select(*kept)
    if name == "vulnerabilities":
        stamps = {c: F.col(f"{c}.seq") for c in kept if c in MERGED_COLUMNS}
        first = F.when(live | _later(F.col("first_seq")), F.col("first_seq")).otherwise(F.col("last_seq"))
        rows = rows.where(live | _later(F.col("last_seq"))).withColumn("first_seq", first)
    else:
        values = EXPLOIT_VALUES if name == "exploits" else REFERENCE_VALUES
        stamps = {c: F.col(f"{c}.seq.seq") for c in values}
        # a child row without any value has no stamp, and goes with its CVE
        rows = rows.where(live | _later(F.greatest(*stamps.values())))
    return rows.withColumns({c: F.when(live | _later(s), F.col(c)) for c, s in stamps.items()}).select(*kept)


def split_by_parent(children: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Child rows with a stored CVE, and the rest for quarantine."""
    keys = parents.select("cve_id")
    return children.join(keys, "cve_id", "left_semi"), children.join(keys, "cve_id", "left_anti")


def without_cve(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Deleting CVEs deletes their child rows."""
    return table.join(removed.select("cve_id"), "cve_id", "left_anti")
