"""Merging: what wins, and that order and grouping of batches do not matter."""

import random
import re
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvegrid.operators import merge
from cvegrid.plans.corpus import Corpus

COLS = ("description", "severity")
SCHEMA = "cve_id string, source string, seq bigint, description string, severity string, cisa_kev boolean"


def table(folded):
    return {
        r.cve_id: (r.description, r.severity, r.cisa_kev, list(r.raw_sources))
        for r in folded.select(
            "cve_id", "description.value", F.col("severity.value").alias("s"), "cisa_kev", "raw_sources"
        ).toDF("cve_id", "description", "severity", "cisa_kev", "raw_sources").collect()
    }


def fold(df):
    return merge.fold_vulnerabilities(merge.vulnerability_states(df, COLS), COLS)


def brute(rows):
    out = {}
    for cve, source, _, desc, sev, kev in sorted(rows, key=lambda r: r[2]):
        d, s, k, src = out.get(cve, (None, None, False, set()))
        out[cve] = (desc or d, sev or s, k or bool(kev), src | {source})
    return {c: (d, s, k, sorted(src)) for c, (d, s, k, src) in out.items()}


def observations(n=400):
    rng = random.Random(5)
    return [(
        # a third of all rows are about one CVE
        "hot" if rng.random() < 0.33 else f"c{rng.randrange(20)}", rng.choice(["nvd", "osv", "epss"]), i,
        rng.choice([None, f"d{i}"]), rng.choice([None, "LOW", "HIGH"]), rng.choice([None, False, True]) if i % 50 == 0 else None,
    ) for i in range(n)]


def test_last_non_null_wins(spark):
    rows = observations()
    assert table(fold(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_any_split_gives_the_same(spark):
    rows = observations()
    shuffled = random.Random(1).sample(rows, len(rows))
    a, b, c = (spark.createDataFrame(shuffled[i::3], SCHEMA) for i in range(3))
    base = fold(a)
    for batch in (b, c, b):  # one batch even twice
        states = merge.vulnerability_states(batch, COLS)
        base = merge.fold_vulnerabilities(merge.union_all(base, states), COLS)
    assert table(base) == brute(rows)


def test_packages_overwrite_with_null(spark):
    rows = spark.createDataFrame([
        ("c", "npm", "p", "osv", 1, "<1", "1"), ("c", "npm", "p", "osv", 2, None, None), ("c", "npm", "p", "gh", 1, "<3", None),
    ], "cve_id string, ecosystem string, package_name string, source string, seq int, vulnerable_versions string, patched_version string")
    got = merge.package_table(merge.fold_packages(merge.package_states(rows))).collect()
    assert sorted((r.source, r.vulnerable_versions, r.patched_version) for r in got) == [("gh", "<3", None), ("osv", None, None)]


def test_package_list_order_decides(spark):
    entry = T.StructType([T.StructField(n, T.StringType()) for n in
                          ("ecosystem", "package_name", "vulnerable_versions", "patched_version")])
    schema = T.StructType([T.StructField("cve_id", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("seq", T.IntegerType()), T.StructField("affected_packages", T.ArrayType(entry))])
    rows = spark.createDataFrame([("c", "gh", 1, [("pip", "p", "<1", "1"), ("pip", "p", ">=2, <3", "3")])], schema)
    got = merge.package_table(merge.fold_packages(merge.package_states(merge.package_observations(rows)))).first()
    assert got.vulnerable_versions == ">=2, <3" and got.ecosystem_lc == "pip"


def test_exploits_and_references_keep_known_values(spark):
    at = datetime(2025, 1, 1)
    rows = spark.createDataFrame([
        ("c", "edb", None, 1, "u1", None, at), ("c", "edb", "", 2, None, "d2", None),
    ], "cve_id string, source string, source_id string, seq int, url string, description string, discovered_at timestamp")
    got = merge.exploit_table(merge.fold_exploits(merge.exploit_states(rows))).collect()
    assert [tuple(r) for r in got] == [("c", "edb", "", "u1", "d2", at)]
    refs = spark.createDataFrame([("c", "u", "patch", "nvd", 1), ("c", "u", None, "osv", 2)],
                                 "cve_id string, url string, ref_type string, source string, seq int")
    assert [tuple(r) for r in merge.reference_table(merge.fold_references(merge.reference_states(refs))).collect()] == [
        ("c", "u", "patch", "osv")]


def test_orphans_are_set_aside(spark):
    kids = spark.createDataFrame([("a", 1), ("b", 2)], "cve_id string, n int")
    kept, aside = merge.split_by_parent(kids, spark.createDataFrame([("a",)], "cve_id string"))
    assert [r.n for r in kept.collect()] == [1] and [r.n for r in aside.collect()] == [2]
    assert [r.n for r in merge.without_cve(kids, kept).collect()] == [2]


def test_whole_tables_are_dealt_before_they_are_sorted(spark):
    """A task's share of a table does not fit its memory; its observations go by key first, without stamps for each column."""
    c = Corpus(spark, "/root/testdata/sf0.001")
    for rows in (c.merged_vulns(), c.merged_packages(), c.merged_exploits(), c.merged_references()):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        lowest = [line for line in plan.splitlines() if re.search(r"Exchange|Sort|Aggregate", line)][-1]
        assert "Exchange" in lowest


def test_folds_of_observations_equal_those_of_states(spark):
    c = Corpus(spark, "/root/testdata/sf0.001")
    states = {
        "vulnerabilities": merge.vulnerability_states(c.observations), "affected_packages": merge.package_states(c.package_rows),
        "exploits": merge.exploit_states(c.exploit_rows), "cve_references": merge.reference_states(c.reference_rows),
    }
    observed = dict(zip(states, (c.observations, c.package_rows, c.exploit_rows, c.reference_rows)))
    for name, unfolded in states.items():
        one, other = merge.FOLDS[name](unfolded), merge.FOLDS_OBSERVED[name](observed[name])
        assert one.columns == other.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_child_rows_are_shuffled_without_their_hash(spark):
    corpus = Corpus(spark, "/root/testdata/sf0.001")
    for rows in (corpus.merged_packages(), corpus.merged_exploits(), corpus.merged_references()):
        rows.collect()
        exchanges = re.findall(r"Exchange hashpartitioning\(([^\n]*)", rows._jdf.queryExecution().executedPlan().toString())
        assert exchanges and not any("_hash" in e for e in exchanges)
        assert len({e.split(", REPARTITION")[0] for e in exchanges}) == 1
