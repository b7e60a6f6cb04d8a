"""Version keys against plain comparators, and rejections that are taken back."""

import random
import re
from datetime import datetime, timedelta, timezone
from functools import cmp_to_key

import pytest
from packaging.version import InvalidVersion, Version
from pyspark.sql import functions as F

from cvegrid.functions.versions import match_level, parse_ranges, scheme_of, version_key
from cvegrid.operators import dependencies, merge, stabbing
from cvegrid.sources.nvd import NVD


def keys_of(spark, texts, scheme):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r.t: r.k for r in rows.select("t", version_key(F.col("t"), F.lit(scheme)).alias("k")).collect()}


def agree(keys, pairs, compare):
    for a, b in pairs:
        expected, found = compare(a, b), (keys[a] > keys[b]) - (keys[a] < keys[b])
        assert found == expected, (a, b, keys[a], keys[b])


def drawn(rnd, parts, n):
    return ["".join(rnd.choice(options) for options in parts) for _ in range(n)]


def test_pep440_order(spark):
    rnd = random.Random(1)
    numbers = ["0", "1", "1.0", "1.0.0", "1.2", "1.10", "2", "0.9"]
    texts = drawn(rnd, [["", "", "v", "1!"], numbers, ["", "", "a1", ".alpha2", "b", "rc1", "-c10", "pre2"], ["", "", ".post1", "-2", "rev"],
                        ["", "", ".dev1", ".dev10"], ["", "", "", "+local.1", "+local.10", "+3", "+l"]], 1500)
    keys = keys_of(spark, texts + ["1.x", "", "dev", "1..2", "1.0-foo"], "pep440")
    assert all(keys[t] is None for t in ("1.x", "", "dev", "1..2", "1.0-foo"))
    pairs = [rnd.sample(texts, 2) for _ in range(10_000)]
    agree(keys, pairs, lambda a, b: (Version(a) > Version(b)) - (Version(a) < Version(b)))


def test_pep440_accepts_what_is_a_version(spark):
    rnd = random.Random(2)
    texts = sorted({"".join(rnd.choice(["1", "0", ".", "-", "a", "rc", "post", "dev", "+", "!", "_", "v"]) for _ in range(rnd.randint(1, 6))) for _ in range(3000)})
    for text, key in keys_of(spark, texts, "pep440").items():
        try:
            Version(text)
        except InvalidVersion:
            assert key is None, text
        else:
            assert key is not None, text


def semver_order(a, b):
    def parts(text):
        main, _, pre = text.split("+")[0].partition("-")
        return [int(x) for x in main.split(".")], pre.split(".") if pre else None

    (x, p), (y, q) = parts(a), parts(b)
    if x != y:
        return 1 if x > y else -1
    if p is None or q is None:
        return (p is None) - (q is None)
    for i, j in zip(p, q):
        if i != j:
            if i.isdigit() and j.isdigit():
                return (int(i) > int(j)) - (int(i) < int(j))
            if i.isdigit() or j.isdigit():
                return -1 if i.isdigit() else 1
            return 1 if i > j else -1
    return (len(p) > len(q)) - (len(p) < len(q))


def test_semver_order(spark):
    rnd = random.Random(3)
    texts = drawn(rnd, [["1.0.0", "1.0.1", "1.10.0", "2.0.0", "0.0.0"], ["", "-alpha", "-alpha.1", "-alpha.2", "-alpha.10", "-alpha-b", "-beta", "-Beta", "-1", "-10",
                        "-2.x", "-rc.1.1", "-a.b", "-alpha.beta"], ["", "", "+build.7"]], 400)
    keys = keys_of(spark, texts, "semver")
    agree(keys, [rnd.sample(texts, 2) for _ in range(10_000)], semver_order)


#: Each list is in ascending order; versions of one place are equal.
MAVEN = [
    ["1.0-alpha", "1.0-alpha-1", "1.0-alpha-2", "1.0-alpha-10", "1.0-beta-1-SNAPSHOT", "1.0-beta-1", "1.0-milestone-1", "1.0-rc1", "1.0-SNAPSHOT",
     "1.0", "1.0-sp", "1.0-sp-1", "1.0-foo", "1.0-jre", "1.0-jre-1", "1.0-1", "1.0-2", "1.0.1-alpha", "1.0.1", "1.0.10", "1.1-SNAPSHOT", "1.1"],
    [("1", "1.0", "1.0.0", "1.0.Final", "1-ga", "1.0.RELEASE", "1-0"), ("1.0.0-1", "1-1"), "1.1"],
    [("2-a1", "2.alpha1", "2-ALPHA-1"), ("2-b2", "2.0-beta-2"), ("2-m3", "2.0.M3"), ("2-cr1", "2.0-RC1"), "2.0"],
]


@pytest.mark.parametrize("order", MAVEN)
def test_maven_order(spark, order):
    places = [x if isinstance(x, tuple) else (x,) for x in order]
    keys = keys_of(spark, [t for p in places for t in p] + ["1.x", "x", "1..2"], "maven")
    assert keys["1.x"] is keys["x"] is keys["1..2"] is None
    ranks = [(keys[t], i) for i, p in enumerate(places) for t in p]
    assert None not in [k for k, _ in ranks]
    agree({t: keys[t] for p in places for t in p}, [(a, b) for i, p in enumerate(places) for a in p for j, q in enumerate(places) for b in q],
          lambda a, b: (lambda i, j: (i > j) - (i < j))(*[next(n for n, p in enumerate(places) if t in p) for t in (a, b)]))
    assert sorted(ranks, key=cmp_to_key(lambda a, b: (a[0] > b[0]) - (a[0] < b[0]))) == sorted(ranks)


@pytest.mark.parametrize("ecosystem, text, version, level", [
    ("PyPI", "<2.0", "2.0rc1", 2), ("PyPI", ">=1.0, <2.0", "2.0.post1", 0), ("PyPI", "< 1!1", "9", 2), ("npm", ">=1.0.0-alpha.2, <2", "1.0.0-alpha.10", 2),
    ("npm", ">=1.0.0-alpha.10", "1.0.0-alpha.2", 0), ("npm", "<2.0.0", "2.0.0+build", 0), ("Maven", "<1.0", "1.0-SNAPSHOT", 2),
    ("maven", "<=1.0", "1.0.Final", 2), ("Packagist", "<1.0", "1.0-beta", 1), ("maven", "<2", "1.x", 1), ("pip", "<2", "1.x", 1),
])
def test_ranges_by_ecosystem(spark, ecosystem, text, version, level):
    scheme = scheme_of(F.lit(ecosystem))
    rows = spark.createDataFrame([(text, version)], "t string, v string").select(
        version_key(F.col("v"), scheme).alias("k"), F.explode(parse_ranges(F.col("t"), scheme)).alias("r")).select("k", "r.*")
    assert rows.agg(F.max(match_level(*[F.col(c) for c in ("k", "lo", "lo_in", "hi", "hi_in", "known")]))).first()[0] == level


def test_keys_name_no_foreign_letters(spark):
    for scheme, texts in {"pep440": ["1.0"], "semver": ["1.0.0-a"], "maven": ["1.0-alpha"]}.items():
        for key in keys_of(spark, texts, scheme).values():
            assert re.fullmatch(r"[ -~]+", key)


def test_a_later_status_takes_a_rejection_back(spark, land):
    start = datetime(2025, 3, 1, tzinfo=timezone.utc)
    folded = []
    for i, status in enumerate(["Rejected", "Analyzed"]):
        path = land(f"nvd{i}", **{f"p{i}__json": {"vulnerabilities": [{"cve": {"id": "CVE-2025-7777", "vulnStatus": status}}]}})
        rows = NVD.records(NVD.read(spark, path), start + timedelta(days=i))
        folded.append(merge.vulnerability_states(rows))
        seen = merge.vulnerability_table(merge.fold_vulnerabilities(folded[0] if i == 0 else folded[0].unionByName(folded[1])))
        assert [r.record_status for r in seen.collect()] == [["REJECTED"], [None]][i]


def test_ranges_meet_the_points_inside(spark):
    rnd = random.Random(5)
    rows = [(a, a + rnd.randint(-2, 40)) for a in (rnd.randint(0, 70) for _ in range(300))] + [(0, 69), (0, 0), (69, 69)]
    points = spark.range(70).select("id", F.inline(stabbing.blocks_of_point(F.col("id"), 7)))
    ranges = spark.createDataFrame(rows, "lo long, hi long").distinct().select("lo", "hi", F.inline(stabbing.blocks_of_range(F.col("lo"), F.col("hi"), 7)))
    found = [tuple(r) for r in points.join(ranges, ["size", "place"]).select("lo", "hi", "id").collect()]
    assert sorted(found) == sorted((a, b, i) for a, b in set(rows) for i in range(70) if a <= i <= b)
    assert ranges.groupBy("lo", "hi").count().agg(F.max("count")).first()[0] <= 14


def test_ranks_follow_the_order(spark):
    rows = [(f"g{i % 7}", f"{i * 7919 % 1000:04}") for i in range(3000)]
    ranks, bits = stabbing.ranked(spark.createDataFrame(rows, "g string, k string").repartition(6), ["g", "k"])
    assert [r.rank for r in ranks.orderBy("g", "k").collect()] == list(range(len(set(rows)))) and bits == len(set(rows)).bit_length()
    assert stabbing.ranked(spark.createDataFrame([], "g string, k string"), ["g", "k"])[0].count() == 0


def test_many_versions_and_ranges_of_one_package(spark):
    n = 20_000
    versions = spark.range(n).select(F.lit("p").alias("project"), F.lit("PyPI").alias("ecosystem"), F.lit("Hot").alias("package"),
                                     F.concat_ws(".", F.lit("1"), F.col("id")).alias("version"), F.col("id").alias("day"))
    packages = spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("cve_id"), F.lit("pypi").alias("ecosystem_lc"), F.lit("hot").alias("package_lc"),
        F.concat(F.lit(">=1."), "id", F.lit(", <1."), F.col("id") + 2).alias("vulnerable_versions"), F.lit("1").alias("patched_version"))
    found = dependencies.match(versions, packages)
    assert found.columns == [*versions.columns, "cve_id", "status", "patched_version"]
    held = found.agg(F.count("*"), F.count_if(F.col("cve_id") == F.concat(F.lit("c"), "day")), F.count_if(F.col("status") == "affected")).first()
    assert tuple(held) == (2 * n - 1, n, 2 * n - 1)
