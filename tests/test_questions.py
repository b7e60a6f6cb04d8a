"""Retrieval, sub-records, contexts and answers."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cvegrid.functions.severity import allowed_levels, allowed_levels_of
from cvegrid.operators import answers, children, context
from cvegrid.operators.intents import Intent, days_of, phrase_days
from cvegrid.operators.retrieval import retrieve, retrieve_many, with_aliases
from cvegrid.plans.ask import ask
from cvegrid.schemas import ANSWERS, INTENTS

NOW = datetime(2025, 3, 1, 6, tzinfo=timezone.utc)
VULNS = ("cve_id string, description string, cvss_score double, cvss_vector string, severity string, "
         "epss_score double, epss_percentile double, cisa_kev boolean, published_at timestamp")
PACKAGES = ("cve_id string, ecosystem string, package_name string, source string, vulnerable_versions string, "
            "patched_version string, ecosystem_lc string, package_lc string")


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    vulns = [(
        f"CVE-2025-{i:05d}", f"text {i}", rng.choice([None, 5.0, 7.5]), None, rng.choice([None, "LOW", "MEDIUM", "HIGH", "CRITICAL"]),
        rng.choice([None, 0.1, 0.5, 0.9]), None, rng.random() < 0.05,
        # some lie exactly on a cutoff
        rng.choice([None, NOW - timedelta(days=rng.randrange(400)), NOW - timedelta(hours=rng.randrange(9000))]),
    ) for i in range(n)]
    packages = []
    for i in range(n):
        for _ in range(rng.randrange(4)):
            eco = "npm" if rng.random() < 0.5 else rng.choice(["PyPI", "Go", "Maven"])
            name = "Hot" if rng.random() < 0.33 else f"Lib{rng.randrange(15)}"
            packages.append((f"CVE-2025-{i:05d}", eco, name, rng.choice(["osv", "github"]), None, None, eco.lower(), name.lower()))
    return vulns, packages


def brute(vulns, packages, it: Intent, limit):
    if not (it.cve_ids or it.package_names or it.ecosystems or it.severity_filter or it.date_range):
        return []
    names, ecos = {x.lower() for x in it.package_names}, {x.lower() for x in it.ecosystems}
    hit = {p[0] for p in packages if (not names or p[7] in names) and (not ecos or p[6] in ecos)}
    days = days_of(it.date_range) if it.date_range else None
    rows = [
        v for v in vulns
        if (not it.cve_ids or v[0] in it.cve_ids) and (not (names or ecos) or v[0] in hit)
        and (not it.severity_filter or v[4] in allowed_levels_of(it.severity_filter))
        and (days is None or (v[8] is not None and v[8] >= NOW - timedelta(days=days)))
    ]
    big = float("inf")
    rows.sort(key=lambda v: (
        not v[7], -v[5] if v[5] is not None else big, -v[2] if v[2] is not None else big,
        -v[8].timestamp() if v[8] else big, v[0]))
    return [v[0] for v in rows[:limit]]


CASES = [
    Intent(), Intent(severity_filter="HIGH+"), Intent(severity_filter="medium"), Intent(severity_filter="odd+"),
    Intent(date_range="last 30 days"), Intent(date_range="since January"), Intent(ecosystems=["NPM"]),
    Intent(ecosystems=["npm", "go"], severity_filter="LOW+", date_range="LAST 2 months"), Intent(package_names=["HOT"]),
    Intent(package_names=["hot", "lib3"], ecosystems=["pypi"]), Intent(package_names=["lib3"], date_range="last 1 year"),
    Intent(cve_ids=["CVE-2025-00003", "CVE-2025-00004", "cve-2025-00005"]),
    Intent(cve_ids=[f"CVE-2025-{i:05d}" for i in range(100)], ecosystems=["npm"], severity_filter="HIGH+"),
    Intent(package_names=["absent"]), Intent(severity_filter="CRITICAL", date_range="last 40 weeks"),
]


@pytest.fixture(scope="module")
def data(spark):
    vulns, packages = corpus()
    return vulns, packages, spark.createDataFrame(vulns, VULNS), spark.createDataFrame(packages, PACKAGES)


@pytest.mark.parametrize("i", range(len(CASES)))
def test_one_question(data, i):
    vulns, packages, v, p = data
    assert [r.cve_id for r in retrieve(v, p, CASES[i], NOW, 20).collect()] == brute(vulns, packages, CASES[i], 20)


def intents_table(spark, cases):
    return spark.createDataFrame([
        (str(i), c.ecosystems, c.package_names or None, c.cve_ids, c.severity_filter, c.date_range, None, None)
        for i, c in enumerate(cases)
    ], INTENTS)


def test_many_questions_equal_one_by_one(spark, data):
    vulns, packages, v, p = data
    cases = CASES + CASES[1:4]  # repeated questions get the same rows
    found = {}
    for r in retrieve_many(intents_table(spark, cases), v, p, NOW, 20).orderBy("intent_id", "rank").collect():
        found.setdefault(int(r.intent_id), []).append(r.cve_id)
        assert r.date_range_ignored == (cases[int(r.intent_id)].date_range == "since January")
    for i, case in enumerate(cases):
        assert found.get(i, []) == brute(vulns, packages, case, 20), case


def test_ecosystem_aliases(spark):
    v = spark.createDataFrame([(f"C{i}", "d", None, None, None, None, None, False, None) for i in range(3)], VULNS)
    p = spark.createDataFrame([("C0", "pip", "a", "github", None, None, "pip", "a"), ("C1", "PyPI", "a", "osv", None, None, "pypi", "a"),
                               ("C2", "npm", "a", "osv", None, None, "npm", "a")], PACKAGES)
    asked = intents_table(spark, [Intent(ecosystems=["Python"])])
    assert retrieve_many(asked, v, p, NOW).count() == 0
    canonical_asked, canonical_packages = with_aliases(asked, p)
    rows = retrieve_many(canonical_asked, v, canonical_packages, NOW).collect()
    assert sorted(r.cve_id for r in rows) == ["C0", "C1"]


def test_severity_and_dates(spark):
    got = spark.createDataFrame([("HIGH+",), ("high",), ("x+",), ("",), (None,)], "s string").select(
        allowed_levels(F.col("s")).alias("l")).collect()
    assert [r.l for r in got] == [["CRITICAL", "HIGH"], ["HIGH"], ["CRITICAL"], None, None]
    texts = ["last 7 days", "in the LAST  2 Weeks", "last 3 month", "last 1 year", "this week", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(phrase_days(F.col("t")).alias("d")).collect()
    assert [r.d for r in got] == [7, 14, 90, 365, None, None] == [days_of(t) if t else None for t in texts]


def facts(spark, rows):
    return spark.createDataFrame(rows, VULNS)


def kids_of(spark, vulns, packages=(), exploits=(), refs=()):
    p = spark.createDataFrame(list(packages), PACKAGES)
    e = spark.createDataFrame(list(exploits), "cve_id string, source string, source_id string, url string, description string")
    r = spark.createDataFrame(list(refs), "cve_id string, url string")
    return children.children_of(vulns, p, e, r)


def test_block_text(spark):
    v = facts(spark, [("C1", "desc", 9.85, None, "CRITICAL", 0.125, None, True, None),
                      ("C2", None, None, None, None, None, None, False, None)])
    kids = kids_of(
        spark, v,
        [("C1", "npm", "b", "osv", "<2", "2", "npm", "b"), ("C1", "", "a", "osv", "", None, "", "a")],
        [("C1", "edb", "1", "https://e", "x"), ("C1", "poc", "", "", "y" * 130), ("C1", "zzz", "", None, None)],
        [("C1", "https://r2"), ("C1", "https://r1")],
    )
    got = {r.cve_id: r.block for r in context.blocks(v, kids, 60_000).collect()}
    assert got["C1"] == (
        "[C1] (CRITICAL | CVSS 9.8 | EPSS 0.12 | KEV: Yes | Exploit: Yes)\n"
        "Affects: a; b (npm) versions <2 — patched in 2\nDescription: desc\n"
        f"Exploits: edb: https://e; poc: {'y' * 120}...; zzz\nSources: https://r1, https://r2")
    assert got["C2"] == "[C2] (KEV: No | Exploit: No)"


def test_block_lines_have_no_limit(spark):
    v = facts(spark, [("C1", "d", None, None, None, None, None, False, None), ("C2", "", None, None, None, None, None, False, None)])
    kids = kids_of(spark, v, refs=[("C1", f"https://r{i:04}") for i in range(3000)])
    rows = sorted((r.cve_id, r.line, r.pos, r.text) for r in context.block_lines(v, kids).collect())
    assert rows[0] == ("C1", 0, 1, "[C1] (KEV: No | Exploit: No)") and rows[1] == ("C1", 2, 1, "d")
    assert [r[3] for r in rows[2:-1]] == [f"https://r{i:04}" for i in range(3000)] and rows[-1][0] == "C2"


def test_oversized_block_stops_packing(spark):
    """A CVE with far more sub-records than fit is never assembled, and nothing after it is kept."""
    v = facts(spark, [(f"C{i}", "d", None, None, None, None, None, False, None) for i in range(4)])
    kids = kids_of(spark, v, refs=[("C2", f"https://r/{i}") for i in range(500)])
    texts = context.blocks(v, kids, 400)
    ranks = texts.withColumn("intent_id", F.lit("q")).withColumn("rank", F.substring("cve_id", 2, 1).cast("int"))
    assert sorted(r.cve_id for r in context.pack(ranks, 100).collect()) == ["C0", "C1"]


def test_packing_is_a_prefix(spark):
    lengths = [30, 50, 10, 40, 5]
    rows = spark.createDataFrame([("q", i, "x" * n) for i, n in enumerate(lengths)], "intent_id string, rank int, block string")
    for budget in (0, 7, 20, 22, 25, 40):
        kept, used = 0, 0
        for n in lengths:
            if used + n > budget * 4:
                break
            kept, used = kept + 1, used + n
        assert sorted(r["rank"] for r in context.pack(rows, budget).collect()) == list(range(kept))


def test_ask(spark, data):
    _, _, v, p = data
    e = spark.createDataFrame([("CVE-2025-00003", "edb", "1", "https://e", None)],
                              "cve_id string, source string, source_id string, url string, description string")
    r = spark.createDataFrame([("CVE-2025-00003", "https://r")], "cve_id string, url string")
    got = {x.intent_id: x for x in ask(intents_table(spark, [CASES[0], CASES[11]]), v, p, e, r, NOW).collect()}
    assert (got["0"].context, got["0"].mode) == ("", "conversational")
    assert got["1"].mode == "grounded" and got["1"].blocks == 2
    assert "Exploits: edb: https://e" in got["1"].context and "\n\n[CVE-2025-0000" in got["1"].context


def test_annotation(spark):
    claim = lambda c, s: (c, s, None, "because")
    rows = spark.createDataFrame([
        ("1", "A", [claim("x", "supported")], []), ("2", "A", [claim("x", "unsupported")], []),
        ("3", "A", [], ["o1", "o2"]), ("4", "A", [claim("x", "unsupported")], ["o"]), ("5", "A", None, None),
    ], ANSWERS)
    got = {r.answer_id: r for r in answers.annotate(rows).collect()}
    assert got["1"].final_answer == got["5"].final_answer == "A"
    assert got["2"].final_answer == "A\n" + answers.UNSUPPORTED_NOTE + "- x (Reason: because)"
    assert got["3"].final_answer == "A\n" + answers.OMITTED_NOTE + "- o1\n- o2"
    assert got["4"].final_answer.index("x (Reason") < got["4"].final_answer.index("- o")
    assert (got["2"].claim_count, got["2"].unsupported_count, got["1"].unsupported_count) == (1, 1, 0)


def test_grounding(spark):
    rows = spark.createDataFrame([
        ("CVE-2025-1111 and CVE-2025-22222", "see CVE-2025-1111, CVE-2024-9999"), ("", "CVE-2025-1111")],
        "context string, answer string")
    got = answers.grounding(rows).collect()
    assert (got[0].not_in_context, got[0].not_cited) == (["CVE-2024-9999"], ["CVE-2025-22222"])
    assert (got[1].not_in_context, got[1].not_cited) == ([], [])


def test_equal_questions_are_packed_once(spark, data, monkeypatch):
    """What is packed does not grow with the number of equal questions; each of them gets the context."""
    import cvegrid.plans.ask as plan
    _, _, v, p = data
    e = spark.createDataFrame([], "cve_id string, source string, source_id string, url string, description string")
    r = spark.createDataFrame([("CVE-2025-00003", "https://r")], "cve_id string, url string")
    packed = []
    monkeypatch.setattr(plan, "pack", lambda rows, budget: packed.append(rows.count()) or context.pack(rows, budget))
    once = ask(intents_table(spark, [CASES[11]]), v, p, e, r, NOW).collect()
    many = ask(intents_table(spark, [CASES[11]] * 30), v, p, e, r, NOW).collect()
    assert packed[0] == packed[1] > 0 and len(many) == 30
    assert {(x.context, x.blocks, x.mode) for x in many} == {(x.context, x.blocks, x.mode) for x in once}
