"""Page text, frontier, crawl log, vectors, dependencies, reports."""

import random
from datetime import datetime, timedelta, timezone

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from cvegrid.functions.text import cap_utf8, content_type, domain_of, estimate_tokens, html_text
from cvegrid.functions.versions import match_level, parse_ranges, version_key
from cvegrid.operators import crawl_state, dependencies, frontier, semantic, stats
from cvegrid.plans import enrich
from cvegrid.plans.enrich import queue_before, read_log, run_round, seed_and_claim
from cvegrid.schemas import CRAWL_LOG
from cvegrid.streaming.crawl import crawl_stream, current_queue

NOW = datetime(2025, 3, 1, 6, tzinfo=timezone.utc)


def texts(spark, pages, **kw):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    return [r.t for r in df.select("i", html_text(F.col("html"), **kw).alias("t")).orderBy("i").collect()]


def test_html_text(spark):
    page = ("<html><head><title>no</title></head><body class='b'><script>if (a<b) x()</script><nav>menu</nav>"
            "<header id=h>top</header><p>Fix  in\n 2.0 &amp;lt; now</p><footer>c</footer><!-- <p>hidden</p> --></body></html>")
    assert texts(spark, [page, "<p>alone</p>", "plain", "", None, "<body><script>x</script></body>"]) == [
        "Fix in 2.0 &lt; now", "alone", "plain", "", "", ""]
    assert texts(spark, ["<p>&#8364;&#x1F600;&quot;&#xD800;</p>", "a  b", "<body>open end"]) == ['€😀"�', "a b", "open end"]


def test_html_text_of_odd_pages(spark):
    pages = ["<nav>a<nav>b</nav>LEAK</nav>x", "<p>a</p><script>var unclosed = 1;", "<div><nav>menu</div>text",
             "<p title='a>b'>seen</p>", "caf&eacute; &le; &amp;lt;", "a</b></i>b<br/>c", "<body>" + "<div>" * 3000 + "deep"]
    assert texts(spark, pages) == ["x", "a", "text", "seen", "café ≤ &lt;", "abc", "deep"]


def test_text_cap_counts_bytes(spark):
    assert texts(spark, ["<p>" + "a " * 60_000 + "</p>"])[0].__len__() == 50_000
    got = spark.range(1).select(cap_utf8(F.lit("aé€"), 2).alias("a"), cap_utf8(F.lit("aé€"), 3).alias("b"),
                                cap_utf8(F.lit("aé€"), 6).alias("c")).first()
    assert tuple(got) == ("a", "aé", "aé€")


def test_text_of_long_pages_is_whole(spark, tmp_path):
    long = "wörd " * 40_000 + "end"
    rows = [(1, f"<html><body><p>{long}</p></body></html>"), (2, "<html><body><p>short</p></body></html>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.text for r in queries()["html_text"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(oracle_sql()["html_text"]).fetchall()) == {1: long, 2: "short"}


def test_addresses(spark):
    urls = ["https://h.example/x", "http://h.example", "ftp://h", "https://github.com/advisories/G",
            "https://www.exploit-db.com/exploits/1", "https://blog.h.example/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = df.select(domain_of(F.col("url")).alias("d"), content_type(F.col("url")).alias("k")).collect()
    assert [r.d for r in got][:3] == ["h.example", "h.example", None]
    assert [r.k for r in got][3:] == ["github_advisory", "poc_readme", "blog_post"]
    assert spark.range(1).select(estimate_tokens(F.lit("a" * 9))).first()[0] == 2


def progress(spark, events):
    rows = [("c", url, None, e, NOW + timedelta(minutes=m), None, None) for m, (url, e) in enumerate(events)]
    return {r.url: (r.status, r.attempts) for r in crawl_state.fold_progress(spark.createDataFrame(rows, CRAWL_LOG)).collect()}


def test_state_machine(spark):
    rng, events, state = random.Random(2), [], {}
    for _ in range(600):
        url = "hot" if rng.random() < 0.33 else f"u{rng.randrange(12)}"
        if url not in state:
            event, state[url] = "seed", ["pending", 0]
        else:
            status, attempts = state[url]
            if status == "pending":
                event, state[url] = "claim", ["claimed", attempts]
            elif status == "claimed":
                event = rng.choice(["fail", "complete", "release"])
                if event == "fail":
                    state[url] = ["dead" if attempts + 1 >= 3 else "pending", attempts + 1]
                else:
                    state[url] = ["complete" if event == "complete" else "pending", attempts]
            else:
                continue
        events.append((url, event))
    assert progress(spark, events) == {u: tuple(s) for u, s in state.items()}


def test_crawl_rounds(spark, tmp_path):
    refs = spark.createDataFrame([("c1", f"https://h/{i}") for i in range(4)] + [("c9", "https://h/9"), ("c1", "ftp://x")],
                                 "cve_id string, url string")
    vulns = spark.createDataFrame([("c1", True, 0.5, None)], "cve_id string, cisa_kev boolean, epss_score double, cvss_score double")
    pages = spark.createDataFrame(
        [("c1", "https://h/0", 200, b"<body>t</body>"), ("c1", "https://h/1", 500, b""), ("c1", "https://h/2", 200, b"<body>v</body>")],
        "cve_id string, url string, status int, body binary")
    vectors = spark.createDataFrame([("c1", "https://h/0", [0.5, 0.5])], "cve_id string, url string, embedding array<float>")
    path = str(tmp_path / "log")
    for day in (0, 1, 1, 2, 3):  # one round is repeated
        after = run_round(spark, path, refs, vulns, pages, vectors, NOW + timedelta(days=day), limit=3, width=2)
    got = {r.url: (r.status, r.attempts, r.domain) for r in after.collect()}
    assert got == {
        "https://h/0": ("complete", 0, "h"), "https://h/1": ("dead", 3, "h"), "https://h/2": ("claimed", 0, "h"),
        "https://h/3": ("claimed", 0, "h"), "https://h/9": ("pending", 0, "h")}
    log = read_log(spark, path)
    assert [(r.url, r.content) for r in crawl_state.content_table(log).collect()] == [("https://h/0", "t")]
    # seeding again adds nothing
    again = seed_and_claim(log, refs, vulns, NOW + timedelta(days=9), limit=3)
    assert again.where("event = 'seed'").count() == 0
    # a lost claim comes back once its lease is over
    freed = seed_and_claim(log, refs, vulns, NOW + timedelta(days=9), limit=3, lease_hours=24).collect()
    assert sorted(r.url for r in freed if r.event == "release") == ["https://h/2", "https://h/3"]
    assert sorted(r.url for r in freed if r.event == "claim") == ["https://h/2", "https://h/3"]


def test_schedule_spaces_domains(spark):
    rows = spark.createDataFrame([("c", f"u{i}", "d1" if i < 3 else "d2", False, 0.1 * i, None) for i in range(4)],
                                 "cve_id string, url string, domain string, cisa_kev boolean, epss_score double, cvss_score double")
    got = {r.url: r.not_before for r in frontier.schedule(rows, 2.0).collect()}
    assert got == {"u2": 0.0, "u1": 0.5, "u0": 1.0, "u3": 0.0}


# --- vectors ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def space():
    rng = np.random.default_rng(4)
    items = rng.normal(size=(300, 8))
    items[1::3] = items[0]  # a third are copies of one vector: ties go to the smaller id
    return items, rng.normal(size=(17, 8)), rng.integers(0, 50, 300), rng.choice(["LOW", "HIGH", None], 300)


def expected(space, k, days=None, levels=None):
    items, queries, age, severity = space
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(unit(queries) @ unit(items).T, 6)
    out = {}
    for q in range(len(queries)):
        ok = [i for i in range(len(items)) if (days is None or age[i] <= days[q]) and (levels is None or severity[i] in levels)]
        out[str(q)] = sorted(ok, key=lambda i: (-sims[q, i], str(i)))[:k]
    return out


def frames(spark, space):
    items, queries, age, severity = space
    v = spark.createDataFrame([(str(i), x.tolist(), int(age[i]), severity[i]) for i, x in enumerate(items)],
                              "item_id string, embedding array<double>, age int, severity string")
    v = v.withColumn("levels", F.array("severity")).drop("severity")
    q = spark.createDataFrame([(str(i), x.tolist(), 5 * i) for i, x in enumerate(queries)],
                              "query_id string, embedding array<double>, days int")
    return q, v.repartition(5)


def ranked(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(int(r.item_id))
    return out


@pytest.mark.parametrize("block", [2_048, 4])
def test_nearest(spark, space, block):
    q, v = frames(spark, space)
    assert ranked(semantic.nearest(q.drop("days"), v, 7, query_block=block)) == expected(space, 7)
    days = [5 * i for i in range(17)]
    limited = q.withColumn("levels", F.array(F.lit("HIGH")))
    assert ranked(semantic.nearest(limited, v, 7, query_block=block)) == {
        k: x for k, x in expected(space, 7, days, {"HIGH"}).items() if x}


def shuffled_rows(df):
    """Rows that each exchange of the plan has written, once ``df`` is collected."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind != "ReusedExchangeExec":
            if kind == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_nearest_shuffles_no_vector_for_each_block(spark, space, monkeypatch):
    monkeypatch.setattr(semantic, "VECTOR_BLOCK", 16)
    q, v = frames(spark, space)
    found = semantic.nearest(q.drop("days"), v, 7, query_block=2)
    assert ranked(found) == expected(space, 7)
    # nine blocks of queries and nineteen of vectors: only the best of each query are dealt out
    assert sum(shuffled_rows(found)) <= 17 * 7


def test_nearest_keeps_equal_ids_and_takes_floats(spark):
    v = spark.createDataFrame([(str(i % 3), [1.0, float(i)]) for i in range(6)], "item_id string, embedding array<float>")
    q = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0])], "query_id string, embedding array<float>")
    got = [(r.query_id, r.rank, r.item_id, r.similarity) for r in semantic.nearest(q, v, 3).orderBy("rank").collect()]
    assert got == [("a", 1, "0", 1.0), ("a", 2, "2", 0.980581), ("a", 3, "1", 0.970143)]


def test_other_vector_paths_agree(spark, space):
    q, v = frames(spark, space)
    want = expected(space, 5)
    assert [int(r.item_id) for r in semantic.search(v, space[1][3].tolist(), 5).collect()] == want["3"]
    model = semantic.train_cells(v, lists=6)
    cells = semantic.assign_cells(v, model)
    assert ranked(semantic.nearest_in_cells(q, cells, model, 5, probes=6)) == want
    few = ranked(semantic.nearest_in_cells(q, cells, model, 5, probes=2))
    hits = sum(len(set(few.get(k, [])) & set(x)) for k, x in want.items())
    assert hits / (5 * len(want)) > 0.3


# --- dependencies -------------------------------------------------------------------

@pytest.mark.parametrize("text, version, level", [
    (">=4.1.0, <4.7.3", "4.7", 2), ("*, <2", "2.0", 0), ("*, <2", "1.9.10", 2), (">=1, <2, >=3, <4", "2.5", 0),
    (">=1, <2, >=3, <4", "3.0.1", 2), ("< 2.0", "1", 2), ("= 1.1", "1.1.0", 2), ("> 1, <= 2", "2.0", 2),
    ("> 1, <= 2", "1.0", 0), (">=1.0a, <2", "1.5", 1), (None, "1", 1), (">=1, <2", "1.x", 1), (">=1.2, <1.10", "1.9", 2),
])
def test_version_ranges(spark, text, version, level):
    df = spark.createDataFrame([(text, version)], "t string, v string").select(
        version_key(F.col("v")).alias("k"), F.explode_outer(parse_ranges(F.col("t"))).alias("r")).select("k", "r.*")
    got = df.agg(F.max(match_level(*[F.col(c) for c in ("k", "lo", "lo_in", "hi", "hi_in", "known")]))).first()[0]
    assert got == level


def test_projects(spark):
    packages = spark.createDataFrame([("c1", "pypi", "flask", ">=2, <2.3", "2.3"), ("c2", "pypi", "flask", "<1", "1")],
                                     "cve_id string, ecosystem_lc string, package_lc string, vulnerable_versions string, patched_version string")
    projects = spark.createDataFrame([("p", [("PyPI", "Flask", "2.0.1")]), ("q", [("pypi", "flask", "dev")])],
                                     "project string, dependencies array<struct<ecosystem:string,package:string,version:string>>")
    found = dependencies.match(dependencies.explode_projects(projects), packages)
    assert sorted((r.project, r.cve_id, r.status) for r in found.collect()) == [
        ("p", "c1", "affected"), ("q", "c1", "unknown"), ("q", "c2", "unknown")]
    vulns = spark.createDataFrame([("c1", "HIGH", False, 0.9), ("c2", "HIGH", True, 0.9)],
                                  "cve_id string, severity string, cisa_kev boolean, epss_score double")
    assert [(r.project, r.cve_id) for r in dependencies.alerts(found, vulns).collect()] == [("p", "c1")]
    assert dependencies.alerts(found, vulns, min_severity="CRITICAL").count() == 0


_PACKAGES = "cve_id string, ecosystem_lc string, package_lc string, vulnerable_versions string, patched_version string"
_DEPS = "project string, ecosystem string, package string, version string, day int"


def trend_rows(df):
    return sorted(map(tuple, df.select("project", "day", "critical", "high", "medium", "low", "total", "change").collect()), key=str)


def test_trend_counts_a_cve_once(spark):
    rng = random.Random(7)
    packages = [(f"c{c}", "pypi", f"p{p}", ">=1, <3" if c % 3 else None, "3") for c in range(12) for p in rng.sample(range(6), 1 + c % 3)]
    deps = [(rng.choice(["a", "b", None]), rng.choice(["pypi", "PyPI"]), f"p{rng.randrange(6)}", f"{rng.randrange(4)}.0", rng.choice([1, 2, 3, 4, None]))
            for _ in range(40)]
    deps += deps[:5] + [("z", "pypi", "p1", "2.0", 1), ("z", "pypi", "p1", "2.1", 1), ("y", "pypi", "p2", "2.0", 1)]
    # some CVEs have two rows, others none
    vulns = [(f"c{c}", rng.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW", None])) for c in [*range(10), 2, 5, 5]]
    p, d = spark.createDataFrame(packages, _PACKAGES), spark.createDataFrame(deps, _DEPS)
    v = spark.createDataFrame(vulns, "cve_id string, severity string")
    plain = dependencies.match(d, p)
    seen = {(r.project, r.day, r.cve_id) for r in plain.collect()}
    want = {}
    for project, day, cve in seen:
        for level in [s for c, s in vulns if c == cve]:
            counts = want.setdefault((project, day), dict.fromkeys(["CRITICAL", "HIGH", "MEDIUM", "LOW", None], 0))
            counts[level] += 1
    totals = {k: sum(x.values()) for k, x in want.items()}
    days = lambda x: sorted((d for p, d in want if p == x), key=lambda d: (d is not None, d))
    before = {(x, d): totals.get((x, e), 0) for x, _ in want for e, d in zip([0, *days(x)], days(x))}
    expected = sorted(((*k, *[x[s] for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")], totals[k], totals[k] - before[k])
                       for k, x in want.items()), key=str)
    facts = dependencies.level_counts(v)
    assert trend_rows(dependencies.severity_trend(plain, v)) == expected
    assert trend_rows(dependencies.severity_trend(dependencies.match(d, p, facts), v)) == expected
    marked = dependencies.match(d, p, facts, within=["project", "day"])
    assert {r.again for r in marked.collect()} == {True, False}
    assert trend_rows(dependencies.severity_trend(marked, v)) == expected


def test_trend_shuffles_no_match_of_a_lone_dependency(spark, tmp_path):
    spark.range(120).select(
        F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("PROMO").alias("p_type"),
        F.lit(1).alias("p_size"), F.lit(1000.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    # 120 CVEs of one package in one ecosystem; fifty projects use one version of it, on a day each
    day = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    spark.range(120).select(
        F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), day.alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).select(
        (F.col("id") * 2310 + 6).alias("o_orderkey"), (F.col("id") * 100).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    trend = queries()["project_trend"](spark, str(tmp_path))
    assert {(r.critical, r.total, r.change) for r in trend.collect()} == {(120, 120, 120)}
    assert max(shuffled_rows(trend)) < 50 * 120 / 4


def test_reports(spark):
    runs = spark.createDataFrame([("nvd", NOW - timedelta(hours=7), 5), ("nvd", NOW - timedelta(hours=6), 2), ("epss", NOW - timedelta(hours=7), 1)],
                                 "source_name string, synced_at timestamp, records bigint")
    meta = stats.sync_metadata(runs)
    due = {r.source_name for r in stats.sources_due(meta, NOW).collect()}
    assert due == {"nvd", "github", "osv", "exploitdb", "cisa_kev"}
    assert {r.source_name for r in stats.sources_due(meta, NOW, forced=["epss", "odd"]).collect()} == {"epss"}
    empty = meta.unionByName(spark.createDataFrame([("osv", None, None)], meta.schema))
    assert [(r.source_name, r.last_sync, r.records_synced) for r in stats.sync_status(empty).collect()] == [
        ("epss", "2025-02-28 23:00:00 UTC", 1), ("nvd", "2025-03-01 00:00:00 UTC", 7), ("osv", "never", 0)]


def test_a_lease_does_not_undo_the_outcome_of_its_round(spark):
    rows = [("C", "u", e, 1) for e in ("release", "claim", "complete")] + [("C", "w", e, 1) for e in ("claim", "release")]
    log = spark.createDataFrame(rows, "cve_id string, url string, event string, at int")
    assert {r.url: r.status for r in crawl_state.fold_progress(log).collect()} == {"u": "complete", "w": "claimed"}


def test_hosts_are_compared_as_hosts(spark):
    kinds = {"https://notgithub.com/a/advisories/1": "vendor_advisory", "https://sub.github.com:443/advisories/1": "github_advisory",
             "https://evil-exploit-db.com/exploits/1": "vendor_advisory", "https://www.exploit-db.com/exploits/1": "poc_readme"}
    rows = spark.createDataFrame([(u,) for u in kinds], "url string")
    assert {r.url: r.kind for r in rows.select("url", content_type(F.col("url")).alias("kind")).collect()} == kinds


def test_stream_of_events_equals_the_fold(spark, tmp_path):
    rng = random.Random(5)
    rows = [("c", "hot" if rng.random() < 0.33 else f"u{rng.randrange(9)}", None, rng.choice(list(crawl_state.EVENTS)),
             NOW + timedelta(seconds=i), None, None) for i in range(300)]
    odd = [("c", "u0", None, None, NOW, None, None), ("c", "u1", None, "fail", None, None, None), (None, "u2", None, "claim", NOW, None, None)]
    rng.shuffle(rows)  # they arrive in any order
    landing, out, checkpoint = (str(tmp_path / n) for n in ("landing", "out", "checkpoint"))
    landed = spark.readStream.schema(CRAWL_LOG)
    for part in (rows[:100], rows[100:] + odd):  # the second start is a restart
        spark.createDataFrame(part, CRAWL_LOG).write.mode("append").parquet(landing)
        crawl_stream(landed.parquet(landing), out, checkpoint).awaitTermination()
    both = rows + odd[2:]
    fold = {(r.cve_id, r.url): (r.status, r.attempts) for r in crawl_state.fold_progress(spark.createDataFrame(both, CRAWL_LOG)).collect()}
    found = current_queue(spark.read.parquet(out)).collect()
    assert {(r.cve_id, r.url): (r.status, r.attempts) for r in found} == fold
    # nothing new: nothing is read, written or counted again
    before = spark.read.parquet(out).count()
    crawl_stream(landed.parquet(landing), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == before


def test_failed_stores_and_changed_pages_are_queued_again(spark, tmp_path):
    refs = spark.createDataFrame([("c1", "https://h/0"), ("c1", "https://h/1")], "cve_id string, url string")
    vulns = spark.createDataFrame([("c1", True, 0.5, None)], "cve_id string, cisa_kev boolean, epss_score double, cvss_score double")

    def page(text):
        return spark.createDataFrame([("c1", f"https://h/{i}", 200, f"<body>{text}</body>".encode()) for i in (0, 1)],
                                     "cve_id string, url string, status int, body binary")

    vectors = spark.createDataFrame([("c1", "https://h/0", [0.5, 0.5]), ("c1", "https://h/1", [0.5])],
                                    "cve_id string, url string, embedding array<float>")
    path = str(tmp_path / "log")

    def after(day, text="old", limit=5, **more):
        rows = run_round(spark, path, refs, vulns, page(text), vectors, NOW + timedelta(days=day), limit=limit, width=2, **more)
        return {r.url[-1]: (r.status, r.attempts) for r in rows.collect()}

    # the second page comes with a vector of another width: it is not stored, and no failure is counted
    assert after(0) == {"0": ("complete", 0), "1": ("pending", 0)}
    assert after(1, refetched=page("old")) == {"0": ("complete", 0), "1": ("pending", 0)}
    assert after(2, "new", limit=0, refetched=page("new")) == {"0": ("pending", 0), "1": ("pending", 0)}
    assert after(3, "new") == after(3, "new") == {"0": ("complete", 0), "1": ("pending", 0)}
    assert [r.content for r in crawl_state.content_table(read_log(spark, path)).collect()] == ["new"]
    # a round that is repeated with later ones in place starts from what was before it
    assert after(2, "new", limit=0, refetched=page("new")) == {"0": ("pending", 0), "1": ("pending", 0)}
    assert after(4, "new", refetched=page("")) == {"0": ("complete", 0), "1": ("pending", 0)}


def test_a_round_folds_what_the_last_queue_does_not_hold(spark, tmp_path):
    refs = spark.createDataFrame([("c1", "https://h/0")], "cve_id string, url string")
    vulns = spark.createDataFrame([("c1", True, 0.5, None)], "cve_id string, cisa_kev boolean, epss_score double, cvss_score double")
    pages = spark.createDataFrame([("c1", "https://h/0", 500, b"")], "cve_id string, url string, status int, body binary")
    vectors = spark.createDataFrame([], "cve_id string, url string, embedding array<float>")
    path = str(tmp_path / "log")
    for day in range(3):
        run_round(spark, path, refs, vulns, pages, vectors, NOW + timedelta(days=day), width=2)
    states, steps = queue_before(spark, path, "9")
    files = states.inputFiles()
    assert len(steps) == 6 and not any("/step=" in f for f in files) and any("/_queues/" in f for f in files)
    assert [(r.status, r.attempts) for r in crawl_state.queue(states).collect()] == [("dead", 3)]
    assert read_log(spark, path).count() == 7


def test_a_round_parses_no_more_pages_than_it_claims(spark, tmp_path, monkeypatch):
    refs = spark.createDataFrame([("c1", f"https://h/{i}") for i in range(50)], "cve_id string, url string")
    pages = refs.select("cve_id", "url", F.lit(200).alias("status"), F.encode(F.concat(F.lit("<p>"), "url"), "UTF-8").alias("body"))
    vectors = refs.select("cve_id", "url", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    vulns = spark.createDataFrame([("c1", True, 0.5, 5.0)], "cve_id string, cisa_kev boolean, epss_score double, cvss_score double")
    given, outcomes = [], enrich.outcomes
    monkeypatch.setattr(enrich, "outcomes", lambda claimed, landed, *rest: given.append(landed.count()) or outcomes(claimed, landed, *rest))
    queue = enrich.run_round(spark, str(tmp_path / "log"), refs, vulns, pages, vectors, NOW, limit=3, width=1)
    assert given == [3] and queue.where("status = 'complete'").count() == 3
