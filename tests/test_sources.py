"""Feeds: reading landed files, filtering, normalizing."""

import gzip
import json
import zipfile
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from cvegrid.plans import catalog_feeds
from cvegrid.plans.corpus import Corpus
from cvegrid.sources import EPSS, GITHUB, KEV, NVD, OSV, OSV_FILES, exploitdb, osv
from cvegrid.sources.crawl import extracted, fetched, valid_vectors

NOW = datetime(2025, 3, 1, tzinfo=timezone.utc)


def one(df, cve):
    return {r.cve_id: r for r in df.collect()}[cve]


def metric(score, role, version="3.1", level="CRITICAL"):
    return {"type": role, "cvssData": {
        "baseScore": score, "vectorString": f"CVSS:{version}/x", "version": version, "baseSeverity": level}}


def nvd_page(*cves):
    return {"totalResults": len(cves), "vulnerabilities": [{"cve": c} for c in cves]}


FULL = {
    "id": "CVE-2025-0100",
    "descriptions": [{"lang": "es", "value": "hola"}, {"lang": "en", "value": "hello"}],
    "metrics": {
        "cvssMetricV2": [{"type": "Primary", "baseSeverity": "LOW", "cvssData": {"baseScore": 2.0, "version": "2.0"}}],
        "cvssMetricV31": [metric(5.0, "Secondary"), metric(9.1, "Primary")],
    },
    "published": "2025-01-02T03:04:05.000", "lastModified": "2025-02-10T00:00:00.000",
    "cisaActionDue": "2025-02-20",
    "references": [
        {"url": "https://a.example", "tags": ["Other", "Patch"]}, {"url": "https://b.example", "tags": ["Vendor Advisory"]},
        {"url": "https://c.example", "tags": ["Exploit", "Patch"]}, {"url": "https://d.example"}, {"url": ""},
    ],
}


def test_nvd(spark, land):
    old = {"id": "CVE-2025-0101", "descriptions": [], "metrics": {}, "lastModified": "2024-01-01T00:00:00.000"}
    v2 = {"id": "CVE-2025-0102", "descriptions": [{"lang": "fr", "value": "salut"}], "metrics": {
        "cvssMetricV31": [], "cvssMetricV2": FULL["metrics"]["cvssMetricV2"]}}
    path = land("nvd", p1__json=nvd_page(FULL, {"id": ""}, old), p2__json=nvd_page(v2))
    rows = NVD.records(NVD.read(spark, path), NOW)
    assert rows.count() == 3
    full = one(rows, "CVE-2025-0100")
    assert (full.description, full.cvss_score, full.cvss_version, full.severity) == ("hello", 9.1, "3.1", "CRITICAL")
    assert full.cisa_kev and full.cisa_kev_due_date == date(2025, 2, 20)
    assert [r.ref_type for r in full.references] == ["patch", "advisory", "exploit", None]
    assert full.published_at == datetime(2025, 1, 2, 3, 4, 5)
    low = one(rows, "CVE-2025-0102")
    assert (low.description, low.severity, low.cvss_version) == ("salut", "LOW", "2.0")
    bare = one(rows, "CVE-2025-0101")
    assert bare.description is None and bare.severity is None and not bare.cisa_kev and bare.references == []
    recent = NVD.records(NVD.read(spark, path), NOW, datetime(2025, 1, 1, tzinfo=timezone.utc))
    assert [r.cve_id for r in recent.collect()] == ["CVE-2025-0100"]


def test_nvd_rejected_is_kept(spark, land):
    path = land("nvd", p__json=nvd_page({"id": "CVE-2025-0001", "vulnStatus": "Rejected"}))
    assert one(NVD.records(NVD.read(spark, path), NOW), "CVE-2025-0001").record_status == "REJECTED"


def test_github(spark, land):
    page = [
        {"ghsa_id": "G1", "cve_id": "CVE-2025-0200", "summary": "short", "description": "", "severity": "critical",
         "cvss_severities": {"cvss_v3": {"score": None}, "cvss_v4": {"score": 7.5, "vector_string": "V4"}},
         "epss": {"percentage": 62.5, "percentile": 99.0}, "published_at": "2025-01-01T10:00:00Z",
         "updated_at": "2025-01-05T00:00:00Z",
         "vulnerabilities": [
             {"package": {"ecosystem": "pip", "name": "alpha"}, "vulnerable_version_range": "< 2", "first_patched_version": "2"},
             {"package": {"ecosystem": "pip", "name": ""}}, {"package": None}],
         "references": ["https://r.example", {"url": "https://object.example"}]},
        {"ghsa_id": "G2", "cve_id": None, "summary": "dropped"},
        {"ghsa_id": "G3", "cve_id": "CVE-2025-0201", "summary": "s", "severity": "unknown", "type": "reviewed"},
        {"ghsa_id": "G4", "cve_id": "CVE-2025-0202", "summary": "s", "type": "unreviewed"},
    ]
    rows = GITHUB.records(GITHUB.read(spark, land("gh", a__json=page)), NOW)
    assert sorted(r.cve_id for r in rows.collect()) == ["CVE-2025-0200", "CVE-2025-0201"]
    full = one(rows, "CVE-2025-0200")
    assert (full.description, full.severity, full.cvss_score, full.cvss_version) == ("short", "CRITICAL", 7.5, "4.0")
    assert (full.epss_score, full.epss_percentile) == (0.625, 0.99)
    assert [tuple(p) for p in full.affected_packages] == [("pip", "alpha", "< 2", "2")]
    assert [r.url for r in full.references] == ["https://r.example"]
    empty = one(rows, "CVE-2025-0201")
    assert empty.severity is None and empty.epss_score is None and empty.affected_packages == []


def osv_record(**changes):
    return {
        "id": "OSV-1", "aliases": ["GHSA-1", "CVE-2025-0300", "CVE-2025-0301"], "summary": "sum", "details": "",
        "severity": [{"type": "CVSS_V2", "score": ""}, {"type": "CVSS_V3", "score": "CVSS:3.1/y"}],
        "affected": [
            {"package": {"ecosystem": "", "name": "x"}, "database_specific": {"severity": "LOW"}},
            {"package": {"ecosystem": "PyPI", "name": "beta"},
             "ranges": [
                 {"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "1.2"}]},
                 {"type": "GIT", "events": [{"introduced": "abc"}, {"fixed": "9"}]},
                 {"type": "ECOSYSTEM", "events": [{"introduced": "2.0"}]}],
             "ecosystem_specific": {"severity": "high"}}],
        "references": [{"type": "WEB", "url": "https://w.example"}, {"url": "https://x.example"}],
        "published": "2025-01-01T00:00:00Z", "modified": "2025-01-10T00:00:00", **changes,
    }


def test_osv_archive(spark, tmp_path):
    folder = tmp_path / "osv"
    folder.mkdir()
    with zipfile.ZipFile(folder / "all.zip", "w") as z:
        z.writestr("a.json", json.dumps(osv_record()))
        z.writestr("b.json", json.dumps(osv_record(id="CVE-2025-0302", aliases=[])))
        z.writestr("c.json", json.dumps(osv_record(id="GHSA-2", aliases=None)))
        z.writestr("readme.txt", "no record")
    rows = OSV.records(OSV.read(spark, str(folder)), NOW)
    assert sorted(r.cve_id for r in rows.collect()) == ["CVE-2025-0300", "CVE-2025-0301", "CVE-2025-0302"]
    row = one(rows, "CVE-2025-0300")
    assert (row.description, row.severity, row.cvss_vector, row.cvss_version) == ("sum", "HIGH", "CVSS:3.1/y", "3.1")
    # the open range takes over the earlier fix
    assert [tuple(p) for p in row.affected_packages] == [("PyPI", "beta", "*, <1.2, >=2.0, <1.2", "1.2")]
    assert [tuple(r) for r in row.references] == [("https://w.example", "web"), ("https://x.example", None)]


def test_osv_since_and_files(spark, land):
    lines = "\n".join(json.dumps(r) for r in (
        osv_record(), osv_record(aliases=["CVE-2025-0310"], modified=None),
        osv_record(aliases=["CVE-2025-0311"], modified="2025-02-01T00:00:00Z")))
    landed = OSV_FILES.read(spark, land("osvf", a__json=lines))
    late = OSV_FILES.records(landed, NOW, datetime(2025, 1, 20, tzinfo=timezone.utc))
    assert sorted(r.cve_id for r in late.collect()) == ["CVE-2025-0310", "CVE-2025-0311"]
    raw = osv.fan_out(OSV_FILES.unpack(landed).select("payload", "arrival").distinct(), first_alias_only=True)
    assert raw.where("cve_id = 'CVE-2025-0300'").count() >= 2


def test_kev(spark, land):
    entries = [
        {"cveID": "CVE-2025-0400", "dateAdded": "2025-01-05", "dueDate": "2025-01-26", "shortDescription": "d",
         "notes": "https://n.example ; more"},
        {"cveID": "CVE-2025-0401", "dateAdded": "never", "dueDate": "soon", "notes": "see vendor"},
        {"cveID": "CVE-2025-0402", "dateAdded": "2025-2-1", "dueDate": "2025-02"},
        {"cveID": ""},
    ]
    landed = KEV.read(spark, land("kev", k__json={"title": "t", "vulnerabilities": entries}))
    rows = KEV.records(landed, NOW)
    assert rows.count() == 3 and all(r.cisa_kev for r in rows.collect())
    first = one(rows, "CVE-2025-0400")
    assert first.cisa_kev_due_date == date(2025, 1, 26) and first.published_at == datetime(2025, 1, 5)
    assert [tuple(r) for r in first.references] == [("https://n.example ; more", "advisory")]
    assert one(rows, "CVE-2025-0401").published_at is None and one(rows, "CVE-2025-0401").references == []
    assert one(rows, "CVE-2025-0402").published_at == datetime(2025, 2, 1)
    assert one(rows, "CVE-2025-0402").cisa_kev_due_date is None
    since = KEV.records(landed, NOW, datetime(2025, 1, 20, tzinfo=timezone.utc))
    assert sorted(r.cve_id for r in since.collect()) == ["CVE-2025-0401", "CVE-2025-0402"]


def test_epss(spark, tmp_path):
    folder = tmp_path / "epss"
    folder.mkdir()
    text = "#model:v1\ncve,epss,percentile\nCVE-2025-0500,0.97,0.99\n,0.1,0.2\nCVE-2025-0501,1d,x\n"
    (folder / "s.csv.gz").write_bytes(gzip.compress(text.encode()))
    rows = EPSS.records(EPSS.read(spark, str(folder)), NOW)
    assert {r.cve_id: (r.epss_score, r.epss_percentile) for r in rows.collect()} == {
        "CVE-2025-0500": (0.97, 0.99), "CVE-2025-0501": (None, None)}


def test_exploitdb(spark):
    refs = spark.createDataFrame([
        ("CVE-2025-1", "https://www.exploit-db.com/exploits/11"), ("CVE-2025-1", "http://exploit-db.com/exploits/12/x"),
        ("CVE-2025-2", "https://exploit-db.com/exploits/none"), ("CVE-2025-3", "https://other.example/11"),
    ], "cve_id string, url string")
    rows = exploitdb.records(refs, NOW).select("cve_id", F.inline("exploits")).collect()
    assert sorted((r.cve_id, r.source_id, r.url) for r in rows) == [
        ("CVE-2025-1", "11", "https://www.exploit-db.com/exploits/11"),
        ("CVE-2025-1", "12", "https://www.exploit-db.com/exploits/12")]


def test_arrival_order_follows_landing(spark, land):
    """Of two pages naming one CVE, the page that landed later wins."""
    from cvegrid.operators import merge

    path = land("nvd", z__json=nvd_page({**FULL, "descriptions": [{"lang": "en", "value": "first"}]}),
                a__json=nvd_page({**FULL, "descriptions": [{"lang": "en", "value": "second"}]}))
    states = merge.vulnerability_states(NVD.records(NVD.read(spark, path), NOW))
    row = merge.vulnerability_table(merge.fold_vulnerabilities(states)).first()
    assert row.description == "second" and row.raw_sources == ["nvd"]


def test_crawl_sources(spark):
    pages = spark.createDataFrame(
        [("c", "u1", 200, b"<body><p>ok</p></body>"), ("c", "u2", 404, b"x"), ("c", "u3", 200, b"<body></body>")],
        "cve_id string, url string, status int, body binary")
    got = {r.url: (r.error, r.text) for r in extracted(fetched(pages)).collect()}
    assert got == {"u1": (None, "ok"), "u2": ("HTTP 404 for u2", ""), "u3": (None, "")}
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "url string, embedding array<float>")
    assert [r.url for r in valid_vectors(vectors, 2).collect()] == ["a"]


def test_landed_advisories_are_dealt_by_page_and_parsed_once(spark):
    """A part table of few megabytes is one file split; a filter on a parsed field parsed the text again for each field."""
    for query in (catalog_feeds.normalize_github, catalog_feeds.scan_github_window):
        rows = query(Corpus(spark, "/root/testdata/sf0.001"))
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(StructField(ghsa_id") == 1 and plan.count("REPARTITION_BY_COL") == 1
