"""Table schemas and the fixed values of the data model."""

from pyspark.sql import types as T

# --- Fixed values: they must equal the data model's for right results ---------

#: Severity levels from most to least severe.
SEVERITY_LADDER = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]

#: NVD reference tag -> stored reference type.
NVD_TAG_TYPES = {
    "Patch": "patch",
    "Exploit": "exploit",
    "Vendor Advisory": "advisory",
    "Third Party Advisory": "advisory",
    "US Government Resource": "advisory",
}

#: Common spelling of an ecosystem -> canonical name.
ECOSYSTEM_ALIASES = {
    "python": "pypi",
    "pip": "pypi",
    "javascript": "npm",
    "js": "npm",
    "node": "npm",
    "go": "Go",
    "golang": "Go",
    "java": "maven",
    "rust": "crates.io",
    "c#": "nuget",
    ".net": "nuget",
    "ruby": "rubygems",
    "php": "composer",
    "dart": "pub",
    "flutter": "pub",
    "elixir": "erlang",
    "erlang": "erlang",
    "swift": "swift",
}

#: Registered feeds in arrival order; the position breaks ties between feeds
#: that sync at the same instant. Later entries win.
SOURCE_ORDER = ["nvd", "github", "osv", "exploitdb", "epss", "cisa_kev"]

#: Refresh interval in seconds per feed.
REFRESH_SECONDS = {
    "nvd": 21_600,
    "github": 21_600,
    "osv": 21_600,
    "exploitdb": 86_400,
    "epss": 86_400,
    "cisa_kev": 86_400,
}

RESULT_LIMIT = 50
CHARS_PER_TOKEN = 4
TOKEN_BUDGET = 15_000
OVERLAP_HOURS = 1
MAX_BODY_BYTES = 5 * 1024 * 1024
MAX_TEXT_BYTES = 50_000
MAX_CRAWL_ATTEMPTS = 3
CLAIM_LIMIT = 500
BACKFILL_CLAIM_LIMIT = 5_000
DOMAIN_RATE = 2.0
EMBEDDING_WIDTH = 1_536
SEMANTIC_K = 10
IVF_LISTS = 100

# --- Normalized record: what every feed is turned into -------------------------

PACKAGE = T.StructType([
    T.StructField("ecosystem", T.StringType()),
    T.StructField("package_name", T.StringType()),
    T.StructField("vulnerable_versions", T.StringType()),
    T.StructField("patched_version", T.StringType()),
])

EXPLOIT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("discovered_at", T.TimestampType()),
])

REFERENCE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("ref_type", T.StringType()),
])

#: Where in which landed file a record came from; ordered field by field it is
#: the arrival order inside one sync.
ARRIVAL = T.StructType([
    T.StructField("landed_at", T.TimestampType()),
    T.StructField("file_id", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("row", T.LongType()),
    T.StructField("item", T.IntegerType()),
])

#: Total arrival order of observations over all syncs and feeds.
SEQ = T.StructType([
    T.StructField("synced_at", T.TimestampType()),
    T.StructField("source_rank", T.IntegerType()),
    *ARRIVAL.fields,
])

#: Scalar columns merged by "last non-null wins".
MERGED_COLUMNS = {
    "description": T.StringType(),
    "cvss_score": T.DoubleType(),
    "cvss_vector": T.StringType(),
    "cvss_version": T.StringType(),
    "epss_score": T.DoubleType(),
    "epss_percentile": T.DoubleType(),
    "cisa_kev_due_date": T.DateType(),
    "severity": T.StringType(),
    "published_at": T.TimestampType(),
    "modified_at": T.TimestampType(),
    "record_status": T.StringType(),
}

NORMALIZED = T.StructType([
    T.StructField("cve_id", T.StringType()),
    T.StructField("source", T.StringType()),
    *[T.StructField(n, t) for n, t in MERGED_COLUMNS.items()],
    T.StructField("cisa_kev", T.BooleanType()),
    T.StructField("affected_packages", T.ArrayType(PACKAGE)),
    T.StructField("exploits", T.ArrayType(EXPLOIT)),
    T.StructField("references", T.ArrayType(REFERENCE)),
    T.StructField("seq", SEQ),
])

# --- Stored tables --------------------------------------------------------------

VULNERABILITIES = T.StructType([
    T.StructField("cve_id", T.StringType()),
    *[T.StructField(n, t) for n, t in MERGED_COLUMNS.items()],
    T.StructField("cisa_kev", T.BooleanType()),
    T.StructField("raw_sources", T.ArrayType(T.StringType())),
    T.StructField("created_in_db", T.TimestampType()),
    T.StructField("updated_in_db", T.TimestampType()),
])

AFFECTED_PACKAGES = T.StructType([
    T.StructField("cve_id", T.StringType()),
    T.StructField("ecosystem", T.StringType()),
    T.StructField("package_name", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("vulnerable_versions", T.StringType()),
    T.StructField("patched_version", T.StringType()),
    T.StructField("ecosystem_lc", T.StringType()),
    T.StructField("package_lc", T.StringType()),
])

EXPLOITS = T.StructType([
    T.StructField("cve_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("discovered_at", T.TimestampType()),
])

CVE_REFERENCES = T.StructType([
    T.StructField("cve_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("ref_type", T.StringType()),
    T.StructField("source", T.StringType()),
])

#: Name of a stored table -> its columns.
STORED = {
    "vulnerabilities": VULNERABILITIES,
    "affected_packages": AFFECTED_PACKAGES,
    "exploits": EXPLOITS,
    "cve_references": CVE_REFERENCES,
}

RUN_LOG = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("synced_at", T.TimestampType()),
    T.StructField("records", T.LongType()),
])

#: One row per crawl event; the work queue and the stored pages are views of it.
CRAWL_LOG = T.StructType([
    T.StructField("cve_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("at", T.TimestampType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# --- Question side ---------------------------------------------------------------

INTENTS = T.StructType([
    T.StructField("intent_id", T.StringType()),
    T.StructField("ecosystems", T.ArrayType(T.StringType())),
    T.StructField("package_names", T.ArrayType(T.StringType())),
    T.StructField("cve_ids", T.ArrayType(T.StringType())),
    T.StructField("severity_filter", T.StringType()),
    T.StructField("date_range", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("raw_search_query", T.StringType()),
])

CLAIM = T.StructType([
    T.StructField("claim", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("rationale", T.StringType()),
])

ANSWERS = T.StructType([
    T.StructField("answer_id", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("claims", T.ArrayType(CLAIM)),
    T.StructField("omissions", T.ArrayType(T.StringType())),
])
