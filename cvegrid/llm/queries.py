"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cvegrid.session import scratch

from . import (
    attention_lm, bpe_prefix, curriculum, fill_middle, hard_negatives, huffman, neighbour_graph, ngram_join, personal, quality_cnn,
    repetition, secret_scan, toxicity,
)
from .common import in_fold, session, table
from .spans import count_kind, fingerprint, joined


def op9_bpe_prefix(spark: SparkSession, folder: str) -> DataFrame:
    coded = bpe_prefix.round_trip(table(spark, folder, "documents").select("doc_id", "text"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_personal_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return personal.extract(table(spark, folder, "documents")).select(
        "doc_id",
        *[count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in personal.KINDS],
        fingerprint(F.col("base")).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op2_neighbour_graph(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_graph.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op3_curriculum_mix(spark: SparkSession, folder: str) -> DataFrame:
    return curriculum.plan(table(spark, folder, "documents"))


def op4_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~in_fold(F.col("doc_id"), 5, 0))
    score = F.col("toxicity.score")
    return toxicity.score(docs, model).select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("toxicity.passages").cast("long").alias("n_passages"),
    )


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, [1.5, 1.0, 0.5][rank % 3 + 1]::DOUBLE AS a,
         [0.5, 1.0, 1.5][rank % 3 + 1]::DOUBLE AS b, 2.0::DOUBLE * source_size AS bound
  FROM per_source
), filled AS (
  SELECT *, sum(bound) OVER w - bound AS filled, sum(weight) OVER w - weight AS lighter,
         sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM weighed WINDOW w AS (ORDER BY bound / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * all_size - filled) / (all_weight - lighter) AS level FROM filled
), goals AS (
  SELECT source, source_size, a, b, least(bound, weight * first_value(level) OVER (
           ORDER BY CASE WHEN level * weight <= bound THEN 0 ELSE 1 END, lighter)) AS target
  FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, a, b,
         sum(size) OVER (PARTITION BY s.source ORDER BY hash, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), counted AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS passes FROM placed
), taken AS (
  SELECT *, CAST(passes * size + least(greatest(goal - passes * source_size - start, 0), size) AS BIGINT) AS taken,
         least((start + size / 2::DOUBLE) / target, 1.0) AS share
  FROM counted
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN a = b THEN share
            ELSE (sqrt(a * a + 2.0 * (b - a) * (share * (a + b) / 2)) - a) / (b - a) END END AS position
FROM taken
"""


def op5_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find(table(spark, folder, "documents")).select(
        "doc_id",
        *[count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS],
        fingerprint(F.col("base")).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        "n_owned",
        "n_copied",
    )


def _secret_part(rank: int, kind: str, pattern: str, holds: str, value: str) -> str:
    """The findings of a kind with their places: the lengths of pieces and matches before, added up."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, lang, {rank} AS rank, '{kind}' AS kind, starts[i] AS s, starts[i] + len(m[i]) AS e, {value} AS v FROM (
    SELECT *, [CAST(list_sum([len(x) FOR x IN parts[:i]]) + coalesce(list_sum([len(x) FOR x IN m[:i - 1]]), 0) AS BIGINT)
        FOR i IN range(1, len(m) + 1)] AS starts
    FROM (SELECT doc_id, source, lang, regexp_extract_all(t, '{quoted}') AS m, string_split_regex(t, '{quoted}') AS parts
      FROM texts)
  ), unnest(range(1, len(m) + 1)) u(i) WHERE {holds}"""


_SECRET = "regexp_extract(m[i], '" + secret_scan.ASSIGN.replace("'", "''") + "', 2)"
_MIXED = " AND ".join(f"regexp_matches(m[i], '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]"))
_SECRET_PARTS = " UNION ALL ".join([
    _secret_part(0, "assign", secret_scan.ASSIGN, f"len({_SECRET}) >= 12", _SECRET),
    _secret_part(1, "access", secret_scan.ACCESS, "true", "m[i]"),
    _secret_part(2, "hex", secret_scan.HEX, "true", "m[i]"),
    _secret_part(3, "owned", "[A-Za-z0-9+/_=-]{20,}", _MIXED, "m[i]"),
])
OP5_SQL = f"""
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS ({_SECRET_PARTS}),
apart AS (
  SELECT * FROM found f WHERE kind <> 'owned' OR NOT EXISTS (
    SELECT 1 FROM found b WHERE b.doc_id = f.doc_id AND b.kind <> 'owned' AND b.s < f.e AND f.s < b.e)
), held AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) > {secret_scan.MAX_OWNERS}
    OR count(DISTINCT coalesce(source, chr(0)) || '/' || coalesce(lang, chr(0))) > {secret_scan.MAX_REPOSITORIES} AS copied
  FROM apart GROUP BY v
), judged AS (SELECT a.*, copied FROM apart a JOIN held h ON h.v = a.v WHERE kind <> 'owned' OR NOT copied),
lines AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (NOT copied) AS n_owned, count(*) FILTER (copied) AS n_copied,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) FILTER (kind <> 'owned') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned,
  coalesce(n_copied, 0) AS n_copied
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id
"""


def op6_partenum_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


OP6_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS g FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN reached r ON r.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""


def op7_quality_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    network = quality_cnn.fit(docs, table(spark, folder, "labels"), ~in_fold(F.col("doc_id"), 4, 2))
    return quality_cnn.score(docs, network).select(
        "doc_id",
        in_fold(F.col("doc_id"), 4, 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )


def op8_suffix_repetition(spark: SparkSession, folder: str) -> DataFrame:
    judged = repetition.judge(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "repetition.*")


def op10_huffman_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(session(spark), "huffman")
    huffman.encode_and_write(table(spark, folder, "documents"), path)
    return huffman.read(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def op11_attention_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = attention_lm.fit(docs, ~in_fold(F.col("doc_id"), 5, 1))
    return attention_lm.score(docs, model).select(
        "doc_id",
        in_fold(F.col("doc_id"), 5, 1).alias("held_out"),
        "lm.n_tokens", "lm.n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score",
    )


def op12_kronecker_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, label)


OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
       s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""


def op13_swar_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, folder, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return cut.select(
        "doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars",
        digest(F.col("fim.output")).alias("output_sha256"),
        digest(fill_middle.restore(F.col("fim.output"), F.col("fim.form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""


QUERIES = {
    "op1_personal_bootstrap": op1_personal_bootstrap,
    "op2_neighbour_graph": op2_neighbour_graph,
    "op3_curriculum_mix": op3_curriculum_mix,
    "op4_toxic_segments": op4_toxic_segments,
    "op5_secret_ownership": op5_secret_ownership,
    "op6_partenum_join": op6_partenum_join,
    "op7_quality_cnn": op7_quality_cnn,
    "op8_suffix_repetition": op8_suffix_repetition,
    "op9_bpe_prefix": op9_bpe_prefix,
    "op10_huffman_tokens": op10_huffman_tokens,
    "op11_attention_lm": op11_attention_lm,
    "op12_kronecker_negatives": op12_kronecker_negatives,
    "op13_swar_fill_middle": op13_swar_fill_middle,
}
ORACLES = {
    "op3_curriculum_mix": OP3_SQL,
    "op5_secret_ownership": OP5_SQL,
    "op6_partenum_join": OP6_SQL,
    "op12_kronecker_negatives": OP12_SQL,
    "op13_swar_fill_middle": OP13_SQL,
}
