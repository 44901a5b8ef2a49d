"""The registered queries of this folder: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann as _ann
from . import bpe as _bpe
from . import fingerprints as _fingerprints
from . import licenses as _licenses
from . import line_dedup as _line_dedup
from . import middle as _middle
from . import mixing as _mixing
from . import near_dedup as _near_dedup
from . import resampling as _resampling
from . import site_tree as _site_tree
from . import suffix_dedup as _suffix_dedup
from . import toxicity as _toxicity
from . import url_filter as _url_filter
from .common import read

#: The rules of the registered URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), whole=True)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = _toxicity.score(docs, _toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", _toxicity.held_out().alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source and a language make a directory."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
    return _licenses.licences(docs).select("doc_id", "path", "licence", F.round("cosine", 6).alias("cosine"), "how", "source_dir")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_filter.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_dedup.near_duplicates(read(spark, sf_dir, "documents"), k=4, percent=80)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def word_vocabulary() -> str:
    """The vocabulary file of the registered queries, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = _bpe.encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ann.search(read(spark, sf_dir, "embeddings"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_tree.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    made = _middle.fill_in_middle(docs, rate=90, swapped=20, seed="1")
    back = _middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    return _resampling.resample(docs, target, percent=25, least_words=20, seed="7").select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_line_dedup, op3_mixing, op4_toxicity, op5_licenses, op6_url_filter, op7_near_duplicates, op8_fingerprints, op9_bpe, op10_nearest, op11_main_text, op12_fill_in_middle, op13_importance)}

ORACLES = {
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, CAST(len(u) AS BIGINT) AS n, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 1 + 8 * CAST(i AS INT), 8) AS BIGINT)) AS r FROM d),
f AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
                  WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
    "op13_importance": r"""
WITH RECURSIVE crc(i, v, k) AS (
  SELECT range, CAST(range AS BIGINT), 0 FROM range(256) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS BIGINT)) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
raw AS (SELECT 0 AS src, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
w AS (SELECT src, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM raw),
e AS (SELECT src, row, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[CAST(i AS INT)] || ' ' || ws[CAST(i AS INT) + 1]))) AS f FROM w),
c AS (SELECT src, row, f, count(*) AS n FROM e GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM c)),
b AS (SELECT f, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda j: CAST('0x' || substr(x, 1 + 2 * CAST(j AS INT), 2) AS BIGINT))),
                         lambda a, y: xor(a >> 8, t[CAST(xor(a & 255, y) AS INT) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket FROM h, tab),
n AS (SELECT range AS bucket, CAST(coalesce(s, 0) AS BIGINT) AS s, CAST(coalesce(t, 0) AS BIGINT) AS t FROM range(10000) LEFT JOIN
      (SELECT bucket, sum(n) FILTER (src = 0) AS s, sum(n) FILTER (src = 1) AS t FROM c JOIN b USING (f) GROUP BY bucket) ON range = bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n),
d AS (SELECT row, CAST(sum(c.n) AS BIGINT) AS n_features, CAST(sum(c.n * gain) AS BIGINT) AS total FROM c JOIN b USING (f) JOIN g USING (bucket) WHERE src = 0 GROUP BY row),
z AS (SELECT w.doc_id, len(ws) AS words, coalesce(n_features, 0) AS n_features,
             coalesce(CASE WHEN total >= 0 THEN total // n_features ELSE -((-total + n_features - 1) // n_features) END, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN d USING (row) WHERE src = 0),
q AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((CAST(h AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, words) AS rn, count(*) OVER (PARTITION BY words >= 20) AS many FROM q)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN words >= 20 AND rn <= 25 * many // 100 THEN CAST(rn AS BIGINT) END AS rank FROM r""",
    "op3_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][((rn - 1) % 3) + 1] AS DOUBLE) AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER b, 0)) AS lvl
      FROM w WINDOW b AS (ORDER BY cap / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, wt * max(lvl) OVER ()) AS target FROM l),
c AS (SELECT d.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM c""",
    "op6_url_filter": r"""
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT u.host, u.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host || r.path) DESC) AS k
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path AND m.k = 1""",
}
