"""The corpus operators as named queries over the whole tables, with SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import (
    byte_conv,
    decontaminate,
    exact_dedup,
    line_dedup,
    lpf_dedup,
    merkle,
    packing,
    resample,
    secret_scan,
    simhash,
    sql,
    token_counts,
    toxicity,
    url_reputation,
)
from packetloom.llm.common import llm_session, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(llm_session(spark), sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).drop("text")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(llm_session(spark), sf_dir, "documents")).drop("ids")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = llm_session(spark)
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"), F.size("matches").cast("bigint").alias("n_matches"), "matches"
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(llm_session(spark), sf_dir, "documents")).drop("row", "component_row")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(llm_session(spark), sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(llm_session(spark), sf_dir, "documents"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = (
                [[(s["kind"], s["begin"], s["end"]) for s in row] for row in batch.column(c).to_pylist()]
                for c in ("base_spans", "spans")
            )
            texts = [secret_scan.span_text(x) for x in every]
            shas = [hashlib.sha256(secret_scan.span_text(x).encode()).hexdigest() for x in base]
            counts = [batch.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex")]
            yield pa.RecordBatch.from_arrays(
                [*counts, pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return found.mapInArrow(
        digest, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lpf_dedup.remove_repeats(table(llm_session(spark), sf_dir, "documents"))
    # The text that is left; what a cut leaves of a character shows as U+FFFD.
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("changed"), text.alias("text")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = llm_session(spark)
    # A page's outcome is the quality label of the document made from it.
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return url_reputation.filter_urls(table(spark, sf_dir, "pages"), labels).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.edited_counts(token_counts.redaction_edits(table(llm_session(spark), sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = llm_session(spark)
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = llm_session(spark)
    docs = table(spark, sf_dir, "documents")
    return byte_conv.quality_scores(docs, byte_conv.fit_quality(docs, table(spark, sf_dir, "labels")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_manifest(table(llm_session(spark), sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark = llm_session(spark)
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_packing, op3_decontamination, op4_simhash, op5_exact_dedup, op6_secrets, op7_suffix_dedup,
        op8_url_filter, op9_token_counts, op10_toxicity, op11_quality, op12_merkle, op13_resample,
    )
}

_EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS n,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(body) DESC, doc_id))
SELECT doc_id, keep_id, group_size, n = 1 AS kept, text_sha256 FROM r
"""

_URL_SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
o AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS good
       FROM p LEFT JOIN o ON page_id = doc_id GROUP BY host),
h AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain,
             list_extract(string_split(host, '.'), -1) AS suffix FROM h0),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
w AS (SELECT coalesce(sum(good), 0) + 1 AS a, coalesce(sum(n), 0) - coalesce(sum(good), 0) + 1 AS b FROM s),
ms AS (SELECT s.*, a - good AS pa, b - (n - good) AS pb FROM s, w), ks AS (SELECT {k} AS k FROM ms WHERE n > 0),
ps AS (SELECT suffix, {a} AS a, {b} AS b FROM ms, ks),
md AS (SELECT d.*, a - good AS pa, b - (n - good) AS pb FROM d JOIN ps USING (suffix)), kd AS (SELECT {k} AS k FROM md WHERE n > 0),
pd AS (SELECT domain, {a} AS a, {b} AS b FROM md, kd),
mh AS (SELECT h.*, a - good AS pa, b - (n - good) AS pb FROM h JOIN pd USING (domain)), kh AS (SELECT {k} AS k FROM mh WHERE n > 0),
ph AS (SELECT host, {a} / ({a} + {b}) AS mean, {a} + {b} AS total FROM mh, kh),
v AS (SELECT host, least(mean + 1.6449 * sqrt(mean * (1 - mean) / (total + 1)), 1) AS upper FROM ph),
f AS (
  SELECT p.*, upper,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/')
           THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p LEFT JOIN v USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM f
"""
for _name, _text in {
    "{k}": """CASE WHEN count(*) < 2 OR sum(n) <= count(*) OR sum(n * power(good / n - {m}, 2)) <= sum({m} * (1 - {m})) THEN 1000
       ELSE least(greatest((sum(n * {m} * (1 - {m})) - sum({m} * (1 - {m})))
                           / (sum(n * power(good / n - {m}, 2)) - sum({m} * (1 - {m}))) - 1, 1), 1000) END""",
    "{a}": "({m} * least(k, pa + pb) + good)",
    "{b}": "((1 - {m}) * least(k, pa + pb) + n - good)",
    "{m}": "(pa / (pa + pb))",
}.items():
    _URL_SQL = _URL_SQL.replace(_name, _text)

ORACLES: dict[str, str] = {
    "op5_exact_dedup": _EXACT_SQL, "op8_url_filter": _URL_SQL, "op12_merkle": sql.MERKLE, "op13_resample": sql.RESAMPLE,
}
