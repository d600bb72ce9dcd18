"""Content keys of documents, fingerprints of a run over them, and what a second run may reuse.

policy    = the settings of a run: names, limits, a ridge, routes by language
earlier   = the same documents before an edit: every seventh had another source,
            every eleventh wasn't there
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdikt.functions import keys as K
from verdikt.operators import resume as R
from verdikt.plans.registry import query

VERSION = "judge_v2"


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL")


def _payload():
    """Fields out of order on purpose; the text goes in whole."""
    return F.struct(
        F.col("text").alias("text"), F.col("source").alias("source"), F.struct(F.col("n_chars").alias("n_chars"), F.col("lang").alias("lang")).alias("meta"),
        F.array((F.col("n_chars") / 8).alias("x"), F.lit(None).cast("double")).alias("sizes"), (F.col("n_chars") > 800).alias("long"),
        F.create_map(F.lit("z"), F.col("lang"), F.lit("a"), F.col("source")).alias("labels"),
    )


def _q(e: str) -> str:
    return f"coalesce(to_json({e})::VARCHAR, 'null')"


_EIGHTH = "CASE WHEN n_chars IS NULL THEN 'null' ELSE (n_chars // 8)::VARCHAR || '.' || ['0', '125', '25', '375', '5', '625', '75', '875'][n_chars % 8 + 1] END"
_JSON = f"""'{{"labels":{{"a":' || {_q('source')} || ',"z":' || {_q('lang')} || '}},"long":' || coalesce((n_chars > 800)::VARCHAR, 'null')
  || ',"meta":{{"lang":' || {_q('lang')} || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || '}},"sizes":[' || {_EIGHTH} || ',null],"source":'
  || {_q('source')} || ',"text":' || {_q('text')} || '}}'"""


@query("content_keys", f"""SELECT doc_id, '{VERSION}::' || sha256({_JSON}) AS cache_key, sha256({_q('text')}) AS text_hash FROM documents WHERE doc_id IS NOT NULL""")
def content_keys(spark, folder):
    rows = documents(spark, folder).select("doc_id", _payload().alias("p"))
    kind = rows.schema["p"].dataType
    return rows.select(
        "doc_id", K.cache_key(VERSION, F.col("p"), kind).alias("cache_key"), K.stable_hash(F.col("p.text"), kind["text"].dataType).alias("text_hash")
    )


def settings(spark):
    return spark.range(1).select(
        F.lit("train_80").alias("split_name"), F.lit(8).alias("max_criteria"), F.lit(None).cast("int").alias("max_pairs_per_example"),
        F.lit(1e-05).alias("covariance_ridge"), F.lit(True).alias("reference_answer_access"),
        F.struct(F.lit("judge").alias("model"), F.lit("local").alias("provider"), F.lit("").alias("base_url")).alias("judge_model"),
        F.create_map(F.lit("fr"), F.array(F.lit("b"), F.lit("a")), F.lit("de"), F.array().cast("array<string>")).alias("routes"),
    )


_SETTINGS_JSON = (
    '{"covariance_ridge":1e-05,"judge_model":{"base_url":"","model":"judge","provider":"local"},"max_criteria":8,"max_pairs_per_example":null,'
    '"reference_answer_access":true,"routes":{"de":[],"fr":["b","a"]},"split_name":"train_80"}'
)


def _print(source: str) -> str:
    own = f"""'{{"lang":' || {_q('lang')} || ',"source":' || {_q(source)} || ',"text":' || {_q('text')} || '}}'"""
    return f"sha256(sha256('{_SETTINGS_JSON}') || '::' || sha256({own}))"


_NOW = _print("source")
_BEFORE = _print("CASE WHEN doc_id % 7 = 0 THEN 'before' ELSE source END")


def fingerprints(spark, rows):
    return R.with_fingerprint(rows, ["text", "lang", "source"], settings(spark)).select("doc_id", "fingerprint")


@query("run_fingerprints", f"SELECT doc_id, {_NOW} AS fingerprint FROM documents WHERE doc_id IS NOT NULL")
def run_fingerprints(spark, folder):
    return fingerprints(spark, documents(spark, folder))


@query("resumed_rows", f"""WITH now AS (SELECT doc_id, lang, {_NOW} AS f FROM documents WHERE doc_id IS NOT NULL),
earlier AS (SELECT DISTINCT doc_id, {_BEFORE} AS f FROM documents WHERE doc_id % 11 <> 0)
SELECT lang, state, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (
  SELECT lang, doc_id, CASE WHEN EXISTS (SELECT 1 FROM earlier e WHERE e.doc_id = n.doc_id AND e.f = n.f) THEN 'reused'
    WHEN doc_id IN (SELECT doc_id FROM earlier) THEN 'stale' ELSE 'new' END AS state FROM now n) GROUP BY ALL""")
def resumed_rows(spark, folder):
    rows = documents(spark, folder)
    before = rows.where("doc_id % 11 <> 0").withColumn("source", F.when(F.col("doc_id") % 7 == 0, "before").otherwise(F.col("source")))
    current = R.with_fingerprint(rows, ["text", "lang", "source"], settings(spark)).select("doc_id", "lang", "fingerprint")
    found = R.resume(current, fingerprints(spark, before), "doc_id")
    return found.groupBy("lang", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))
