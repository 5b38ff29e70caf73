"""Logical tables of the engine over parquet tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """(doc_id, path, label, sha256, source_id, derived, n_chars) of documents: three in a row are one family, the second and third derived."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc"), F.expr("doc_id div 3").cast("string"), F.when(F.expr("doc_id % 3 = 1"), "__aug_d3").when(F.expr("doc_id % 3 = 2"), "__erode_k3_it1__aug_shift5").otherwise(""))
    path = F.concat_ws("/", F.col(label), F.concat(name, F.lit(".txt")))
    return d.select("doc_id", path.alias("path"), F.col(label).alias("label"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "n_chars").withColumns({"source_id": paths.source_id(F.col("path")), "derived": paths.is_derived(F.col("path"))})


def manifest_sql(label: str = "lang") -> str:
    return f"""manifest AS (
  SELECT doc_id, {label} || '/' || stem || '.txt' AS path, {label} AS label, sha, {label} || '/' || regexp_replace(stem, '__(aug|erode|dilate)_.*$', '') AS source_id,
    regexp_matches(stem, '__(aug|erode|dilate)_') AS derived, n_chars
  FROM (SELECT doc_id, {label}, n_chars, sha256(text) AS sha, 'doc' || CAST(doc_id // 3 AS VARCHAR) || CASE doc_id % 3 WHEN 1 THEN '__aug_d3' WHEN 2 THEN '__erode_k3_it1__aug_shift5' ELSE '' END AS stem FROM documents)
)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v, split): validation is every fifth vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train").alias("split"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, candidate, seed, run_seq, val_macro_f1, val_accuracy, training_seconds, parameter_count, status) of runs made up of events: a run is a user group of an event type."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.col("event_type").alias("candidate"), (F.col("user_id") % 5).cast("int").alias("seed"))
    r = g.agg(
        F.round(F.avg("value") / F.max("value"), 4).alias("val_macro_f1"),
        F.round(F.avg("value") / (F.max("value") + 1), 4).alias("val_accuracy"),
        F.round(F.sum("value"), 4).alias("training_seconds"),
        F.count("*").alias("parameter_count"),
        F.min("event_id").alias("run_seq"),
    )
    return r.select(F.concat_ws("-", "candidate", F.col("seed").cast("string")).alias("run_id"), "*", F.when(F.col("run_seq") % 7 == 0, "failed").otherwise("complete").alias("status"))


RECEIPTS_SQL = """receipts AS (
  SELECT event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS run_id, event_type AS candidate, CAST(user_id % 5 AS INTEGER) AS seed,
    round(avg(value) / max(value), 4) AS val_macro_f1, round(avg(value) / (max(value) + 1), 4) AS val_accuracy, round(sum(value), 4) AS training_seconds,
    count(*) AS parameter_count, min(event_id) AS run_seq, CASE WHEN min(event_id) % 7 = 0 THEN 'failed' ELSE 'complete' END AS status
  FROM events GROUP BY 1, 2, 3
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, val_macro_f1, val_accuracy, train_accuracy): an epoch is a block of a run's events."""
    e = table(spark, sf_dir, "events")
    h = e.groupBy(F.concat_ws("-", F.lit("run"), (F.col("user_id") % 6).cast("string")).alias("run_id"), (F.floor(F.col("event_id") / F.lit(100)) % 30 + 1).cast("int").alias("epoch"))
    return h.agg(F.round(F.avg("value") / 100, 3).alias("val_macro_f1"), F.round(F.max("value") / 1000, 3).alias("val_accuracy"), F.round(F.avg("value") / 90, 3).alias("train_accuracy"))


HISTORY_SQL = """history AS (
  SELECT 'run-' || CAST(user_id % 6 AS VARCHAR) AS run_id, CAST((event_id // 100) % 30 + 1 AS INTEGER) AS epoch,
    round(avg(value) / 100, 3) AS val_macro_f1, round(max(value) / 1000, 3) AS val_accuracy, round(avg(value) / 90, 3) AS train_accuracy
  FROM events GROUP BY 1, 2
)"""
