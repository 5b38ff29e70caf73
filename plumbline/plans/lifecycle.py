"""Queries over what happens to runs and tables in time: protocols, searches, streams, frozen splits, caches, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths
from plumbline.operators import protocol, runs, search, sequence, split
from plumbline.plans.manifests import SCAN, scanned
from plumbline.plans.registry import query
from plumbline.plans.storage import new_folder
from plumbline.runtime import cut
from plumbline.sources import sinks
from plumbline.sources.views import manifest_sql, table
from plumbline.streaming.statuses import StatusTable

_ALLOWED = [(None, "view"), (None, "click"), ("view", "click"), ("click", "cart"), ("cart", "purchase"), ("view", "view"), ("click", "view"), ("cart", "view"), ("purchase", "view"), ("purchase", "click")]
_PAIRS = ", ".join(f"({'NULL' if a is None else repr(a)}, {b!r})" for a, b in _ALLOWED)
_STEPS = f"""WITH ok(a, b) AS (VALUES {_PAIRS}), step AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, event_type AS state FROM events),
bad AS (SELECT * FROM step WHERE NOT EXISTS (SELECT 1 FROM ok WHERE a IS NOT DISTINCT FROM before AND b = state))"""


@query(f"{_STEPS} SELECT user_id, min(event_id) AS event_id, arg_min(coalesce(before, '-'), event_id) AS before, arg_min(state, event_id) AS state FROM bad GROUP BY 1")
def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The first step of each user's log of events that no allowed step leads to."""
    log = table(spark, d, "events").select("user_id", "event_id", "event_type")
    got = protocol.first_illegal(log, protocol.transitions(spark, _ALLOWED), "user_id", "event_id", "event_type")
    return got.withColumn("before", F.coalesce("before", F.lit("-")))


def _uniform(key: str) -> str:
    return f"((CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) + 1) / 4294967296.0)"


_SEARCH = f"""WITH t AS (SELECT event_type AS study, event_id AS trial, value AS x, CAST(json_extract(props, '$.k') AS INTEGER) AS y FROM events WHERE value IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL),
s AS (SELECT *, y >= (SELECT quantile_disc(u.y, 0.75) FROM t u WHERE u.study = t.study) AS good FROM t),
f AS (SELECT study, low, high, n1, n0, greatest(1.06 * coalesce(s1, 0) * pow(greatest(n1, 1), -0.2), (high - low) / 100) AS h1, greatest(1.06 * coalesce(s0, 0) * pow(greatest(n0, 1), -0.2), (high - low) / 100) AS h0 FROM (
  SELECT study, min(x) AS low, max(x) AS high, count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0, stddev_samp(x) FILTER (good) AS s1, stddev_samp(x) FILTER (NOT good) AS s0 FROM s GROUP BY 1) WHERE high > low),
c AS (SELECT study, candidate, arg_min(x, md5(study || '|' || candidate || '|' || trial)) AS x FROM s, (SELECT unnest(range(24)) AS candidate) WHERE good GROUP BY 1, 2),
m AS (SELECT study, candidate, greatest(low, least(high, x + h1 * sqrt(-2 * ln({_uniform("study || '|' || candidate || '|r'")})) * cos(2 * pi() * {_uniform("study || '|' || candidate || '|a'")}))) AS spot FROM c JOIN f USING (study)),
k AS (SELECT study, candidate, any_value(spot) AS spot, sum(CASE WHEN good THEN exp(-pow((spot - x) / h1, 2) / 2) / (h1 * sqrt(2 * pi())) ELSE 0 END) AS k1, sum(CASE WHEN NOT good THEN exp(-pow((spot - x) / h0, 2) / 2) / (h0 * sqrt(2 * pi())) ELSE 0 END) AS k0
  FROM s JOIN m USING (study) JOIN f USING (study) GROUP BY 1, 2),
o AS (SELECT study, candidate, spot AS x, ln((k1 + 1 / (high - low)) / (n1 + 1)) - ln((k0 + 1 / (high - low)) / (n0 + 1)) AS score FROM k JOIN f USING (study))"""


@query(f"{_SEARCH} SELECT study, CAST(candidate AS INTEGER) AS candidate, round(x, 5) AS x, round(score, 5) AS score FROM o")
def suggested_trials(spark: SparkSession, d: str) -> DataFrame:
    """Where each study of trials made of events would try next, and how much that promises."""
    e = table(spark, d, "events").select("event_type", "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("y"))
    got = search.suggestions(e, "event_type", "event_id", "value", "y")
    return got.select("study", "candidate", F.round("x", 5).alias("x"), F.round("score", 5).alias("score"))


@query("SELECT user_id AS run_id, max(event_id) AS seq, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def status_stream(spark: SparkSession, d: str) -> DataFrame:
    """Statuses that come in batches, of which one comes again; the last of each run."""
    folder = new_folder(spark)
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    rows.repartition(3, "seq").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    statuses = StatusTable(spark, f"{folder}/statuses")
    statuses.follow(stream, f"{folder}/progress").awaitTermination()
    statuses.upsert(spark.read.parquet(f"{folder}/statuses/batch=1"), 1)
    return statuses.read()


def _hash_sql(columns: str, where: str, source: str) -> str:
    row = f"sha256(concat_ws(chr(31), {columns}))"
    parts = ", ".join(f"'|', CAST(coalesce(sum(CAST('0x' || substr({row}, {1 + 15 * i}, 15) AS BIGINT)), 0) AS VARCHAR)" for i in range(4))
    return f"(SELECT sha256(concat(CAST(count(*) AS VARCHAR), {parts})) FROM {source} WHERE {where})"


_CASES = f"""WITH {manifest_sql()}, base AS (SELECT doc_id, path, label, sha AS sha256, source_id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM manifest),
same AS (SELECT * FROM base), relabelled AS (SELECT doc_id, path, CASE WHEN doc_id = 7 THEN 'new' ELSE label END AS label, sha256, source_id, split FROM base), shortened AS (SELECT * FROM base WHERE doc_id <> 10)"""
_FROZEN = " UNION ALL ".join(
    f"SELECT '{c}' AS manifest, {change} AS first_change, {_hash_sql('path, label, sha256, source_id', chr(39).join(['split = ', 'train', '']), c)} AS train_hash, {_hash_sql('path, label, sha256, source_id', chr(39).join(['split = ', 'validation', '']), c)} AS validation_hash"
    for c, change in (("same", "NULL"), ("relabelled", "'label_hash'"), ("shortened", "'validation_hash'"))
)


@query(f"{_CASES} {_FROZEN}")
def frozen_split(spark: SparkSession, d: str) -> DataFrame:
    """A frozen split held against itself, against a manifest with another label and against one that lacks a row."""
    from plumbline.sources.views import manifest

    base = manifest(spark, d).select("doc_id", "path", "label", "sha256", "source_id", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split"))
    cases = {"same": base, "relabelled": base.withColumn("label", F.when(F.col("doc_id") == 7, "new").otherwise(F.col("label"))), "shortened": base.where("doc_id <> 10")}
    frozen = cut(split.identity(base))
    out = []
    for name, df in cases.items():
        now = cut(split.identity(df))
        out.append(split.first_change(frozen, now, "label_hash", "train_hash", "validation_hash").crossJoin(now).select(F.lit(name).alias("manifest"), "first_change", "train_hash", "validation_hash"))
    return reduce(DataFrame.union, out)


def _by_language(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query(
    """WITH a AS (SELECT doc_id, lang, text FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id = 3 THEN 'xx' ELSE lang END AS lang, text FROM documents),
r AS (SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM a GROUP BY 1), s AS (SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM b GROUP BY 1)
SELECT 1 AS step, 1 AS computed, * FROM r UNION ALL SELECT 2, 1, * FROM r UNION ALL SELECT 3, 2, * FROM s"""
)
def cached_counts(spark: SparkSession, d: str) -> DataFrame:
    """A cached table asked for twice, and again after a row of its input changed."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    changed = docs.withColumn("lang", F.when(F.col("doc_id") == 3, "xx").otherwise(F.col("lang")))
    cache, out = runs.Cache(new_folder(spark)), []
    for step, df in enumerate((docs, docs, changed), 1):
        got = cache.get(spark, {"by": "lang"}, _by_language, df)
        out.append(got.select(F.lit(step).alias("step"), F.lit(cache.computed).alias("computed"), "*"))
    return reduce(DataFrame.union, out)


_PATH = "lang || CASE doc_id % 3 WHEN 1 THEN '-b' WHEN 2 THEN '.c' ELSE '' END || '/' || doc_id || '.txt'"


@query(f"SELECT path, by_part, by_string FROM (SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS by_part, row_number() OVER (ORDER BY path) - 1 AS by_string FROM (SELECT {_PATH} AS path FROM documents)) WHERE by_part <> by_string")
def path_order(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose place by their parts is another than by their characters."""
    k = F.col("doc_id") % 3
    rows = table(spark, d, "documents").select(F.concat("lang", F.when(k == 1, "-b").when(k == 2, ".c").otherwise(""), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    both = sequence.numbered(rows.withColumn("parts", paths.parts(F.col("path"))), "parts", name="by_part").drop("parts").join(sequence.numbered(rows, "path", name="by_string"), "path")
    return both.where("by_part <> by_string")


@query(
    f"""{SCAN}, c AS (SELECT count(*) AS n FROM valid GROUP BY label), g AS (SELECT count(*) AS n FROM valid GROUP BY sha HAVING count(*) > 1)
SELECT (SELECT count(*) FROM scan) AS discovered, (SELECT count(*) FROM valid) AS valid, (SELECT count(*) FROM scan WHERE label IS NOT NULL AND width < 0) AS corrupt,
  (SELECT count(*) FROM scan WHERE label IS NULL) AS label_errors, (SELECT count(*) FROM c) AS classes, (SELECT min(n) FROM c) AS minimum, (SELECT max(n) FROM c) AS maximum,
  (SELECT count(*) FROM g) AS duplicate_groups, CAST((SELECT coalesce(sum(n), 0) FROM g) AS BIGINT) AS duplicate_members, round((SELECT max(n) / min(n) FROM c), 6) AS imbalance"""
)
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    """The audit of a scan that is read once, written to a folder, and its report read again."""
    folder = new_folder(spark)
    sinks.audit_to(scanned(spark, d), folder)
    got = spark.read.option("multiLine", True).json(f"{folder}/audit_report.json")
    return got.select("discovered", "valid", "corrupt", "label_errors", "classes", "minimum", "maximum", "duplicate_groups", "duplicate_members", F.round("imbalance", 6).alias("imbalance"))
