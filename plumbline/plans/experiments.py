"""Queries over runs, histories and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import contracts, joins, runs, sequence
from plumbline.plans.registry import SQL, query
from plumbline.sources.views import HISTORY_SQL, RECEIPTS_SQL, history, receipts, table

R, H = f"WITH {RECEIPTS_SQL}", f"WITH RECURSIVE {HISTORY_SQL}"


@query(f"{R} SELECT run_id, val_macro_f1, val_accuracy, CAST(row_number() OVER (ORDER BY val_macro_f1 DESC, val_accuracy DESC, run_seq) - 1 AS INTEGER) AS model_index FROM receipts")
def rank_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.ranked(receipts(spark, d)).select("run_id", "val_macro_f1", "val_accuracy", "model_index")


BOARD = f"""{R}, board AS (
  SELECT candidate, avg(val_macro_f1) AS mean_macro_f1, stddev_samp(val_macro_f1) AS std_macro_f1, avg(val_accuracy) AS mean_accuracy, count(DISTINCT seed) AS seeds,
    arg_min(parameter_count, (-val_macro_f1, -val_accuracy, run_seq)) AS parameter_count, sum(training_seconds) AS training_seconds FROM receipts GROUP BY candidate
)"""


@query(
    f"{BOARD} SELECT candidate, round(mean_macro_f1, 6) AS mean_macro_f1, round(std_macro_f1, 6) AS std_macro_f1, round(mean_accuracy, 6) AS mean_accuracy, seeds, parameter_count, round(training_seconds, 2) AS training_seconds FROM board"
)
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    b = runs.leaderboard(receipts(spark, d))
    return b.withColumns({**{c: F.round(c, 6) for c in ("mean_macro_f1", "std_macro_f1", "mean_accuracy")}, "training_seconds": F.round("training_seconds", 2)})


_TRIALS = "trials AS (SELECT run_id AS candidate, val_macro_f1 AS value, val_accuracy FROM receipts WHERE status = 'complete')"


@query(
    f"""{R}, {_TRIALS}, top AS (SELECT * FROM trials ORDER BY value DESC, val_accuracy DESC, candidate LIMIT 3)
SELECT candidate, value, val_accuracy FROM top UNION ALL SELECT candidate, value, val_accuracy FROM trials WHERE candidate = (SELECT min(candidate) FROM trials) AND candidate NOT IN (SELECT candidate FROM top)"""
)
def finalists(spark: SparkSession, d: str) -> DataFrame:
    t = runs.by_state(receipts(spark, d).withColumn("state", F.upper("status")), "COMPLETE").select(F.col("run_id").alias("candidate"), F.col("val_macro_f1").alias("value"), "val_accuracy")
    control = t.join(F.broadcast(t.agg(F.min("candidate").alias("candidate"))), "candidate")  # a row
    return runs.finalists(t, 3, control)


@query(f"{BOARD} SELECT run_id, candidate, seed FROM receipts WHERE seed = 2 AND candidate = (SELECT candidate FROM board ORDER BY mean_macro_f1 DESC, mean_accuracy DESC, candidate LIMIT 1)")
def winner_first_seed(spark: SparkSession, d: str) -> DataFrame:
    return runs.winner(receipts(spark, d), [2, 0, 1]).select("run_id", "candidate", "seed")


@query(f"{R} SELECT count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status <> 'complete') AS failed FROM receipts")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    return runs.status_counts(receipts(spark, d))


@query(
    f"""{H} SELECT run_id, best_epoch, val_macro_f1, val_accuracy FROM (SELECT run_id, epoch AS best_epoch, val_macro_f1, val_accuracy,
  row_number() OVER (PARTITION BY run_id ORDER BY val_macro_f1 DESC, val_accuracy DESC, epoch) AS rn FROM history) WHERE rn = 1"""
)
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return runs.best_epochs(history(spark, d))


@query(
    f"""{H}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM history),
walk AS (
  SELECT run_id, i, epoch, val_macro_f1 AS f, val_accuracy AS a, true AS improved, 0 AS stale FROM o WHERE i = 1
  UNION ALL
  SELECT o.run_id, o.i, o.epoch, CASE WHEN b THEN o.val_macro_f1 ELSE w.f END, CASE WHEN b THEN o.val_accuracy ELSE w.a END, b, CASE WHEN b THEN 0 ELSE w.stale + 1 END
  FROM walk w JOIN (SELECT * FROM o) o ON o.run_id = w.run_id AND o.i = w.i + 1, LATERAL (SELECT o.val_macro_f1 > w.f OR (o.val_macro_f1 = w.f AND o.val_accuracy > w.a) AS b)
)
SELECT run_id, epoch, improved, CAST(stale AS BIGINT) AS stale, min(CASE WHEN stale >= 3 THEN epoch END) OVER (PARTITION BY run_id) AS stop_epoch FROM walk"""
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return runs.patience(history(spark, d), 3).select("run_id", "epoch", "improved", F.col("stale").cast("long").alias("stale"), "stop_epoch")


@query(
    f"""{H}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS i FROM history),
walk AS (
  SELECT run_id, CAST(0 AS BIGINT) AS i, 0 AS epoch, -1e308::DOUBLE AS best, 0 AS bad, 0.001::DOUBLE AS lr FROM (SELECT DISTINCT run_id FROM o)
  UNION ALL
  SELECT o.run_id, o.i, o.epoch, CASE WHEN up THEN o.val_macro_f1 ELSE w.best END, CASE WHEN up THEN 0 WHEN w.bad + 1 > 2 THEN 0 ELSE w.bad + 1 END, CASE WHEN NOT up AND w.bad + 1 > 2 THEN w.lr * 0.2 ELSE w.lr END
  FROM walk w JOIN o ON o.run_id = w.run_id AND o.i = w.i + 1, LATERAL (SELECT o.val_macro_f1 > CASE WHEN w.best < 0 THEN w.best ELSE w.best * 1.0001 END AS up)
)
SELECT run_id, epoch, round(lr, 12) AS lr FROM walk WHERE i > 0"""
)
def plateau_lr(spark: SparkSession, d: str) -> DataFrame:
    return runs.plateau(history(spark, d), 0.001).withColumn("lr", F.round("lr", 12))


@query(
    f"""{H}, b AS (SELECT run_id, epoch, max(val_macro_f1) OVER (PARTITION BY run_id ORDER BY epoch) AS best FROM history)
SELECT x.run_id, x.epoch, x.best, round(quantile_cont(y.best, 0.5), 6) AS median, count(*) >= 3 AND x.epoch > 2 AND x.best < quantile_cont(y.best, 0.5) AS pruned
FROM b x JOIN b y ON x.epoch = y.epoch AND x.run_id <> y.run_id GROUP BY x.run_id, x.epoch, x.best"""
)
def median_prune(spark: SparkSession, d: str) -> DataFrame:
    return runs.median_pruned(history(spark, d)).withColumn("median", F.round("median", 6))


@query(f"{H} SELECT run_id, epoch, val_macro_f1, round(val_macro_f1 - lag(val_macro_f1) OVER (PARTITION BY run_id ORDER BY epoch), 6) AS delta FROM history")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    return runs.curve(history(spark, d)).withColumn("delta", F.round("delta", 6))


@query(f"{H} SELECT run_id, epoch, round(train_accuracy - val_accuracy, 6) AS gap FROM history")
def generalisation_gap(spark: SparkSession, d: str) -> DataFrame:
    return runs.gaps(history(spark, d)).select("run_id", "epoch", F.round("gap", 6).alias("gap"))


@query(f"{H}, {RECEIPTS_SQL} SELECT h.run_id, h.epoch, r.candidate, r.seed FROM (SELECT *, CAST(substr(run_id, 5) AS INTEGER) % 5 AS s FROM history) h LEFT JOIN (SELECT seed, min(candidate) AS candidate FROM receipts GROUP BY seed) r ON r.seed = h.s")
def history_enriched(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d).withColumn("seed", (F.substring("run_id", 5, 9).cast("int") % 5).cast("int"))
    r = receipts(spark, d).groupBy("seed").agg(F.min("candidate").alias("candidate"))
    return runs_enriched(h, r)


def runs_enriched(h: DataFrame, r: DataFrame) -> DataFrame:
    return joins.enrich(h, r, "seed").select("run_id", "epoch", "candidate", "seed")


@query(
    f"""{R} SELECT coalesce(a.k, b.k) AS key, a.v AS a, b.v AS b FROM (SELECT candidate AS k, CAST(sum(parameter_count) AS VARCHAR) AS v FROM receipts WHERE seed IN (0, 1, 3) GROUP BY 1) a
FULL OUTER JOIN (SELECT candidate AS k, CAST(sum(parameter_count) AS VARCHAR) AS v FROM receipts WHERE seed IN (1, 2, 4) AND candidate <> 'view' GROUP BY 1) b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v"""
)
def config_diff(spark: SparkSession, d: str) -> DataFrame:
    r = receipts(spark, d)
    side = lambda where: r.where(where).groupBy(F.col("candidate").alias("key")).agg(F.sum("parameter_count").cast("string").alias("value"))
    return contracts.config_diff(side("seed in (0, 1, 3)"), side("seed in (1, 2, 4) and candidate <> 'view'"))


@query(f"{R} SELECT 'seed' AS \"column\", count(DISTINCT seed) AS n_values, count(DISTINCT seed) = 1 AS ok FROM receipts UNION ALL SELECT 'status', count(DISTINCT status), count(DISTINCT status) = 1 FROM receipts")
def protocol_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    return contracts.same_values(receipts(spark, d), "seed", "status")


@query("SELECT c_custkey, CAST((i - 1) // 7 + 1 AS INTEGER) AS round, CAST((i - 1) % 7 + 1 AS INTEGER) AS member, CAST(i AS INTEGER) AS job FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer)")
def job_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Customers given to a team of seven in turn, those with the largest balance first."""
    rows = table(spark, d, "customer").select("c_custkey", (-F.col("c_acctbal")).alias("o"))
    return sequence.allocated(rows, 7, "o", "c_custkey").drop("o")


@query(
    """WITH j AS (SELECT 0 AS gaps, row_number() OVER (ORDER BY c_custkey) AS job, count(*) OVER () AS total FROM customer UNION ALL
  SELECT 1, CASE WHEN i = 7 THEN 8 ELSE i END, total FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS i, count(*) OVER () AS total FROM customer) WHERE i <> 41)
SELECT gaps, count(*) AS n, count(DISTINCT job) AS distinct_jobs, CAST(min(job) AS INTEGER) AS lo, CAST(max(job) AS INTEGER) AS hi, count(*) = any_value(total) AND count(DISTINCT job) = any_value(total) AND min(job) = 1 AND max(job) = any_value(total) AS ok FROM j GROUP BY gaps"""
)
def job_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A whole allocation, and one in which a job is given twice and one to nobody."""
    customers = table(spark, d, "customer").select("c_custkey")
    whole, total = sequence.allocated(customers, 6, "c_custkey"), customers.count()
    holes = whole.where("job <> 41").withColumn("job", F.when(F.col("job") == 7, 8).otherwise(F.col("job")))
    out = [sequence.job_coverage(x, total).select(F.lit(i).alias("gaps"), "*") for i, x in enumerate((whole, holes))]
    return out[0].union(out[1])


_RULES = [("SKIP", ["Brand#11", "Brand#12"], "own study"), ("LATER", ["Brand#21", "Brand#12"], "cost")]


@query(
    """SELECT family, CASE WHEN h IS NOT NULL THEN 'RUN' WHEN family IN ('Brand#11', 'Brand#12') THEN 'SKIP' WHEN family = 'Brand#21' THEN 'LATER' ELSE 'LATER' END AS decision,
  CASE WHEN h IS NOT NULL THEN h WHEN family IN ('Brand#11', 'Brand#12') THEN 'own study' WHEN family = 'Brand#21' THEN 'cost' ELSE 'represented' END AS reason
FROM (SELECT DISTINCT p_brand AS family FROM part) LEFT JOIN (SELECT p_brand AS family, min(p_type) AS h FROM part WHERE p_size > 48 GROUP BY 1) USING (family)"""
)
def coverage_decision(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    selected = part.where("p_size > 48").groupBy(F.col("p_brand").alias("family")).agg(F.min("p_type").alias("hypothesis"))
    return joins.decisions(part.select(F.col("p_brand").alias("family")).distinct(), selected, _RULES)


@query(f"{R} SELECT run_id, 'candidate' AS name, candidate AS value FROM receipts UNION ALL SELECT run_id, 'seed', CAST(seed AS VARCHAR) FROM receipts UNION ALL SELECT run_id, 'status', status FROM receipts")
def receipt_key_values(spark: SparkSession, d: str) -> DataFrame:
    return runs.key_values(receipts(spark, d).select("run_id", "candidate", "seed", "status"), "run_id")


@query("SELECT p_mfgr AS family, p_name AS label FROM (SELECT p_brand AS p_mfgr, min(p_name) AS p_name FROM part GROUP BY 1)")
def map_override(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    own = part.where("p_size < 25").groupBy("p_brand").agg(F.min("p_name").alias("label"))
    every = part.groupBy("p_brand").agg(F.min("p_name").alias("label"))
    return joins.override(own, every, "p_brand", "label", part.select(F.col("p_name").alias("label"))).select(F.col("p_brand").alias("family"), "label")


@query(
    """SELECT epoch, round(sum(l * n) / sum(n), 6) AS loss, round(sum(c) / sum(n), 6) AS accuracy, CAST(0 AS BIGINT) AS not_finite
FROM (SELECT CAST(user_id % 9 AS INTEGER) AS epoch, value AS l, event_id % 32 + 1 AS n, event_id % 7 % (event_id % 32 + 1) AS c FROM events) GROUP BY epoch"""
)
def epoch_means(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.operators import metrics

    e = table(spark, d, "events").select((F.col("user_id") % 9).cast("int").alias("epoch"), F.col("value").alias("loss"), F.expr("event_id % 32 + 1").alias("n"), F.expr("event_id % 7 % (event_id % 32 + 1)").alias("correct"))
    return metrics.batch_means(e).withColumns({"loss": F.round("loss", 6), "accuracy": F.round("accuracy", 6)})


_DECIDED = SQL["coverage_decision"]


@query(f"SELECT decision, count(*) AS n FROM ({_DECIDED}) GROUP BY 1")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return coverage_decision(spark, d).groupBy("decision").agg(F.count("*").alias("n"))


@query(
    f"""{R}, f AS (SELECT DISTINCT candidate AS family FROM receipts), c AS (SELECT DISTINCT candidate AS family FROM receipts WHERE status = 'complete')
SELECT (SELECT string_agg(family, ',' ORDER BY family) FROM f) AS assigned, (SELECT coalesce(string_agg(family, ',' ORDER BY family), '') FROM c) AS completed,
  (SELECT count(*) FROM f) = (SELECT count(*) FROM c) AS complete, (SELECT coalesce(string_agg(run_id, ',' ORDER BY run_id), '') FROM receipts WHERE status <> 'complete') AS failed_runs"""
)
def handoff(spark: SparkSession, d: str) -> DataFrame:
    r = receipts(spark, d).withColumn("family", F.col("candidate"))
    h = runs.handoff(r, r.select("family"))
    return h.select(*[F.array_join(c, ",").alias(c) for c in ("assigned", "completed", "failed_runs")], "complete")


@query("SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def last_status(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return runs.last_status(e).withColumnRenamed("run_id", "user_id")


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return joins.ordered_distinct(table(spark, d, "events"), "event_type", "event_id")


@query(
    f"""{R}, c AS (SELECT run_id, CASE seed WHEN 0 THEN 'h0' ELSE 'h1' END AS split_hash, candidate AS phase FROM receipts UNION ALL SELECT 'a/b', 'h0', 'x' UNION ALL SELECT 'a/b', 'h0', 'x')
SELECT 1 AS ord, 'one_split_and_phase' AS "check", CAST(2 AS BIGINT) AS violations UNION ALL SELECT 2, 'unique_run_ids', (SELECT count(*) FROM (SELECT run_id FROM c GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 3, 'run_id_names', (SELECT count(*) FROM c WHERE contains(run_id, '/'))"""
)
def comparable_runs(spark: SparkSession, d: str) -> DataFrame:
    r = receipts(spark, d).select("run_id", F.when(F.col("seed") == 0, "h0").otherwise("h1").alias("split_hash"), F.col("candidate").alias("phase"))
    bad = spark.createDataFrame([("a/b", "h0", "x")] * 2, r.schema)
    return contracts.comparable_runs(r.union(bad)).select("ord", "check", "violations")


@query(
    """WITH g AS (SELECT c.event_type AS candidate, s.seed, a.augment FROM (SELECT DISTINCT event_type FROM events) c, (SELECT DISTINCT CAST(user_id % 5 AS INTEGER) AS seed FROM events) s, (VALUES ('no'), ('yes')) a(augment))
SELECT candidate, seed, augment, CAST(row_number() OVER (ORDER BY md5('42|' || candidate || '|' || seed || '|' || augment)) - 1 AS INTEGER) AS number FROM g"""
)
def search_space(spark: SparkSession, d: str) -> DataFrame:
    """The grid of the candidates and seeds that events name, in a seeded order."""
    from plumbline.operators import scoring

    e = table(spark, d, "events")
    seen = e.agg(F.collect_set("event_type").alias("candidate"), F.collect_set((F.col("user_id") % 5).cast("int")).alias("seed")).first()
    return scoring.search_space(spark, {"candidate": sorted(seen.candidate), "seed": sorted(seen.seed), "augment": ["no", "yes"]}).withColumn("seed", F.col("seed").cast("int"))
