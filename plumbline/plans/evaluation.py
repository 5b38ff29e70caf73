"""Queries over predictions: scoring, metrics, error analysis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import values
from plumbline.operators import audit, contracts, inference, joins, metrics, scoring, training
from plumbline.plans.registry import query
from plumbline.runtime import cut
from plumbline.sources.views import table, vectors

V = """vec AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding AS v, CASE WHEN vec_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM embeddings),
cen AS (SELECT label, i, avg(CAST(v[i] AS DOUBLE)) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vec WHERE split = 'train') GROUP BY label, i),
item AS (SELECT vec_id, label, i, CAST(v[i] AS DOUBLE) AS y FROM (SELECT vec_id, label, v, unnest(range(1, len(v) + 1)) AS i FROM vec WHERE split = 'validation')),
logit AS (SELECT vec_id, item.label AS true_label, cen.label AS predicted_label, sum(x * y) AS logit FROM item JOIN cen USING (i) GROUP BY 1, 2, 3),
prob AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM logit)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, predicted_label) AS rk FROM prob),
pred AS (SELECT 'v' || CAST(vec_id AS VARCHAR) AS path, vec_id, true_label, predicted_label, round(prob, 6) AS confidence FROM ranked WHERE rk = 1),
labs AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT label FROM vec))"""
W = f"WITH {V}"


def _scored(spark: SparkSession, d: str, distance: str = "dot") -> DataFrame:
    """Validation vectors with the logits of all labels."""
    v = vectors(spark, d)
    scorer = scoring.CentroidScorer(v.where("split = 'train'"), distance)
    return scorer.logits(v.where("split = 'validation'").select("vec_id", F.col("label").alias("true_label"), "v"))


def predictions(spark: SparkSession, d: str, distance: str = "dot") -> DataFrame:
    """(path, vec_id, true_label, predicted_label, confidence) of the nearest centroid on validation vectors."""
    p = scoring.prediction_of(_scored(spark, d, distance))
    return p.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("path"), "vec_id", "true_label", "predicted_label", F.round("confidence", 6).alias("confidence"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return audit.label_index(vectors(spark, d))


@query(f"{W} SELECT path, true_label, predicted_label, confidence FROM pred")
def centroid_predict(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select("path", "true_label", "predicted_label", "confidence")


@query(
    f"""{W} SELECT vec_id, max(CASE WHEN rk = 1 THEN predicted_label END) AS prediction, round(max(CASE WHEN rk = 1 THEN prob END), 6) AS confidence,
  round(max(CASE WHEN rk = 1 THEN prob END) - max(CASE WHEN rk = 2 THEN prob END), 6) AS margin, max(CASE WHEN rk = 2 THEN predicted_label END) AS top2_label,
  round(max(CASE WHEN rk = 2 THEN prob END), 6) AS top2_confidence, max(CASE WHEN rk = 3 THEN predicted_label END) AS top3_label, round(max(CASE WHEN rk = 3 THEN prob END), 6) AS top3_confidence
FROM ranked GROUP BY vec_id"""
)
def csv_flatten_topk(spark: SparkSession, d: str) -> DataFrame:
    flat = scoring.flatten_top_k(scoring.top_of(_scored(spark, d), "vec_id", 3), "vec_id")
    return flat.withColumns({c: F.round(c, 6) for c in ("confidence", "margin", "top2_confidence", "top3_confidence")})


@query(f"{W} SELECT vec_id, string_agg(predicted_label, ',' ORDER BY rk) AS labels, count(*) AS k FROM ranked WHERE rk <= 5 GROUP BY vec_id")
def topk_predictions(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.top_of(_scored(spark, d), "vec_id", 5)
    return t.select("vec_id", F.array_join("top_k.label", ",").alias("labels"), F.size("top_k").cast("long").alias("k"))


@query(f"{W} SELECT CASE WHEN confidence < 0.12 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS status, count(*) AS n FROM pred GROUP BY 1")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_status(predictions(spark, d), 0.12).groupBy("status").agg(F.count("*").alias("n"))


_VIEWS = f"""{W}, va AS (
  SELECT vec_id, unnest([0, 1, 2, 3, 4]) AS view, v FROM vec WHERE split = 'validation'
), vi AS (
  SELECT vec_id, view, i, CASE view WHEN 0 THEN CAST(v[i] AS DOUBLE) WHEN 1 THEN CAST(v[i] AS DOUBLE) * 1.03 WHEN 2 THEN CAST(v[i] AS DOUBLE) * 0.97
    WHEN 3 THEN CAST(v[CASE WHEN i = len(v) THEN 1 ELSE i + 1 END] AS DOUBLE) ELSE CAST(v[CASE WHEN i = 1 THEN len(v) ELSE i - 1 END] AS DOUBLE) END AS y
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM va)
), vl AS (SELECT vec_id, view, label AS predicted_label, sum(x * y) AS logit FROM vi JOIN cen USING (i) GROUP BY 1, 2, 3
), vp AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, view) AS prob FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id, view)) AS e FROM vl))
SELECT vec_id, predicted_label, round(avg(prob), 6) AS prob FROM vp GROUP BY 1, 2"""


@query(_VIEWS)
def tta_mean(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    scorer = scoring.CentroidScorer(v.where("split = 'train'"))
    scored = scorer.logits(scoring.views(v.where("split = 'validation'").select("vec_id", "v"), "vec_id"))
    probs = scored.select("vec_id", "view", F.explode(scoring.ranked(F.col("logits"))).alias("x")).select("vec_id", "view", F.col("x.label").alias("predicted_label"), (-F.col("x.n")).alias("prob"))
    p = scoring.mean_views(probs, "vec_id")
    return p.withColumn("prob", F.round("prob", 6))


@query(f"{W} SELECT a.label AS true_label, b.label AS predicted_label, (SELECT count(*) FROM pred WHERE true_label = a.label AND predicted_label = b.label) AS n FROM labs a CROSS JOIN labs b")
def confusion_long(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(predictions(spark, d), _labels(spark, d))


@query(f"{W} SELECT a.label AS true_label, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b.idx) AS counts FROM labs a CROSS JOIN labs b LEFT JOIN (SELECT true_label AS t, predicted_label AS p, count(*) AS n FROM pred GROUP BY 1, 2) ON t = a.label AND p = b.label GROUP BY 1")
def confusion_wide(spark: SparkSession, d: str) -> DataFrame:
    wide = metrics.confusion_wide(predictions(spark, d), _labels(spark, d))
    return wide.select("true_label", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


REPORT = f"""{W}, s AS (
  SELECT idx, label, (SELECT count(*) FROM pred WHERE true_label = label) AS support, (SELECT count(*) FROM pred WHERE predicted_label = label) AS predicted,
    (SELECT count(*) FROM pred WHERE predicted_label = label AND true_label = label) AS tp FROM labs
), report AS (
  SELECT idx, label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r,
    CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2.0 * tp / (support + predicted) END AS f, support FROM s
)"""


@query(f"{REPORT} SELECT idx, label, round(CAST(p AS DOUBLE), 6) AS precision, round(CAST(r AS DOUBLE), 6) AS recall, round(CAST(f AS DOUBLE), 6) AS f1, support FROM report")
def per_class_report(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.per_class(predictions(spark, d), _labels(spark, d))
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    f"""{REPORT} SELECT round((SELECT avg(CAST(true_label = predicted_label AS INT)) FROM pred), 6) AS accuracy, (SELECT count(*) FROM pred) AS n, round(avg(CAST(p AS DOUBLE)), 6) AS macro_precision,
  round(avg(CAST(r AS DOUBLE)), 6) AS macro_recall, round(avg(CAST(f AS DOUBLE)), 6) AS macro_f1, round(min(CAST(r AS DOUBLE)), 6) AS minimum_per_class_recall FROM report"""
)
def macro_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.macro(predictions(spark, d), _labels(spark, d))
    return m.withColumns({c: F.round(c, 6) for c in m.columns if c != "n"})


@query(f"{W} SELECT round(avg(r), 6) AS macro_recall, count(*) AS classes FROM (SELECT avg(CAST(true_label = predicted_label AS INT)) AS r FROM pred GROUP BY true_label)")
def macro_recall_present(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_recall_present(predictions(spark, d)).withColumn("macro_recall", F.round("macro_recall", 6))


def _by(key: str, name: str) -> str:
    return f"{W} SELECT {key} AS {name}, count(*) AS support, CAST(sum(CAST(true_label = predicted_label AS INT)) AS BIGINT) AS correct, round(avg(CAST(true_label = predicted_label AS INT)), 6) AS recall FROM pred GROUP BY 1"


@query(_by("CAST(vec_id % 7 AS INTEGER)", "writer_id"))
def writer_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_by(predictions(spark, d).withColumn("writer_id", (F.col("vec_id") % 7).cast("int")), "writer_id").withColumn("recall", F.round("recall", 6))


@query(_by("true_label", "true_label"))
def worst_classes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.recall_by(predictions(spark, d), "true_label").withColumn("recall", F.round("recall", 6))


@query(f"{W} SELECT true_label, predicted_label, count(*) AS n FROM pred WHERE true_label <> predicted_label GROUP BY 1, 2")
def confusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_pairs(predictions(spark, d))


@query(
    f"""{W} SELECT least(true_label, predicted_label) AS label_a, greatest(true_label, predicted_label) AS label_b, count(*) FILTER (true_label < predicted_label) AS a_to_b,
  count(*) FILTER (true_label > predicted_label) AS b_to_a, count(*) AS total FROM pred WHERE true_label <> predicted_label GROUP BY 1, 2"""
)
def confusion_pairs_bidir(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion_pairs_both(predictions(spark, d))


@query(f"{W} SELECT path, true_label, predicted_label, confidence FROM pred WHERE true_label <> predicted_label ORDER BY confidence DESC, path LIMIT 20")
def confident_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confident_errors(predictions(spark, d)).select("path", "true_label", "predicted_label", "confidence")


@query(f"{W} SELECT path, true_label, predicted_label, confidence FROM pred ORDER BY confidence, path LIMIT 20")
def unsure_rows(spark: SparkSession, d: str) -> DataFrame:
    return metrics.unsure(predictions(spark, d)).select("path", "true_label", "predicted_label", "confidence")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 25")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return metrics.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25)


@query(f"{W} SELECT CASE WHEN vec_id % 3 = 0 THEN 'unknown' WHEN true_label = predicted_label THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM pred GROUP BY 1")
def outcomes(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return p.groupBy(values.outcome(F.when(F.col("vec_id") % 3 != 0, F.col("true_label")), F.col("predicted_label")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"{W} SELECT path, true_label AS label, predicted_label AS prediction, true_label = predicted_label AS correct, confidence FROM pred")
def suffix_join_score(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    truth = p.select("path", F.col("true_label").alias("label"))
    found = p.select(F.concat(F.lit("/tmp/x/"), "path").alias("path"), F.col("predicted_label").alias("prediction"), "confidence")
    return joins.score_predictions(truth, found).select("path", "label", "prediction", "correct", "confidence")


@query(
    f"""{W}, rows AS (SELECT vec_id, count(*) - CASE WHEN vec_id % 7 = 3 THEN 1 ELSE 0 END AS n, vec_id % 7 = 5 AS negative FROM prob GROUP BY vec_id)
SELECT 1 AS ord, 'classes' AS "check", count(*) FILTER (n <> 10) AS violations FROM rows UNION ALL SELECT 2, 'negative', count(*) FILTER (negative) FROM rows
UNION ALL SELECT 3, 'sum', (SELECT count(*) FROM (SELECT vec_id, max(prob) FILTER (rk = 1) AS p, min(prob) AS q FROM ranked GROUP BY 1) WHERE vec_id % 7 = 3 AND q > 1e-5 OR vec_id % 7 = 5 AND 2 * p > 1e-5)"""
)
def probability_contract(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh row lacks its least likely label, another seventh has a likeliest one of negative probability."""
    p = _scored(spark, d).select("vec_id", F.transform(scoring.ranked(F.col("logits")), lambda x: -x["n"]).alias("p"))
    short, negative = F.slice("p", F.lit(1), F.size("p") - 1), F.transform("p", lambda x, i: F.when(i == 0, -x).otherwise(x))
    p = p.withColumn("p", F.when(F.col("vec_id") % 7 == 3, short).when(F.col("vec_id") % 7 == 5, negative).otherwise(F.col("p")))
    return contracts.probability_contract(p, "p", 10).select("ord", "check", "violations")


@query(f"{W} SELECT count(*) FILTER ((vec_id % 7 = 1) <> (vec_id % 11 = 2)) AS unmatched, count(*) FILTER (vec_id % 7 <> 1 AND vec_id % 11 <> 2 AND vec_id % 3 = 0) AS mismatches FROM pred")
def reload_parity(spark: SparkSession, d: str) -> DataFrame:
    """Some rows are gone from the first, some from the second, which has another label in a third of its rows."""
    p = predictions(spark, d)
    again = p.where("vec_id % 7 <> 1").withColumn("predicted_label", F.when(F.col("vec_id") % 3 == 0, "none").otherwise(F.col("predicted_label")))
    return contracts.reload_parity(p.where("vec_id % 11 <> 2"), again)


@query(
    f"""{W}, dist AS (
  SELECT vec_id, cen.label AS predicted_label, sqrt(sum((x - y) * (x - y))) AS e, sum(abs(x - y)) AS m FROM item JOIN cen USING (i) GROUP BY 1, 2
), b AS (
  SELECT vec_id, arg_min(predicted_label, (e, predicted_label)) AS by_euclidean, arg_min(predicted_label, (m, predicted_label)) AS by_manhattan FROM dist GROUP BY 1
) SELECT path, predicted_label AS by_dot, by_euclidean, by_manhattan FROM pred JOIN b USING (vec_id)"""
)
def model_compare_same_rows(spark: SparkSession, d: str) -> DataFrame:
    out = predictions(spark, d).select("path", F.col("predicted_label").alias("by_dot"))
    for name in ("euclidean", "manhattan"):
        out = joins.one_to_one(out, predictions(spark, d, name).select("path", F.col("predicted_label").alias(f"by_{name}")), "path")
    return out


@query(
    """WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(sum(x[i] * CAST(y[i] AS DOUBLE)), 5) AS dot, round(sqrt(sum((CAST(x[i] AS DOUBLE) - y[i]) ** 2)), 5) AS euclidean, round(sum(abs(CAST(x[i] AS DOUBLE) - y[i])), 5) AS manhattan
FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM p) GROUP BY vec_id"""
)
def vector_distance(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return p.select("vec_id", *[F.round(f("x", "y"), 5).alias(n) for n, f in (("dot", lambda a, b: values.dot(F.col(a), F.col(b))), ("euclidean", lambda a, b: values.euclidean(F.col(a), F.col(b))), ("manhattan", lambda a, b: values.manhattan(F.col(a), F.col(b))))])


_SPOILT = """bad AS (SELECT vec_id, CASE WHEN vec_id % 13 = 5 THEN 'no vector' WHEN vec_id % 11 = 3 THEN 'length 63, not 64' WHEN vec_id % 17 = 2 THEN 'a component is null or not finite' END AS error FROM embeddings)"""


@query(
    f"""{W.replace("validation' ELSE 'train' END AS split FROM embeddings)", "validation' ELSE 'train' END AS split FROM embeddings), allv AS (SELECT vec_id, i, CAST(v[i] AS DOUBLE) AS y FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM vec))")}, {_SPOILT},
al AS (SELECT vec_id, cen.label AS predicted_label, sum(x * y) AS logit FROM allv JOIN cen USING (i) GROUP BY 1, 2),
ap AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS prob FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM al)),
ar AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, predicted_label) AS rk FROM ap),
one AS (SELECT vec_id, max(predicted_label) FILTER (rk = 1) AS prediction, max(prob) FILTER (rk = 1) AS p1, max(prob) FILTER (rk = 2) AS p2, max(predicted_label) FILTER (rk = 2) AS top2_label FROM ar GROUP BY 1)
SELECT vec_id, CASE WHEN error IS NULL THEN prediction END AS prediction, CASE WHEN error IS NULL THEN round(p1, 6) END AS confidence, CASE WHEN error IS NULL THEN round(p1 - p2, 6) END AS margin,
  CASE WHEN error IS NULL THEN top2_label END AS top2_label, error, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN p1 < 0.12 THEN 'LOW_CONFIDENCE' ELSE 'OK' END AS status FROM one JOIN bad USING (vec_id)"""
)
def batch_predict(spark: SparkSession, d: str) -> DataFrame:
    """All vectors by a linear model in batches; some are missing, some too short, some hold a number that is none."""
    v, k = vectors(spark, d), F.col("vec_id")
    weights = {r.label: r.centroid for r in scoring.CentroidScorer(v.where("split = 'train'")).centroids.collect()}  # a row for each label
    labels = sorted(weights)
    model = inference.linear(np.array([weights[x] for x in labels]), np.zeros(len(labels)))
    spoilt = F.transform("v", lambda x, i: F.when(i == 7, float("nan")).otherwise(x))
    items = v.select("vec_id", F.when(k % 13 == 5, None).when(k % 11 == 3, F.slice("v", 1, 63)).when(k % 17 == 2, spoilt).otherwise(F.col("v")).alias("v"))
    out = inference.BatchScorer(model, labels, 64).results(items, "vec_id", 0.12)
    return out.select("vec_id", "prediction", *[F.round(c, 6).alias(c) for c in ("confidence", "margin")], "top2_label", "error", "status")


def _rounds(n: int) -> str:
    """SQL of so many rounds of gradient descent of a softmax regression, from zero weights; i = 65 is the bias."""
    out = [
        """vec AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, embedding AS v, vec_id % 5 = 0 AS val FROM embeddings),
x AS (SELECT vec_id, i, CASE WHEN i = 65 THEN 1.0 ELSE CAST(v[i] AS DOUBLE) END AS x FROM (SELECT vec_id, v, unnest(range(1, 66)) AS i FROM vec)),
lab AS (SELECT DISTINCT label AS c FROM vec), num AS (SELECT count(*) AS n FROM vec WHERE NOT val), w0 AS (SELECT c, i, 0.0::DOUBLE AS w FROM lab, (SELECT unnest(range(1, 66)) AS i))"""
    ]
    for r in range(n):
        out += [
            f"z{r} AS (SELECT vec_id, c, sum(x * w) AS z FROM x JOIN w{r} USING (i) GROUP BY 1, 2)",
            f"p{r} AS (SELECT vec_id, c, label, val, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, c) AS rk FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z{r}) JOIN vec USING (vec_id))",
        ]
        if r < n - 1:
            out.append(f"w{r + 1} AS (SELECT c, i, w - 2.0 / (SELECT n FROM num) * g AS w FROM w{r} JOIN (SELECT c, i, sum((p - CASE WHEN c = label THEN 1 ELSE 0 END) * x) AS g FROM p{r} JOIN x USING (vec_id) WHERE NOT val GROUP BY 1, 2) USING (c, i))")
    each = [
        f"SELECT {r} AS epoch, round((SELECT avg(-ln(p)) FROM p{r - 1} WHERE NOT val AND c = label), 6) AS train_loss, round((SELECT avg(CAST(c = label AS INT)) FROM p{r - 1} WHERE NOT val AND rk = 1), 6) AS train_accuracy, "
        f"round((SELECT avg(-ln(p)) FROM p{r} WHERE val AND c = label), 6) AS val_loss, round((SELECT avg(CAST(c = label AS INT)) FROM p{r} WHERE val AND rk = 1), 6) AS val_accuracy"
        for r in range(1, n)
    ]
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(each)


@query(_rounds(4))
def training_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of softmax regression, the loss and accuracy of each."""
    v = cut(vectors(spark, d))
    found = training.fit(v.where("split = 'train'"), v.where("split = 'validation'"), epochs=3, lr=2.0)
    return found.frame(spark).select("epoch", *[F.round(c, 6).alias(c) for c in ("train_loss", "train_accuracy", "val_loss", "val_accuracy")])


@query()
def logistic_predict(spark: SparkSession, d: str) -> DataFrame:
    """(path, predicted_label) of a logistic model; a fitted model, so without SQL."""
    v = vectors(spark, d)
    scorer = scoring.LogisticScorer(v.where("split = 'train'"), maxIter=20, regParam=0.01)
    scored = scoring.prediction_of(scorer.logits(v.where("split = 'validation'").select("vec_id", "v")))
    return scored.select("vec_id", "predicted_label", F.round("confidence", 4).alias("confidence"))
