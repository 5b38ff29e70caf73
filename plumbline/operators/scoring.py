"""Batch scoring: scorers, top-k, views, thresholds."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import values
from plumbline.runtime import cut

#: Numbers of centroids that are held in one row; parts that the items of a block of centroids are dealt in.
MOST_NUMBERS, SALTS = 5_000_000, 64


class Scorer(Protocol):
    """Anything that gives items with `logits` array<struct<predicted_label,logit>>: the place where a trained network plugs in."""

    def logits(self, items: DataFrame) -> DataFrame: ...


def scores(scorer: Scorer, items: DataFrame) -> DataFrame:
    """(items' columns but v, predicted_label, logit), a row for each label."""
    out = scorer.logits(items).withColumn("z", F.explode("logits"))
    return out.select(*[c for c in items.columns if c != "v"], "z.predicted_label", "z.logit")


class CentroidScorer:
    """The mean vector of each label; the logit is the dot product, the negative distance otherwise."""

    def __init__(self, train: DataFrame, distance: str = "dot"):
        self.distance = {"dot": values.dot, "euclidean": lambda a, b: -values.euclidean(a, b), "manhattan": lambda a, b: -values.manhattan(a, b)}[distance]
        e = train.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
        self.centroids = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))

    def logits(self, items: DataFrame) -> DataFrame:
        """items with logits, in the order of the labels. Centroids of up to MOST_NUMBERS numbers are one row that every task
        gets; more are cut into blocks of so many, which meet the items in a shuffle by block and salt."""
        size = self.centroids.agg(F.coalesce(F.sum(F.size("centroid")), F.lit(0))).first()[0]
        if size <= MOST_NUMBERS:
            every = self.centroids.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("__centroids"))
            return items.join(F.broadcast(every)).withColumn("logits", self._scored()).drop("__centroids")
        blocks = -(-size // MOST_NUMBERS)
        block = F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("__block")
        every = self.centroids.groupBy(block).agg(F.collect_list(F.struct("label", "centroid")).alias("__centroids"))
        every = every.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        rows = cut(items.withColumn("__row", F.monotonically_increasing_id()))  # written, so that the numbers stay
        wide = rows.withColumns({"__block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "__salt": F.pmod("__row", F.lit(SALTS))})
        parts = wide.join(every.hint("shuffle_hash"), ["__block", "__salt"]).select("__row", F.explode(self._scored()).alias("z"))
        logits = parts.groupBy("__row").agg(F.array_sort(F.collect_list("z")).alias("logits"))
        return rows.join(logits, "__row", "left").drop("__row")

    def _scored(self) -> Column:
        return F.transform("__centroids", lambda c: F.struct(c["label"].alias("predicted_label"), self.distance(F.col("v"), c["centroid"]).alias("logit")))


class LogisticScorer:
    """Multinomial logistic regression, fitted on the executors; logits are the model's raw scores."""

    def __init__(self, train: DataFrame, **settings):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import StringIndexer
        from pyspark.ml.functions import array_to_vector

        self.index = StringIndexer(inputCol="label", outputCol="idx", stringOrderType="alphabetAsc").fit(train)
        rows = self.index.transform(train.withColumn("features", array_to_vector("v")))
        self.model = LogisticRegression(labelCol="idx", featuresCol="features", family="multinomial", **settings).fit(rows)

    def logits(self, items: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        raw = self.model.transform(items.withColumn("features", array_to_vector("v"))).withColumn("raw", vector_to_array("rawPrediction"))
        names = F.array(*map(F.lit, self.index.labels))
        return raw.select(*items.columns, F.zip_with(names, "raw", lambda n, x: F.struct(n.alias("predicted_label"), x.alias("logit"))).alias("logits"))


def ranked(logits: Column) -> Column:
    """array<struct<n,label>> of an array of logits: the softmax, negative, from the likeliest label, ties by label."""
    return F.array_sort(_negatives(logits))


def _negatives(logits: Column) -> Column:
    """ranked() without an order. The logits are used in one place, so that they are computed once a row."""

    def of(z: Column) -> Column:
        probs = values.softmax(F.transform(z, lambda x: x["logit"]))
        return F.zip_with(probs, z, lambda p, x: F.struct((-p).alias("n"), x["predicted_label"].alias("label")))

    return values.let(logits, of)


def top_of(scored: DataFrame, key: str, k: int = 3) -> DataFrame:
    """top_k() of items with logits, row by row."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    return _topped(scored.select(key, F.explode(F.array(ranked(F.col("logits")))).alias("s")), key, k)


def _topped(lists: DataFrame, key: str, k: int) -> DataFrame:
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    top = F.transform(F.slice("s", 1, k), lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("confidence")))
    margin = (second["n"] - first["n"]) if k > 1 else F.lit(None).cast("double")
    return lists.select(key, top.alias("top_k"), margin.alias("margin"))


def probabilities(scores: DataFrame, key: str) -> DataFrame:
    """scores with `prob`, the softmax of logit over the labels of a key."""
    w = Window.partitionBy(key)
    e = F.exp(F.col("logit") - F.max("logit").over(w))
    return scores.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(w)).drop("e")


def top_k(probs: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, top_k array<struct<label,confidence>>, margin): the k likeliest labels of rows (key, predicted_label, prob),
    ties by label; at most as many as there are. margin is null with one label. Never more than the k best of a key
    and of a part of the rows are held."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("prob").desc(), "predicted_label"))
    best = probs.withColumn("rank", rank).where(F.col("rank") <= max(k, 2))  # a limit that each task applies before the shuffle
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("prob")).alias("n"), F.col("predicted_label").alias("label")))).alias("s"))
    return _topped(lists, key, k)


def prediction_of(scored: DataFrame) -> DataFrame:
    """Items with logits, less v and these, with predicted_label and confidence: the likeliest label, ties by label.

    The best label comes out of a generator, below which a filter on it isn't pushed: that would compute the logits twice.
    """
    own = [c for c in scored.columns if c not in ("v", "logits")]
    out = scored.select(*own, F.explode(F.array(F.array_min(_negatives(F.col("logits"))))).alias("s"))
    return out.select(*own, F.col("s.label").alias("predicted_label"), (-F.col("s.n")).alias("confidence"))


def predict(probs: DataFrame, key: str) -> DataFrame:
    """(key, predicted_label, confidence): the likeliest label, ties by label."""
    best = F.min(F.struct((-F.col("prob")).alias("n"), F.col("predicted_label").alias("label")))
    return probs.groupBy(key).agg(best.alias("b")).select(key, F.col("b.label").alias("predicted_label"), (-F.col("b.n")).alias("confidence"))


def mean_views(probs: DataFrame, key: str) -> DataFrame:
    """(key, predicted_label, prob): the mean probability over views (key, view, predicted_label, prob)."""
    return probs.groupBy(key, "predicted_label").agg(F.avg("prob").alias("prob"))


def views(vectors: DataFrame, key: str) -> DataFrame:
    """Five fixed views of a vector: as it is, scaled by 3 % up and down, shifted by one place each way."""
    turned = [F.col("v"), F.transform("v", lambda x: x * 1.03), F.transform("v", lambda x: x * 0.97), F.concat(F.slice("v", 2, 1 << 20), F.slice("v", 1, 1)), F.concat(F.slice("v", -1, 1), F.slice("v", F.lit(1), F.size("v") - 1))]
    return vectors.select(*[c for c in vectors.columns if c != "v"], F.posexplode(F.array(*turned)).alias("view", "v"))


def flatten_top_k(results: DataFrame, key: str) -> DataFrame:
    """The result table: prediction, confidence, margin, and the second and third label, null where there are fewer."""
    at = lambda i, f: F.get("top_k", F.lit(i))[f]
    return results.select(key, at(0, "label").alias("prediction"), at(0, "confidence").alias("confidence"), "margin", at(1, "label").alias("top2_label"), at(1, "confidence").alias("top2_confidence"), at(2, "label").alias("top3_label"), at(2, "confidence").alias("top3_confidence"))


def with_status(results: DataFrame, threshold: float, error: Column | None = None) -> DataFrame:
    return results.withColumn("status", values.status(F.col("confidence"), threshold, error))


def crops(pages: DataFrame, boxes: str = "boxes") -> DataFrame:
    """A row for each box of a page, for a scorer: one image becomes several items."""
    return pages.select("*", F.posexplode(boxes).alias("box_id", "box")).drop(boxes)


def search_space(spark, grid: dict[str, list], trials: int | None = None, seed: int = 42) -> DataFrame:
    """Configurations of a grid with their number, or `trials` of them by a seeded hash. Grids are small."""
    out = spark.range(1).drop("id")
    for name, options in grid.items():
        out = out.crossJoin(spark.createDataFrame([(o,) for o in options], [name]))
    order = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in grid]).cast("binary"))
    out = out.withColumn("number", F.row_number().over(Window.orderBy(order)) - 1)
    return out if trials is None else out.where(F.col("number") < trials)


def log_uniform(number: Column, low: float, high: float, salt: str, seed: int = 42) -> Column:
    """A log-uniform draw for a trial's number, the same each time."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), number), F.lit(1 << 30)) / float(1 << 30)
    return F.exp(F.log(F.lit(low)) + u * (F.log(F.lit(high)) - F.log(F.lit(low))))


def ablate(base: dict, steps: dict[str, list], score) -> tuple[dict, list[tuple[dict, float]]]:
    """Coordinate ablation: for each key in turn, the options are scored on the best configuration so far, which
    changes only for a strictly better score. Returns the best and all that was scored."""
    best, tried = dict(base), [(dict(base), score(base))]
    top = tried[0][1]
    for key, options in steps.items():
        for option in options:
            if option != best.get(key):
                config = {**best, key: option}
                tried.append((config, score(config)))
        for config, s in tried:
            if s > top and all(config.get(k) == best.get(k) for k in best if k != key):
                best, top = config, s
    return best, tried
