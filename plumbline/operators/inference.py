"""Batch inference with a model that each worker loads once; an item that can't be scored is an error in its row, never a failed batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from plumbline.functions import values
from plumbline.operators import scoring

#: Items that a model gets at a time.
BATCH = 512
#: Numbers of a model that is sent along with the tasks; a larger one is loaded by the workers from where it is stored.
MODEL_NUMBERS = 20_000_000


def fault(v: Column, length: int) -> Column:
    """Why a vector can't be scored: no vector, one of another length, a null or non-finite component; null if it can."""
    bad = F.exists(v, lambda x: ~values.finite(x))
    return F.when(v.isNull(), "no vector").when(F.size(v) != length, F.concat(F.lit("length "), F.size(v).cast("string"), F.lit(f", not {length}"))).when(bad, "a component is null or not finite")


def batch_scores(items: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], length: int, classes: int, vector: str = "v", batch: int = BATCH) -> DataFrame:
    """items with `outputs` array<double> and `error`.

    load() is called once in each Python worker and gives a function from a batch (rows x length) to scores (rows x
    classes). A batch holds sound rows only: what fault() names is replaced by zeros on the way in and by null
    on the way out. Outputs that are not finite are an error of their row too.
    """

    def make():
        model = load()
        return lambda x: np.asarray(model(x.astype(np.float64)), np.float64).reshape(len(x), classes)

    score = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[length]])
    why = fault(F.col(vector), length)
    zeros = F.array_repeat(F.lit(0.0), length)
    rows = items.withColumns({"error": why, "__in": F.when(why.isNull(), F.col(vector).cast("array<double>")).otherwise(zeros)})
    rows = rows.withColumn("outputs", score("__in"))
    spoilt = F.exists("outputs", lambda x: ~values.finite(x))
    rows = rows.withColumn("error", F.coalesce("error", F.when(spoilt, "an output is not finite")))
    return rows.withColumn("outputs", F.when(F.col("error").isNull(), F.col("outputs"))).drop("__in")


def linear(weights: np.ndarray, bias: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A linear model (classes x length, classes) for batch_scores()."""
    if weights.size > MODEL_NUMBERS:
        raise ValueError(f"a model of {weights.size} numbers is stored and loaded, not sent along")
    return lambda: lambda x: x @ weights.T + bias


class BatchScorer:
    """A scoring.Scorer of such a model: logits of the labels, and the error of items that have none."""

    def __init__(self, load: Callable[[], Callable[[np.ndarray], np.ndarray]], labels: list[str], length: int):
        self.load, self.labels, self.length = load, labels, length

    def logits(self, items: DataFrame) -> DataFrame:
        out = batch_scores(items, self.load, self.length, len(self.labels))
        names = F.array(*map(F.lit, self.labels))
        return out.withColumn("logits", F.zip_with(names, "outputs", lambda n, x: F.struct(n.alias("predicted_label"), x.alias("logit")))).drop("outputs")

    def results(self, items: DataFrame, key: str, threshold: float, k: int = 3) -> DataFrame:
        """(key, prediction, confidence, margin, top2_label, ..., error, status): a row for each item, also for one in error."""
        scored = self.logits(items).select(key, "logits", "error")
        ranked = F.when(F.col("error").isNull(), scoring.ranked(F.col("logits")))
        lists = scored.select(key, "error", F.explode(F.array(ranked)).alias("s"))
        first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
        top = F.transform(F.slice("s", 1, k), lambda x: F.struct(x["label"].alias("label"), (-x["n"]).alias("confidence")))
        flat = scoring.flatten_top_k(lists.select(F.struct(key, "error").alias("__of"), top.alias("top_k"), (second["n"] - first["n"]).alias("margin")), "__of")
        flat = flat.select(f"__of.{key}", *[c for c in flat.columns if c != "__of"], "__of.error")
        return scoring.with_status(flat, threshold, F.col("error"))
