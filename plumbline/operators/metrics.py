"""Classification metrics from predictions (true_label, predicted_label) and a label index (label, idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(true_label, predicted_label, n) over all pairs of labels, zeros included. Pairs are classes squared, not rows."""
    counts = pred.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))
    grid = labels.select(F.col("label").alias("true_label")).crossJoin(labels.select(F.col("label").alias("predicted_label")))
    return grid.join(counts, ["true_label", "predicted_label"], "left").select("true_label", "predicted_label", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(true_label, counts array<bigint>): for each true label how often each label was predicted, by its index; labels are few."""
    counts = confusion(pred, labels).join(F.broadcast(labels.withColumnRenamed("label", "predicted_label")), "predicted_label")
    return counts.groupBy("true_label").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("counts"))


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("true_label") == F.col("predicted_label")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def per_class(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, label, precision, recall, f1, support) of every label; a quotient by zero is 0."""
    c = pred.groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))
    both = c.select(F.explode(F.array(F.struct(F.col("true_label").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted_label").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), (F.col("true_label") == F.col("predicted_label")).alias("hit"))
    s = both.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("x.t")).otherwise(0)).alias("tp"))
    j = labels.join(s, "label", "left").na.fill(0, ["support", "predicted", "tp"])
    p, r = _zero(F.try_divide("tp", "predicted")), _zero(F.try_divide("tp", "support"))
    f1 = _zero(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")))
    return j.select("idx", "label", p.alias("precision"), r.alias("recall"), f1.alias("f1"), "support")


def macro(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: accuracy, and macro precision, recall and F1 and the least recall over all labels, absent ones as 0."""
    m = per_class(pred, labels).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.min("recall").alias("minimum_per_class_recall"))
    return accuracy(pred).join(F.broadcast(m))


def recall_by(pred: DataFrame, key: str) -> DataFrame:
    """(key, support, correct, recall), worst first, then fewest."""
    g = pred.groupBy(key).agg(F.count("*").alias("support"), F.sum((F.col("true_label") == F.col("predicted_label")).cast("int")).cast("long").alias("correct"))
    return g.withColumn("recall", F.col("correct") / F.col("support")).orderBy("recall", "support", key)


def macro_recall_present(pred: DataFrame) -> DataFrame:
    """Mean recall over the labels that occur as truth (balanced accuracy)."""
    return recall_by(pred, "true_label").agg(F.avg("recall").alias("macro_recall"), F.count("*").alias("classes"))


def class_weights(train: DataFrame, labels: DataFrame, most: float = 3.0) -> DataFrame:
    """(label, weight): the root of largest count by count, `most` at most (and for no row), divided by the mean."""
    c = labels.join(train.groupBy("label").agg(F.count("*").alias("n")), "label", "left")
    top = c.agg(F.max("n").alias("top"))
    raw = c.join(F.broadcast(top)).withColumn("raw", F.coalesce(F.least(F.sqrt(F.try_divide("top", "n")), F.lit(most)), F.lit(most)))  # a row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("label", (F.col("raw") / F.col("mean")).alias("weight"))


def batch_means(batches: DataFrame) -> DataFrame:
    """One row for each epoch of batches (epoch, loss, n, correct): mean loss by size, accuracy, all finite or an error."""
    bad = F.count_if(F.isnan("loss") | (F.abs("loss") == float("inf")))
    return batches.groupBy("epoch").agg(F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum("n")).alias("loss"), F.try_divide(F.sum("correct"), F.sum("n")).alias("accuracy"), bad.alias("not_finite"))


def support(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """(idx, label, train_count, val_count, development_count) of every label."""
    g = assigned.groupBy("label").agg(F.count_if(F.col("split") == "train").alias("train_count"), F.count_if(F.col("split") == "validation").alias("val_count"))
    g = labels.join(g, "label", "left").na.fill(0, ["train_count", "val_count"])
    return g.select("idx", "label", "train_count", "val_count", (F.col("train_count") + F.col("val_count")).alias("development_count"))


def confusion_pairs(pred: DataFrame) -> DataFrame:
    """(true_label, predicted_label, n) of errors, commonest first."""
    return pred.where("true_label <> predicted_label").groupBy("true_label", "predicted_label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "true_label", "predicted_label")


def confusion_pairs_both(pred: DataFrame) -> DataFrame:
    """(label_a, label_b, a_to_b, b_to_a, total) of errors between two labels, commonest first."""
    a, b = F.least("true_label", "predicted_label"), F.greatest("true_label", "predicted_label")
    g = pred.where("true_label <> predicted_label").groupBy(a.alias("label_a"), b.alias("label_b"))
    g = g.agg(F.count_if(F.col("true_label") < F.col("predicted_label")).alias("a_to_b"), F.count_if(F.col("true_label") > F.col("predicted_label")).alias("b_to_a"), F.count("*").alias("total"))
    return g.orderBy(F.desc("total"), "label_a", "label_b")


def confident_errors(pred: DataFrame, n: int = 20) -> DataFrame:
    return pred.where("true_label <> predicted_label").orderBy(F.desc("confidence"), "path").limit(n)


def unsure(pred: DataFrame, n: int = 20) -> DataFrame:
    return pred.orderBy("confidence", "path").limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of their key: the same rows of the same table each time."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), key).limit(n)
