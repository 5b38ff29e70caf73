"""Ranking and analysis of experiment runs and their histories."""

from __future__ import annotations

import inspect

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.runtime import exists, storage


def rank(runs: DataFrame) -> DataFrame:
    """runs by macro F1, then accuracy, best first; ties in the order of run_seq."""
    return runs.orderBy(F.desc("val_macro_f1"), F.desc("val_accuracy"), "run_seq")


def ranked(runs: DataFrame) -> DataFrame:
    """runs with model_index, their place in rank() from 0. Runs are few: one window over all of them."""
    return runs.withColumn("model_index", F.row_number().over(Window.orderBy(F.desc("val_macro_f1"), F.desc("val_accuracy"), "run_seq")) - 1)


def leaderboard(runs: DataFrame) -> DataFrame:
    """A row for each candidate: mean and sample deviation of macro F1 (null for one run), mean accuracy, seeds, the first run's parameter count, total seconds; best first."""
    g = runs.groupBy("candidate").agg(
        F.avg("val_macro_f1").alias("mean_macro_f1"),
        F.stddev_samp("val_macro_f1").alias("std_macro_f1"),
        F.avg("val_accuracy").alias("mean_accuracy"),
        F.countDistinct("seed").alias("seeds"),
        F.min_by("parameter_count", F.struct(-F.col("val_macro_f1"), -F.col("val_accuracy"), F.col("run_seq"))).alias("parameter_count"),
        F.sum("training_seconds").alias("training_seconds"),
    )
    return g.orderBy(F.desc("mean_macro_f1"), F.desc("mean_accuracy"), "candidate")


def finalists(candidates: DataFrame, k: int, control: DataFrame | None = None, by: tuple[str, ...] = ("value", "val_accuracy"), key: str = "candidate") -> DataFrame:
    """The k best candidates, and the control ones that are not among them."""
    top = candidates.orderBy(*[F.desc(c) for c in by], key).limit(k)
    return top if control is None else top.unionByName(control.join(top.select(key), key, "left_anti"), allowMissingColumns=True)


def winner(runs: DataFrame, seeds: list[int]) -> DataFrame:
    """The run of the best candidate by leaderboard() that has the first seed asked for, not the luckiest seed."""
    best = leaderboard(runs).limit(1).select("candidate")
    return runs.join(best, "candidate", "left_semi").where(F.col("seed") == seeds[0]).orderBy("run_seq").limit(1)


def best_epochs(history: DataFrame) -> DataFrame:
    """(run_id, best_epoch, val_macro_f1, val_accuracy): the earliest epoch of the best (macro F1, accuracy)."""
    order = F.struct("val_macro_f1", "val_accuracy", -F.col("epoch"))
    return history.groupBy("run_id").agg(F.max_by("epoch", order).alias("best_epoch"), F.max_by("val_macro_f1", order).alias("val_macro_f1"), F.max_by("val_accuracy", order).alias("val_accuracy"))


def improvements(history: DataFrame) -> DataFrame:
    """history with `improved`: strictly better by (macro F1, accuracy) than every epoch before."""
    before = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    score = F.struct("val_macro_f1", "val_accuracy")
    best = F.max(score).over(before)
    return history.withColumn("improved", best.isNull() | (score > best))


def patience(history: DataFrame, most: int, reset: Column | None = None, counting: Column | None = None) -> DataFrame:
    """history with `stale` and `stop_epoch`: epochs since the last improvement (or `reset`), counted where
    `counting`, and the first epoch of a run at which they reach `most`, null if none does."""
    h = improvements(history)
    fresh = F.col("improved") if reset is None else F.col("improved") | reset
    line = Window.partitionBy("run_id").orderBy("epoch")
    h = h.withColumn("block", F.sum(fresh.cast("int")).over(line))
    tick = ~fresh if counting is None else ~fresh & counting
    h = h.withColumn("stale", F.sum(tick.cast("int")).over(Window.partitionBy("run_id", "block").orderBy("epoch")))
    return h.withColumn("stop_epoch", F.min(F.when(F.col("stale") >= most, F.col("epoch"))).over(Window.partitionBy("run_id"))).drop("block")


def plateau(history: DataFrame, start: float, factor: float = 0.2, wait: int = 2, threshold: float = 1e-4) -> DataFrame:
    """(run_id, epoch, lr): the rate after each epoch, cut by `factor` once macro F1 has not grown by the
    relative threshold for more than `wait` epochs. A fold over a run's epochs, which are few."""
    lists = history.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("val_macro_f1").alias("m")))).alias("es"))
    zero = F.struct(F.lit(-1e308).alias("best"), F.lit(0).alias("bad"), F.lit(start).alias("lr"), F.array().cast("array<struct<epoch:int,lr:double>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        better = e["m"] > F.when(acc["best"] < 0, acc["best"]).otherwise(acc["best"] * (1 + threshold))
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        lr = F.when(bad > wait, acc["lr"] * factor).otherwise(acc["lr"])
        row = F.array(F.struct(e["epoch"].cast("int").alias("epoch"), lr.alias("lr")))
        return F.struct(F.when(better, e["m"]).otherwise(acc["best"]).alias("best"), F.when(bad > wait, 0).otherwise(bad).alias("bad"), lr.alias("lr"), F.concat(acc["out"], row).alias("out"))

    return lists.select("run_id", F.inline(F.aggregate("es", zero, step, lambda acc: acc["out"])))


def median_pruned(steps: DataFrame, startup: int = 3, warmup: int = 2) -> DataFrame:
    """(run_id, epoch, best, median, pruned): a run's best so far against the median of the others' at the same step.

    No run is pruned before `startup` others have the step, nor in its first `warmup` epochs. A step with one run
    has no row. The others' median is looked up by rank: where a run stands at or before the middle of all
    at its step, the others' middle is one further on.
    """
    line = Window.partitionBy("run_id").orderBy("epoch")
    step = Window.partitionBy("epoch")
    s = steps.select("run_id", "epoch", F.max("val_macro_f1").over(line).alias("best"))
    s = s.withColumns({"rank": F.row_number().over(step.orderBy("best", "run_id")) - 1, "others": F.count("*").over(step) - 1}).where("others > 0")
    at = lambda i: F.when(F.col("rank") <= i, i + 1).otherwise(i)
    s = s.withColumns({"lo": at(F.expr("(others - 1) div 2")), "hi": at(F.expr("others div 2"))})
    ranks = lambda c: s.select("epoch", F.col("rank").alias(c), F.col("best").alias(f"{c}_best"))
    j = s.join(ranks("lo"), ["epoch", "lo"]).join(ranks("hi"), ["epoch", "hi"]).withColumn("median", (F.col("lo_best") + F.col("hi_best")) / 2)
    return j.select("run_id", "epoch", "best", "median", ((F.col("others") >= startup) & (F.col("epoch") > warmup) & (F.col("best") < F.col("median"))).alias("pruned"))


def curve(history: DataFrame) -> DataFrame:
    """(run_id, epoch, val_macro_f1, delta): each epoch against the one before."""
    line = Window.partitionBy("run_id").orderBy("epoch")
    return history.select("run_id", "epoch", "val_macro_f1", (F.col("val_macro_f1") - F.lag("val_macro_f1").over(line)).alias("delta"))


def gaps(runs: DataFrame, a: str = "train_accuracy", b: str = "val_accuracy") -> DataFrame:
    return runs.withColumn("gap", F.col(a) - F.col(b))


def status_counts(runs: DataFrame) -> DataFrame:
    """One row: complete and failed runs."""
    return runs.agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") != "complete").alias("failed"))


def by_state(trials: DataFrame, *states: str) -> DataFrame:
    return trials.where(F.col("state").isin(*states))


def remaining_trials(trials: DataFrame, budget: int) -> int:
    """Trials left of a total budget; complete and pruned ones are finished."""
    return max(0, budget - by_state(trials, "COMPLETE", "PRUNED").count())


def handoff(runs: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row: families assigned, completed, failed runs, and whether all are done. Families are few."""
    done = runs.where("status = 'complete'").select("family").distinct()
    j = assigned.select("family").distinct().join(done.withColumn("done", F.lit(True)), "family", "left")
    left = j.agg(F.array_sort(F.collect_list("family")).alias("assigned"), F.array_sort(F.collect_list(F.when(F.col("done"), F.col("family")))).alias("completed"), (F.count_if(F.col("done").isNull()) == 0).alias("complete"))
    return left.join(F.broadcast(runs.where("status <> 'complete'").agg(F.array_sort(F.collect_list("run_id")).alias("failed_runs"))))


def first_n(df: DataFrame, per: str, n: int, *order: str, strict: bool = True) -> DataFrame:
    """The first n rows of each value of `per`; fewer is an error if strict."""
    out = df.withColumn("rn", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rn") <= n)
    if strict and (short := out.groupBy(per).count().where(F.col("count") < n).first()):
        raise ValueError(f"{per} {short[0]!r} has {short[1]} rows of {n}")
    return out


def last_status(statuses: DataFrame) -> DataFrame:
    """The last status of each run of an append-only table (run_id, seq, status)."""
    return statuses.groupBy("run_id").agg(F.max_by("status", "seq").alias("status"))


def key_values(df: DataFrame, key: str) -> DataFrame:
    """(key, name, value): each record's columns as rows, nested values as JSON."""
    names = [c for c in df.columns if c != key]
    kinds = dict(df.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith(("struct", "array", "map")) else F.col(c).cast("string")
    return df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), text(c).alias("value")) for c in names])).alias("x")).select(key, "x.*")


class Cache:
    """Results by the fingerprint of what made them, as parquet in a folder all executors see.

    The key of an entry holds the settings, the source of the function that makes it and the content of its input tables (an
    order-independent sum of row hashes, see split.content_hash), so that a change in any of them is another
    entry. computed counts the entries made, and rows says how many rows each had, observed while it was written.
    """

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.computed, self.rows = 0, {}

    def path(self, key: object, make=None, *inputs: DataFrame) -> str:
        from plumbline.functions.values import fingerprint
        from plumbline.operators.split import content_hash

        code = inspect.getsource(make) if make is not None and inputs else None
        return f"{self.root}/{fingerprint([key, code, [content_hash(df, *sorted(df.columns)) for df in inputs]])[:16]}"

    def get(self, spark, key: object, make, *inputs: DataFrame) -> DataFrame:
        """The stored table of the key and inputs, make(*inputs), made and stored if it is not there; a write that broke off is made anew."""
        path = self.path(key, make, *inputs)
        if not exists(spark, f"{path}/_SUCCESS"):
            seen = Observation()
            make(*inputs).observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
            self.computed += 1
            self.rows[path] = seen.get["n"]
        return spark.read.parquet(path)

    def drop_but(self, spark, *paths: str) -> int:
        """Entries of the folder that are not among the paths, which go; their number."""
        system, where = storage(spark, self.root)
        old = [s.getPath() for s in system.listStatus(where) if s.getPath().getName() not in {p.rsplit("/", 1)[-1] for p in paths}]
        for p in old:
            system.delete(p, True)
        return len(old)
