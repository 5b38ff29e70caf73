"""Profiles of a manifest: counts, imbalance, duplicates, conflicts, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_counts(manifest: DataFrame) -> DataFrame:
    """(label, image_count), fewest first, then by label."""
    return manifest.groupBy("label").agg(F.count("*").alias("image_count")).orderBy("image_count", "label")


def imbalance(manifest: DataFrame) -> DataFrame:
    """One row: least and largest class, and their ratio, null without rows."""
    c = manifest.groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.min("n").alias("minimum"), F.max("n").alias("maximum"), F.try_divide(F.max("n"), F.min("n")).alias("ratio"))


def histogram(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """(value, n): how often each value occurs."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def color_mode(channels: Column) -> Column:
    """The mode of a decoded image by its channels, null for a corrupt one."""
    return F.when(channels == 1, "L").when(channels == 3, "RGB").when(channels == 4, "RGBA")


def most_common(df: DataFrame, value: Column, order: Column, n: int = 20, name: str = "value") -> DataFrame:
    """The n commonest values; ties go to the one met first in `order`."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n).select(name, "n")


def duplicate_members(manifest: DataFrame) -> DataFrame:
    """(sha256, path) of rows whose content occurs more than once, by hash and path.

    Hashes that repeat are found by a partial count and joined back, so that no window holds a group.
    """
    twice = manifest.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1 and sha256 is not null").select("sha256")
    return manifest.join(twice, "sha256").select("sha256", "path").orderBy("sha256", "path")


def duplicate_groups(manifest: DataFrame) -> DataFrame:
    """One row: groups of equal content, their members, and rows more than one of each."""
    g = manifest.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("duplicate_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_members"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("redundant"))


def conflict_groups(manifest: DataFrame) -> DataFrame:
    """(sha256, labels, members) of content that has more than one label."""
    return manifest.where("sha256 is not null").groupBy("sha256").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("members")).where("labels > 1")


def conflict_members(manifest: DataFrame) -> DataFrame:
    """(path, label, sha256) of rows in conflict, by path."""
    return manifest.join(conflict_groups(manifest).select("sha256"), "sha256", "left_semi").select("path", "label", "sha256").orderBy("path")


def quarantine(manifest: DataFrame, policy: str = "exclude") -> DataFrame:
    """manifest without content in conflict; with policy `error`, a conflict is an error, with `keep`, it stays."""
    if policy not in ("exclude", "error", "keep"):
        raise ValueError("policy must be exclude, error or keep")
    if policy == "keep":
        return manifest
    bad = conflict_groups(manifest).select("sha256")
    if policy == "error" and not bad.isEmpty():
        raise ValueError("equal content has conflicting labels")
    kept = manifest.join(bad, "sha256", "left_anti")
    return kept.select(*manifest.columns)


def check_classes(before: DataFrame, after: DataFrame, expected: int | None = None) -> int:
    """The number of classes left; fewer than two, or not the number expected, is an error."""
    n = after.select("label").distinct().count()
    if expected is not None and n != expected:
        raise ValueError(f"expected {expected} classes, found {n} (of {before.select('label').distinct().count()} before exclusion)")
    if n < 2:
        raise ValueError("classification needs two classes at least")
    return n


def states() -> tuple[Column, Column, Column]:
    """Whether a row of a scan (label, width) has no label, is corrupt, or is valid."""
    lost = F.col("label").isNull()
    corrupt = ~lost & (F.coalesce(F.col("width"), F.lit(-1)) < 0)
    return lost, corrupt, ~lost & ~corrupt


def summary(scan: DataFrame) -> DataFrame:
    """One row of totals of a scan (path, label, width, sha256): discovered = valid + corrupt + without label.

    A row without a label is counted as that and no further; a label with a null or negative width is corrupt.
    """
    lost, corrupt, valid = states()
    counts = scan.where(valid).groupBy("label").agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), F.min("n").alias("minimum"), F.max("n").alias("maximum"))
    totals = scan.agg(F.count("*").alias("discovered"), F.count_if(valid).alias("valid"), F.count_if(corrupt).alias("corrupt"), F.count_if(lost).alias("label_errors"))
    groups = duplicate_groups(scan.where(valid)).select("duplicate_groups", "duplicate_members")
    return totals.join(F.broadcast(counts)).join(F.broadcast(groups)).withColumn("imbalance", F.try_divide("maximum", "minimum"))  # a row each


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row x column, absent ones 0."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def cardinality(df: DataFrame, content: str, *keys: str) -> DataFrame:
    """One row: distinct values of each key, and rows of content beyond the first of each."""
    return df.agg(*[F.countDistinct(k).alias(f"n_{k}") for k in keys], (F.count(content) - F.countDistinct(content)).alias("duplicates"))


def label_index(manifest: DataFrame) -> DataFrame:
    """(label, idx) in string order of the labels, from 0; the labels are few."""
    return manifest.select("label").distinct().withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)
