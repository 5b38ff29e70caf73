"""Checks of manifests, splits, predictions and runs: one row for each check, or an error for the first that fails."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import paths


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def raise_first(checks: DataFrame) -> None:
    """An error with the sample of the violated check of the lowest ord."""
    bad = checks.where("violations > 0").orderBy("ord").first()
    if bad:
        raise ValueError(f"{bad['check']}: {bad['violations']} ({bad['sample']})")


def _check(ord_: int, name: str, rows: DataFrame, what: Column, sample: int = 10) -> DataFrame:
    """A check row: how many rows violate it, and the smallest few of what they are."""
    rows = rows.select(what.cast("string").alias("x"))
    least = rows.orderBy("x").limit(sample).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("sample"))
    return rows.agg(F.count("*").alias("violations")).join(F.broadcast(least)).select(F.lit(ord_).alias("ord"), F.lit(name).alias("check"), "violations", "sample")


def overlap(df: DataFrame, column: str, a: str = "train", b: str = "validation") -> DataFrame:
    """Values of a column in both splits; null and empty ones are no values."""
    some = lambda s: df.where((F.col("split") == s) & F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()
    return some(a).intersect(some(b))


def leakage(assigned: DataFrame) -> DataFrame:
    """Checks of a split: no content, source or path on both sides, and only originals in validation."""
    rows = [_check(i, f"{c}_overlap", overlap(assigned, c), F.col(c)) for i, c in enumerate(("path", "sha256", "source_id"), 1)]
    rows.append(_check(4, "derived_in_validation", assigned.where("split = 'validation' and derived"), F.col("path")))
    return reduce(DataFrame.union, rows)


def preflight(manifest: DataFrame, label_map: DataFrame, files: DataFrame, expected_train: int, expected_val: int, expected_classes: int, verify_hashes: bool = False) -> DataFrame:
    """The checks of a frozen manifest (path, label, sha256, source_id, split) in order of precedence.

    label_map is (label, idx); files is (path, sha256) of what is there. Files that no row names are
    counted, but are no violation: their check has ord 0.
    """
    m = require_columns(manifest, "path", "label", "sha256", "source_id", "split")
    idx = label_map.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    gap = idx.where(f"not (n = {expected_classes} and d = n and lo = 0 and hi = n - 1)")
    counts = m.agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "validation").alias("v"))
    checks = [
        _check(1, "label_mapping", gap, F.col("n")),
        _check(2, "manifest_count", counts.where(f"t <> {expected_train} or v <> {expected_val}"), F.concat_ws("/", "t", "v")),
        _check(3, "path_escape", m.where(paths.escapes(F.col("path"))), F.col("path")),
        _check(4, "duplicate_entries", m.groupBy("split", "path").count().where("count > 1"), F.col("path")),
        _check(5, "unknown_labels", m.join(label_map.select("label"), "label", "left_anti"), F.concat_ws(":", "split", "path", "label")),
        _check(6, "missing_files", m.join(files.select("path"), "path", "left_anti").select("path").distinct(), F.col("path")),
    ]
    if verify_hashes:
        both = m.where("nullif(sha256, '') is not null").join(files.select("path", F.col("sha256").alias("actual")), "path")
        checks.append(_check(7, "content_hash", both.where("actual <> sha256"), F.col("path")))
    checks += [_check(8 + i, f"{c}_overlap", overlap(m, c), F.col(c)) for i, c in enumerate(("path", "sha256", "source_id"))]
    present = m.join(files.select("path"), "path", "left_semi").groupBy("label", "split").agg(F.count("*").alias("actual"))
    wanted = m.groupBy("label", "split").agg(F.count("*").alias("expected"))
    checks.append(_check(11, "class_counts", wanted.join(present, ["label", "split"], "left").where("expected <> coalesce(actual, 0)"), F.col("label")))
    extra = _check(0, "extra_files", files.join(m.select("path"), "path", "left_anti"), F.col("path"))
    return reduce(DataFrame.union, [extra, *checks])


def same_values(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each column: how many values it has, and whether that is one."""
    counts = df.agg(*[F.countDistinct(c).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_values").withColumn("ok", F.col("n_values") == 1)


def comparable_runs(runs: DataFrame) -> DataFrame:
    """Checks of runs that are shown side by side: one split hash, one phase, unique ids without path parts."""
    one = same_values(runs, "split_hash", "phase").where("not ok")
    bad = runs.where(~F.col("run_id").rlike("^[^/\\\\]+$") | F.col("run_id").isin(".", ".."))
    return reduce(DataFrame.union, [_check(1, "one_split_and_phase", one, F.col("column")), _check(2, "unique_run_ids", runs.groupBy("run_id").count().where("count > 1"), F.col("run_id")), _check(3, "run_id_names", bad, F.col("run_id"))])


def config_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b) of keys whose values differ or are on one side only, of two tables (key, value)."""
    j = a.select("key", F.col("value").alias("a"), F.lit(True).alias("in_a")).join(b.select("key", F.col("value").alias("b"), F.lit(True).alias("in_b")), "key", "full_outer")
    return j.where("in_a is null or in_b is null or not (a <=> b)").select("key", "a", "b")


def pair_protocol(a: DataFrame, b: DataFrame, key: str) -> None:
    """An error unless two configurations differ in that key and no other."""
    got = sorted(r["key"] for r in config_diff(a, b).limit(20).collect())
    if got != [key]:
        raise ValueError(f"exactly {key} may differ; differing: {got}")


def exact_set(df: DataFrame, per_class: int, classes: int, training: DataFrame) -> DataFrame:
    """Checks of an external set: so many rows in each of so many classes, no duplicate, none in training."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("n")).where(f"n <> {classes}")
    twice = df.groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    return reduce(
        DataFrame.union,
        [
            _check(1, "class_count", total, F.col("n")),
            _check(2, "rows_per_class", counts.where(f"n <> {per_class}"), F.col("label")),
            _check(3, "duplicates", twice, F.col("sha256")),
            _check(4, "in_training", df.join(training.select("sha256"), "sha256", "left_semi"), F.col("sha256")),
        ],
    )


def probability_contract(scores: DataFrame, probabilities: str, classes: int, tolerance: float = 1e-5) -> DataFrame:
    """Checks of scored rows: so many probabilities, none negative, their sum 1."""
    p = F.col(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return reduce(DataFrame.union, [_check(1, "classes", scores.where(F.size(p) != classes), F.size(p)), _check(2, "negative", scores.where(F.exists(p, lambda x: x < 0)), p.cast("string")), _check(3, "sum", scores.where(F.abs(total - 1) > tolerance), total)])


def reload_parity(stored: DataFrame, again: DataFrame, key: str = "path") -> DataFrame:
    """One row: predictions that differ between two scorings, and rows that only one of them has."""
    j = stored.select(key, F.col("predicted_label").alias("a"), F.lit(1).alias("ia")).join(again.select(key, F.col("predicted_label").alias("b"), F.lit(1).alias("ib")), key, "full_outer")
    return j.agg(F.count_if(F.expr("ia is null or ib is null")).alias("unmatched"), F.count_if(F.expr("ia = 1 and ib = 1 and not (a <=> b)")).alias("mismatches"))


def accounting(meta: DataFrame) -> DataFrame:
    """Whether the accounts of split.metadata() add up."""
    rules = {
        "included": "included_images = source_images - excluded_conflicting_images - held_out_derived_images",
        "parts": "included_images = train_images + val_images",
        "kinds": "original_images + derived_images = source_images - excluded_conflicting_images",
        "fraction": "actual_val_fraction <=> try_divide(val_images, original_images)",
    }
    return meta.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(v).alias("ok")) for k, v in rules.items()])).alias("x")).select("x.*")


def capture_contract(df: DataFrame) -> DataFrame:
    """Checks of captured rows: writer and capture ids of safe characters, each capture once."""
    bad = df.where(~F.col("writer_id").rlike("^[A-Za-z0-9_-]+$") | ~F.col("capture_id").rlike("^[A-Za-z0-9_-]+$"))
    return _check(1, "ids", bad, F.concat_ws("/", "writer_id", "capture_id")).union(_check(2, "captures", df.groupBy("writer_id", "capture_id", "path").count().where("count > 1"), F.col("path")))


def predictions(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Checks, in order of precedence, of a run's predictions (path, true_label, predicted_label, confidence) against
    a manifest (path, label): paths once on each side, the same paths, the same truth, confidences from 0 to 1."""
    twice = truth.select("path").groupBy("path").count().union(found.select("path").groupBy("path").count()).where("count > 1")
    lone = truth.select("path").join(found.select("path"), "path", "left_anti").union(found.select("path").join(truth.select("path"), "path", "left_anti"))
    other = found.join(truth.select("path", "label"), "path").where("not (label <=> true_label)")
    outside = found.where("not coalesce(confidence between 0 and 1 and not isnan(confidence), false)")
    return reduce(DataFrame.union, [_check(i, name, rows, F.col("path")) for i, (name, rows) in enumerate((("duplicates", twice), ("coverage", lone), ("truth", other), ("confidence", outside)), 1)])


def checked_predictions(truth: DataFrame, found: DataFrame) -> DataFrame:
    """found with `correct`, if no check of predictions() is violated."""
    raise_first(predictions(truth, found))
    return found.withColumn("correct", F.col("true_label") == F.col("predicted_label"))


def resolved_config(external: dict | None, embedded: dict | None, known: set[str]) -> dict:
    """A model's settings from a file and from its checkpoint, which must not differ (a tuple and a list are the same),
    name only known settings, and be there in one of them."""
    same = lambda v: list(v) if isinstance(v, (list, tuple)) else v
    if external is not None and embedded is not None:
        for key in sorted(external.keys() | embedded.keys()):
            if same(external.get(key)) != same(embedded.get(key)):
                raise ValueError(f"config and checkpoint differ in {key}: {external.get(key)!r}, {embedded.get(key)!r}")
    config = external or embedded
    if not isinstance(config, dict):
        raise ValueError("there is no usable config")
    if unknown := sorted(config.keys() - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return config


def resolved_labels(external: dict | None, embedded: dict | None) -> dict[str, int]:
    """A label index from a file and from a checkpoint, which must not differ and number its labels from 0 without gaps."""
    if external is not None and embedded is not None and external != embedded:
        raise ValueError("label index and checkpoint differ")
    labels = external or embedded
    if not isinstance(labels, dict) or not labels:
        raise ValueError("there is no label index")
    try:
        out = {str(k): int(v) for k, v in labels.items()}
    except (TypeError, ValueError):
        raise ValueError("a label index holds whole numbers") from None
    if sorted(out.values()) != list(range(len(out))):
        raise ValueError("label indices must run from 0 without gaps")
    return out


def output_dimension(scored: DataFrame, labels: int) -> None:
    """An error if items with logits have not one logit a label."""
    if bad := scored.where(F.size("logits") != labels).select(F.size("logits")).first():
        raise ValueError(f"{bad[0]} outputs for {labels} labels")
