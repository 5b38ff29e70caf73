"""Leakage-safe, grouped and stratified train/validation split."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import audit
from plumbline.operators.graph import connected_components
from plumbline.runtime import cut, exists

ALGORITHM = "source-family-hash-order-greedy"
#: Hexadecimal digits of a group's hash that name its bucket.
DIGITS = 3


def families(manifest: DataFrame) -> DataFrame:
    """manifest with `grp`: the smallest source id that a row's source is linked to by equal content."""
    sources = manifest.where("sha256 is not null").groupBy("sha256").agg(F.min("source_id").alias("b"))
    edges = manifest.join(sources, "sha256").select(F.col("source_id").alias("a"), "b").union(manifest.select("source_id", "source_id"))
    roots = connected_components(edges.distinct())
    return manifest.join(roots.select(F.col("node").alias("source_id"), F.col("root").alias("grp")), "source_id")


def assign(grouped: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """grouped (families()) with `split`: train, validation or held_out_derived.

    For each label, groups with an original are put in an order given by a seeded hash. The one closest
    in originals to fraction x all originals goes to validation first; each further group follows if it
    brings the count strictly closer to that and is not the last. With fewer than two such groups the
    label stays in train. Derived rows of a chosen group are held out.

    While the count stays at or below its goal every group follows, so whole buckets of the order are settled by their
    sums, and one bucket of a label by a running sum. Beyond that only groups below twice what is missing can follow,
    of each size so many as fit and one more; a fold in order holds one count and gets these alone, however
    many groups a label has.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must be between 0 and 1")
    groups = grouped.groupBy("label", "grp").agg(F.sum(F.when(F.col("derived"), 0).otherwise(1)).cast("long").alias("size")).where("size > 0")
    groups = cut(groups.withColumn("o", F.md5(F.concat(F.lit(f"{seed}|"), F.col("grp")).cast("binary"))))
    order = F.struct("o", "grp")
    head = F.min(F.struct(F.abs(F.col("size") - F.col("target")).alias("off"), "o", "grp", "size")).alias("head")  # ties go by the hash
    totals = groups.groupBy("label").agg((F.sum("size") * F.lit(float(fraction))).alias("target"), F.count("*").alias("n")).where("n > 1")
    heads = cut(groups.join(totals, "label").groupBy("label", "target").agg(head))
    rest = groups.join(heads, "label").where("grp <> head.grp").select("label", "grp", "size", "o", "target", F.col("head.size").alias("start"))
    lasts = rest.groupBy("label").agg(F.max(order).alias("last"))
    rest = cut(rest.join(lasts, "label").where(order < F.col("last")).drop("last").withColumn("bucket", F.substring("o", 1, DIGITS)))

    sums = rest.groupBy("label", "bucket", "start", "target").agg(F.sum("size").alias("sum"))
    before = F.col("start") + F.coalesce(F.sum("sum").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)  # sixteen to the power of DIGITS rows a label at most
    crossed = cut(sums.where("before + sum > target").groupBy("label").agg(F.min("bucket").alias("crossing"), F.min_by("before", "bucket").alias("before")))
    rest = rest.join(crossed, "label", "left")
    whole = rest.where("crossing is null or bucket < crossing").select("label", "grp")
    line = Window.partitionBy("label").orderBy("o", "grp")
    inside = rest.where("bucket = crossing").withColumn("held", F.col("before") + F.sum("size").over(line))
    inside = cut(inside.select("label", "grp", "size", "o", "target", "held"))
    stop = cut(inside.where("held > target").groupBy("label").agg(F.min(order).alias("stop"), F.min_by(F.col("held") - F.col("size"), order).alias("held")))
    fits = inside.drop("held").join(stop, "label").where(order < F.col("stop")).select("label", "grp")

    missing = F.col("target") - F.col("held")
    open_ = rest.join(stop, "label").where((F.col("bucket") >= F.col("crossing")) & (order >= F.col("stop")) & (F.col("size") < 2 * missing))
    open_ = open_.withColumn("place", F.row_number().over(Window.partitionBy("label", "size").orderBy("o", "grp"))).where(F.col("place") <= missing / F.col("size") + 1)
    kind = dict(grouped.dtypes)
    late = open_.select("label", "o", "grp", "size", "target", "held").repartition("label").sortWithinPartitions("label", "o", "grp").mapInPandas(_greedy, f"label {kind['label']}, grp {kind['grp']}")
    chosen = heads.select("label", "head.grp").union(whole).union(fits).union(late).withColumn("chosen", F.lit(True))
    out = grouped.join(chosen, ["label", "grp"], "left")
    split = F.when(F.col("chosen").isNull(), "train").when(F.col("derived"), "held_out_derived").otherwise("validation")
    return out.withColumn("split", split).drop("chosen")


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(label, grp) of the groups that bring their label's count closer to its target, from rows in order; held is the count before the first."""
    label, count = None, 0
    for batch in batches:
        picked = []
        for name, grp, size, target, held in zip(*(batch[c] for c in ("label", "grp", "size", "target", "held")), strict=True):
            if name != label:
                label, count = name, held
            if abs(count + size - target) < abs(count - target):
                count += size
                picked.append((name, grp))
        yield pd.DataFrame(picked, columns=["label", "grp"])


def split(manifest: DataFrame, fraction: float = 0.2, seed: int = 42, policy: str = "exclude", expected: int | None = None) -> DataFrame:
    """Quarantine of conflicts, families, assignment.

    With policy `keep` content in conflict stays: it links the families of its labels, and each label's rows are assigned
    on their own, so the two can be on two sides.
    """
    kept = audit.quarantine(manifest, policy)
    audit.check_classes(manifest, kept, expected)
    return assign(families(kept), fraction, seed)


def train_only(assigned: DataFrame) -> DataFrame:
    """Labels with fewer than two groups that hold an original."""
    g = assigned.where("not derived").groupBy("label").agg(F.countDistinct("grp").alias("n"))
    return assigned.select("label").distinct().join(g, "label", "left").where("coalesce(n, 0) < 2").select("label")


def content_hash_of(*columns: str) -> Column:
    """An aggregate that identifies the rows of a table, whatever their order: a hash of each row, summed in four parts so
    that no task sees more than partial sums, and hashed once more. Any engine with SHA-256 can compute it."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]).cast("binary"), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]).cast("binary"), 256)


def content_hash(df: DataFrame, *columns: str) -> str:
    """content_hash_of() a table."""
    return df.agg(content_hash_of(*columns)).first()[0]


def first_change(frozen: DataFrame, now: DataFrame, *keys: str) -> DataFrame:
    """One row: first_change, the first of the keys in which one row of identities differs from another, null if none does."""
    both = frozen.select(F.struct(*keys).alias("a")).crossJoin(now.select(F.struct(*keys).alias("b")))  # a row each
    return both.select(F.coalesce(*[F.when(~F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), k) for k in keys]).alias("first_change"))


def identity(assigned: DataFrame) -> DataFrame:
    """One row: label_hash, train_hash and validation_hash of a split (path, label, sha256, source_id, split)."""
    part = lambda s: assigned.where(F.col("split") == s).agg(content_hash_of("path", "label", "sha256", "source_id").alias(f"{s}_hash"))
    labels = audit.label_index(assigned).agg(content_hash_of("label", "idx").alias("label_hash"))
    return labels.crossJoin(part("train")).crossJoin(part("validation"))  # a row each


def metadata(source: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row of the split's accounts; excluded is content in conflict that is not in the split."""
    conflicts = audit.conflict_groups(source).join(assigned.select("sha256"), "sha256", "left_anti").agg(F.count("*").alias("excluded_conflicting_hashes"), F.coalesce(F.sum("members"), F.lit(0)).alias("excluded_conflicting_images"))
    counts = assigned.agg(
        F.count_if(F.col("split") == "train").alias("train_images"),
        F.count_if(F.col("split") == "validation").alias("val_images"),
        F.count_if(F.col("split") == "held_out_derived").alias("held_out_derived_images"),
        F.count_if(~F.col("derived")).alias("original_images"),
        F.count_if(F.col("derived")).alias("derived_images"),
        F.countDistinct("label").alias("num_classes"),
    )
    out = source.agg(F.count("*").alias("source_images")).join(F.broadcast(counts)).join(F.broadcast(conflicts))  # a row each
    return out.withColumn("included_images", F.col("train_images") + F.col("val_images")).withColumn("actual_val_fraction", F.try_divide("val_images", "original_images"))


def freeze(assigned: DataFrame, identity: dict) -> dict:
    """The identity of a frozen split with the hashes of its parts and of its label index."""
    parts = {f"{name}_hash": content_hash(assigned.where(F.col("split") == name), "path", "label", "sha256", "source_id") for name in ("train", "validation")}
    return {**identity, **parts, "label_hash": content_hash(audit.label_index(assigned), "label", "idx")}


def reuse(frozen: dict | None, assigned: DataFrame, identity: dict) -> dict:
    """frozen if it still describes the split, an error naming the first thing that changed if not; a new freeze without one."""
    now = freeze(assigned, identity)
    if frozen is None:
        return now
    for key in [*identity, "label_hash", "train_hash", "validation_hash"]:
        if frozen.get(key) != now[key]:
            raise ValueError(f"frozen split does not match: {key}")
    return frozen


#: What a frozen split's folder holds.
FROZEN = ("split_meta.json", "train.csv", "val.csv", "label_to_index.json")


def frozen_at(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds a frozen split; one that holds some of its parts is an error, never a new start."""
    there = [exists(spark, f"{folder}/{x}") for x in FROZEN]
    if any(there) and not all(there):
        raise ValueError(f"{folder} lacks {', '.join(x for x, ok in zip(FROZEN, there, strict=True) if not ok)}")
    return all(there)


def verified(assigned: DataFrame) -> DataFrame:
    """assigned, its lineage cut, if the split does not leak; see contracts.leakage."""
    from plumbline.operators.contracts import leakage

    assigned = cut(assigned)
    if bad := leakage(assigned).where("violations > 0").orderBy("ord").first():
        raise ValueError(f"{bad['check']}: {bad['violations']}")
    return assigned
