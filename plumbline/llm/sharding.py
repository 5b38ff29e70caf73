"""Shards of near equal bytes by sampled splitters; DataFrame functions only."""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.runtime import cut

#: Ranges that records are dealt to: more for more bytes, but never more splitters than the driver and a plan hold with ease.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 16 << 20, 64, 4096
#: Key samples for each range.
OVERSAMPLE = 16
#: Times that overfull ranges are looked at and subdivided at most.
ROUNDS = 4
#: A group of copies of over this part of a shard is divided at shard bounds; a smaller one stays in one shard.
LARGE_GROUP = 0.01


def _literal(values: list, kind: str) -> Column:
    """An array literal of a bounded number of values, read from JSON so that the plan stays small."""
    return F.from_json(F.lit("[" + ",".join(values) + "]"), f"array<{kind}>")


def _range_of(splitters: list[tuple[int, int, int]]) -> Column:
    """How many splitters are at most the row's key, by binary search over a literal array."""
    if not splitters:
        return F.lit(0)
    steps = math.ceil(math.log2(len(splitters) + 1))
    bounds = _literal([f'{{"h":{h},"g":{g},"s":{s}}}' for h, g, s in splitters], "struct<h:bigint,g:bigint,s:bigint>")
    powers = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    reach = lambda at, step: (at + step <= len(splitters)) & (F.get(bounds, at + step - 1) <= F.struct("h", "g", "s"))
    return F.aggregate(powers, F.lit(0), lambda at, step: F.when(reach(at, step), at + step).otherwise(at))


def _splitters(sample: list[tuple[int, int, int, float]], parts: int) -> list[tuple[int, int, int]]:
    """parts - 1 quantile boundaries of a weighted sample of keys. A boundary within a group of copies that
    the sample holds but once or twice moves to the group's start, so that small groups are not cut."""
    sample.sort()
    often: dict[int, int] = {}
    for h, *_ in sample:
        often[h] = often.get(h, 0) + 1
    total, seen, out = sum(x[3] for x in sample), 0.0, []
    for h, g, s, w in sample:
        if len(out) + 1 < parts and seen + w > total * (len(out) + 1) / parts:
            out.append((h, g, s) if often[h] > 2 else (h, -(1 << 63), -(1 << 63)))
            while len(out) + 1 < parts and seen + w > total * (len(out) + 1) / parts:
                out.append(out[-1])
        seen += w
    return sorted(set(out))


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of docs in one of `shards` shards of near equal bytes.

    A row's size is its text's UTF-8 bytes plus 8 (null: 8, with the CRC of no bytes). Keys order rows by text, then id, each by
    hash, then by a hash of the row's number, so that rows equal in both can be parted too. Keys drawn with a chance in
    proportion to size give quantile boundaries of many more ranges than shards; rows are dealt to ranges, ranges of over
    twice the mean get more boundaries from further samples of their own, and exact range totals then place each row on
    the line of all bytes, which is cut in `shards` equal pieces. Groups of equal texts stay in one shard unless they hold over 1 % of a
    shard's bytes. Slots run from 0 without gaps in key order.

    Texts are read once and are in no shuffle. Each range is sorted in one task, and its rows are a
    few numbers each. Null ids and texts have hashes like other values; repeated rows get one slot each
    (which of them gets which does not matter, as they are equal); an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.lit("text"), F.col(text_col)).alias("h"),
        F.xxhash64(F.lit("row"), F.col(id_col)).alias("g"),
        F.xxhash64(F.lit("number"), F.monotonically_increasing_id()).alias("s"),
    )
    rows = cut(rows)
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = min(MOST_RANGES, max(LEAST_RANGES, total // RANGE_BYTES))

    def sample(of: DataFrame, held: int, wanted: float, salt: str) -> list[tuple[int, int, int, float]]:
        """Keys of rows of `held` bytes, drawn one by one with the chance size x rate, at most 1; a row of more weighs more."""
        rate = wanted / held
        draw = (F.xxhash64(F.lit(salt), "h", "g", "s").bitwiseAND(F.lit((1 << 40) - 1))).cast("double") / float(1 << 40)
        return [tuple(r) for r in of.where(draw < F.col("size") * rate).select("h", "g", "s", F.greatest(F.lit(1.0), F.col("size") * rate)).collect()]

    def totals(bounds: list[tuple[int, int, int]]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        placed = rows.withColumn("r", _range_of(bounds))
        return placed, {r[0]: (r[1], r[2]) for r in placed.groupBy("r").agg(F.sum("size"), F.count("*")).collect()}

    bounds = _splitters(sample(rows, total, ranges * OVERSAMPLE, "first"), ranges)
    placed, sums = totals(bounds)
    for again in range(ROUNDS):
        over = {r: b for r, (b, n) in sums.items() if b > 2 * total / ranges and n > 1}
        if not over:
            break
        hot = sum(over.values())
        inside: dict[int, list] = {r: [] for r in over}
        for x in sample(placed.where(F.col("r").isin(list(over))), hot, OVERSAMPLE * math.ceil(hot * ranges / total), f"again {again}"):
            inside[bisect_right(bounds, x[:3])].append(x)
        more = [x for r, b in over.items() for x in _splitters(inside[r], math.ceil(b * ranges / total))]
        if set(more) <= set(bounds):  # a row of its own that is larger than a range
            break
        bounds = sorted({*bounds, *more})
        placed, sums = totals(bounds)

    before = [(0, 0)]
    for r in range(len(bounds) + 1):
        b, n = sums.get(r, (0, 0))
        before.append((before[-1][0] + b, before[-1][1] + n))
    starts = _literal([f'{{"b":{b},"n":{n}}}' for b, n in before], "struct<b:bigint,n:bigint>")
    line = Window.partitionBy("r").orderBy("h", "g", "s")
    group = Window.partitionBy("r", "h")
    placed = placed.withColumns({"end": F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(line)})
    placed = placed.withColumns({"group_bytes": F.sum("size").over(group), "group_end": F.max("end").over(group)})
    at = F.get(starts, F.col("r"))
    middle = F.when(F.col("group_bytes") <= LARGE_GROUP * total / shards, F.col("group_end") - F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = placed.select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor((at["b"] + middle) * shards / total)).cast("int").alias("shard"), (at["n"] + F.col("n") - 1).alias("place"))
    placed = cut(placed)
    first = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row for each shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
