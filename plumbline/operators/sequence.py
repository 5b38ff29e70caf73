"""Ordered algorithms: islands, allocation, reading order, grids, profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.runtime import cut


def islands(series: DataFrame, key: str, x: str, low: str, most: float = 1) -> DataFrame:
    """(key, begin, end, length) of runs of consecutive x where `low` is at most `most`; end exclusive."""
    w = Window.partitionBy(key).orderBy(x)
    s = series.where(F.col(low) <= most).withColumn("g", F.col(x) - F.row_number().over(w))
    return s.groupBy(key, "g").agg(F.min(x).alias("begin"), (F.max(x) + 1).alias("end"), F.count("*").alias("length")).drop("g")


def numbered(rows: DataFrame, *order, name: str = "n") -> DataFrame:
    """rows with their number from 0 in an order that must tell all rows apart.

    Rows are dealt out in ranges of the order; a row's number is its place in its range and the rows of the ranges
    before, of which there is one count each, so that no task holds or sorts all rows.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))  # a row for each range
    return dealt.withColumn(name, place).join(F.broadcast(starts), "__part").withColumn(name, (F.col(name) + F.col("__start")).cast("long")).drop("__part", "__start")


def jobs(spark: SparkSession, team: int, rounds: int, total: int = 41) -> DataFrame:
    """(round, member, job) of a round-robin allocation, jobs from 1 to total."""
    if team not in (6, 7) or rounds < 1:
        raise ValueError("a team has 6 or 7 members, and there is one round at least")
    grid = spark.range(1, rounds + 1).select(F.col("id").cast("int").alias("round")).crossJoin(spark.range(1, team + 1).select(F.col("id").cast("int").alias("member")))
    return grid.withColumn("job", ((F.col("round") - 1) * team + F.col("member")).cast("int")).where(F.col("job") <= total)


def allocated(rows: DataFrame, team: int, *order: str) -> DataFrame:
    """rows with (round, member, job) of a round-robin allocation in an order that must tell them apart, jobs from 1."""
    n = F.col("__n")
    rows = numbered(rows, *order, name="__n")
    return rows.withColumns({"round": F.expr(f"__n div {team} + 1").cast("int"), "member": (n % team + 1).cast("int"), "job": (n + 1).cast("int")}).drop("__n")


def job_coverage(allocation: DataFrame, total: int = 41) -> DataFrame:
    """One row: jobs allocated, distinct ones, and whether each from 1 to total is there once."""
    g = allocation.agg(F.count("*").alias("n"), F.countDistinct("job").alias("distinct_jobs"), F.min("job").alias("lo"), F.max("job").alias("hi"))
    return g.withColumn("ok", F.expr(f"n = {total} and distinct_jobs = {total} and lo = 1 and hi = {total}"))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (first, cy, near, ...) with `line`, from 0 on each page, from rows page by page by centre.

    A line that a centre is too far below is below all later ones too, so the last line alone is open, and a sum and a
    count are all that is held of a page, however many boxes it has.
    """
    line, total, count = 0, 0.0, 0
    for batch in batches:
        out = []
        for first, cy, near in zip(*(batch.column(c).to_pylist() for c in ("first", "cy", "near")), strict=True):
            if first:
                line, total, count = 0, cy, 1
            elif abs(cy - total / count) <= near:
                total, count = total + cy, count + 1
            else:
                line, total, count = line + 1, cy, 1
            out.append(line)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "line"])


def reading_order(boxes: DataFrame, page: str = "page") -> DataFrame:
    """boxes (page, box_id, x1, y1, x2, y2) with line and position in reading order.

    By centre from the top, a box joins the first line whose mean centre is within 0.6 x the mean height. Pages are
    dealt out and sorted by Spark, and their boxes pass in batches.
    """
    columns = ["x1", "y1", "x2", "y2"]
    b = boxes.select(F.col(page).alias("page"), "box_id", *[F.col(c).cast("double").alias(c) for c in columns]).repartition("page")
    b = b.withColumn("cy", F.coalesce((F.col("y1") + F.col("y2")) / 2, F.lit(float("nan"))))  # unknown centres are last, each a line
    height = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    order = [F.asc_nulls_last(c) for c in ("cy", "x1", "box_id")]
    b = b.withColumn("near", F.avg(height).over(Window.partitionBy("page")) * 0.6)
    b = b.withColumn("first", F.row_number().over(Window.partitionBy("page").orderBy(*order)) == 1)
    b = b.sortWithinPartitions("page", *order)
    kind = ", ".join(f"{c} {t}" for c, t in b.dtypes)
    b = b.mapInArrow(_lines, f"{kind}, line int")
    place = Window.partitionBy("page").orderBy("line", F.asc_nulls_last("x1"), *order[::2])
    return b.select(F.col("page").alias(page), "box_id", *columns, "line", (F.row_number().over(place) - 1).alias("position"))


def zipped(df: DataFrame, boxes: str, scores: str) -> DataFrame:
    """A row for each box with its score, from two parallel arrays."""
    z = df.withColumn("z", F.explode(F.arrays_zip(F.col(boxes).alias("box"), F.col(scores).alias("score"))))
    return z.select(*[c for c in df.columns if c not in (boxes, scores)], F.col("z.box").alias("box"), F.col("z.score").alias("score"))


def ink_bounds(pixels: DataFrame, key: str = "image", dark: int = 190) -> DataFrame:
    """(key, left, top, right, bottom) of ink in pixels (key, x, y, v, w): rows with max(2, w div 500) dark pixels, then
    columns with 2 from the first to the last of these rows; right and bottom exclusive. An image without ink has no row."""
    d = pixels.where(F.col("v") < dark)
    rows = d.groupBy(key, "y").agg(F.count("*").alias("n"), F.max("w").alias("w")).where("n >= greatest(2, w div 500)").groupBy(key).agg(F.min("y").alias("top"), (F.max("y") + 1).alias("bottom"))
    columns = d.join(rows, key).where("y >= top and y < bottom").groupBy(key, "x").agg(F.count("*").alias("n"), F.first("top").alias("top"), F.first("bottom").alias("bottom")).where("n >= 2")
    return columns.groupBy(key).agg(F.min("x").alias("left"), F.first("top").alias("top"), (F.max("x") + 1).alias("right"), F.first("bottom").alias("bottom"))


def pool(pixels: DataFrame, key: str = "image", size: int = 2) -> DataFrame:
    """(key, r, c, v): maxima of size x size cells of a matrix (key, r, c, v)."""
    return pixels.groupBy(key, F.floor(F.col("r") / size).cast("int").alias("r"), F.floor(F.col("c") / size).cast("int").alias("c")).agg(F.max("v").alias("v"))


def convolve(pixels: DataFrame, kernel: list[list[float]], key: str = "image") -> DataFrame:
    """(key, r, c, v): the valid cross-correlation of a matrix with a small kernel."""
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(v)).alias("k")) for i, row in enumerate(kernel) for j, v in enumerate(row)])
    t = pixels.select(key, "r", "c", "v", F.explode(taps).alias("t")).select(key, (F.col("r") - F.col("t.i")).alias("r"), (F.col("c") - F.col("t.j")).alias("c"), (F.col("v") * F.col("t.k")).alias("p"))
    return t.groupBy(key, "r", "c").agg(F.sum("p").alias("v"), F.count("*").alias("n")).where(F.col("n") == len(kernel) * len(kernel[0])).drop("n")
