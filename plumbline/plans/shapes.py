"""Queries over characters, boxes, grids, series and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import paths, values
from plumbline.operators import sequence
from plumbline.plans.registry import query
from plumbline.sources.views import table


@query(
    """SELECT label, CAST(CASE WHEN regexp_full_match(label, '[0-9]+') THEN TRY_CAST(label AS INTEGER) WHEN length(c) <> 1 THEN NULL WHEN unicode(c) BETWEEN 3585 AND 3642 OR unicode(c) BETWEEN 3647 AND 3675 THEN unicode(c) - 3424
  WHEN unicode(c) < 128 THEN unicode(c) END AS INTEGER) AS code
FROM (SELECT label, substr(label, strpos(label, '_') + 1) AS c FROM (SELECT p || '_' || chr(CAST(p AS INTEGER)) AS label FROM (SELECT unnest(range(40, 60)) AS p UNION ALL SELECT unnest(range(3580, 3680)))
  UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT s_suppkey || '_' || s_name FROM supplier))"""
)
def tis620_codes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a number and a character, numbers alone, and labels of many characters, which have no code."""
    points = spark.range(40, 60).union(spark.range(3580, 3680)).select(F.col("id").cast("int").alias("point"))
    ch = F.decode(F.unhex(F.lpad(F.hex("point"), 4, "0")), "UTF-16BE")
    s = table(spark, d, "supplier")
    labels = points.select(F.concat_ws("_", F.col("point").cast("string"), ch).alias("label")).union(s.select(F.col("s_suppkey").cast("string"))).union(s.select(F.concat_ws("_", F.col("s_suppkey").cast("string"), "s_name")))
    return labels.select("label", values.label_code(F.col("label")).alias("code"))


_BOX = "SELECT o_orderkey AS box_id, o_custkey AS page, (o_orderkey * 7 % 900)::DOUBLE AS x1, (o_orderkey * 13 % 600)::DOUBLE AS y1, (o_orderkey * 7 % 900 + 20 + o_orderkey % 60)::DOUBLE AS x2, (o_orderkey * 13 % 600 + 15 + o_orderkey % 40)::DOUBLE AS y2 FROM orders"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    x, y = (o * 7 % 900).cast("double"), (o * 13 % 600).cast("double")
    return table(spark, d, "orders").select(o.alias("box_id"), F.col("o_custkey").alias("page"), x.alias("x1"), y.alias("y1"), (x + 20 + o % 60).alias("x2"), (y + 15 + o % 40).alias("y2"))


@query(
    f"""SELECT box_id, CAST(greatest(0, floor(x1 - (x2 - x1) * 0.125)) AS BIGINT) AS x1, CAST(greatest(0, floor(y1 - (y2 - y1) * 0.125)) AS BIGINT) AS y1,
  CAST(least(920, ceil(x2 + (x2 - x1) * 0.125)) AS BIGINT) AS x2, CAST(least(620, ceil(y2 + (y2 - y1) * 0.125)) AS BIGINT) AS y2 FROM ({_BOX})"""
)
def bbox_expand(spark: SparkSession, d: str) -> DataFrame:
    b = values.expand_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.lit(920), F.lit(620), 0.125)
    return _boxes(spark, d).select("box_id", b.alias("b")).select("box_id", "b.*")


@query("SELECT o_orderkey, CAST(o_custkey % 72 // 8 AS INTEGER) AS row, CAST(o_custkey % 72 % 8 AS INTEGER) AS col FROM orders")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", values.grid_cell(F.col("o_custkey") % 72).alias("c")).select("o_orderkey", "c.*")


@query(
    f"""WITH RECURSIVE b AS (
  SELECT *, (y1 + y2) / 2 AS cy, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) / 2, x1, box_id) AS i, 0.6 * avg(greatest(1, y2 - y1)) OVER (PARTITION BY page) AS near FROM ({_BOX})
), walk AS (
  SELECT page, i, [cy] AS sums, [1] AS sizes, 1 AS line FROM b WHERE i = 1
  UNION ALL
  SELECT page, i, CASE WHEN k = 0 THEN list_append(sums, cy) ELSE list_transform(sums, lambda x, j: CASE WHEN j = k THEN x + cy ELSE x END) END,
    CASE WHEN k = 0 THEN list_append(sizes, 1) ELSE list_transform(sizes, lambda x, j: CASE WHEN j = k THEN x + 1 ELSE x END) END, CASE WHEN k = 0 THEN len(sums) + 1 ELSE k END
  FROM (SELECT w.page, b.i, b.cy, sums, sizes, coalesce(list_position(list_transform(sums, lambda x, j: abs(b.cy - x / sizes[j]) <= b.near), true), 0) AS k FROM walk w JOIN b ON b.page = w.page AND b.i = w.i + 1)
), last AS (SELECT page, arg_max(sums, i) AS sums, arg_max(sizes, i) AS sizes FROM walk GROUP BY page
), lines AS (SELECT page, k, row_number() OVER (PARTITION BY page ORDER BY sums[k] / sizes[k], k) - 1 AS line FROM (SELECT *, unnest(range(1, len(sums) + 1)) AS k FROM last))
SELECT b.page, box_id, x1, y1, x2, y2, CAST(lines.line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY b.page ORDER BY lines.line, x1, b.i) - 1 AS INTEGER) AS position
FROM b JOIN walk USING (page, i) JOIN lines ON lines.page = b.page AND lines.k = walk.line"""
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return sequence.reading_order(_boxes(spark, d))


_SERIES = "SELECT event_type AS key, event_id // 20 AS x, count(*) FILTER (value > 60) AS n FROM events GROUP BY 1, 2"


@query(
    f"""SELECT key, CAST(min(x) AS BIGINT) AS begin, CAST(max(x) + 1 AS BIGINT) AS "end", count(*) AS length
FROM (SELECT key, x, x - row_number() OVER (PARTITION BY key ORDER BY x) AS g FROM ({_SERIES}) WHERE n <= 1) GROUP BY key, g"""
)
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("key"), F.expr("event_id div 20").alias("x")).agg(F.count_if(F.col("value") > 60).alias("n"))
    return sequence.islands(s, "key", "x", "n")


@query("SELECT CAST(least(floor(v * 4), 3) AS INTEGER) AS bin, count(*) AS n FROM (SELECT (event_id % 101) / 100 AS v FROM events) GROUP BY 1")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(values.bin_of(F.col("event_id") % 101 / 100).alias("bin")).agg(F.count("*").alias("n"))


_PIX = "SELECT l_suppkey AS image, CAST(l_orderkey % 8 AS INTEGER) AS r, CAST(l_linenumber % 8 AS INTEGER) AS c, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") % 8).cast("int").alias("r"), (F.col("l_linenumber") % 8).cast("int").alias("c")).agg(F.max("l_quantity").alias("v"))


@query(f"SELECT image, r // 2 AS r, c // 2 AS c, max(v) AS v FROM ({_PIX}) GROUP BY 1, 2, 3")
def pool_2x2(spark: SparkSession, d: str) -> DataFrame:
    return sequence.pool(_pixels(spark, d))


@query(
    f"""WITH p AS ({_PIX}), k AS (SELECT * FROM (VALUES (0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.5), (1, 1, -1.0)) t(i, j, w))
SELECT image, r - i AS r, c - j AS c, round(sum(v * CAST(w AS DOUBLE)), 6) AS v FROM p, k GROUP BY 1, 2, 3 HAVING count(*) = 4"""
)
def convolution(spark: SparkSession, d: str) -> DataFrame:
    return sequence.convolve(_pixels(spark, d), [[1.0, 2.0], [0.5, -1.0]]).withColumn("v", F.round("v", 6))


_INK = """SELECT l_suppkey AS image, l_partkey % 40 AS x, l_orderkey % 30 AS y, CAST(l_quantity * 6 AS INTEGER) AS v, 1600 AS w FROM lineitem
UNION ALL SELECT s_suppkey, 90 + i, 60 + i * 2, 0, 1600 FROM supplier, range(2) t(i)"""


@query(
    f"""WITH p AS ({_INK}), y AS (SELECT image, y FROM p WHERE v < 190 GROUP BY 1, 2 HAVING count(*) >= 3), yy AS (SELECT image, min(y) AS top, max(y) + 1 AS bottom FROM y GROUP BY 1),
x AS (SELECT image, x, top, bottom FROM p JOIN yy USING (image) WHERE v < 190 AND y >= top AND y < bottom GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2)
SELECT image, min(x) AS "left", top, max(x) + 1 AS "right", bottom FROM x GROUP BY image, top, bottom"""
)
def ink_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Each image has two stray pixels below its ink, which are no ink."""
    li = table(spark, d, "lineitem")
    p = li.select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_orderkey") % 30).alias("y"), (F.col("l_quantity") * 6).cast("int").alias("v"), F.lit(1600).alias("w"))
    stray = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    return sequence.ink_bounds(p.union(stray.select("image", F.lit(90) + F.col("i"), F.lit(60) + F.col("i") * 2, F.lit(0), F.lit(1600))))


@query("SELECT page_id, nullif(regexp_extract(u, '^https://[^/]*/file/d/([^/]+)', 1), '') AS file_id FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://drive.example.com/file/d/id' || CAST(page_id AS VARCHAR) || '/view' ELSE url END AS u FROM pages)")
def drive_ids(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://drive.example.com/file/d/id"), F.col("page_id").cast("string"), F.lit("/view"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", paths.drive_file_id(u).alias("file_id"))


@query("SELECT c_custkey, substr(sha256(c_name), 1, 12) AS short_id, regexp_matches(c_name, '^[A-Za-z0-9_-]+$') AS plain FROM customer")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", values.short_hash(F.col("c_name")).alias("short_id"), values.identifier(F.col("c_name")).alias("plain"))


@query("SELECT p_partkey, CAST(floor((p_size + 2 - 3) / 2) + 1 AS BIGINT) AS size FROM part")
def conv_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", values.conv_size(F.col("p_size"), 3, 2, 1).alias("size"))


@query("SELECT p_partkey, CAST(split_part(p_brand, '#', 2) AS INTEGER) AS prefix FROM part")
def numeric_prefixes(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat(F.split("p_brand", "#")[1], F.lit("_x"))
    return table(spark, d, "part").select("p_partkey", paths.numeric_prefix(label).alias("prefix"))
