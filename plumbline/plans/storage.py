"""Queries that go through files: sinks write what sources read again; and the columns that go with them."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import paths, values
from plumbline.operators import contracts, kernels, runs, scoring, sequence, split
from plumbline.plans.registry import query
from plumbline.runtime import checkpoint_dir
from plumbline.sources import archives, files, sinks
from plumbline.sources.views import RECEIPTS_SQL, manifest, manifest_sql, receipts, table

M = f"WITH {manifest_sql()}"


def new_folder(spark: SparkSession) -> str:
    """A new folder where all executors see it."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _put(folder: str, contents: dict[str, bytes]) -> str:
    """A few small files of a fixture."""
    system, where = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
    for name, data in contents.items():
        system.create_dir(f"{where}/{name}".rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{where}/{name}") as out:
            out.write(data)
    return folder


@query(f"{M} SELECT path, coalesce(label, '') AS label, sha AS sha256, source_id FROM manifest")
def manifest_csv(spark: SparkSession, d: str) -> DataFrame:
    """A manifest written as CSV and read again by its schema."""
    folder = new_folder(spark)
    sinks.write_csv(manifest(spark, d), folder, "path", "label", "sha256", "source_id")
    return files.csv_manifest(spark, folder)


@query(f"WITH {RECEIPTS_SQL} SELECT run_id, candidate, seed, val_macro_f1, status, training_seconds FROM receipts")
def receipt_documents(spark: SparkSession, d: str) -> DataFrame:
    """A receipt document of each run, of which there are a few, read again by a glob."""
    folder, kept = new_folder(spark), receipts(spark, d).select("run_id", "candidate", "seed", "val_macro_f1", "status", "training_seconds")
    _put(folder, {f"{r.run_id}/run_receipt.json": kept_json(r) for r in kept.collect()})
    return files.receipts(spark, f"{folder}/*/run_receipt.json", kept.schema).drop("file")


def kept_json(row) -> bytes:
    import json

    return json.dumps(row.asDict(), indent=2, ensure_ascii=False).encode()


@query(f"WITH {RECEIPTS_SQL} SELECT run_id, CASE WHEN run_seq % 3 = 0 THEN 'done' ELSE status END AS status FROM receipts")
def appended_status(spark: SparkSession, d: str) -> DataFrame:
    """A status table that is appended to, the last status of each run."""
    folder, r = new_folder(spark), receipts(spark, d)
    sinks.append_status(r.select("run_id", F.lit(1).alias("seq"), "status"), folder)
    sinks.append_status(r.where("run_seq % 3 = 0").select("run_id", F.lit(2).alias("seq"), F.lit("done").alias("status")), folder)
    return runs.last_status(spark.read.parquet(folder))


_IMAGE = "SELECT n_nationkey AS k, r_name, CASE WHEN n_nationkey % 7 = 5 THEN '' ELSE r_name || '/' END || n_nationkey || '.png' AS path FROM nation JOIN region ON n_regionkey = r_regionkey"


def _images(spark: SparkSession, d: str) -> str:
    """A tree with an image for each nation below its region: some broken, some without a folder, one hidden."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect()  # 25 rows
    content = {}
    for r in rows:
        k = r.n_nationkey
        content[("" if k % 7 == 5 else f"{r.r_name}/") + f"{k}.png"] = b"broken" if k % 7 == 3 else files.png(4 + k, 4 + k, (9 * k, 10, 20))
    return _put(new_folder(spark), {**content, ".cache/x.png": files.png(2, 2, (0, 0, 0)), "notes.txt": b"no image"})


@query(
    f"""SELECT path, CASE WHEN k % 7 <> 5 THEN r_name END AS label, CAST(CASE WHEN k % 7 = 3 THEN -1 ELSE 4 + k END AS INTEGER) AS width, CAST(CASE WHEN k % 7 = 3 THEN -1 ELSE 3 END AS INTEGER) AS channels,
  CASE k % 7 WHEN 5 THEN 'no label folder' WHEN 3 THEN 'corrupt' END AS error, CASE WHEN k % 7 <> 3 THEN (4 + k) || 'x' || (4 + k) END AS resolution FROM ({_IMAGE})"""
)
def image_audit(spark: SparkSession, d: str) -> DataFrame:
    got = files.images(spark, _images(spark, d))
    return got.select("path", "label", "width", "channels", "error", F.when(F.col("width") > 0, paths.resolution(F.col("width"), F.col("height"))).alias("resolution"))


@query(
    f"""SELECT path, CASE WHEN k % 7 <> 3 THEN CAST(3 * 16 * 16 AS INTEGER) END AS n, CASE WHEN k % 7 <> 3 THEN round((9 * k / 255 - 0.5) / 0.5, 4) END AS red, CASE WHEN k % 7 <> 3 THEN round((20 / 255 - 0.5) / 0.5, 4) END AS blue, k % 7 = 3 AS failed FROM ({_IMAGE})"""
)
def image_tensors(spark: SparkSession, d: str) -> DataFrame:
    """Images decoded, fitted to a square and normalised, an error in its row."""
    root = _images(spark, d)
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.png").load(root)
    t = kernels.tensors(images, 16, [0.5] * 3, [0.5] * 3)
    name = F.regexp_extract(files.origin(), r"/[0-9a-f]{32}/(.*)$", 1)
    return t.select(name.alias("path"), F.when(F.col("error").isNull(), F.size("tensor")).alias("n"), F.round(F.get("tensor", F.lit(0)).cast("double"), 4).alias("red"), F.round(F.get("tensor", F.lit(767)).cast("double"), 4).alias("blue"), F.col("error").isNotNull().alias("failed"))


@query(f"SELECT path, k % 7 <> 3 AS valid FROM ({_IMAGE})")
def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    got = files.discover(spark, _images(spark, d))
    return got.select(F.regexp_extract("path", r"/[0-9a-f]{32}/(.*)$", 1).alias("path"), (F.col("length") > 6).alias("valid"))


def _zipped(rows: DataFrame, folder: str) -> DataFrame:
    """(archive, n): archives in a folder that all executors see, each written where its rows (archive, member, text) are."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, name, n = None, None, 0
        for batch in batches:
            for archive, member, text in zip(batch["archive"], batch["member"], batch["text"], strict=True):
                if archive != name:
                    if open_:
                        open_.close()
                        yield pd.DataFrame([(name, n)], columns=["archive", "n"])
                    system, where = archives.located(f"{folder}/{archive}")
                    open_, name, n = zipfile.ZipFile(system.open_output_stream(where), "w", zipfile.ZIP_DEFLATED), archive, 0
                open_.writestr(zipfile.ZipInfo(member), text or "", zipfile.ZIP_DEFLATED if n % 2 else zipfile.ZIP_STORED)
                n += 1
        if open_:
            open_.close()
            yield pd.DataFrame([(name, n)], columns=["archive", "n"])

    return rows.repartition("archive").sortWithinPartitions("archive", "member").mapInPandas(write, "archive string, n long")


_IN = "'texts ' || doc_id % 16 || '.zip'"


@query(
    f"""SELECT {_IN} AS archive, lang || '/' || doc_id || '.txt' AS member, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256, false AS failed FROM documents
UNION ALL SELECT 'broken.zip', NULL, NULL, NULL, true"""
)
def zip_contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents put into archives, read again member by member; one file is no archive."""
    folder, docs = new_folder(spark), table(spark, d, "documents")
    _put(folder, {"broken.zip": b"PK no archive"})
    rows = docs.select(F.concat(F.lit("texts "), (F.col("doc_id") % 16).cast("string"), F.lit(".zip")).alias("archive"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("member"), "text")
    _zipped(rows, folder).agg(F.sum("n")).collect()
    got = archives.zip_members(spark, folder, 1 << 20)
    return got.select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "member", "size", "sha256", F.col("error").isNotNull().alias("failed"))


@query("SELECT 'wrap/P-' || n_nationkey || '-' || (161 + n_nationkey) || '-0F-' || n_regionkey || '.png' AS member, CAST(n_nationkey + 1 AS BIGINT) AS size, CAST(161 + n_nationkey AS VARCHAR) AS code, CAST(n_nationkey AS VARCHAR) AS writer FROM nation")
def archive_codes(spark: SparkSession, d: str) -> DataFrame:
    """Members of a ZIP for each region, their codes and writers."""
    zips: dict[int, io.BytesIO] = {}
    for r in table(spark, d, "nation").collect():  # 25 rows
        with zipfile.ZipFile(zips.setdefault(r.n_regionkey, io.BytesIO()), "a") as z:
            z.writestr(f"wrap/P-{r.n_nationkey}-{161 + r.n_nationkey}-0F-{r.n_regionkey}.png", b"x" * (r.n_nationkey + 1))
    root = _put(new_folder(spark), {f"{k}.zip": v.getvalue() for k, v in zips.items()})
    return files.archive_members(spark, root).select("member", "size", "code", paths.writer_id(F.col("member")).alias("writer"))


@query(
    """SELECT p.page_id || '/' || i || '.png' AS path, CAST(i AS VARCHAR) AS label, 'p' || p.page_id AS source_page, CASE WHEN i <> 2 THEN sha256(p.page_id || '/' || i || '.png') END AS sha256
FROM (SELECT page_id, unnest(range(page_id % 4)) AS i FROM pages) p"""
)
def crops_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page records flattened to crops, with the hashes of their files; each third crop's file is missing."""
    i = F.sequence(F.lit(0), F.col("page_id") % 4 - 1)
    crop = lambda k: F.struct(F.concat_ws("/", F.col("page_id").cast("string"), F.concat(k.cast("string"), F.lit(".png"))).alias("path"), k.cast("string").alias("label"), k.cast("int").alias("row"), F.lit(0).alias("column"))
    pages = table(spark, d, "pages").where("page_id % 4 > 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_page"), F.lit("w").alias("writer_id"), F.lit("c").alias("capture_id"), F.transform(i, crop).alias("crops"))
    there = pages.select(F.explode("crops").alias("c")).where("c.row <> 2").select("c.path", values.sha256(F.col("c.path")).alias("sha256"))
    return files.page_crops(pages, there).select("path", "label", "source_page", "sha256")


@query(
    """WITH t AS (SELECT 'd' || doc_id AS path, lang AS label FROM documents), f AS (
  SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 13 = 1 THEN 'xx' ELSE lang END AS truth, CASE doc_id % 17 WHEN 1 THEN 1.5 WHEN 2 THEN NULL ELSE 0.5 END AS confidence FROM documents WHERE doc_id % 19 <> 3
  UNION ALL SELECT 'd' || doc_id, lang, 0.5 FROM documents WHERE doc_id % 23 = 4)
SELECT 1 AS ord, 'duplicates' AS "check", (SELECT count(*) FROM (SELECT path FROM f GROUP BY path HAVING count(*) > 1)) AS violations
UNION ALL SELECT 2, 'coverage', (SELECT count(*) FROM t WHERE path NOT IN (SELECT path FROM f)) UNION ALL SELECT 3, 'truth', (SELECT count(*) FROM f JOIN t USING (path) WHERE label IS DISTINCT FROM truth)
UNION ALL SELECT 4, 'confidence', (SELECT count(*) FROM f WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false))"""
)
def prediction_contract(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with each of the faults that a run's file can have."""
    docs = table(spark, d, "documents").withColumn("path", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    i = F.col("doc_id")
    found = docs.where(i % 19 != 3).select("path", F.when(i % 13 == 1, "xx").otherwise(F.col("lang")).alias("true_label"), F.lit("x").alias("predicted_label"), F.when(i % 17 == 1, 1.5).when(i % 17 != 2, 0.5).alias("confidence"))
    found = found.union(docs.where(i % 23 == 4).select("path", "lang", F.lit("x"), F.lit(0.5)))
    return contracts.predictions(docs.select("path", F.col("lang").alias("label")), found).select("ord", "check", "violations")


@query(
    """WITH a AS (SELECT n_regionkey AS label, CASE WHEN n_regionkey = 2 THEN 0 ELSE n_nationkey END AS grp, n_regionkey = 4 OR n_nationkey % 5 = 1 AS derived FROM nation)
SELECT label FROM a GROUP BY label HAVING count(DISTINCT CASE WHEN NOT derived THEN grp END) < 2"""
)
def train_only_labels(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("label"), F.when(F.col("n_regionkey") == 2, 0).otherwise(F.col("n_nationkey")).alias("grp"), F.expr("n_regionkey = 4 or n_nationkey % 5 = 1").alias("derived"))
    return split.train_only(n)


@query("SELECT s_suppkey, CAST((i - 1) // 10 AS INTEGER) AS sheet_row, CAST((i - 1) % 10 AS INTEGER) AS sheet_col FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i FROM supplier)")
def contact_sheet_places(spark: SparkSession, d: str) -> DataFrame:
    return sinks.contact_sheet(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey", "sheet_row", "sheet_col")


@query("SELECT page_id, CAST(i % 8 * 300 + 21 AS INTEGER) AS x0, CAST(i // 8 * 300 + 48 + 21 AS INTEGER) AS y0, CAST((i % 8 + 1) * 300 - 21 AS INTEGER) AS x1, CAST((i // 8 + 1) * 300 - 21 AS INTEGER) AS y1 FROM (SELECT page_id, page_id % 72 AS i FROM pages)")
def form_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Where the inside of each page's cell of a form is."""
    boxes = F.broadcast(spark.createDataFrame([(i, *b) for i, b in enumerate(kernels.grid_boxes(2400, 2700, 9))], "cell int, x0 int, y0 int, x1 int, y1 int"))  # 72 rows
    pages = table(spark, d, "pages").select("page_id", (F.col("page_id") % 72).cast("int").alias("cell"))
    return pages.join(boxes, "cell").drop("cell")


@query("SELECT o_orderkey, 'b' || i AS box, round(o_totalprice * i, 2) AS score, CAST(i - 1 AS INTEGER) AS box_id FROM (SELECT *, unnest(range(1, o_orderkey % 3 + 1)) AS i FROM orders)")
def boxes_with_scores(spark: SparkSession, d: str) -> DataFrame:
    """Parallel arrays of an image's boxes and scores as rows, and the places of the boxes."""
    i = F.filter(F.array(F.lit(1), F.lit(2)), lambda k: k <= F.col("o_orderkey") % 3)
    o = table(spark, d, "orders").select("o_orderkey", F.transform(i, lambda k: F.concat(F.lit("b"), k.cast("string"))).alias("boxes"), F.transform(i, lambda k: F.round(F.col("o_totalprice") * k, 2)).alias("scores"))
    z = sequence.zipped(o, "boxes", "scores")
    return z.join(scoring.crops(o.select("o_orderkey", "boxes")), ["o_orderkey", "box"]).select("o_orderkey", "box", "score", F.col("box_id").cast("int").alias("box_id"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id BETWEEN 10 AND 150 AND doc_id NOT IN (11, 40)")
def rows_in_range(spark: SparkSession, d: str) -> DataFrame:
    return files.row_range(table(spark, d, "documents").select("doc_id", "lang"), 10, 150, [11, 40], key="doc_id")


@query(
    """SELECT c_custkey, replace(replace('<' || c_name || '> & ''q''', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('''', '&#x27;') AS escaped,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'House' ELSE c_mktsegment END || ' [' || c_mktsegment || ']' AS shown, CASE WHEN c_custkey % 2 = 0 THEN 'net.' || c_mktsegment ELSE 'net' END AS model,
  round(c_acctbal * 1000 / nullif(c_custkey % 3, 0), 4) AS ms, c_custkey % 4 = 0 AS allowed, CASE WHEN c_custkey % 5 = 0 THEN '◌' || chr(3633) ELSE c_name END AS marked,
  CASE WHEN c_custkey % 6 = 0 THEN c_custkey || '.0' END AS corner, c_name || '.png' AS relative
FROM customer"""
)
def text_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of reports: escaped and display labels, model names, times, hosts, marks, corners, relative paths."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    url = F.when(k % 4 == 0, "https://drive.example.com/x").when(k % 4 == 1, "http://drive.example.com/x").when(k % 4 == 2, "https://other.example.com/x").otherwise("no url")
    four = F.concat(k.cast("string"), F.lit(",0 8,0 8,9"), F.when(k % 6 == 0, " 0,9").otherwise(""))
    return c.select(
        "c_custkey",
        values.html_escape(F.concat(F.lit("<"), "c_name", F.lit("> & 'q'"))).alias("escaped"),
        values.display_label(F.col("c_mktsegment"), F.create_map(F.lit("BUILDING"), F.lit("House"))).alias("shown"),
        values.model_name(F.lit("net"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("")).alias("model"),
        F.round(values.ms_per_item(F.col("c_acctbal"), k % 3), 4).alias("ms"),
        paths.https_host(url, ("drive.example.com",)).alias("allowed"),
        values.marked(F.when(k % 5 == 0, "ั").otherwise(F.col("c_name"))).alias("marked"),
        F.get(values.corners(four), F.lit(0))["x"].cast("string").alias("corner"),
        paths.relative_to(F.concat(F.lit("data/in/"), "c_name", F.lit(".png")), "data/in").alias("relative"),
    )


@query("SELECT CAST(n_regionkey AS VARCHAR) AS label, count(*) AS n FROM nation GROUP BY 1")
def fixture_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree with a label for each region and an image for each of its nations, all different."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows
    root = _put(new_folder(spark), {f"{r.n_regionkey}/{r.n_nationkey}.png": files.png(8, 8, (10 * r.n_nationkey, 10, 7)) for r in rows})
    return files.images(spark, root).where("error is null").groupBy("label").agg(F.countDistinct("sha256").alias("n"))


@query("SELECT sha256(text) AS sha256 FROM documents WHERE text <> '' GROUP BY 1")
def hashes_seen(spark: SparkSession, d: str) -> DataFrame:
    """The hashes of a training manifest, of which a missing one has none."""
    folder, docs = new_folder(spark), table(spark, d, "documents")
    rows = docs.select(F.lit("p").alias("path"), F.lit("l").alias("label"), F.when(F.col("text") != "", values.sha256(F.col("text"))).otherwise("").alias("sha256"), F.lit("s").alias("source_id"))
    sinks.write_csv(rows, folder, *[f.name for f in T.StructType(files.MANIFEST)])
    return files.seen_hashes(spark, folder).union(files.seen_hashes(spark, f"{folder}-missing"))
