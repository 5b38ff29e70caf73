"""Queries over the split against their SQL, where equal texts have several labels."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.plans.catalog import QUERIES, SQL
from tests.compare import rows
from tests.conftest import SF

SPLITS = "split_assign split_counts split_meta split_leakage split_accounting crosstab_split class_distribution class_weights".split()


@pytest.fixture(scope="module")
def conflicting(spark, tmp_path_factory):
    """A folder of documents of which some of one language hold the text of another's, alone, in a family and in many copies."""
    d = tmp_path_factory.mktemp("conflicts")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.lang: r.text for r in docs.groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    a, b, *_ = sorted(first)
    text = F.when((F.col("lang") == b) & (F.col("doc_id") % 5 == 0), F.lit(first[a])).when((F.col("lang") == a) & (F.col("doc_id") % 17 == 3), F.lit("short")).when((F.col("lang") == b) & (F.col("doc_id") % 7 == 1), F.lit("short")).otherwise(F.col("text"))
    docs.withColumn("text", text).coalesce(1).write.parquet(f"{d}/written")
    (part,) = (d / "written").glob("*.parquet")
    shutil.move(part, d / "documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", SPLITS)
def test_query_matches_sql(name, spark, conflicting):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{conflicting}/documents.parquet'")
    assert con.sql("SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1)").fetchall()[0][0] >= 2
    assert rows(QUERIES[name](spark, conflicting).toPandas()) == rows(con.sql(SQL[name]).df())
