import zlib

from pyspark.sql import functions as F

from plumbline.llm import sharding
from tests.conftest import SF


def check(got, docs, shards):
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return {k: sum(r.size for r in v) for k, v in by.items()}


def test_bytes_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = sharding.shard(docs).collect()
    sizes = check(got, docs.collect(), 24)
    assert len(sizes) == 24 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = sharding.op5_sharding(spark, SF).collect()
    largest = max(len(t.encode()) + 8 for t in docs.values())
    sizes = check(got, docs, 24)
    assert max(sizes.values()) - sum(sizes.values()) / 24 <= largest
    for r in got:
        assert r.size == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None


def test_hot_group_is_divided_and_small_ones_are_not(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x" * 500).otherwise(F.concat(F.lit("y" * 500), F.floor(F.col("id") / 6).cast("string"))).alias("text"))
    got = sharding.shard(docs, 8).collect()
    sizes = check(got, docs.collect(), 8)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    where = {}
    for r in got:
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(v) > 1 for v in where.values()) == 1


def test_more_splitters_for_overfull_ranges(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERSAMPLE", 1)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("z"), (F.col("id") % 97 * 10).cast("int")).alias("text"))
    sizes = check(sharding.shard(docs, 4).collect(), docs.collect(), 4)
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_odd_rows(spark, odd, none):
    got = sharding.shard(odd, 3).collect()
    check(got, odd.collect(), 3)
    assert sum(r.size == 8 for r in got) >= 3
    assert sharding.shard(none).count() == 0


def test_repeated_rows_are_parted(spark, monkeypatch):
    """Rows equal in id and text, and null ids of one text, are in many ranges and in shards of near equal bytes."""
    monkeypatch.setattr(sharding, "RANGE_BYTES", 1 << 10)
    docs = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(None).cast("long")).otherwise(F.lit(7)).alias("doc_id"), F.lit("x" * 300).alias("text"))
    asked = []
    plain = sharding._range_of
    monkeypatch.setattr(sharding, "_range_of", lambda bounds: asked.append(bounds) or plain(bounds))
    sizes = check(sharding.shard(docs, 6).collect(), docs.collect(), 6)
    assert len(sizes) == 6 and max(sizes.values()) <= 1.02 * min(sizes.values())
    assert len(asked[-1]) > 100
