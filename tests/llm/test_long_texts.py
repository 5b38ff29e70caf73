"""Every operator on texts of some megabytes beside short ones."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, decontaminate, langid, passages, pii, prefixes, quality, repair, secrets, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    prose = " ".join(r.choice(words) for _ in range(300_000))
    texts = [prose, prose + " and an end", "again " * 200_000, "x" * 3_000_000, "a.b@" * 300_000, "1 " * 500_000, "short text of a few words", None]
    rows = [(i, t, "en" if i % 2 else "de", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


def test_operators_take_long_texts(spark, long):
    n = long.count()
    assert langid.language_mixture(long, fitted_on=long).where("language.lang is not null").count() == n
    labels = spark.createDataFrame([(0, 1), (6, 0), (1, 1), (4, 0)], "doc_id long, quality int")
    assert quality.quality_scores(long, labels).where("quality_score.score between 0 and 1").count() == n
    assert bpe.tokenise(long.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).where(F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).count() == n
    assert pii.find_personal(long).count() == n
    assert sharding.shard(long, 3).agg(F.sum("size")).first()[0] == long.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0]
    items = long.where("doc_id = 0").select(F.lit(1).alias("item_id"), F.substring("text", 1000, 400).alias("text"))
    hit = {r.doc_id: r.n_hit for r in decontaminate.contamination(long, items).collect()}
    assert hit[0] == hit[1] > 20 and hit[2] == hit[3] == hit[6] == 0
    near = {r.doc_id: r.component_id for r in simhash.near_groups(long).collect()}
    assert near[1] == near[0] == 0
    assert secrets.find_secrets(long).count() == n


def test_passages_of_long_texts(long):
    got = {r.doc_id: r for r in passages.repeated_passages(long).collect()}
    assert got[0].component_id == got[1].component_id == 0
    assert got[0].spans == "0-300000" and got[1].spans == "0-300000"
    assert all(got[i].n_passages == 0 for i in (2, 3, 4, 5, 6, 7))


def test_stages_of_the_pipeline_take_long_texts(spark, long, tmp_path):
    long.where("doc_id = 0").select(F.lit("a").alias("item_id"), F.substring("text", 1000, 400).alias("text")).write.parquet(f"{tmp_path}/benchmark.parquet")
    long.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {name: {r.doc_id for r in stage(spark, long, str(tmp_path)).select("doc_id").collect()} for name, stage in corpus_pipeline.STAGES}
    assert kept["language_id"] <= {0, 1, 2, 3, 4, 6} and {0, 1} <= kept["language_id"]
    assert 0 in kept["near_dedup"] and 1 not in kept["near_dedup"]
    assert kept["decontaminate"] == {2, 3, 4, 5, 6, 7}
    assert kept["mask_pii"] == kept["encode"] == set(range(8))
    masked = {r.doc_id: r for r in corpus_pipeline.mask_pii(spark, long, "").collect()}
    assert masked[0].text == long.where("doc_id = 0").first().text and all(r.text is None or r.n_chars == len(r.text) for r in masked.values())
    assert corpus_pipeline.encode(spark, long, "").where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_new_operators_take_long_texts(spark, long):
    counted = prefixes.prefix_counts(long.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    assert counted.where(F.size("prefix_tokens") == F.length(F.coalesce("text", F.lit(""))) + 1).count() == long.count()
    talk = long.select(F.lit(1).cast("long").alias("conv_id"), F.col("doc_id").alias("turn"), F.when(F.col("doc_id") % 2 == 0, "user").otherwise("assistant").alias("role"), "text")
    assert repair.repair_audit(talk, fault=False).first().blank == 1


def test_a_text_of_twenty_megabytes_in_each_filter(spark):
    """Twenty megabytes in one text beside short ones, through the stages that read whole texts."""
    words = F.lit("the of and to in is that for it was on are as with his they at be this from have or by one had not but what all were ")
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(words, F.lit(180_000))).otherwise(F.concat(words, F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert docs.agg(F.max(F.length("text"))).first()[0] > 20_000_000
    items = spark.createDataFrame([("x", "nothing of this stands in any of the texts at hand today")], "item_id string, text string")
    assert decontaminate.contamination(docs, items).where("n_hit = 0").count() == 3
    assert simhash.near_groups(docs).count() == pii.find_personal(docs).count() == 3
    assert secrets.find_secrets(docs).count() == 3
