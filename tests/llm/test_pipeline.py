import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, decontaminate, langid, pii, registry
from tests.conftest import SF
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import groups


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept[name] = docs
        if name != "encode":
            assert docs.columns == columns
    texts = lambda name: {r.doc_id: r.text for r in kept[name].collect()}
    assert texts("language_id") == {i: t for i, t in left.items() if t and any(c.isalpha() for c in t)}
    first = texts("language_id")
    assert set(texts("near_dedup")) == {i for i, _, c in groups(list(first.items())) if i == c}
    second = texts("near_dedup")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(texts("decontaminate")) == {i for i, _, hit, _ in contaminated(list(second.items()), items) if not hit}
    third = texts("decontaminate")
    assert texts("mask_pii") == {i: pii.masked(t) for i, t in third.items()}
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    last = kept["encode"].collect()
    assert len(last) == len(third)
    for r in last:
        assert b"".join(tokens[i] for i in r.ids).decode() == pii.masked(third[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)
    run = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in run.collect()} == set(third)


def test_odd_rows(spark, odd, none):
    for frame in (odd, none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).where(~F.col("round_trip")).count() == 0


def test_registry_names():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in registry.QUERIES
    assert set(registry.SQL) <= set(registry.QUERIES)
    assert langid.UNDETERMINED == "und" and decontaminate.WINDOW == 10
