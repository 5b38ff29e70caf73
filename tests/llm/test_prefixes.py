import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from plumbline.llm import prefixes
from tests.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as file:
        return prefixes.Counter(file.read())


def every_prefix(reference, text):
    return [len(x) for x in reference.encode([text[:i] for i in range(len(text) + 1)])]


def test_every_prefix_of_random_texts(counter, reference):
    r = random.Random(3)
    letters = [" "] * 6 + list("abcdeinorst") * 2 + list(".,!\n\t\"'()0123456789éß①漢字▁²½_ﬁ🙂\x00") + ["  ", "the ", "ing", "<s>", "<0x41>"]
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert counter.prefixes(text).tolist() == every_prefix(reference, text), text


def test_runs_of_blanks_and_junk(counter, reference):
    r = random.Random(4)
    for _ in range(200):
        text = " " * r.randint(0, 60) + r.choice(["", "the", "①", "1", " x", "\n", "▁"]) + " " * r.randint(0, 40)
        assert counter.prefixes(text).tolist() == every_prefix(reference, text), text
    for text in ("x" * 700, "ab" * 300, "!?" * 200, "é" * 300, "1" * 300, "aaaaaaab" * 60, "日本語" * 100):
        assert counter.prefixes(text).tolist() == every_prefix(reference, text)


def test_cuts_are_only_a_saving(counter, reference):
    whole = prefixes.Counter(open(PATH, "rb").read())
    whole.chunks, whole.by_word = prefixes.regex.compile(prefixes.CUTS[-1]), False
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(" abn.t1é漢'\n") for _ in range(r.randint(1, 80)))
        assert whole.prefixes(text).tolist() == counter.prefixes(text).tolist()


def test_query_matches_the_library(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = prefixes.op12_tokens(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.n_tokens == len(reference.encode(docs[r.doc_id])) and r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 4096)


def test_budgets_need_no_encoding(spark, reference):
    docs = prefixes.prefix_counts(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), PATH)
    cut = {r.doc_id: r for r in prefixes.truncated(docs, 50).collect()}
    for r in docs.withColumn("fits", prefixes.fitting(F.col("prefix_tokens"), 50)).collect():
        assert r.prefix_tokens[r.fits] <= 50 and all(n > 50 for n in r.prefix_tokens[r.fits + 1 :])
        assert cut[r.doc_id].text == r.text[: r.fits] and len(reference.encode(cut[r.doc_id].text)) == cut[r.doc_id].prefix_tokens[-1] <= 50


def test_odd_rows(spark, odd, none, reference):
    for r in prefixes.prefix_counts(odd.withColumn("prefix_tokens", F.lit("mine")), PATH).collect():
        assert r.prefix_tokens == every_prefix(reference, r.text or "")[: len(r.text or "") + 1] if len(r.text or "") < 100 else r.prefix_tokens[-1] == len(reference.encode(r.text))
        assert r.h == "x" or r.h is None
    assert prefixes.prefix_counts(none, PATH).count() == 0


def test_a_text_of_twenty_megabytes(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").withColumn("text", F.repeat("text", F.lit(3_000_000)))
    docs = docs.union(docs.select(F.lit(2), F.repeat(F.lit("some words and a 1, "), F.lit(1_000_000))))
    got = {r.doc_id: r for r in prefixes.prefix_counts(docs, PATH).select("doc_id", prefixes.tokens(F.col("prefix_tokens")).alias("n"), F.size("prefix_tokens").alias("size")).collect()}
    assert got[1].size == 3_000_001 and got[2].size == 20_000_001 and got[2].n > 5_000_000
