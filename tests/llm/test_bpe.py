import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe
from tests.conftest import SF

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_tiktoken(spark, reference):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in bpe.op3_bpe(spark, SF).collect():
        ids = reference.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_random_texts(reference):
    tokens = bpe.read_ranks(PATH)
    codec = bpe._Codec(bpe.serialise(tokens), public_tokenizers.PATTERN)
    assert codec.pieces == tokens
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice("abcé ß日本語\n\t　🙂👍🏽αβ一0123́\x00▁'s") for _ in range(r.randint(0, 50)))
        assert codec.ids(text) == reference.encode_ordinary(text)
    for text in ("a" * 5000, " " * 3000, "<unk>", "<|endoftext|>"):
        assert codec.ids(text) == reference.encode_ordinary(text)
    assert all(len(w) <= bpe.SHORT for w in codec.known)


def test_odd_rows(spark, odd, none):
    docs = odd.select("doc_id", "text", "fp")
    for r in bpe.tokenise(docs, PATH).collect():
        assert bytes(r.decoded).decode() == (r.text or "") and (r.text or r.ids == [])
    assert bpe.tokenise(none, PATH).count() == 0
