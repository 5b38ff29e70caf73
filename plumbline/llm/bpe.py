"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from a rank vocabulary."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.batches import bounded

#: Pre-tokens remembered by a worker, and characters of one at most; the memory is emptied when full.
REMEMBERED, SHORT = 200_000, 40


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where it is printable, else the next free one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks must run from 0 without gaps."""
    ranks = {}
    with open(path, "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: piece i is token i, byte by byte in byte_alphabet(), scored -i.

    Normalisation is the identity: no prefix, no white space removed or escaped. Ids equal ranks; one
    more piece is the unknown one, which no text of mapped bytes reaches.
    """
    chars = byte_alphabet()
    pieces = b"".join(_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(tokens))
    pieces += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


class _Codec:
    """Per worker: the loaded model, the bytes of its pieces, and the ids of pre-tokens met so far."""

    def __init__(self, model: bytes, pattern: str):
        self.split = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = dict(enumerate(byte_alphabet()))
        back = {c: b for b, c in self.map.items()}
        self.pieces = [bytes(map(back.__getitem__, self.model.id_to_piece(i))) for i in range(self.model.get_piece_size() - 1)]
        self.whole = {t: i for i, t in enumerate(self.pieces)}
        self.known: dict[str, list[int]] = {}

    def ids(self, text: str) -> list[int]:
        known, out = self.known, []
        for word in self.split.findall(text):
            if (got := known.get(word)) is None:
                raw = word.encode("utf-8", "surrogatepass")
                one = self.whole.get(raw)  # a pre-token that is a token as it stands is not taken apart
                got = self.model.encode(raw.decode("latin-1").translate(self.map)) if one is None else [one]
                if len(word) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = got
            out += got
        return out


_codecs: dict[tuple[bytes, str], _Codec] = {}


def _codec(model: bytes, pattern: str) -> _Codec:
    """The worker's codec, loaded once and used by all its tasks."""
    if (model, pattern) not in _codecs:
        _codecs[model, pattern] = _Codec(model, pattern)
    return _codecs[model, pattern]


class Tokenizer:
    """Encodes and decodes columns by the ranks of a file, its vocabulary held in a broadcast of fixed size."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        self._shared = spark.sparkContext.broadcast((serialise(read_ranks(path)), pattern))

    def encode(self, text: Column) -> Column:
        """array<int> of ids, null as the empty text; matches of the pattern are encoded one by one, whole texts."""
        shared = self._shared

        @F.arrow_udf("array<int>")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codec = _codec(*shared.value)
            for texts in batches:
                found = [np.array(codec.ids(t.as_py() or ""), np.int32) for t in texts]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))

        return of(text)

    def decode(self, ids: Column) -> Column:
        """binary of array<int>: the characters of the model's pieces mapped back to bytes; null as no ids, an id outside the vocabulary fails."""
        shared = self._shared

        @F.arrow_udf("binary")
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            tokens = _codec(*shared.value).pieces
            for lists in batches:
                flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                if len(flat) and not 0 <= flat.min() <= flat.max() < len(tokens):
                    raise ValueError("an id is outside the vocabulary")
                yield pa.array([b"".join(map(tokens.__getitem__, flat[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())

        return of(F.coalesce(ids, F.array().cast("array<int>")))


def tokenise(docs: DataFrame, path: str, text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with `ids` array<int> and `decoded` binary of the whole text; null and empty texts give no ids.

    Row by row, so copies, ties and an empty table need no care; columns of docs of these names are replaced,
    others come out as they were.
    """
    t = Tokenizer(docs.sparkSession, path, pattern)
    return docs.withColumn("ids", t.encode(F.col(text_col))).withColumn("decoded", t.decode(F.col("ids")))


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of tokenise()'s ids and decoded."""
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    bounded(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(tokenise(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
