"""Exact token counts of every prefix of a text, by dynamic programming over the pieces of a BPE model."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Chunks remembered by a worker, characters of one at most, pairs of pieces remembered; a memory is emptied when full.
REMEMBERED, SHORT, PAIRS = 400_000, 32, 2_000_000
#: Characters whose counts make one batch of results; a longer text is a batch of its own.
BATCH = 1 << 20

BLANK = "▁"
#: What a text is to the vocabulary; the score of no piece.
BEGINNING, PIECE, NEVER = 1, 2, float("-inf")
#: Ways to cut a text so that no piece reaches over a cut, the finest first; which of them holds is checked against all pieces.
CUTS = (rf"{BLANK}*(?:\p{{L}}+|\p{{Nd}}|[^\p{{L}}\p{{Nd}}{BLANK}]+)|{BLANK}+", rf"{BLANK}*[^{BLANK}]+|{BLANK}+", r"(?s:.+)")


class _Memory(dict):
    """What a function gave for short texts; emptied when full."""

    def __init__(self, of: Callable[[str], bytes]):
        self._of = of

    def __missing__(self, text: str) -> bytes:
        out = self._of(text)
        if len(text) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = out
        return out


class Counter:
    """Prefix counts by a sentencepiece BPE model with byte fallback.

    The last piece of a prefix's encoding decides the rest: a prefix that ends in piece p is encoded as the prefix before
    p, followed by p, if and only if the last piece there and p stay apart when encoded together. So
    count[i] = count[i - len(p)] + 1 for the one piece p that ends at i and passes, and a text takes one pass.
    The model must put a blank in front, write blanks as U+2581 and change nothing else.
    """

    def __init__(self, model: bytes):
        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(m.get_piece_size())
        if m.normalize("ﬁ  a ") != f"{BLANK}ﬁ{BLANK}{BLANK}a{BLANK}" or any(map(m.is_unused, ids)) or not any(map(m.is_byte, ids)):
            raise ValueError("the model must leave texts as they are, have bytes and no unused pieces")
        self.score = {m.id_to_piece(i): m.get_score(i) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        self.longest = max(map(len, self.score))
        self.kind = {p[:i]: BEGINNING for p in self.score for i in range(1, len(p))} | dict.fromkeys(self.score, PIECE)
        self.chunks = next(c for p in CUTS if all(map((c := regex.compile(p)).fullmatch, self.score)))
        self.by_word = self.chunks.pattern != CUTS[-1]
        self.apart: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.known = _Memory(self._grown)
        self.words = _Memory(lambda word: b"".join(map(self.known.__getitem__, self.chunks.findall(BLANK + word))))

    def merged(self, text: str, cut: int = 0) -> list[str] | None:
        """The pieces and characters of a short text, merged by score and from the left; None once a merge reaches over `cut`."""
        score = self.score.get
        parts = list(text)
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        left = cut  # parts before the cut
        while pairs and (best := max(pairs)) > NEVER:
            at = pairs.index(best)
            if at == left - 1:
                return None
            left -= at < left
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1], NEVER)
        return parts

    def _stay_apart(self, a: str, b: str) -> bool:
        """Whether a and b, each a piece, are what their joint text is encoded as; a may be the empty text."""
        self.pairs += 1
        if self.pairs > PAIRS:
            self.apart, self.pairs = {}, 0
        return self.merged(a + b, len(a)) == ([a, b] if a else [b])

    def counts(self, chunk: str) -> array:
        """Tokens of the first 0, 1, ... characters of a chunk, as if nothing stood around it. What is kept beside the counts
        is bounded by the longest piece."""
        size, kind, ring = len(chunk), self.kind.get, self.longest + 1
        ending: list[list[tuple[int, str]]] = [[] for _ in range(ring)]  # the pieces that end at a place, the longest first
        last = [""] * ring
        after = [self.apart.setdefault("", {})] * ring  # which pieces stay apart from the last one
        count = array("i", [0])
        for at in range(size + 1):
            here = at % ring
            if at:
                for start, piece in ending[here]:
                    apart = after[start % ring]
                    passes = apart.get(piece)
                    if passes is None:
                        passes = apart[piece] = self._stay_apart(last[start % ring], piece)
                    if passes:
                        count.append(count[start] + 1)
                        break
                else:  # a character without a piece: its bytes, with which nothing merges
                    count.append(count[-1] + len(chunk[at - 1].encode("utf-8", "surrogatepass")))
                    piece = ""
                ending[here] = []
                last[here], after[here] = piece, self.apart.get(piece) or self.apart.setdefault(piece, {})
            for end in range(at + 1, size + 1):
                piece = chunk[at:end]
                if not (of := kind(piece)):
                    break
                if of == PIECE:
                    ending[end % ring].append((at, piece))
        return count

    def _grown(self, chunk: str) -> bytes:
        """What each character of a chunk adds to the count, as int32."""
        count = self.counts(chunk)
        return array("i", map(sub, count[1:], count)).tobytes()

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, ..., len(text) characters of a text."""
        if text and self.by_word and "  " not in text and BLANK not in text and text[0] != " " and text[-1] != " ":
            parts = map(self.words.__getitem__, text.split(" "))  # each with the blank in front of it
        else:
            parts = map(self.known.__getitem__, self.chunks.findall((BLANK + text).replace(" ", BLANK)))
        out = np.cumsum(np.frombuffer(b"".join(parts), np.int32), dtype=np.int32)
        out[0] = 0  # the blank in front comes with the first character only
        return out


_counters: dict[bytes, Counter] = {}


def _counter(model: bytes) -> Counter:
    """The worker's counter, made once and used by all its tasks."""
    if model not in _counters:
        _counters[model] = Counter(model)
    return _counters[model]


def prefix_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """docs with `prefix_tokens` array<int>: at index i the tokens that the model at `path` gives the first i characters.

    Whole texts; null is the empty text, whose array is [0]. Row by row, so copies, ties and an empty table need no care; a
    column of docs of this name is replaced, others come out as they were. The array answers tokens(),
    fitting() and truncated() without encoding again.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop("prefix_tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in batches:
            texts, at = batch.column(batch.schema.get_field_index(text_col)), 0
            while at < len(texts):
                found, size, start = [], 0, at
                while at < len(texts) and (not found or size < BATCH):
                    found.append(counter.prefixes(texts[at].as_py() or ""))
                    size, at = size + len(found[-1]), at + 1
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, "prefix_tokens"])

    return docs.mapInArrow(count, StructType([*docs.schema, StructField("prefix_tokens", ArrayType(IntegerType()))]))


def tokens(prefix: Column) -> Column:
    """Tokens of the whole text."""
    return F.element_at(prefix, -1).cast("long")


def fitting(prefix: Column, limit: int | Column) -> Column:
    """Characters of the longest prefix of at most `limit` tokens."""
    return F.array_max(F.transform(prefix, lambda n, i: F.when(n <= limit, i)))


def truncated(docs: DataFrame, limit: int, text_col: str = "text", prefix_col: str = "prefix_tokens") -> DataFrame:
    """docs of prefix_counts() with texts of over `limit` tokens cut to their longest prefix within it, and their counts cut alike."""
    fits = fitting(F.col(prefix_col), limit)
    return docs.withColumns({text_col: F.substring(F.col(text_col), F.lit(1), fits), prefix_col: F.slice(prefix_col, F.lit(1), fits + 1)})


#: Tokens that a text may have before it counts as over the limit.
LIMIT = 4096


def op12_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = prefix_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("n_tokens", tokens(F.col("prefix_tokens")))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
