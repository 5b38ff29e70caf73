"""SimHash near-duplicates found by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.native import small_side
from plumbline.operators.graph import connected_components
from plumbline.runtime import cut

BITS = 64
#: Shingles hashed at a time, so that a text of any length needs bounded memory.
BLOCK = 1 << 16
#: Distinct fingerprints of a bucket that one task compares directly; larger buckets are dealt out further.
BUCKET = 20_000


def simhash(text: str | None, words: int = 4) -> int:
    """The fingerprint of a text as a signed 64-bit integer.

    A-Z is lowered; words are runs without ASCII white space; shingles of `words` words are joined by
    one space (a shorter text is one shingle); null and wordless texts give zero. A bit is 1 if it is
    set in over half of the shingles' XXH64 values (seed 42), repeats counted.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :]
    counts, hashed = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.array([hashed(line[s:e], 42) for s, e in zip(starts[at : min(n, at + BLOCK)].tolist(), ends[at : at + BLOCK].tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, words: int = 4) -> Column:
    """simhash() of a text column."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([simhash(t if isinstance(t, str) else None, words) for t in texts], dtype="int64")

    return of(text)


def covering_masks(radius: int) -> list[int]:
    """Signed 64-bit masks, 2^(radius+1) - 1 of them, of which one at least hides any set of `radius` bits.

    Bit i gets a nonzero vector v(i) of radius+1 bits; mask m keeps the bits with odd <v(i), m>. Bits
    that differ give at most `radius` linear conditions <v(i), m> = 0, so a nonzero m meets them all.
    """
    top = (1 << (radius + 1)) - 1
    bits = [1 + i % top for i in range(BITS)]
    masks = [sum(1 << i for i, v in enumerate(bits) if (v & m).bit_count() & 1) for m in range(1, top + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all values within the radius of one another, a spanning forest instead of every pair."""
    rest = np.unique(values)
    links: list[tuple[int, int]] = []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= radius
            if near.any():
                links += [(int(at), int(x)) for x in rest[near]]
                queue += list(rest[near])
                rest = rest[~near]
    return links


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b) from a column `fps` of fingerprints that share a bucket."""

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in _forest(np.asarray(x, np.int64), radius)] for x in lists])

    return buckets.select(F.explode(joined("fps")).alias("l")).select("l.a", "l.b")


def near_links(prints: DataFrame, radius: int = 4, column: str = "fp", bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly those within `radius` bits of one another.

    Each fingerprint goes to one bucket of every covering mask. Buckets of one are dropped by a count;
    a bucket of over `bucket` fingerprints is dealt out by radius+1 pieces of the bits its mask hides,
    of which one piece must be equal, and a piece of over `bucket` is compared block by block, so nothing is
    lost and no task gathers more than two blocks. No prints give no links.
    """
    masks = covering_masks(radius)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
    tables = prints.select(F.col(column).alias("fp")).select("fp", keys.alias("x")).select("fp", "x.t", "x.k")
    full = cut(tables.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    held = tables.join(full, ["t", "k"])
    small = held.where(F.col("n") <= bucket).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    out = _links(small.select("fps"), radius)
    if not full.where(F.col("n") > bucket).isEmpty():
        hidden = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
        pieces = [[sum(1 << i for i in h[p :: radius + 1]) for p in range(radius + 1)] for h in hidden]
        signed = [[x - (1 << 64) if x >> 63 else x for x in row] for row in pieces]
        table = F.array(*[F.array(*[F.lit(x) for x in row]) for row in signed])
        dealt = held.where(F.col("n") > bucket).select("t", "k", "fp", F.posexplode(F.get(table, F.col("t"))).alias("p", "m"))
        dealt = dealt.select("t", "k", "p", F.col("fp").bitwiseAND(F.col("m")).alias("q"), "fp")
        piece = ["t", "k", "p", "q"]
        sizes = dealt.groupBy(*piece).agg(F.ceil(F.count("*") / bucket).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
        dealt = dealt.join(sizes, piece).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.groupBy(*piece, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        out = out.union(_links(dealt.select("fps"), radius))
    return out.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs.

    Rows with fingerprints within `radius` bits are linked; component_id is the smallest id reachable.
    text_hash is Spark's xxhash64 of the text. Copies share one fingerprint and so one node of the
    graph. Null and wordless texts have fingerprint zero and are linked like any other; null ids are
    passed over when the smallest id is taken (a group of null ids alone has a null component);
    repeated rows give repeated rows; the smallest id is one of a group's ids, so ties can't be; an empty table
    gives an empty result; other columns of docs are not read.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), fingerprint(F.col(text_col), words).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(near_links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    roots = cut(roots.join(nodes, "fp"))
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    label = nodes.join(roots.join(least, "root").select("fp", "least"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return rows.join(label, "fp").select("doc_id", "text_hash", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each group of near_groups(), the one with the smallest id; all columns stay.

    Among repeated rows (equal id and text) one stays. Groups whose ids are all null keep one row of
    each distinct text. Null, empty and blank texts are one group, so one row of them stays; an empty table stays empty.
    """
    groups = cut(near_groups(docs, id_col, text_col, words, radius))
    gone = groups.where("doc_id <> component_id or (doc_id is null and component_id is not null)").select("doc_id", "text_hash").distinct()
    twice = groups.where("doc_id = component_id or component_id is null").groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash")
    own = docs.withColumns({"__pl_id": F.col(id_col), "__pl_hash": F.xxhash64(F.col(text_col))})
    on = lambda x: own["__pl_id"].eqNullSafe(x["doc_id"]) & (own["__pl_hash"] == x["text_hash"])
    gone = small_side(cut(gone))
    kept = own.join(gone, on(gone), "left_anti")
    twice = cut(twice)
    if not twice.isEmpty():
        own = kept
        kept = own.join(twice, on(twice), "left_anti").union(own.join(twice, on(twice), "left_semi").dropDuplicates(["__pl_id", "__pl_hash"]))
    return kept.select(*docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
