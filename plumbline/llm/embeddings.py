"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import connected_components
from plumbline.runtime import cut

#: Hash tables, hashes joined to one bucket, buckets that a vector is put in for each table.
TABLES, HASHES, PROBES = 12, 2, 3
#: Vectors of a bucket that a task compares with one another; a larger bucket is compared in blocks of so many.
BLOCK = 2000
#: Pairs whose buckets are compared in one step.
PAIRS = 100_000
#: Rows of vectors hashed at a time.
ROWS = 2000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x


def buckets(x: np.ndarray, table: int, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """For each row of x the `probes` likeliest buckets of a table: first the row's own, then those with one
    hash replaced by its second largest coordinate, by how little that coordinate falls behind."""
    n, d = x.shape
    size = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    own, other, gap = [], [], []
    for k in range(hashes):
        signs = np.random.default_rng([table, k, size]).choice([-1.0, 1.0], (3, size))
        y = padded
        for s in signs:
            y = hadamard(y * s)
        top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
        row = np.arange(n)[:, None]
        top = np.take_along_axis(top, np.argsort(-np.abs(y[row, top]), axis=1, kind="stable"), 1)
        value = 2 * top + (y[row, top] < 0)
        own.append(value[:, 0])
        other.append(value[:, 1])
        gap.append(np.abs(y[row, top]) @ [1.0, -1.0])
    base = sum(v * (2 * size) ** k for k, v in enumerate(own))
    moved = np.stack([base + (other[k] - own[k]) * (2 * size) ** k for k in range(hashes)], axis=1)
    order = np.argsort(np.stack(gap, axis=1), axis=1, kind="stable")
    return np.concatenate((base[:, None], np.take_along_axis(moved, order, 1)), axis=1)[:, :probes]


def _codes(nodes: DataFrame, tables: int) -> DataFrame:
    """(node, codes) of each node: PROBES buckets of each table in a row."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["v"].map(len)):
                for at in range(0, len(part), ROWS):
                    some = part.iloc[at : at + ROWS]
                    x = np.stack(some["v"]).astype(np.float64)
                    x /= np.abs(x).max(1, keepdims=True)
                    yield pd.DataFrame({"node": some["node"].to_numpy(), "codes": list(np.concatenate([buckets(x, t) for t in range(tables)], axis=1))})

    return nodes.select("node", "v").mapInPandas(put, "node string, codes array<bigint>")


def _narrow(codes: DataFrame) -> DataFrame:
    """codes in the narrowest integers that hold them: a vector carries them to each of its buckets."""
    most = codes.agg(F.max(F.array_max("codes"))).first()[0] or 0
    return codes.withColumn("codes", F.col("codes").cast("array<smallint>" if most < 1 << 15 else "array<int>" if most < 1 << 31 else "array<bigint>"))


def _first_shared(a: np.ndarray, b: np.ndarray, t: int, bucket: int) -> np.ndarray:
    """Whether `bucket` of table t is the first that rows of a and b share, given codes as tables x PROBES."""
    seen = np.zeros(len(a), bool)
    for k in range(t):
        seen |= (a[:, k, :, None] == b[:, k, None, :]).any((1, 2))
    both = np.where((a[:, t, :, None] == b[:, t, None, :]).any(2), a[:, t].astype(np.int64), np.iinfo(np.int64).max).min(1)
    return ~seen & (both == bucket)


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest point that each reaches over links a to b and what it reached before, root, itself if nothing else."""
    if not len(a):
        return root
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _counted(groups: DataFrame, least: float) -> DataFrame:
    """(node, links, root) from rows (t, bucket, i, j, members) of vectors that share a bucket, of one block or two: to how many
    vectors a node links that it shares no earlier bucket with, and a node that it reaches over these links."""

    @F.pandas_udf("array<struct<node:string,links:bigint,root:string>>")
    def of(t: pd.Series, bucket: pd.Series, two: pd.Series, node: pd.Series, weight: pd.Series, block: pd.Series, v: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for table, code, across, ids, n, side, vs, cs in zip(t, bucket, two, node, weight, block, v, codes, strict=True):
            x = np.stack(vs).astype(np.float64)
            x /= np.abs(x).max(1, keepdims=True)
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            c = np.stack(cs).reshape(len(x), -1, PROBES)
            n, side = np.asarray(n), np.asarray(side)
            links = np.zeros(len(x), np.int64)
            root = np.arange(len(x))
            for at in range(0, len(x), 500):
                i, j = np.nonzero(x[at : at + 500] @ x.T >= least)
                i += at
                some = (i < j) & ((side[i] != side[j]) | (not across))
                for k in range(0, int(some.sum()), PAIRS):
                    a, b = i[some][k : k + PAIRS], j[some][k : k + PAIRS]
                    first = _first_shared(c[a], c[b], table, code)
                    a, b = a[first], b[first]
                    links += np.bincount(a, n[b], len(x)).astype(np.int64) + np.bincount(b, n[a], len(x)).astype(np.int64)
                    root = _roots(root, a, b)
            out.append([{"node": ids[k], "links": int(links[k]), "root": ids[root[k]]} for k in np.flatnonzero(links).tolist()])
        return pd.Series(out)

    m = "members."
    return groups.select(F.explode(of("t", "bucket", F.col("i") < F.col("j"), m + "node", m + "n", m + "own", m + "v", m + "codes")).alias("l")).select("l.*")


def near_vectors(vectors: DataFrame, least: float = 0.93, tables: int = TABLES, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id) for every row of vectors.

    Vectors of equal, non-null labels link at a cosine of `least` or more, computed in double precision.
    Equal vectors are one node with a count. A node goes to PROBES buckets of each table; buckets of
    one are dropped by a count, larger ones than `block` are compared block against block, so that no
    task holds more than two blocks. A pair is counted in the first bucket that both are in, and what leaves
    a block is a count and a root for each node, never its pairs. Recall is measured in the tests.

    Vectors that are null, zero or hold null or non-finite components, and those with a null label or
    id, link with nothing: n_links 0, component_id the id itself. Vectors of different lengths don't
    link. Rows that repeat an id count as vectors of their own. Other columns are not read; an empty table
    gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    key = [F.when(F.coalesce(sound, F.lit(False)), F.xxhash64(F.lit(i), "label", "v")).alias(f"k{i}") for i in (1, 2)]
    rows = cut(rows.select("vec_id", "label", "v", *key))
    rows = rows.withColumn("node", F.concat(F.hex("k1"), F.lit("-"), F.hex("k2"))).drop("k1", "k2")  # null where either is
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")))

    coded = cut(_narrow(cut(_codes(nodes.repartition("node"), tables))).join(nodes.select("node", "n", "label", "v"), "node"))
    bucket = ["dim", "t", "bucket", "label"]
    entries = coded.select("node", "label", F.size("v").alias("dim"), F.posexplode("codes").alias("p", "code"))
    entries = entries.select("node", "label", "dim", F.floor(F.col("p") / PROBES).cast("int").alias("t"), F.col("code").cast("long").alias("bucket"))
    full = entries.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    held = entries.join(full, bucket).withColumn("own", own).join(coded.select("node", "n", "v", "codes"), "node")
    held = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.groupBy(*bucket, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")).agg(F.collect_list(F.struct("node", "n", "own", "v", "codes")).alias("members"))
    linked = cut(_counted(held, least).groupBy("node", "root").agg(F.sum("links").alias("links")))
    links = linked.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
    near = linked.groupBy("node").agg(F.sum("links").alias("near"))

    roots = cut(connected_components(links).join(nodes.select("node", "rep"), "node"))
    first = roots.join(roots.groupBy("root").agg(F.min("rep").alias("first")), "root").select("node", "first")
    label = nodes.select("node", "rep", "n").join(near, "node", "left").join(first, "node", "left")
    label = label.select("node", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    out = rows.select("vec_id", "node").join(label, "node", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op8_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, len(embedding) AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS least FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, least(vec_id, coalesce(c.least, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
