"""Hard negatives by a vantage-point tree over norm-augmented vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.runtime import Stored, cut

#: Numbers of the sample that the tree is fitted on, and its rows at most. All rows are indexed, whatever the sample holds.
SAMPLE_NUMBERS, SAMPLE_ROWS = 4_000_000, 65_536
#: Rows of a leaf that make one block (and numbers in it at most), anchors that are compared with a block at a time.
BLOCK, BLOCK_NUMBERS, ANCHORS = 4096, 1_000_000, 256
#: A leaf of the tree has at least so many rows of the sample.
LEAST = 16
#: Each wave of a search visits so many times the leaves before it.
GROWTH = 8
#: No score is beyond this.
ALL = 1 << 62


@dataclass
class Tree:
    """A vantage-point tree. Every vector x is augmented by sqrt(top - |x|^2), top being the largest squared norm, and an anchor by
    zero; then score and distance go together: d^2 = |anchor|^2 + top - 2 score, and a score window is an annulus."""

    top: float
    points: list[np.ndarray] = field(default_factory=list)
    nodes: list[tuple] = field(default_factory=list)  # (point, radius, inside, outside), or (leaf,)
    paths: list[list[int]] = field(default_factory=list)  # of each leaf the points above it
    low: np.ndarray | None = None  # distances of a leaf's rows to the points above it: at least, at most
    high: np.ndarray | None = None

    def augmented(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate((x, np.sqrt(np.maximum(self.top - (x * x).sum(1, keepdims=True), 0))), axis=1)

    def distances(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (points * points).sum(1) - 2 * x @ points.T, 0))

    def grow(self, x: np.ndarray, leaf_rows: int, path: tuple[int, ...] = ()) -> int:
        """Adds the tree of augmented rows x; the number of its root. Of a few rows the one that sees the others at the most
        various distances becomes the vantage point."""
        at = len(self.nodes)
        self.nodes.append(())
        if len(x) >= 2 * max(leaf_rows, LEAST):
            some = x[np.linspace(0, len(x) - 1, 8).astype(int)]
            d = self.distances(x, some)
            best = int(d.std(0).argmax())
            radius = float(np.median(d[:, best]))
            inside = d[:, best] <= radius
            if not inside.all():
                point = len(self.points)
                self.points.append(some[best])
                self.nodes[at] = (point, radius, self.grow(x[inside], leaf_rows, (*path, point)), self.grow(x[~inside], leaf_rows, (*path, point)))
                return at
        self.nodes[at] = (len(self.paths),)
        self.paths.append(list(path))
        return at

    @property
    def depth(self) -> int:
        return max(map(len, self.paths))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each augmented row, and its distances to the points above that leaf (zero beyond them)."""
        d = self.distances(x, np.stack(self.points)) if self.points else np.zeros((len(x), 0))
        leaf, above = np.zeros(len(x), np.int64), np.zeros((len(x), self.depth))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if len(node) == 1:
                leaf[rows] = node[0]
                path = self.paths[node[0]]
                above[rows, : len(path)] = d[rows][:, path]
            else:
                inside = d[rows, node[0]] <= node[1]
                todo += [(node[2], rows[inside]), (node[3], rows[~inside])]
        return leaf, above

    def scores(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest score that each leaf's rows can have with each anchor, by the triangle inequality."""
        norms = (q * q).sum(1)[:, None]
        d = self.distances(np.concatenate((q, np.zeros((len(q), 1))), axis=1), np.stack(self.points)) if self.points else np.zeros((len(q), 1))
        near, far = np.zeros((len(q), len(self.paths))), np.full((len(q), len(self.paths)), np.sqrt(norms) + np.sqrt(self.top))
        for k in range(self.depth):
            has = np.array([len(p) > k for p in self.paths])
            to = d[:, [p[k] if len(p) > k else 0 for p in self.paths]]
            near = np.where(has, np.maximum(near, np.maximum(to - self.high[:, k], self.low[:, k] - to)), near)
            far = np.where(has, np.minimum(far, to + self.high[:, k]), far)
        slack = 1e-6 * (norms + self.top) + 1
        return (norms + self.top - far * far) / 2 - slack, (norms + self.top - near * near) / 2 + slack


def _matrix(flat: pa.Array, width: int) -> np.ndarray:
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


class Index:
    """All rows (id, label, v) in the leaves of a tree, each leaf in blocks of BLOCK rows. v holds whole numbers; shorter vectors are filled up with zeros."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        size, width, top, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.max(F.array_max(F.transform("v", F.abs)))).first()
        self.width, self.exact = max(width or 1, 1), (most or 0) ** 2 * (width or 1) < 1 << 53
        self.rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(self.width) - F.size("v")))).select("id", "label", "v")
        sample = max(LEAST, min(SAMPLE_ROWS, SAMPLE_NUMBERS // self.width))
        held = self.rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()
        block = max(1, min(BLOCK, BLOCK_NUMBERS // self.width))
        tree = Tree(float(top or 0))
        x = np.array(held["v"].tolist(), np.float64).reshape(-1, self.width)
        tree.grow(tree.augmented(x), -(-len(x) * block // max(size, 1)))
        self._fill(tree, block)
        self.tree = spark.sparkContext.broadcast(tree)

    def _fill(self, tree: Tree, block: int) -> None:
        width = self.width

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    leaf, above = tree.leaves(tree.augmented(_matrix(part.column(2).flatten(), width).astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf), pa.array(list(above), pa.list_(pa.float64()))], ["id", "label", "v", "leaf", "above"])

        placed = Stored(self.rows.mapInArrow(put, "id long, label string, v array<bigint>, leaf bigint, above array<double>"))
        spans = [f(F.get("above", F.lit(k))) for k in range(tree.depth) for f in (F.min, F.max)]
        found = {r[0]: r[1:] for r in placed.df.groupBy("leaf").agg(F.count("*"), *spans).collect()}  # a row for each leaf of the tree
        empty = (0, *[0.0] * 2 * tree.depth)
        values = np.array([found.get(i, empty) for i in range(len(tree.paths))], np.float64)
        slack = 1e-9 * np.sqrt(tree.top)
        tree.low, tree.high = values[:, 1::2] - slack, values[:, 2::2] + slack
        counts = [int(-(-n // block)) or 1 for n in values[:, 0]]
        blocks = F.get(F.from_json(F.lit(str(counts)), "array<int>"), F.col("leaf").cast("int"))
        packed = placed.df.groupBy("leaf", F.pmod(F.xxhash64("id"), blocks).alias("block")).agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
        self.blocks = Stored(packed.select("leaf", F.col("rows.id").alias("ids"), F.col("rows.label").alias("labels"), F.flatten("rows.v").alias("flat"))).df
        placed.drop()

    def best(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(anchor, window, best array<struct<minus,id>>) for queries (anchor, label, v, windows array<struct<window,low,high>>): the k rows
        of the highest score in each window, of the anchor's own label (same) or of the others, the anchor itself left out.

        Leaves are visited in waves, those first that can hold the nearest rows of the annulus; a leaf is left out once
        its annulus doesn't meet the window or can't beat the k-th row found.
        """
        leaves, at, step = len(self.tree.value.paths), 0, 1
        queries = cut(queries.withColumn("windows", F.transform("windows", lambda w: F.struct(w["window"], w["low"], w["high"], w["low"].alias("least")))))
        best = None
        while at < leaves:
            routed = self._routed(queries, at, at + step)
            pairs = routed.join(self.blocks, "leaf")
            found = pairs.select(F.explode(self._compared(k, same)(*[F.col(c) for c in ("anchors", "own", "vectors", "windows", "ids", "labels", "flat")])).alias("f")).select("f.*")
            if best is not None:
                found = found.unionByName(best.select("anchor", "window", F.explode("best").alias("b")).select("anchor", "window", "b.*"))
            best = cut(found.groupBy("anchor", "window").agg(F.slice(F.array_sort(F.collect_list(F.struct("minus", "id"))), 1, k).alias("best")))
            at, step = at + step, (at + step) * (GROWTH - 1)
            if at < leaves:
                full = best.where(F.size("best") == k).select("anchor", "window", (-F.element_at("best", k)["minus"]).alias("reached"))
                each = queries.select("anchor", "label", "v", F.explode("windows").alias("w")).select("anchor", "label", "v", "w.*").join(full, ["anchor", "window"], "left")
                window = F.struct("window", "low", "high", F.coalesce("reached", "least").alias("least"))
                queries = cut(each.groupBy("anchor").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.collect_list(window).alias("windows")))
        return best

    def _routed(self, queries: DataFrame, start: int, end: int) -> DataFrame:
        """(leaf, anchors, own, vectors, windows): up to ANCHORS queries together for each leaf among their start-th to end-th."""
        shared, width = self.tree, self.width
        window = "array<struct<window:bigint,low:bigint,high:bigint,least:bigint>>"

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = shared.value
            for batch in batches:
                for at in range(0, len(batch), ANCHORS):
                    part = batch.iloc[at : at + ANCHORS]
                    low, high = tree.scores(np.stack(part["v"]).astype(np.float64).reshape(-1, width))
                    meets, order = np.zeros(low.shape, bool), np.empty(low.shape)
                    for i, windows in enumerate(part["windows"]):
                        for w in windows:
                            meets[i] |= (high[i] >= max(w["low"], w["least"])) & (low[i] <= w["high"])
                        order[i] = -np.minimum(high[i], max((w["high"] for w in windows), default=ALL))
                    place = np.argsort(np.argsort(order, axis=1, kind="stable"), axis=1, kind="stable")
                    meets &= (place >= start) & (place < end)
                    out = []
                    for leaf in np.flatnonzero(meets.any(0)).tolist():
                        some = part[meets[:, leaf]]
                        out.append((leaf, some["anchor"].to_numpy(), some["label"].to_numpy(), np.concatenate(some["v"].to_list()), list(some["windows"])))
                    yield pd.DataFrame(out, columns=["leaf", "anchors", "own", "vectors", "windows"])

        return queries.select("anchor", "label", "v", "windows").mapInPandas(route, f"leaf bigint, anchors array<bigint>, own array<string>, vectors array<bigint>, windows array<{window}>")

    def _compared(self, k: int, same: bool):
        """For queries and a block of rows the k best rows of each window."""
        width, kind = self.width, np.float64 if self.exact else np.int64

        @F.arrow_udf("array<struct<anchor:bigint,window:bigint,id:bigint,minus:bigint>>")
        def of(anchors: pa.Array, own: pa.Array, vectors: pa.Array, windows: pa.Array, ids: pa.Array, labels: pa.Array, flat: pa.Array) -> pa.Array:
            out = []
            for i in range(len(anchors)):
                names, code = np.unique(np.array(labels[i].as_py(), object).astype(str), return_inverse=True)
                codes = {name: c for c, name in enumerate(names.tolist())}
                id_ = ids[i].values.to_numpy(zero_copy_only=False)
                score = _matrix(vectors[i].values, width).astype(kind) @ _matrix(flat[i].values, width).astype(kind).T
                found = []
                for row, anchor, label, ranges in zip(score, anchors[i].as_py(), own[i].as_py(), windows[i].as_py(), strict=True):
                    allowed = ((code == codes.get(label, -1)) == same) & (id_ != anchor)
                    for w in ranges:
                        some = np.flatnonzero(allowed & (row >= max(w["low"], w["least"])) & (row <= w["high"]))
                        if len(some) > k:
                            some = some[row[some] >= np.partition(row[some], -k)[-k]]
                        some = some[np.lexsort((id_[some], -row[some]))[:k]]
                        found += [{"anchor": anchor, "window": w["window"], "id": int(id_[j]), "minus": -int(row[j])} for j in some]
                out.append(found)
            return pa.array(out, pa.list_(pa.struct([(c, pa.int64()) for c in ("anchor", "window", "id", "minus")])))

        return of


def whole_numbers(v: Column) -> Column:
    """floor(256 x) of each component."""
    return F.transform(v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, v array<bigint>).

    anchors: which rows are anchors, by vec_id. The positives of an anchor are the other rows of its label with the highest inner
    product, its negatives for each of them the rows of other labels with the highest one within low to high per cent of
    the positive's; ties go to the smaller vec_id. All rows are searched, and the results are exact.

    Rows with a null vec_id, label or vector, or a null component, take no part; of rows that repeat a vec_id the one
    with the least label and vector does. Vectors of different lengths are compared as if filled up with zeros. A
    window below zero is empty. Other columns are not read; an empty table gives an empty result.
    """
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())
    one = rows.where(sound).groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(F.struct(F.col("label").cast("string").alias("label"), "v")).alias("one"))
    rows = cut(one.select("id", "one.label", "one.v"))
    index = Index(rows)
    asked = cut(index.rows.withColumnRenamed("id", "vec_id").where(anchors).select(F.col("vec_id").alias("anchor"), "label", "v"))
    everything = F.array(F.struct(F.lit(0).cast("long").alias("window"), F.lit(-ALL).alias("low"), F.lit(ALL).alias("high")))
    near = index.best(asked.withColumn("windows", everything), positives, same=True)
    near = near.select("anchor", F.explode("best").alias("b")).select("anchor", F.col("b.id").alias("window"), (-F.col("b.minus")).alias("score"))

    p, q = F.col("score") * low, F.col("score") * high
    windows = near.withColumns({"low": p + F.pmod(-p, F.lit(100)), "high": q - F.pmod(q, F.lit(100))})  # whole hundreds within the window
    windows = windows.selectExpr("anchor", "window", "score", "low div 100 AS low", "high div 100 AS high").where("low <= high")
    windows = cut(windows)
    ranges = windows.groupBy("anchor").agg(F.collect_list(F.struct("window", "low", "high")).alias("windows"))
    found = index.best(asked.join(ranges, "anchor"), negatives, same=False)
    each = found.select("anchor", "window", F.posexplode("best").alias("rank", "b")).join(windows.select("anchor", "window", "score"), ["anchor", "window"])
    return each.select(
        F.col("anchor").alias("anchor_id"), F.col("window").alias("positive_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("negative_id"), F.col("score").alias("positive_score"), (-F.col("b.minus")).alias("negative_score")
    )


def op11_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(finite).select("vec_id", label.alias("label"), whole_numbers(F.col("embedding")).alias("v"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), negative AS (
  SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT * FROM negative WHERE rank <= 10
"""
