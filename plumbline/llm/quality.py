"""Document quality by co-training of a text view and a metadata view."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.langid import held_out
from plumbline.runtime import Stored, cut

#: Labelled rows that the classifiers are fitted on at most, taken by a hash of the id.
LABELLED = 4000
#: Hashed features of each view.
WORDS, META = 1024, 256
ROUNDS, ADDED = 5, 100
_SHAPES = 10
_PUNCT, _UPPER, _DIGIT = re.compile(r"[^\w\s]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]")


def text_features(text: str | None) -> np.ndarray:
    """Hashed words (log counts, scaled to length one) and the shape of a whole text; zeros for null and empty texts."""
    out = np.zeros(WORDS + _SHAPES, np.float32)
    words = text.split() if text else []
    if not words:
        return out
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    at = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % WORDS
    np.add.at(out, at, np.log1p(np.fromiter(counts.values(), np.float32, len(counts))))
    out[:WORDS] /= np.sqrt((out[:WORDS] ** 2).sum())
    n, lines = len(text), text.split("\n")
    out[WORDS:] = (
        np.log1p(len(words)) / 5,
        len(counts) / len(words),
        len(_PUNCT.findall(text)) / n * 5,
        len(_UPPER.findall(text)) / n * 5,
        len(_DIGIT.findall(text)) / n * 5,
        n / len(words) / 10,
        len(set(lines)) / len(lines),
        max(counts.values()) / len(words),
        np.log1p(len(lines)) / 5,
        sum(len(x) * (c > 1) for x, c in counts.items()) / n,
    )
    return out


def meta_features(source: str | None, lang: str | None, n_chars: float | None) -> np.ndarray:
    """Hashed source, language, both, and size class; a null is a value of its own."""
    size = -1 if n_chars is None or n_chars != n_chars or n_chars < 0 else int(np.log2(1 + n_chars))
    out = np.zeros(META, np.float32)
    for key in (f"s:{source}", f"l:{lang}", f"sl:{source}:{lang}", f"n:{size}", f"nl:{size}:{lang}"):
        out[zlib.crc32(key.encode("utf-8", "surrogatepass")) % META] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, l2: float = 1e-3, steps: int = 120) -> np.ndarray:
    """Weights, the last one the intercept, by Nesterov's method; classes weigh the same."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(x.dtype)
    rate = 4 / ((weight[:, None] * x * x).sum() + l2)
    w = np.zeros(x.shape[1], x.dtype) if w is None else w
    v = w.copy()
    for i in range(steps):
        g = x.T @ (weight * (_sigmoid(x @ v) - y)) + l2 * v
        new = v - rate * g
        v = new + i / (i + 3) * (new - w)
        w = new
    return w


@dataclass
class CoTrained:
    """Weights of the two views and of the calibrated sum of their logits."""

    text: np.ndarray
    meta: np.ndarray
    blend: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, metadata) probabilities of good quality."""
        a, b = text @ self.text[:-1] + self.text[-1], meta @ self.meta[:-1] + self.meta[-1]
        return _sigmoid(self.blend[0] * a + self.blend[1] * b + self.blend[2]), _sigmoid(a), _sigmoid(b)


#: The key of a row of a pool: its id and the hash of what it holds.
Key = tuple
#: For a view, what the other one is surest of: (key, label, text features, metadata features).
Picked = list[tuple[Key, int, np.ndarray, np.ndarray]]


class ArrayPool:
    """Unlabelled rows in memory, keyed by their place."""

    def __init__(self, text: np.ndarray, meta: np.ndarray):
        self.views = (text, meta)

    def surest(self, weights: list[np.ndarray], added: int, sure: float) -> list[Picked]:
        """For each view the `added` rows of each class that it is surest of, at `sure` at least; ties by key."""
        out: list[Picked] = []
        for x, w in zip(self.views, weights, strict=True):
            p = chance(x, w)
            out.append([((int(i),), label, self.views[0][i], self.views[1][i]) for label, q in ((1, p), (0, 1 - p)) for i in np.argsort(-q, kind="stable")[:added] if q[i] >= sure])
        return out


class TablePool:
    """Rows (doc_id, which, t, m) of a stored table but for those with an id of known, scored where they are; equal rows of an id count once."""

    def __init__(self, rows: DataFrame, known: DataFrame):
        self.rows, self.known = rows, known.select("doc_id")
        self._kind = dict(rows.dtypes)["doc_id"]

    def surest(self, weights: list[np.ndarray], added: int, sure: float) -> list[Picked]:
        """As of ArrayPool, ties by a checksum of the id. A task gives the ids of what it is sure of, a few numbers each, of which
        labelled ones go; the rows picked are fetched by id: four times `added` at most."""
        shared = self.rows.sparkSession.sparkContext.broadcast(weights)

        def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for view, (c, n, w) in enumerate(zip(("t", "m"), (WORDS + _SHAPES, META), shared.value, strict=True)):
                    p = chance(unpacked(b[c], n), w)
                    for label, q in ((1, p), (0, 1 - p)):
                        some = np.flatnonzero(q >= sure)
                        part = b.iloc[some]
                        yield pd.DataFrame({"view": view, "label": label, "chance": q[some], "doc_id": part["doc_id"], "which": part["which"], "tie": [zlib.crc32(str(i).encode()) for i in part["doc_id"]]})

        found = self.rows.mapInPandas(rank, f"view int, label int, chance double, doc_id {self._kind}, which long, tie long")
        found = found.join(self.known, "doc_id", "left_anti").groupBy("view", "label", "doc_id", "which").agg(F.max("chance").alias("chance"), F.first("tie").alias("tie"))
        order = Window.partitionBy("view", "label").orderBy(F.desc("chance"), "tie", "doc_id", "which")
        best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= added).orderBy("view", F.desc("label"), "place").collect()
        shared.unpersist()
        wanted = self.rows.sparkSession.createDataFrame([(r.doc_id, r.which) for r in best], f"doc_id {self._kind}, which long").distinct()
        rows = self.rows.join(F.broadcast(wanted), ["doc_id", "which"]).dropDuplicates(["doc_id", "which"]).collect() if best else []
        held = {(r.doc_id, r.which): (unpacked([r.t], WORDS + _SHAPES)[0], unpacked([r.m], META)[0]) for r in rows}
        return [[((r.doc_id, r.which), r.label, *held[r.doc_id, r.which]) for r in best if r.view == view] for view in (0, 1)]


def unpacked(cells, n: int) -> np.ndarray:
    """Rows of n features from cells of bytes."""
    return np.frombuffer(b"".join(cells), np.float16).reshape(-1, n).astype(np.float32)


def packed(row: np.ndarray) -> bytes:
    return np.minimum(row, np.finfo(np.float16).max).astype(np.float16).tobytes()


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The chance of good quality by a view, to nine digits, so that it doesn't depend on which rows are computed together."""
    return np.round(_sigmoid(x.astype(np.float64) @ w[:-1].astype(np.float64) + float(w[-1])), 9)


def exchange(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: ArrayPool | TablePool | None, rounds: int = ROUNDS, added: int = ADDED, sure: float = 0.9) -> CoTrained:
    """Each round, each view labels the pool rows of each class that it is surest of (`added` at most, at
    `sure` at least) for the other view's next fit; the first label that a row got stays. A fifth of the labelled rows, in
    order, takes no part in the fits and calibrates each view by a slope and a shift. The views say different things of a
    row, so their calibrated log-odds add up."""
    if not len(y) or len(set(y.tolist())) < 2:
        p = float(y.mean()) if len(y) else 0.5
        z = float(np.log((p + 1e-3) / (1 - p + 1e-3)))
        return CoTrained(np.zeros(text.shape[1] + 1, np.float32), np.zeros(meta.shape[1] + 1, np.float32), np.array([0.0, 0.0, z]))
    own = np.arange(len(y)) % 5 != 0
    if len(set(y[own].tolist())) < 2 or len(set(y[~own].tolist())) < 2:
        own[:] = True
        rest = own
    else:
        rest = ~own
    given: list[dict[Key, tuple[int, np.ndarray]]] = [{}, {}]
    weights: list[np.ndarray | None] = [None, None]
    for r in range(rounds + 1):
        for k, x in enumerate((text, meta)):
            rows = [given[k][i] for i in sorted(given[k])]
            fx = np.concatenate((x[own], np.stack([f for _, f in rows]))) if rows else x[own]
            fy = np.concatenate((y[own], np.array([label for label, _ in rows], y.dtype))) if rows else y[own]
            weights[k] = _logistic(fx, fy, weights[k])
        if r == rounds or pool is None:
            break
        for k, picked in enumerate(pool.surest(weights, added, sure)):
            for key, label, *features in picked:
                given[1 - k].setdefault(key, (label, features[1 - k]))
    blend = np.zeros(3)
    for k, (x, w) in enumerate(zip((text, meta), weights, strict=True)):
        z = x[rest] @ w[:-1] + w[-1]
        scale = max(float(np.abs(z).mean()), 1e-6)
        slope, shift = _logistic((z / scale)[:, None], y[rest], l2=1e-2, steps=300)
        blend[k], blend[2] = max(0.0, slope) / scale, blend[2] + shift
    return CoTrained(weights[0], weights[1], blend)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, added: int = ADDED, sure: float = 0.9) -> CoTrained:
    """exchange() with a pool in memory."""
    return exchange(text, meta, y, ArrayPool(pool_text, pool_meta) if len(pool_text) else None, rounds, added, sure)


def _features(rows: DataFrame) -> DataFrame:
    """(doc_id, which, quality, t, m): the features of whole texts and of metadata as bytes; which identifies what a row holds."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "which": b["which"], "quality": b["quality"], "t": [packed(text_features(t)) for t in b["text"]], "m": [packed(meta_features(*x)) for x in zip(b["source"], b["lang"], b["n_chars"], strict=True)]})

    rows = rows.select("doc_id", "which", "quality", "text", "source", "lang", "n_chars")
    return rows.mapInPandas(of, f"doc_id {dict(rows.dtypes)['doc_id']}, which long, quality int, t binary, m binary")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained:
    """The classifiers of labelled rows, bounded by a parameter, by a hash of the id, and of all other rows as the pool.

    Rows whose id or label is null are not labelled; an id with several labels takes the largest; of
    several rows of one labelled id the one with the least hash of text, source, language and size is learnt from. The
    features of all rows, two kilobytes a row before they are compressed, are stored once for all rounds; the driver gets
    `labelled` rows of fixed width and those that a round picks.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
    known, order = cut(known), F.xxhash64(F.lit("quality"), "doc_id")
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    some = F.broadcast(known.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(labelled))  # so many rows at most
    own = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars", F.xxhash64("text", "source", "lang", "n_chars").alias("which"))
    one = own.select("doc_id", "which").join(some, "doc_id").groupBy("doc_id").agg(F.min("which").alias("which"), F.first("quality").alias("quality"))
    picked = own.join(F.broadcast(one), ["doc_id", "which"]).dropDuplicates(["doc_id"])
    got = _features(picked).toPandas()
    got = got.sort_values("doc_id", key=lambda s: s.map(lambda i: zlib.crc32(str(i).encode()))).reset_index(drop=True)
    text, meta, y = unpacked(got["t"], WORDS + _SHAPES), unpacked(got["m"], META), (got["quality"].to_numpy() > 0).astype(np.float32)
    if len(set(y.tolist())) < 2:
        return exchange(text, meta, y, None)
    pool = Stored(_features(own.withColumn("quality", F.lit(None).cast("int"))))  # labelled rows too, so that no text is in a shuffle
    model = exchange(text, meta, y, TablePool(pool.df.select("doc_id", "which", "t", "m"), known))
    pool.drop()
    return model


def score(docs: DataFrame, model: CoTrained) -> Column:
    """struct<score, text_score, meta_score> of text, source, lang and n_chars."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score:double,text_score:double,meta_score:double>")
    def of(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        if not len(text):
            return pd.DataFrame({"score": [], "text_score": [], "meta_score": []}, dtype="float64")
        x = np.stack([text_features(t) for t in text])
        m = np.stack([meta_features(*v) for v in zip(source, lang, n_chars, strict=True)])
        return pd.DataFrame(dict(zip(("score", "text_score", "meta_score"), (np.asarray(v, np.float64) for v in shared.value.scores(x, m)), strict=True)))

    return of("text", "source", "lang", F.col("n_chars").cast("double"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with `quality_score` struct<score, text_score, meta_score>, a score for every row.

    Learns from labels (doc_id, quality) of rows that are not held out (see langid.held_out) and from
    all rows without label. Null and empty texts are scored by their metadata and the intercept;
    a null in a metadata column is a value of its own; without labels of both classes every score is
    the labels' mean (0.5 without any). Repeated rows each get the same score; an empty table stays empty;
    a column of docs called `quality_score` is replaced, others come out as they were.
    """
    return docs.withColumn("quality_score", score(docs, fit(docs.where(~held_out()), labels.where(~held_out()))))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("quality_score")
    return docs.select("doc_id", held_out().alias("held_out"), s["score"].alias("score"), s["text_score"].alias("text_score"), s["meta_score"].alias("meta_score"), (s["score"] >= 0.5).cast("int").alias("quality_pred"))
