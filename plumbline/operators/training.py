"""Softmax regression fitted in rounds: each round is one pass over the rows, whose tasks send one sum of gradients each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import inference

#: Rows whose gradient is taken in one multiplication.
ROWS = 8192


@dataclass
class Epoch:
    epoch: int
    lr: float
    train_loss: float
    train_accuracy: float
    val_loss: float
    val_accuracy: float
    val_macro_f1: float
    improved: bool


@dataclass
class Fit:
    """Weights (classes x (length + 1), the last column a bias) of the best epoch, and what each epoch was like."""

    labels: list[str]
    weights: np.ndarray
    best_epoch: int
    history: list[Epoch] = field(default_factory=list)
    stopped: bool = False

    def scorer(self) -> inference.BatchScorer:
        return inference.BatchScorer(inference.linear(self.weights[:, :-1], self.weights[:, -1]), self.labels, self.weights.shape[1] - 1)

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(vars(e).values()) for e in self.history], "epoch int, lr double, train_loss double, train_accuracy double, val_loss double, val_accuracy double, val_macro_f1 double, improved boolean")


def softmax_sums(weights: np.ndarray, x: np.ndarray, y: np.ndarray, gradient: bool = True) -> tuple[np.ndarray, float, np.ndarray]:
    """For rows x of classes y: the sum of gradients of the log loss, the sum of losses, the confusion matrix (true x predicted)."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    z = x @ weights.T
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    total = e.sum(1, keepdims=True)
    loss = float((np.log(total[:, 0]) - z[np.arange(len(x)), y]).sum())
    confusion = np.zeros((len(weights), len(weights)))
    np.add.at(confusion, (y, z.argmax(1)), 1)
    p = e / total
    p[np.arange(len(x)), y] -= 1
    return (p.T @ x if gradient else np.zeros((0, 0))), loss, confusion


def _pass(rows: DataFrame, weights: np.ndarray, gradient: bool) -> tuple[np.ndarray, float, np.ndarray]:
    """softmax_sums() over all rows (class, v): one row of sums leaves each task, and these are added up by place."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, total = shared.value, None
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.iloc[at : at + ROWS]
                g, loss, c = softmax_sums(w, np.stack(part["v"]).astype(np.float64), part["class"].to_numpy(), gradient)
                some = np.concatenate((g.ravel(), [loss], c.ravel()))
                some = np.append(np.nan_to_num(some), 0.0 if np.isfinite(some).all() else 1.0)  # a table's numbers may be null, but not what is no number
                total = some if total is None else total + some
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    parts = rows.select("class", "v").mapInPandas(sums, "sums array<double>")
    added = parts.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.array([r["x"] for r in sorted(added.collect())], np.float64)  # as many numbers as the model and a confusion matrix have
    shared.unpersist()
    k = len(weights)
    if not len(flat):
        raise ValueError("there are no rows")
    flat, spoilt = flat[:-1], flat[-1]
    if spoilt:
        raise ValueError("the loss is not finite")
    return flat[: len(flat) - 1 - k * k].reshape(k, -1) if gradient else weights, float(flat[-1 - k * k]), flat[len(flat) - k * k :].reshape(k, k)


def macro_f1(confusion: np.ndarray) -> float:
    """The mean F1 over all classes, 0 where a class has neither rows nor predictions."""
    both = confusion.sum(0) + confusion.sum(1)
    return float(np.mean(np.divide(2 * np.diag(confusion), both, out=np.zeros(len(both)), where=both > 0)))


def fit(train: DataFrame, validation: DataFrame, epochs: int, lr: float, patience: int | None = None, factor: float = 0.2, wait: int = 2, threshold: float = 1e-4, each: Callable[[Epoch], None] | None = None) -> Fit:
    """Full-batch gradient descent on rows (label, v), from zero weights.

    After each epoch the rows of validation are scored. The best epoch is the earliest of the best (macro F1, accuracy), and
    its weights are kept. The rate is cut by `factor` once macro F1 has not grown by the relative threshold for more
    than `wait` epochs; training stops once `patience` epochs went by without a better one. Labels are those of train, in string
    order; a label that only validation has is an error, as is a loss that is not finite. Rows are read
    anew in each pass: give a stored table.
    """
    labels = sorted(r[0] for r in train.select("label").distinct().collect())  # classes are few: their weights are one matrix
    if unknown := validation.where(~F.col("label").isin(labels)).select("label").first():
        raise ValueError(f"label {unknown[0]!r} is not in the training rows")
    index = F.array_position(F.array(*map(F.lit, labels)), F.col("label")).cast("int") - 1
    train, validation = (df.select(index.alias("class"), "v") for df in (train, validation))
    weights = np.zeros((len(labels), train.select(F.size("v")).first()[0] + 1))
    out, best, stale, top, bad = Fit(labels, weights, 0), None, 0, -np.inf, 0
    for epoch in range(1, epochs + 1):
        gradient, loss, seen = _pass(train, weights, True)
        n = seen.sum()
        weights = weights - lr / n * gradient
        _, val_loss, confusion = _pass(validation, weights, False)
        total = confusion.sum()
        f1, accuracy = macro_f1(confusion), float(np.trace(confusion) / total)
        improved = best is None or (f1, accuracy) > best
        out.history.append(Epoch(epoch, lr, float(loss / n), float(np.trace(seen) / n), float(val_loss / total), accuracy, f1, improved))
        if each:
            each(out.history[-1])
        if improved:
            best, stale, out.weights, out.best_epoch = (f1, accuracy), 0, weights, epoch
        else:
            stale += 1
        if f1 > (top if top < 0 else top * (1 + threshold)):
            top, bad = f1, 0
        else:
            bad += 1
        if bad > wait:
            lr, bad = lr * factor, 0
        if patience is not None and stale >= patience:
            out.stopped = True
            break
    return out
