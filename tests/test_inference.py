import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import inference, metrics, scoring, training


def vectors(spark, n, d, labels, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(0, 1, (labels, d))
    rows = [(i, f"{i % labels:02d}", (centre[i % labels] + r.normal(0, 1, d)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, v array<double>"), rows


def test_bad_items_are_rows_with_an_error(spark):
    r = random.Random(1)
    good = lambda: [r.random() for _ in range(4)]
    rows = [(0, good()), (1, None), (2, good()[:3]), (3, [1.0, float("nan"), 0.0, 0.0]), (4, [1.0, None, 0.0, 0.0]), (5, []), (6, [float("inf")] * 4), (7, good()), (8, [1e308] * 4)]
    items = spark.createDataFrame(rows, "id long, v array<double>").repartition(2)
    weights, bias = np.array([[1.0, 2, 3, 4], [4.0, 3, 2, 1], [-1.0, 0, 0, 0]]), np.array([0.0, 0.1, 5])
    out = {x.id: x for x in inference.batch_scores(items, inference.linear(weights, bias), 4, 3).collect()}
    for i in (0, 7):
        assert out[i].error is None and np.allclose(out[i].outputs, weights @ rows[i][1] + bias)
    why = {1: "no vector", 2: "length 3, not 4", 3: "a component is null or not finite", 4: "a component is null or not finite", 5: "length 0, not 4", 6: "a component is null or not finite", 8: "an output is not finite"}
    assert {i: out[i].error for i in why} == why and all(out[i].outputs is None for i in why)
    res = {x.id: x for x in inference.BatchScorer(inference.linear(weights, bias), ["a", "b", "c"], 4).results(items, "id", 0.5).collect()}
    assert len(res) == 9 and {res[i].status for i in why} == {"ERROR"} and all(res[i].prediction is None and res[i].margin is None for i in why)
    z = weights @ rows[0][1] + bias
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert res[0].prediction == "abc"[p.argmax()] and abs(res[0].confidence - p.max()) < 1e-9


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    path = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{path}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda x: x.sum(1, keepdims=True)

    items = spark.range(5000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v")).repartition(8)
    assert inference.batch_scores(items, load, 2, 1, batch=50).where("outputs[0] = id + 1").count() == 5000
    assert len(list(tmp_path.iterdir())) <= 16


def plain_fit(rows, val, epochs, lr, patience, factor, wait):
    labels = sorted({x[1] for x in rows})
    x, y = np.array([[*x[2], 1] for x in rows]), np.array([labels.index(x[1]) for x in rows])
    vx, vy = np.array([[*x[2], 1] for x in val]), np.array([labels.index(x[1]) for x in val])
    w, best, stale, out, kept, top, bad = np.zeros((len(labels), x.shape[1])), None, 0, [], None, -1.0, 0
    for epoch in range(1, epochs + 1):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(len(x)), y]).mean()
        w = w - lr * ((p - np.eye(len(labels))[y]).T @ x) / len(x)
        guess = (vx @ w.T).argmax(1)
        accuracy = (guess == vy).mean()
        f1 = np.mean([2 * ((guess == c) & (vy == c)).sum() / max(1, (guess == c).sum() + (vy == c).sum()) for c in range(len(labels))])
        out.append((epoch, lr, loss, accuracy, f1))
        if best is None or (f1, accuracy) > best:
            best, stale, kept = (f1, accuracy), 0, (epoch, w)
        else:
            stale += 1
        if f1 > (top * (1 + 1e-4) if top >= 0 else top):
            top, bad = f1, 0
        else:
            bad += 1
            if bad > wait:
                lr, bad = lr * factor, 0
        if stale >= patience:
            break
    return out, kept


def test_training_against_plain_loops(spark):
    df, rows = vectors(spark, 300, 5, 4, seed=3)
    train, val = df.where("id % 3 <> 0").repartition(4).cache(), df.where("id % 3 = 0").cache()
    seen = []
    got = training.fit(train, val, epochs=40, lr=3.0, patience=6, factor=0.5, wait=1, each=seen.append)
    want, kept = plain_fit([r for r in rows if r[0] % 3], [r for r in rows if r[0] % 3 == 0], 40, 3.0, 6, 0.5, 1)
    assert [(e.epoch, round(e.lr, 9)) for e in got.history] == [(e[0], round(e[1], 9)) for e in want] and seen == got.history
    assert np.allclose([(e.train_loss, e.val_accuracy, e.val_macro_f1) for e in got.history], [e[2:] for e in want])
    assert got.stopped and len(got.history) < 40 and got.best_epoch == kept[0] and np.allclose(got.weights, kept[1])
    assert len({e.lr for e in got.history}) > 1
    found = scoring.prediction_of(got.scorer().logits(val.select("id", F.col("label").alias("true_label"), "v")).drop("error"))
    accuracy = metrics.accuracy(found).first().accuracy
    assert abs(accuracy - got.history[got.best_epoch - 1].val_accuracy) < 1e-12


def test_training_refuses(spark):
    df, _ = vectors(spark, 30, 3, 2)
    with pytest.raises(ValueError, match="not in the training rows"):
        training.fit(df.where("label = '00'"), df, 1, 0.1)
    with pytest.raises(ValueError, match="not finite"):
        training.fit(df.union(df.limit(1).withColumn("v", F.array(F.lit(float("nan")), F.lit(0.0), F.lit(0.0)))), df, 2, 0.1)


def test_scoring_costs_little_more_than_logits(spark):
    df, _ = vectors(spark, 3000, 32, 72)
    df = df.repartition(8).cache()
    df.count()
    scored = scoring.CentroidScorer(df).logits(df)
    took = {}
    for name, f in (("logits", scored.select(F.size("logits"), F.aggregate("logits", F.lit(0.0), lambda a, x: a + x["logit"]))), ("all", scoring.prediction_of(scored)), ("some", scoring.prediction_of(scored).where("predicted_label <> '01'"))):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            f.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = min(times)
    assert max(took["all"], took["some"]) < 2 * took["logits"] + 0.5, took


def test_centroids_of_any_number(spark, monkeypatch):
    df, _ = vectors(spark, 200, 6, 9)
    scorer = scoring.CentroidScorer(df, "euclidean")
    want = sorted((r.id, [(z.predicted_label, round(z.logit, 9)) for z in r.logits]) for r in scorer.logits(df).collect())
    monkeypatch.setattr(scoring, "MOST_NUMBERS", 12)
    got = sorted((r.id, [(z.predicted_label, round(z.logit, 9)) for z in r.logits]) for r in scorer.logits(df.union(df.where("id < 0"))).collect())
    assert got == want


def test_eleven_labels(spark):
    pred = spark.createDataFrame([(f"l{i:02d}", f"l{(i * i) % 11:02d}") for i in range(11)] * 2, "true_label string, predicted_label string")
    labels = spark.createDataFrame([(f"l{i:02d}", i) for i in range(11)], "label string, idx int")
    for r in metrics.confusion_wide(pred, labels).collect():
        i = int(r.true_label[1:])
        assert r.counts == [2 if j == (i * i) % 11 else 0 for j in range(11)]
