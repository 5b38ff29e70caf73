import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality


def test_held_out_quality(spark):
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert (got.quality_pred == got.quality).mean() > 0.85


def test_every_row_is_scored(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (6, 1), (7, None), (None, 1), (5, 0), (5, 0)], "doc_id long, quality int")
    got = quality.quality_scores(odd, labels).select("quality_score.score").collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(none, labels).count() == 0
    blank = quality.quality_scores(odd, labels.limit(0)).select("quality_score.score").collect()
    assert all(abs(r.score - 0.5) < 1e-6 for r in blank)


def test_views_teach_each_other():
    """Over seeds, each view and their sum do better with the other's pseudo-labels than without."""
    found = {0: [], 5: []}
    for seed in range(12):
        r = np.random.default_rng(seed)
        y = (r.random(600) > 0.5).astype(np.float32)
        text, meta = (np.stack([y + r.normal(0, s, 600), r.normal(0, 1, 600)], 1).astype(np.float32) for s in (0.3, 0.6))
        for rounds, out in found.items():
            m = quality.co_train(text[:40], meta[:40], y[:40], text[40:], meta[40:], rounds=rounds)
            out.append([((p > 0.5) == (y > 0.5)).mean() for p in m.scores(text, meta)])
    without, with_ = (np.mean(x, 0) for x in found.values())
    assert (with_ > without).all()


def test_a_hot_id_is_learnt_from_once(spark, monkeypatch):
    """However many rows have one id, the driver gets one of each id, always the same."""
    rows = [(1, f"text {i}", "en", "s", i) for i in range(500)] + [(i, "good words here" if i % 2 else "BAD!!! BAD!!!", "en", "s", 10) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 20)], "doc_id long, quality int")
    seen = []
    plain = quality.exchange
    monkeypatch.setattr(quality, "exchange", lambda *a: seen.append((*a[:3], a[3].rows.join(a[3].known, "doc_id", "left_anti").select("doc_id", "which", "t", "m").distinct().toPandas())) or plain(*a))
    first = quality.fit(docs, labels)
    second = quality.fit(docs.repartition(7), labels)
    assert [len(x[2]) for x in seen] == [19, 19] and [len(x[3]) for x in seen] == [10, 10]
    assert all(np.array_equal(a, b) for a, b in zip(seen[0][:3], seen[1][:3])) and np.array_equal(first.text, second.text) and np.array_equal(first.blend, second.blend)


def plain_logistic(x, y, start, l2, steps):
    """Gradients row by row, by Nesterov's method, classes weighing the same."""
    rows = [[*map(float, r), 1.0] for r in x]
    n = {c: max(1, sum(1 for v in y if v == c)) for c in (0, 1)}
    weight = [0.5 / n[int(v)] for v in y]
    rate = 4 / (sum(w * sum(v * v for v in r) for w, r in zip(weight, rows)) + l2)
    w = list(start) if start is not None else [0.0] * len(rows[0])
    v = list(w)
    for i in range(steps):
        g = [l2 * a for a in v]
        for r, label, c in zip(rows, y, weight):
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(r, v))))))
            for j, a in enumerate(r):
                g[j] += c * (p - label) * a
        new = [a - rate * b for a, b in zip(v, g)]
        v = [a + i / (i + 3) * (a - b) for a, b in zip(new, w)]
        w = new
    return w


def plain_co_training(text, meta, y, pool, rounds, added, sure):
    """The exchange and the calibration with lists and dictionaries; pool: key -> (text, meta), in order of ties."""
    own = [i for i in range(len(y)) if i % 5]
    rest = [i for i in range(len(y)) if i % 5 == 0]
    views, given, weights = (text, meta), [{}, {}], [None, None]
    at = lambda f, w: sum(float(a) * b for a, b in zip(f, w)) + w[-1]
    for r in range(rounds + 1):
        for k in (0, 1):
            keys = sorted(given[k])
            weights[k] = plain_logistic([views[k][i] for i in own] + [pool[i][k] for i in keys], [y[i] for i in own] + [given[k][i] for i in keys], weights[k], 1e-3, 120)
        if r == rounds:
            break
        new = []
        for k in (0, 1):
            p = {key: round(1 / (1 + math.exp(-at(f[k], weights[k]))), 9) for key, f in pool.items()}
            for label in (1, 0):
                q = {key: v if label else round(1 - v, 9) for key, v in p.items()}
                new += [(1 - k, key, label) for key in sorted(q, key=lambda key: -q[key])[:added] if q[key] >= sure]
        for k, key, label in new:
            given[k].setdefault(key, label)
    blend = [0.0, 0.0, 0.0]
    for k in (0, 1):
        z = [at(views[k][i], weights[k]) for i in rest]
        scale = max(sum(map(abs, z)) / len(z), 1e-6)
        slope, shift = plain_logistic([[v / scale] for v in z], [y[i] for i in rest], None, 1e-2, 300)
        blend[k], blend[2] = max(0.0, slope) / scale, blend[2] + shift
    return weights, blend, given


def test_exchange_and_calibration_against_plain_loops():
    r = np.random.default_rng(11)
    y = (r.random(140) > 0.4).astype(np.float32)
    text, meta = (np.stack([2 * y + r.normal(0, s, 140), r.normal(0, 1, 140), (r.random(140) > 0.5)], 1).astype(np.float32) for s in (0.4, 0.8))
    pool = {(i,): (text[40 + i], meta[40 + i]) for i in range(100)}
    got = quality.co_train(text[:40], meta[:40], y[:40], text[40:], meta[40:], rounds=3, added=7, sure=0.8)
    weights, blend, given = plain_co_training(text[:40].tolist(), meta[:40].tolist(), y[:40].tolist(), pool, 3, 7, 0.8)
    assert min(map(len, given)) > 10
    assert np.allclose(got.text, weights[0], atol=1e-3) and np.allclose(got.meta, weights[1], atol=1e-3) and np.allclose(got.blend, blend, atol=1e-2)
    probability = [1 / (1 + math.exp(-(blend[0] * (t @ np.array(weights[0])[:-1] + weights[0][-1]) + blend[1] * (m @ np.array(weights[1])[:-1] + weights[1][-1]) + blend[2]))) for t, m in zip(text, meta)]
    assert np.allclose(got.scores(text, meta)[0], probability, atol=1e-3)


def test_the_pool_of_a_table_is_that_in_memory(spark):
    """All unlabelled rows take part, whatever partitions they are in, and repeated ones count once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = quality._features(docs.withColumns({"which": F.lit(7).cast("long"), "quality": F.lit(None).cast("int")})).drop("quality").cache()
    local = rows.toPandas()
    local = local.sort_values("doc_id", key=lambda s: s.map(lambda i: zlib.crc32(str(i).encode()))).reset_index(drop=True)
    text, meta = quality.unpacked(local["t"], quality.WORDS + 10), quality.unpacked(local["m"], quality.META)
    r = np.random.default_rng(2)
    weights = [r.normal(0, 1, text.shape[1] + 1).astype(np.float32), r.normal(0, 1, meta.shape[1] + 1).astype(np.float32)]
    for added, sure in ((5, 0.5), (1000, 0.6), (3, 1.1)):
        want = quality.ArrayPool(text, meta).surest(weights, added, sure)
        more = rows.limit(20).withColumn("doc_id", F.col("doc_id") + 1_000_000)  # rows with a label take no part
        got = quality.TablePool(rows.union(rows).union(more).repartition(5), more.select("doc_id")).surest(weights, added, sure)
        for a, b in zip(want, got, strict=True):
            assert [(local["doc_id"][k[0]], label) for k, label, *_ in a] == [(k[0], label) for k, label, *_ in b]
            assert all(np.array_equal(x[2], z[2]) and np.array_equal(x[3], z[3]) for x, z in zip(a, b))
