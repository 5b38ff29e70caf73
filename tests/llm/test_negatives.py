import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import negatives
from tests.compare import rows
from tests.conftest import SF

SCHEMA = "vec_id long, label string, v array<bigint>, id int, anchor string, leaf int"


def brute(data, every=10):
    keep = {}
    for i, label, v in data:
        if i is not None and label is not None and v is not None and None not in v and (i not in keep or (label, v) < keep[i]):
            keep[i] = (label, v)

    def score(a, b):
        return sum(x * y for x, y in zip(keep[a][1], keep[b][1]))

    out = []
    for a in [i for i in keep if i % every == 0]:
        ranked = sorted(((-score(a, b), b) for b in keep if b != a))
        for minus, p in [x for x in ranked if keep[x[1]][0] == keep[a][0]][:5]:
            fits = [(-n, b) for n, b in ranked if keep[b][0] != keep[a][0] and 30 * -minus <= 100 * -n <= 90 * -minus][:10]
            out += [(a, p, k, b, -minus, n) for k, (n, b) in enumerate(fits, 1)]
    return sorted(out)


def got(spark, data, every=10):
    df = spark.createDataFrame([(*r, 1, "a", 2) for r in data], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


def test_query_matches_sql(spark, duck):
    assert rows(negatives.op11_negatives(spark, SF).toPandas()) == rows(duck.sql(negatives.OP11_SQL).df())


@pytest.mark.parametrize("block", [8, 40])
def test_many_leaves_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "LEAST", 2)
    r = np.random.default_rng(block)
    centres = r.normal(0, 100, (12, 6))
    data = [(i, "abc"[i % 3], [int(x) for x in np.floor(centres[i % 12] + r.normal(0, 10, 6))]) for i in range(400)]
    data += [(1000 + i, "abc"[i % 3], data[7][2]) for i in range(150)]  # copies
    assert got(spark, data) == brute(data)


def test_leaves_are_left_out_only_where_they_cannot_matter():
    r = np.random.default_rng(1)
    x = np.floor(r.normal(0, 100, (40, 5))[r.integers(0, 40, 3000)] + r.normal(0, 5, (3000, 5)))
    tree = negatives.Tree(float((x * x).sum(1).max()))
    tree.grow(tree.augmented(x), 50)
    leaf, above = tree.leaves(tree.augmented(x))
    tree.low, tree.high = (np.array([f(above[leaf == i], axis=0) for i in range(len(tree.paths))]) for f in (np.min, np.max))
    q = x[::60]
    low, high = tree.scores(q)
    score = q @ x.T
    for i in range(len(tree.paths)):
        assert (score[:, leaf == i] >= low[:, [i]]).all() and (score[:, leaf == i] <= high[:, [i]]).all()
    best = -np.sort(-score, axis=1)[:, [9]]
    assert len(tree.paths) > 20 and (high < best).mean() > 0.2


def test_odd_rows(spark):
    r = random.Random(2)
    data = [(i, r.choice("ab"), [r.randint(-9, 9) for _ in range(r.choice([3, 3, 3, 2, 0]))]) for i in range(60)]
    data += [(None, "a", [1, 2, 3]), (70, None, [1, 2, 3]), (80, "a", None), (90, "b", [1, None, 3]), (10, "a", [9, 9, 9]), (10, "a", [9, 9, 9]), (100, "only", [1, 1, 1]), (110, "a", [0, 0, 0])]
    assert got(spark, data) == brute(data)
    assert got(spark, []) == []


def test_large_numbers_are_exact(spark):
    data = [(i, "ab"[i % 2], [(1 << 28) + i * i, (1 << 27) - i, 3]) for i in range(40)]
    assert got(spark, data) == brute(data)


def test_query_leaves_unsound_rows_out(spark, tmp_path):
    v = [[0.5, 0.25], [0.5, 0.3], [float("nan"), 0.1], [0.4, None], None, [0.3, 0.2], [-0.001, math.inf]]
    spark.createDataFrame([(i * 100, x, i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = negatives.op11_negatives(spark, str(tmp_path)).collect()
    assert {r.anchor_id for r in found} | {r.negative_id for r in found} <= {0, 100, 500}
