import numpy as np
import pytest

from plumbline.llm import embeddings
from tests.conftest import SF

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    ids = [i for i, _, _ in rows]
    sound = [v is not None and i is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, label in rows]
    x = [np.array(v, np.float32).astype(float) if ok else None for ok, (_, v, _) in zip(sound, rows)]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if sound[a] and sound[b] and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt(x[a] @ x[a] * (x[b] @ x[b])) >= least:
                links[a].add(b)
                links[b].add(a)
    out = []
    for a in links:
        seen, stack = {a}, [a]
        while stack:
            for b in links[stack.pop()] - seen:
                seen.add(b)
                stack.append(b)
        out.append((ids[a], len(links[a]), min((ids[b] for b in seen), key=lambda i: (i is None, i or 0))))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def clustered(seed, n=400, dim=64, labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(n // 8, dim))
    rows = []
    for i in range(n):
        v = centres[i % len(centres)] + r.normal(size=dim) * r.choice([0, 0.1, 0.25, 0.4])
        rows.append((i, [float(x) for x in np.float32(v)], int(i % len(centres)) % labels))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_against_brute_force(spark, seed):
    rows = clustered(seed)
    found, want = got(embeddings.near_vectors(spark.createDataFrame(rows, KIND))), brute(rows)
    total = lambda x: sum(n for _, n, _ in x)
    assert total(want) > 500 and total(found) >= 0.99 * total(want)
    assert all(a[1] <= b[1] for a, b in zip(sorted(found), sorted(want)))


def test_blocks_of_a_hot_bucket_lose_nothing(spark):
    rows = [(i, [float(x) for x in np.float32(np.eye(16)[0] + np.random.default_rng(i).normal(size=16) * 0.02)], 1) for i in range(200)]
    found = got(embeddings.near_vectors(spark.createDataFrame(rows, KIND), block=30))
    assert found == brute(rows) and all(n == 199 and c == 0 for _, n, c in found)


def test_odd_vectors(spark):
    one, two = [1.0] + [0.0] * 7, [1.0, 0.1] + [0.0] * 6
    rows = [(5, one, 1), (3, one, 1), (3, two, 1), (7, two, 2), (8, one, None), (None, one, 1), (9, None, 1), (10, [0.0] * 8, 1), (11, [None] + one[1:], 1), (12, [float("nan")] + one[1:], 1), (13, [float("inf")] + one[1:], 1), (14, [1.0], 1), (15, [], 1), (16, [1e-30] + [0.0] * 7, 1), (17, [3e38] + [0.0] * 7, 1)]
    found = got(embeddings.near_vectors(spark.createDataFrame(rows, KIND)))
    assert {x[0]: x[1:] for x in found if x[0] not in (3, None)} == {5: (4, 3), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10), 11: (0, 11), 12: (0, 12), 13: (0, 13), 14: (0, 14), 15: (0, 15), 16: (4, 3), 17: (4, 3)}
    assert [x for x in found if x[0] == 3] == [(3, 4, 3)] * 2 and (None, 0, None) in found
    assert embeddings.near_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = embeddings.op8_embeddings(spark, SF)
    assert got(found) == brute(rows) and found.where("kept <> (vec_id = component_id)").count() == 0


def test_pairs_at_the_threshold_share_a_bucket():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(2, 10_000, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.sqrt((y * y).sum(1, keepdims=True))
    met = np.zeros(len(x), bool)
    for t in range(embeddings.TABLES):
        a, b = embeddings.buckets(x, t), embeddings.buckets(y, t)
        met |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert met.all()
