import random
import re
from itertools import combinations

import xxhash

from plumbline.llm import simhash
from tests.conftest import SF


def brute(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(rows):
    """(doc_id, fingerprint, smallest id reachable) of (doc_id, text)."""
    prints = [(i, brute(t)) for i, t in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, f, least.get(find(k))) for k, (i, f) in enumerate(prints)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in df.collect()), key=repr)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in simhash.op9_simhash(spark, SF).collect()), key=repr)
    assert found == groups(rows)


def test_masks_cover_every_pair_within_the_radius():
    for radius in (1, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        r = random.Random(3)
        for _ in range(3000):
            flips = sum(1 << b for b in r.sample(range(64), radius))
            assert any(m & flips == 0 for m in masks)
        assert all(20 <= (m & (1 << 64) - 1).bit_count() <= 40 for m in masks) or radius == 1


def test_links_and_heavy_buckets_against_brute_force(spark):
    r = random.Random(4)
    prints = set()
    while len(prints) < 300:
        p = r.getrandbits(64)
        for _ in range(r.randint(1, 6)):
            prints.add(p)
            for b in r.sample(range(64), r.randint(1, 5)):
                p ^= 1 << b
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4

    def components(links):
        root = {p: p for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        out = {}
        for p in prints:
            out.setdefault(find(p), set()).add(p)
        return sorted(map(sorted, out.values()))

    want = components([(a, b) for a, b in combinations(prints, 2) if near(a, b)])
    for bucket in (20_000, 1):
        links = [(x.a, x.b) for x in simhash.near_links(df, bucket=bucket).collect()]
        assert all(near(a, b) for a, b in links) and components(links) == want


def test_long_texts_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(5000))
    whole = simhash.simhash(text)
    monkeypatch.setattr(simhash, "BLOCK", 37)
    assert simhash.simhash(text) == whole == (lambda f: f - (1 << 64) if f >> 63 else f)(brute(text))


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(simhash.near_groups(odd)) == groups(rows)
    assert simhash.near_groups(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    want = sorted({(c, f) for i, f, c in groups(rows) if i == c}, key=repr)
    assert sorted({(r.doc_id, brute(r.text)) for r in kept.collect()}, key=repr) == want and kept.count() == len(want)
