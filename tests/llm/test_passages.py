import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import passages


def test_compact_windows_against_brute_force():
    r = random.Random(1)
    for _ in range(300):
        n, span = r.randint(1, 40), r.randint(1, 8)
        h = np.array([r.randint(0, 15) for _ in range(n)], np.uint64)
        want = []
        for c in range(n):
            lo = hi = c
            while lo > 0 and h[lo - 1] > h[c]:
                lo -= 1
            while hi < n - 1 and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= span:
                want.append((lo, c, hi))
        assert sorted(passages.compact_windows(h << np.uint64(40), span)) == sorted(want)


def covered(docs):
    """Words in a run of PASSAGE words that another document has too."""
    runs = defaultdict(set)
    for i, text in docs.items():
        w = text.encode().lower().split()
        for k in range(len(w) - passages.PASSAGE + 1):
            runs[tuple(w[k : k + passages.PASSAGE])].add((i, k))
    out = defaultdict(set)
    for v in runs.values():
        if len({i for i, _ in v}) > 1:
            for i, k in v:
                out[i].update(range(k, k + passages.PASSAGE))
    return out


def words(r):
    return {w for s in filter(None, r.spans.split(",")) for w in range(*map(int, s.split("-")))}


def test_planted_passages_hot_groups_and_clean_documents(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, edited = text(60), text(90)
    docs = {i: text(150) for i in range(60)}
    for i in range(40):
        at = r.randint(0, 100)
        docs[i][at:at] = shared
    changed = [*edited]
    changed[20] = "changed"
    docs[50][70:70], docs[51][10:10] = edited, changed
    line = text(20)
    for i in range(52, 60):
        docs[i][r.randint(0, 100) : 0] = line
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {x.doc_id: x for x in passages.repeated_passages(df).collect()}
    for i in range(40):
        assert got[i].n_passages == 1 and got[i].n_repeated_words >= 60 and got[i].component_id == 0
    assert got[50].n_passages == 1 and got[51].component_id == got[50].component_id == 50
    for i in [*range(40, 50), *range(52, 60)]:
        assert got[i].n_passages == 0 and got[i].component_id == i


def similar(p, q):
    """Whether two runs of words hold similar passages, by all pairs of runs of SPAN tokens."""
    a, b = ([tuple(w[i : i + passages.SHINGLE]) for i in range(len(w) - passages.SHINGLE + 1)] for w in (p, q))
    runs = lambda t: [set(t[i : i + passages.SPAN]) for i in range(len(t) - passages.SPAN + 1)]
    return any(len(x & y) >= passages.SIMILAR * len(x | y) for x in runs(a) for y in runs(b))


@pytest.mark.parametrize("hot", [0, 1000])
def test_recall_of_edited_passages_against_brute_force(spark, hot):
    """Pairs in foreign surroundings with words changed, taken out or put in, at random places and in the middle; also
    where a thousand other documents hold the first 30 words of each (unlike one another around them)."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    around = lambda p: " ".join([word() for _ in range(r.randint(10, 70))] + p + [word() for _ in range(r.randint(10, 70))])
    docs, want, head = [], {}, [word() for _ in range(30)]
    for n, edits in ((50, 1), (52, 1), (55, 1), (60, 1), (60, 2), (90, 1), (90, 2), (120, 4)):
        for k in range(60):
            p = [*(head if hot else ()), *[word() for _ in range(n)]][:n]
            q = list(p)
            for at in [n // 2] if edits == 1 and k % 2 else r.sample(range(n), edits):
                q[at : at + r.choice((1, 1, 0))] = [word()] * r.choice((1, 1, 0))
            if similar(p, q):
                want.setdefault((n, edits), []).append(len(docs))
            docs += [around(p), around(q)]
    pairs = len(docs)
    docs += [around(head) for _ in range(hot)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x.doc_id: x for x in passages.repeated_passages(df, block=256).collect()}
    for kind, firsts in want.items():
        found = sum(got[i].component_id == got[i + 1].component_id and got[i].n_passages * got[i + 1].n_passages > 0 for i in firsts)
        assert found >= 0.9 * len(firsts), (kind, found, len(firsts))
    assert all(got[i].n_passages == 0 for i in range(pairs, len(docs)))
    assert all(got[i].component_id in (i, i - i % 2) for i in range(pairs))


def test_every_word_of_exact_passages_is_reported(spark):
    """Also where most documents hold a passage and some a longer form of it, on one side or both, in several steps."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    docs = {}
    for _ in range(12):
        before, core, after = text(40), text(60), text(40)
        for _ in range(24):
            lo, hi = r.choice((0, 0, 3, 5, 10, 20, 33)), r.choice((0, 0, 4, 5, 10, 20, 33))
            passage = before[len(before) - lo :] + core + after[:hi]
            docs[len(docs)] = " ".join(text(r.randint(5, 80)) + passage * r.choice((1, 1, 1, 2)) + text(r.randint(5, 80)))
    want = covered(docs)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for x in passages.repeated_passages(df).collect():
        assert want[x.doc_id] <= words(x) and x.n_repeated_words == len(words(x))


def test_edited_passages_around_a_common_phrase(spark):
    """Pairs are found, although hundreds of unrelated documents hold 30 of their words: but for the few, 3 % on the mean,
    of which fewer than two of four min-hashes agree."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    phrase, docs = text(30), {}
    for i in range(100):
        side = r.choice((1, -1))
        p = (phrase + text(24)) if side > 0 else text(24) + phrase
        q = list(p)
        q[32 if side > 0 else -33] = word()
        docs[2 * i], docs[2 * i + 1] = (" ".join(text(30) + x + text(30)) for x in (p, q))
    for i in range(200, 500):
        docs[i] = " ".join(text(40) + phrase + text(40))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in passages.repeated_passages(df).collect()}
    assert all(got[i].component_id in (i, i - i % 2) for i in range(200))
    assert sum(got[i].component_id == i - i % 2 and got[i].n_repeated_words >= 45 for i in range(200)) >= 190
    assert all(got[i].n_passages == 0 for i in range(200, 500))


def test_every_word_of_exact_passages_in_sample(spark):
    sf = "/root/testdata/sf0.01"
    want = covered({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    assert all(want[r.doc_id] <= words(r) for r in passages.op6_passages(spark, sf).collect())


def test_signatures_and_candidates_agree_with_plain_windows():
    r = random.Random(9)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(n)) for n in (0, 3, 49, 50, 51, 80, 300, 7, 120)] + [None]
    row, f, key, left, c, right = passages.signatures(texts)
    for i, text in enumerate(texts):
        t = passages.tokens(text)[0]
        for g in range(passages.HASHES):
            h, at = passages._mixed(t, g), (row == i) & (f == g)
            assert sorted(zip(left[at].tolist(), c[at].tolist(), right[at].tolist())) == sorted(passages.compact_windows(h))
            assert np.array_equal(key[at].view(np.uint64), h[c[at]] ^ np.uint64(g))
        if len(t) >= passages.SPAN:
            at = row == i
            count, _, first, last, centre = passages.held_by(f[at], key[at], left[at], c[at], right[at], 0, len(t) - passages.SPAN + 1)
            assert count.tolist() == [passages.HASHES] * (len(t) - passages.SPAN + 1)
            assert sorted(k for s, e in zip(first, last) for k in range(s, e + 1)) == sorted([*range(len(count))] * (passages.HASHES * (passages.HASHES - 1) // 2))
            assert set((first + centre).tolist()) <= set(c[at].tolist()) and (centre < passages.SPAN).all()


def test_odd_rows(spark, odd, none):
    got = passages.repeated_passages(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words or 0) >= r.n_repeated_words
    assert passages.repeated_passages(none).count() == 0
    twice = spark.createDataFrame([(1, "w x y z " * 20), (2, "w x y z " * 20), (2, "w x y z " * 20), (3, "short"), (4, "short")], "doc_id long, text string")
    got = passages.repeated_passages(twice).collect()
    assert sorted((r.doc_id, r.spans, r.component_id) for r in got) == [(1, "0-80", 1), (2, "0-80", 1), (2, "0-80", 1), (3, "", 3), (4, "", 4)]
