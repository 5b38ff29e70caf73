"""Hashes of words and runs that op6_passages takes from running sums, against plain loops."""

import random

import numpy as np

from plumbline.llm import passages as p


def test_words_across_pieces_and_long_words():
    r = random.Random(5)
    sizes = [r.randint(1, 30) for _ in range(9000)]
    sizes[100:100] = [p.PIECE - 1, p.PIECE, p.PIECE + 1, 3 * p.PIECE + 7]
    words = [bytes(r.choices(b"abcdefgh\xc3\xa9\x00", k=n)) for n in sizes]
    text = b" \n" + b"".join(w + r.choice([b" ", b"\t", b"\r\n", b"\x0b\x0c"]) for w in words) + b"last"
    got, starts = p._words(text, places=True)
    assert len(got) == len(words) + 1 and all(text[s : s + len(w)] == w for s, w in zip(starts, words))
    base, mask = int(p._BASE), (1 << 64) - 1
    for h, w in random.Random(1).sample(list(zip(got.tolist(), [*words, b"last"], strict=True)), 300) + list(zip(got[98:106].tolist(), words[98:106])):
        total, power = 0, 1
        for c in w:
            total, power = total + int(p._NUMBERS[c]) * power & mask, power * base & mask
        total = (total ^ len(w) * 0xD6E8FEB86659FD93 & mask) * 0xBF58476D1CE4E5B9 & mask
        assert h == total ^ total >> 32


def test_tokens_of_many_texts_count_their_words():
    texts = [None, "", "  ", "a b c d", "A b\tc\nd e", b"a b c d e f", "é " * 50, "x" * 70_000 + " y z u v w", *["one two three four five six"] * 3]
    found, counts = p._tokens_of(texts)
    plain = [len((t.decode() if isinstance(t, bytes) else t or "").split()) for t in texts]
    assert counts.tolist() == plain
    want = np.concatenate([p.tokens(t.decode() if isinstance(t, bytes) else t)[0] for t in texts])
    assert (found == want).all()


def test_first_of_their_kind_and_runs():
    r = np.random.default_rng(2)
    for n, kinds in ((0, 1), (1, 1), (500, 3), (5000, 4000), (5000, 1 << 40)):
        v = r.integers(0, kinds, n).astype(np.uint64)
        want = np.zeros(n, bool)
        want[np.unique(v, return_index=True)[1]] = True
        assert (p._first(v) == want).all()
    h = r.integers(0, 2, 4000).astype(np.uint64)
    for n in (1, 2, 3, 7, 8, 12):
        plain = [tuple(h[i : i + n].tolist()) for i in range(len(h) - n + 1)]
        got = p._runs(h, n).tolist()
        assert len(got) == len(plain) and len(set(zip(got, plain))) == len(set(got)) == len(set(plain))


def test_result_counts_words_without_a_regular_expression(spark):
    texts = [None, "", "  a\x0bb\x0cc\r\nd ", "one", "w " * 60, "w " * 60]
    out = p.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {x.doc_id: x.n_words for x in out.collect()} == {0: 0, 1: 0, 2: 4, 3: 1, 4: 60, 5: 60}


def test_passages_of_few_distinct_tokens_are_compared_only_where_they_can_be_similar(monkeypatch):
    """Items of texts that say few words again and again share a key and nothing else; those that are similar are linked all the same."""
    r = np.random.default_rng(4)
    rows = [r.choice(r.integers(0, 1 << 32, 12), p.SPAN) for _ in range(200)]
    rows += [np.where(np.arange(p.SPAN) == k, 7, rows[k]) for k in range(0, 40, 4)]  # one token of 46 is another
    tokens = np.array(rows, np.uint32)
    n = len(tokens)
    items = p._Items(np.zeros(n, int), np.arange(n), np.zeros(n, int), np.full(n, 5), np.ones(n, int), [t.tobytes() for t in tokens])
    compared, near = [], p._Items.near
    monkeypatch.setattr(p._Items, "near", lambda self, a, of, b: (compared.append(len(b)), near(self, a, of, b))[1])
    got = {(int(a), int(b)) for a, b, *_ in items.links()}
    sets = [set(t.tolist()) for t in tokens]
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if len(sets[a] & sets[b]) >= p.SIMILAR * len(sets[a] | sets[b])}
    assert len(want) >= 10 and {tuple(sorted(x)) for x in got} == want
    assert sum(compared) <= 20 * len(want)  # all 22,000 before
