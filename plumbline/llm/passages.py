"""Near-duplicate passages across documents by compact windows.

A token is the hash of five words, a passage a run of SPAN tokens. For a hash function, the compact window
(l, c, r) of a document says that every run of tokens from i to j with l <= i <= c <= j <= r has its least hash
at c: all these runs share one min-hash, the window's signature. The windows of a document are the nodes of the
Cartesian tree over its hashes whose subtrees hold a passage, about two for each SPAN tokens.

Windows with a signature that another document has are interval-joined within their document: where windows of
two hash functions hold the same passage, the two signatures are a key. Documents with a key in common are
candidates there, and their passages are compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.native import small_side
from plumbline.operators.graph import connected_components
from plumbline.runtime import Stored, cut

#: Words of a token, words of a passage at least, hash functions; passages of two functions' common min-hashes are
#: compared. Of four functions each agrees with a chance equal to the similarity, so at 0.8 two do with 97 %.
SHINGLE, PASSAGE, HASHES = 5, 50, 4
#: Tokens of a passage, and their Jaccard similarity at least.
SPAN = PASSAGE - SHINGLE + 1
SIMILAR = 0.8
#: Distinct tokens that two passages without repeated ones share at least.
SHARED = int(np.ceil(2 * SPAN * SIMILAR / (1 + SIMILAR)))
#: Passages of one key that a task compares with one another; a larger group is compared block by block.
BLOCK = 4096
#: Passages that are compared, or written, in one step.
STEP = 20_000
#: Bytes of text that are looked at in one step, and whose words are hashed in one step.
STRETCH, PIECE = 1 << 20, 1 << 16
_GAP = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_NUMBERS = np.array([xxhash.xxh64_intdigest(bytes([i])) for i in range(256)], np.uint64)
_BASE = np.uint64(xxhash.xxh64_intdigest(b"base") | 5)
_POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(PIECE - 1, _BASE, np.uint64))))
_INVERSE = np.concatenate(([np.uint64(1)], np.cumprod(np.full(PIECE - 1, pow(int(_BASE), -1, 1 << 64), np.uint64))))
_PLACES = np.uint64((1 << 30) - 1)


def tokens(text: str | None) -> tuple[np.ndarray, int]:
    """(hashes of each SHINGLE consecutive words as uint64, number of words). A-Z is lowered, words are runs without ASCII white space."""
    words = _words(text.encode("utf-8", "surrogatepass").lower() if text else b"")
    return (_chained(words, SHINGLE) if len(words) >= SHINGLE else words[:0]), len(words)


def tokens_of(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of tokens() of all texts in a row, how many each text has)."""
    found, counts = _tokens_of(texts)
    return found, np.maximum(counts - (SHINGLE - 1), 0)


def _tokens_of(texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(the hashes of tokens() of all texts in a row, how many words each text has); bytes are UTF-8."""
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):  # many short texts at a time, as each step has a cost of its own
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= STRETCH):
            size += len(raw[end]) + 1
            end += 1
        ends = np.cumsum([len(x) + 1 for x in raw[at:end]])
        words, starts = _words(b" ".join(raw[at:end]).lower(), places=True)
        n = np.diff(np.searchsorted(starts, ends), prepend=0)
        counts.append(n)
        if len(words) >= SHINGLE:
            size = np.maximum(n - (SHINGLE - 1), 0)
            found.append(_chained(words, SHINGLE)[np.repeat(np.cumsum(n) - n - np.cumsum(size) + size, size) + np.arange(size.sum())])
        at = end
    return np.concatenate(found), np.concatenate(counts)


def _words(text: bytes, places: bool = False):
    """A hash of each word of a text, and where the words start: a sum of a number for each byte times a power for its place
    in the word, in 64 bits, mixed with the length. Sums of all words come from the running sum of a piece of text."""
    code = np.frombuffer(text, np.uint8)
    word = ~_GAP[code]
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False)) if len(code) else np.zeros(0, np.int64)
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return (np.zeros(0, np.uint64), starts) if places else np.zeros(0, np.uint64)
    sizes = stops - starts
    out = np.empty(len(starts), np.uint64)
    total = np.zeros(PIECE + 1, np.uint64)
    a = 0
    while a < len(starts):  # pieces of whole words
        b = max(a + 1, int(np.searchsorted(stops, starts[a] + PIECE, "right")))
        if sizes[a] > PIECE:
            out[a] = _long_word(code[starts[a] : stops[a]])
        else:
            piece = _NUMBERS[code[starts[a] : stops[b - 1]]]
            piece *= _POWERS[: len(piece)]
            np.cumsum(piece, out=total[1 : len(piece) + 1])
            first = starts[a:b] - starts[a]
            out[a:b] = (total[stops[a:b] - starts[a]] - total[first]) * _INVERSE[first]
        a = b
    out ^= sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return (out, starts) if places else out


def _long_word(code: np.ndarray) -> int:
    """The sum of a word of over PIECE bytes, piece by piece."""
    total = 0
    for at in range(0, len(code), PIECE):
        part = code[at : at + PIECE]
        total += int((_NUMBERS[part] * _POWERS[: len(part)]).sum(dtype=np.uint64)) * pow(int(_BASE), at, 1 << 64)
    return total % (1 << 64)


def _chained(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out ^= h[i : i + len(out)]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, put together from hashes of runs of half the length."""
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = a * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out += b
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return out

    width = 1
    while width * 2 <= n:
        h, width = pair(h[:-width], h[width:]), width * 2
    return pair(h[: len(h) - n + width], h[n - width :]) if width < n else h


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of stretches of a column of texts, of STRETCH bytes at most where a text is no longer than that."""
    if not len(texts):
        return
    size = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32 if texts.type in (pa.string(), pa.binary()) else np.int64)[texts.offset : texts.offset + len(texts) + 1]).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + STRETCH, "right")))
        yield at, end
        at = end


def _raw(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.binary() if texts.type in (pa.string(), pa.binary()) else pa.large_binary()).to_pylist()


def _mixed(t: np.ndarray, seed: int) -> np.ndarray:
    t = (t ^ np.uint64(seed * 0x5851F42D4C957F2D + 0x14057B7EF767814F & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    return t ^ t >> np.uint64(31)


def compact_windows(hashes: np.ndarray, span: int = SPAN, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(l, c, r) of every window of `span` hashes or more, r included; of equal hashes the first is the least.

    `ends` are the ends of documents that stand in a row in `hashes`, each a tree of its own. The centres, nodes of
    the Cartesian tree with `span` hashes or more below, are the sliding minima. l and r come from the tree of the
    centres alone, as the nearest smaller hash on either side of a centre is a centre too.
    """
    ends = np.array([len(hashes)]) if ends is None else ends
    return [tuple(x) for x in _windows(hashes, span, ends, _inside(span, ends)).tolist()]


def _inside(span: int, ends: np.ndarray) -> np.ndarray:
    """Whether the runs of `span` values that begin at each place lie in one document."""
    sizes = np.diff(ends, prepend=0)
    good = np.ones(int(ends[-1]), bool)
    for k in range(1, span):
        good[(ends - k)[sizes >= k]] = False
    return good[: max(len(good) - span + 1, 0)]


def _windows(hashes: np.ndarray, span: int, ends: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """compact_windows() as rows of an array, by c."""
    n = len(hashes)
    # hashes are compared by their upper 34 bits, then by place, wherever they stand
    low, width = hashes & ~_PLACES, 1
    low |= np.arange(n, dtype=np.uint64)
    while width * 2 <= span and width < n:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: max(n - span + 1, 0)], low[span - width :])
    low = low[inside]
    if not len(low):
        return np.zeros((0, 3), np.int64)
    low = low[np.concatenate(([True], low[1:] != low[:-1]))]
    c = (low & _PLACES).astype(np.int64)
    of, m = np.searchsorted(ends, c, "right"), len(low)
    first = np.concatenate(([True], of[1:] != of[:-1]))
    before, after = np.arange(-1, m - 1), np.arange(1, m + 1)  # places of the next smaller hash on either side, m where there is none
    before[first], after[np.concatenate((first[1:], [True]))] = m, m
    low = np.concatenate((low, [np.uint64(0)]))
    for at in (before, after):
        some = np.flatnonzero(low[at] > low[:-1])
        while len(some):  # who is larger says where to look on
            at[some] = at[at[some]]
            some = some[low[at[some]] > low[some]]
    place = np.concatenate((c, [0]))
    left = np.where(before == m, np.concatenate(([0], ends))[of], place[before] + 1)
    right = np.where(after == m, ends[of] - 1, place[after] - 1)
    return np.stack((left, c, right), 1)


def signatures(texts: list[str | bytes | None]) -> tuple[np.ndarray, ...]:
    """(row, f, key, l, c, r) arrays: the compact windows of each text for each hash function f; key is the signature."""
    return _signatures(texts)[0]


def _signatures(texts: list[str | bytes | None]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(signatures(), the number of words of each text)."""
    every, counts = _tokens_of(texts)
    sizes = np.maximum(counts - (SHINGLE - 1), 0)
    rows = np.flatnonzero(sizes >= SPAN)
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    if len(rows):
        every, ends = every[np.repeat(sizes >= SPAN, sizes)], np.cumsum(sizes[rows])
        starts, inside = np.concatenate(([0], ends)), _inside(SPAN, ends)
        for f in range(HASHES):
            h = _mixed(every, f)
            x = _windows(h, SPAN, ends, inside)
            d = np.searchsorted(ends, x[:, 1], "right")
            at = x - starts[d][:, None]
            for c, v in zip(columns, (rows[d], np.full(len(x), f), h[x[:, 1]] ^ np.uint64(f), *at.T), strict=True):
                c.append(v)
    out = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    out[2] = out[2].astype(np.uint64).view(np.int64)
    return tuple(out), counts


def held_by(f: np.ndarray, key: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray, base: np.ndarray | int, n: int) -> tuple[np.ndarray, ...]:
    """(count, key, i, j, o): in how many functions' windows each of n passages lies, by its first token; and of each two
    windows of two functions that hold the passages from i to j a key of both signatures, and how far on from i the
    first's centre is. Windows may be of several documents whose passages are numbered from `base` of each window."""
    lo, hi = base + np.maximum(left, c - SPAN + 1), base + np.minimum(c, right - SPAN + 1)
    count = np.bincount(lo, minlength=n + 1) - np.bincount(hi + 1, minlength=n + 1)
    by = [at[np.argsort(lo[at], kind="stable")] for at in (np.flatnonzero(f == g) for g in range(HASHES))]
    mixed, out = key.view(np.uint64), []
    for a, b in combinations(by, 2):  # the windows of one function hold a passage once
        first, end = np.searchsorted(hi[b], lo[a]), np.searchsorted(lo[b], hi[a], "right")
        size = np.maximum(end - first, 0)
        x = np.repeat(a, size)
        y = b[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        i = np.maximum(lo[x], lo[y])
        out.append(((mixed[x] * np.uint64(0x9E3779B97F4A7C15) ^ mixed[y]).view(np.int64), i, np.minimum(hi[x], hi[y]), lo[x] - np.maximum(left[x], c[x] - SPAN + 1) + c[x] - i))
    return np.cumsum(count)[:-1], *(np.concatenate(v) for v in zip(*out, strict=True))


def _lists(row: np.ndarray, rows: int, **columns: np.ndarray) -> pa.ListArray:
    """A list of structs for each of so many rows, from arrays of values and the row of each, in any order."""
    order = np.argsort(row, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(v[order]) for v in columns.values()], list(columns)))


def _of_lists(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(row of each struct of a column of lists, its fields)."""
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), [x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten()]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (th, text, windows): `runs`, hashes of the passages that lie in a shared window of every function, as only
    these can stand in another text as they are, and `items`, what held_by() gives but for those of which all passages
    stand earlier in the same text, as in a word said a thousand times."""
    for whole in batches:
        for begin, end in _parts(whole.column("text")):
            batch = whole.slice(begin, end - begin)
            found, sizes = tokens_of(_raw(batch.column("text")))
            start, base = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(sizes - SPAN + 1)))
            row, (key, lr, cf) = _of_lists(batch.column("windows"))
            count, pair, i, j, o = held_by(cf & 3, key, lr >> 32, cf >> 2, lr & (1 << 32) - 1, base[row], int(base[-1]))
            at, doc = np.flatnonzero(count == HASHES), np.searchsorted(base, i, "right") - 1
            every = np.repeat(np.arange(len(batch)), sizes - SPAN + 1)
            run = _runs(found, SPAN)[start[every] + np.arange(base[-1]) - base[every]]
            new = np.concatenate(([0], np.cumsum(_first(run ^ every.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))))
            some = new[j + 1] > new[i]
            doc, pair, i, j, o = (x[some] for x in (doc, pair, i, j, o))
            of, run = every[at], run[at].view(np.int64)
            short = lambda x, d: (x - base[d]).astype(np.int32)
            lists = _lists(of, len(batch), h=run, i=short(at, of)), _lists(doc, len(batch), key=pair, i=short(i, doc), j=short(j, doc), o=o.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("th"), *lists], ["th", "runs", "items"])


def _first(values: np.ndarray) -> np.ndarray:
    """Whether each of the values is the first of its kind."""
    n = len(values)
    bits = max(n, 1).bit_length() + 2
    slot = (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)
    least = np.full(1 << bits, n, np.int32)
    least[slot[::-1]] = np.arange(n - 1, -1, -1, dtype=np.int32)  # the last one written stays
    of = least[slot]
    out = of == np.arange(n)
    rest = np.flatnonzero(values[of] != values) if n else of  # who shares a slot with another value
    out[rest[np.unique(values[rest], return_index=True)[1]]] = True
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])))
def _merged(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Spans from starts to ends, ends exclusive, in order, those that touch joined."""
    out = []
    for s, e in zip(starts, ends, strict=True):
        order = np.argsort(s, kind="stable")
        s, e = np.asarray(s)[order], np.maximum.accumulate(np.asarray(e)[order]) if len(order) else np.zeros(0, int)
        new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1]))) if len(s) else np.zeros(0, int)
        out.append([{"s": int(a), "e": int(b)} for a, b in zip(s[new], e[np.concatenate((new[1:] - 1, [len(s) - 1]))] if len(s) else (), strict=True)])
    return pd.Series(out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (th, text, items): a row (key, blocks, th, i, o, n, tokens) an item, with the upper halves of the n passages' tokens."""
    for whole in batches:
        for begin, end in _parts(whole.column("text")):
            batch = whole.slice(begin, end - begin)
            found, sizes = tokens_of(_raw(batch.column("text")))
            start = np.concatenate(([0], np.cumsum(sizes)))
            t = (found >> np.uint64(32)).astype(np.uint32)
            row, (key, blocks, i, j, o) = _of_lists(batch.column("items"))
            th = batch.column("th").to_numpy()
            for x in range(0, len(row), STEP):
                x = slice(x, x + STEP)
                size = (j[x] - i[x]).astype(np.int64) + SPAN
                ends = np.cumsum(size)
                flat = t[np.repeat(start[row[x]] + i[x] - ends + size, size) + np.arange(ends[-1])]
                bounds = np.concatenate(([0], ends * 4)).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])
                columns = [pa.array(v) for v in (key[x], blocks[x], th[row[x]], i[x], o[x], (size - SPAN + 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, raw], ["key", "blocks", "th", "i", "o", "n", "tokens"])


class _Items:
    """Passages of many groups, in order of group and text: `t` holds all tokens, item x those from at[x], its passages
    begin at the first `n[x]` of them, and its centre is `o[x]` tokens on."""

    def __init__(self, group: np.ndarray, th: np.ndarray, i: np.ndarray, o: np.ndarray, n: np.ndarray, raw: list[bytes]):
        self.group, self.th, self.i, self.o, self.n = group, th, i, o, n
        self.t = np.frombuffer(b"".join(raw), np.uint32)
        self.size = n + SPAN - 1
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.twice = np.zeros(len(n), bool)
        bit = np.uint64(1) << (self.t & np.uint32(63)).astype(np.uint64)
        self.bits = np.stack([np.bitwise_or.reduceat(np.where((self.t >> np.uint32(6)) & np.uint32(3) == k, bit, np.uint64(0)), self.at[:-1]) for k in range(4)], 1)
        self.slack = np.zeros(len(n), np.int64)
        self.least = np.full(len(n), SPAN)

    def can_be(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether items a and b can share the tokens that similar passages do, by a set of 256 bits of each; those that
        differ in so many bits can't. Passages of p and q distinct tokens share SIMILAR / (1 + SIMILAR) of p + q."""
        both = np.bitwise_count(self.bits[a] & self.bits[b]).sum(1, dtype=np.int64)
        return (1 + SIMILAR) * (both + self.slack[a]) >= SIMILAR * (self.least[a] + self.least[b]) - 1e-6

    def live(self) -> np.ndarray:
        """Items with a passage of which SHARED places hold a token that another item of the group has too, or, where it holds
        one twice, SIMILAR of its distinct tokens. Notes which items hold a token twice, the `least` distinct tokens of a
        passage of theirs, and the `slack`, distinct tokens that set no bit of their own."""
        item = np.repeat(np.arange(len(self.n)), self.size)
        value = self.group[item].astype(np.uint64) << np.uint64(32) | self.t
        order = np.argsort(value, kind="stable")
        v, x = value[order], item[order]
        same = v[1:] == v[:-1]
        again = np.flatnonzero(same & (x[1:] == x[:-1]))
        self.twice[x[again]] = True
        self.slack = self.size - np.bincount(x[again], minlength=len(self.n)) - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        often = np.zeros(len(v), bool)
        often[order[1:]] |= same
        often[order[:-1]] |= same
        total = np.concatenate(([0], np.cumsum(often)))
        of = np.repeat(np.arange(len(self.n)), self.n)
        begin = np.repeat(self.at[:-1] - np.cumsum(self.n) + self.n, self.n) + np.arange(self.n.sum())
        need = np.full(len(begin), float(SHARED))
        if len(again):  # where a token stood before in its item; one that did within the passage is not distinct
            earlier = np.full(len(v), -1)
            earlier[order[again + 1]] = order[again]
            rest = np.flatnonzero(self.twice[of])
            for k in range(0, len(rest), STEP):
                k = rest[k : k + STEP]
                p = SPAN - (earlier[begin[k][:, None] + np.arange(SPAN)] >= begin[k][:, None]).sum(1)
                np.minimum.at(self.least, of[k], p)
                need[k] = SIMILAR * p - 1e-6
        enough = total[begin + SPAN] - total[begin] >= need
        return np.bincount(of, enough, len(self.n)) > 0

    def _flat(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the items' tokens, where each item's start among these)."""
        size = self.size[items]
        ends = np.cumsum(size)
        return np.repeat(self.at[items] - ends + size, size) + np.arange(ends[-1]), ends - size

    def near(self, leaders: np.ndarray, of: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(x, least, most) of those of others with passages similar to ones of leaders[of] that begin `most` to `least`
        tokens before the centre in both; x are places in others."""
        flat, _ = self._flat(leaders)
        value = np.repeat(np.arange(len(leaders)), self.size[leaders]).astype(np.uint64) << np.uint64(32) | self.t[flat]
        order = np.argsort(value, kind="stable")
        ranked, place = value[order], (flat - np.repeat(self.at[leaders], self.size[leaders]))[order]
        flat, first = self._flat(others)
        value = np.repeat(of, self.size[others]).astype(np.uint64) << np.uint64(32) | self.t[flat]
        at = np.minimum(np.searchsorted(ranked, value), len(ranked) - 1)
        place = np.where(ranked[at] == value, place[at], -(1 << 20)).astype(np.int32)
        total = np.concatenate(([0], np.cumsum(place >= 0)))

        a = leaders[of]
        lo, hi = np.maximum(self.o[others] - self.n[others], self.o[a] - self.n[a]) + 1, np.minimum(self.o[others], self.o[a])
        width = np.maximum(hi - lo + 1, 0)
        x = np.repeat(np.arange(len(others)), width)
        step = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(width.sum())
        begin = first[x] + self.o[others[x]] - step
        twice = self.twice[a[x]] | self.twice[others[x]]
        some = twice | (total[begin + SPAN] - total[begin] >= SHARED)
        x, step, begin, twice = x[some], step[some], begin[some], twice[some]
        in_a = self.o[a[x]] - step
        window = np.arange(SPAN)
        good = np.zeros(len(x), bool)
        once = np.flatnonzero(~twice)
        for k in range(0, len(once), STEP):
            k = once[k : k + STEP]
            there = (place[begin[k][:, None] + window] - in_a[k][:, None].astype(np.int32)).view(np.uint32)  # negative ones are large
            good[k] = (there < SPAN).sum(1) >= SHARED
        rest = np.flatnonzero(twice)
        distinct = lambda v: 1 + (np.diff(np.sort(v, 1)) != 0).sum(1)
        for k in range(0, len(rest), STEP):  # sets of tokens, by row
            k = rest[k : k + STEP]
            p = self.t[(self.at[a[x[k]]] + in_a[k])[:, None] + window]
            q = self.t[(self.at[others[x[k]]] + self.o[others[x[k]]] - step[k])[:, None] + window]
            either = distinct(np.concatenate((p, q), 1))
            good[k] = distinct(p) + distinct(q) - either >= SIMILAR * either
        x, step = x[good], step[good]
        if not len(x):
            return x, x, x
        new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        return x[new], step[new], step[np.concatenate((new[1:] - 1, [len(x) - 1]))]

    def links(self) -> np.ndarray:
        """Rows (a, b, least, most): links that join all items of a group with similar passages, and cover passages of each.

        A search in breadth, in all groups at once: each round one item of each group, one reached if there is
        any, is compared with those of its group that are not reached.
        """
        items = np.flatnonzero(self.live())
        reached, out = np.zeros(len(items), bool), [np.zeros((0, 4), np.int64)]
        while len(items):
            group = self.group[items]
            starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(items)])))
            place = np.arange(len(items))
            lead = np.minimum.reduceat(np.where(reached, place, place + len(items)), starts) % len(items)
            whose = np.repeat(lead, sizes)
            leads = place == whose
            asked = np.flatnonzero(~reached & ~leads)
            a, b = items[whose[asked]], items[asked]
            asked = asked[(self.th[a] != self.th[b]) & self.can_be(a, b)]
            if len(asked):
                w = whose[asked]
                new = np.concatenate(([True], w[1:] != w[:-1]))
                x, least, most = self.near(items[w[new]], np.cumsum(new) - 1, items[asked])
                x = asked[x]
                out.append(np.stack((items[whose[x]], items[x], least, most), 1))
                reached[x] = True
            left = ~leads & np.repeat(np.add.reduceat(~reached & ~leads, starts) > 0, sizes)
            items, reached = items[left], reached[left]
        return np.concatenate(out)


_FOUND = "a long, b long, a0 int, a1 int, b0 int, b1 int"


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of texts with the words from a0 to a1 and b0 to b1 that are similar, ends exclusive, from rows in order
    of key, x, y and th. Whole groups are looked at; the last one of a batch may go on in the next."""

    def found(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[["key", "x", "y"]].to_numpy()
        group = np.cumsum(np.concatenate(([False], (keys[1:] != keys[:-1]).any(1))))
        x = _Items(group, *(rows[c].to_numpy(np.int64) for c in ("th", "i", "o", "n")), rows["tokens"].tolist())
        a, b, least, most = x.links().T
        begin, end = (lambda k: x.i[k] + x.o[k] - most), (lambda k: x.i[k] + x.o[k] - least + PASSAGE)
        return pd.DataFrame({"a": x.th[a], "b": x.th[b], "a0": begin(a), "a1": end(a), "b0": begin(b), "b1": end(b)}).astype({c: np.int32 for c in ("a0", "a1", "b0", "b1")}).drop_duplicates()

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < STEP:
            continue
        rows = pd.concat(held, ignore_index=True)
        last = (rows[["key", "x", "y"]] == rows[["key", "x", "y"]].iloc[-1]).all(axis=1).to_numpy()
        whole = int(np.argmax(last))
        if whole:
            yield found(rows.iloc[:whole])
        held = [rows.iloc[whole:]]
    if sum(map(len, held)):
        yield found(pd.concat(held, ignore_index=True))


def _in_two(rows: DataFrame, *more) -> DataFrame:
    """(key, lo, ...) of the keys of rows that two texts th have or more, lo the least of them, to be joined by hash.

    They are written, so that the join shuffles rows and keys and nothing else, and can split a hot key's rows.
    """
    keys = rows.groupBy("key").agg(F.min("th").alias("lo"), F.max("th").alias("most"), *more).where("lo <> most").drop("most")
    return Stored(keys).df.hint("shuffle_hash")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_passages, n_repeated_words, spans, component_id) for every row of docs.

    A passage of PASSAGE words or more that another document also holds, as it stands or with a
    Jaccard similarity of SIMILAR of its tokens, is repeated. spans lists them, overlapping ones
    joined, as start-end in words, end exclusive, comma-joined; component_id is the smallest id
    reachable from document to document over such passages.

    Equal texts are one node: a text of PASSAGE words or more that occurs in two rows is a repeated
    passage as a whole. Passages that stand in several texts as they are are found by one hash each, all
    words of them are reported, and one of the texts stands for the others from there on. What else
    shares two signatures is compared with all of its key, in blocks where there are more than
    `block`, until what is similar is linked; spans of edited passages cover those of one link at least, and
    of an edited passage that a text holds twice, word for word, the first is compared.

    Null, empty and short texts have no passages. Rows with a null id take part and are told apart by
    their text; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, end in _parts(whole.column("text")):
                batch = whole.slice(begin, end - begin)
                (row, f, key, left, c, right), n = _signatures(_raw(batch.column("text")))
                th = batch.column("th").to_numpy()
                for columns in ((th[row], key, left << 32 | right, c << 2 | f), (th, n, np.full(len(th), -1), np.full(len(th), -1))):
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in columns], ["th", "key", "lr", "cf"])

    # l and r, c and f are one number each, as all windows are shuffled; a text's number of words is a row where they are -1
    every = Stored(rows.select("th", "text").mapInArrow(windows, "th long, key long, lr long, cf long"))
    texts = cut(rows.select("doc_id", "th"))
    counts = every.df.where("cf < 0").groupBy("th").agg(F.max("key").alias("n_words"))
    nodes = cut(texts.groupBy("th").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).join(counts, "th"))
    found = every.df.where("cf >= 0")
    shared = found.join(_in_two(found).select("key"), "key").groupBy("th").agg(F.collect_set(F.struct("key", "lr", "cf")).alias("windows"))
    functions = F.size(F.array_distinct(F.transform("windows", lambda w: w["cf"].bitwiseAND(F.lit(3)))))
    shared = Stored(shared.where(functions > 1))
    every.drop()

    def source(wanted: DataFrame) -> DataFrame:
        """(th, text), a row for each text of wanted; rows that repeat one id may give it twice, to the same result."""
        wanted = small_side(cut(wanted.select("th").join(nodes.select("th", "rep"), "th")))
        return rows.alias("r").join(wanted.alias("w"), (F.col("r.th") == F.col("w.th")) & F.col("r.doc_id").eqNullSafe(F.col("w.rep"))).select("r.th", "r.text")

    held = source(shared.df).join(shared.df, "th").select("th", "text", "windows")
    held = Stored(held.mapInArrow(_candidates, "th long, runs array<struct<h:long,i:int>>, items array<struct<key:long,i:int,j:int,o:int>>"))
    shared.drop()

    runs = held.df.select("th", F.explode("runs").alias("x")).select("th", F.col("x.h").alias("key"), "x.i")
    exact = runs.join(_in_two(runs), "key").groupBy("th").agg(F.collect_set("i").alias("i"), F.collect_set(F.when(F.col("lo") < F.col("th"), F.col("i"))).alias("gone"), F.collect_set("lo").alias("with"))
    next_to = lambda c: _merged(c, F.transform(c, lambda i: i + 1))
    exact = Stored(exact.select("th", "with", next_to(F.col("i")).alias("runs"), next_to(F.col("gone")).alias("gone")))

    left = held.df.select("th", "items").join(exact.df.select("th", "gone"), "th", "left")
    known = lambda x: F.exists("gone", lambda g: (g["s"] <= x["i"]) & (x["j"] < g["e"]))
    left = left.select("th", F.explode(F.when(F.col("gone").isNull(), F.col("items")).otherwise(F.filter("items", lambda x: ~known(x)))).alias("x")).select("th", "x.*")
    items = Stored(left)
    held.drop()
    blocks = F.ceil(F.count("*") / block).cast("int").alias("blocks")
    near = Stored(items.df.join(_in_two(items.df, blocks).drop("lo"), "key").groupBy("th").agg(F.collect_list(F.struct("key", "blocks", "i", "j", "o")).alias("items")))
    items.drop()
    near_texts = source(near.df).join(near.df, "th").select("th", "text", "items")
    parts = near_texts.mapInArrow(_slices, "key long, blocks int, th long, i int, o int, n int, tokens binary")
    own = F.pmod(F.xxhash64("th"), F.col("blocks")).cast("int")
    parts = parts.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.select("key", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "th", "i", "o", "n", "tokens")
    parts = parts.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "th")
    linked = cut(parts.mapInPandas(_compared, _FOUND).distinct())
    near.drop()

    span = lambda df, th, s, e: df.select(F.col(th).alias("th"), s.cast("int").alias("s"), e.cast("int").alias("e"))
    spans = span(linked, "a", F.col("a0"), F.col("a1")).union(span(linked, "b", F.col("b0"), F.col("b1")))
    spans = spans.union(span(exact.df.select("th", F.explode("runs").alias("x")), "th", F.col("x.s"), F.col("x.e") + (PASSAGE - 1)))
    spans = spans.union(span(nodes.where(f"n > 1 and n_words >= {PASSAGE}"), "th", F.lit(0), F.col("n_words")))
    spans = spans.distinct().groupBy("th").agg(F.collect_list("s").alias("ss"), F.collect_list("e").alias("es")).select("th", _merged("ss", "es").alias("xs"))

    edges = linked.select("a", "b").union(exact.df.select("th", F.explode("with").alias("b")).where("th <> b")).distinct()
    roots = connected_components(edges, "a", "b").select(F.col("node").alias("th"), "root")
    roots = cut(roots.join(nodes.select("th", "rep"), "th"))
    least = roots.groupBy("root").agg(F.min("rep").alias("least"))
    label = nodes.select("th", "rep", "n", F.col("n_words").alias("words")).join(roots.join(least, "root").select("th", "least"), "th", "left").join(spans, "th", "left")
    listed = F.coalesce("xs", F.array().cast("array<struct<s:int,e:int>>"))
    label = label.select(
        "th",
        "words",
        F.size(listed).cast("long").alias("n_passages"),
        F.aggregate(listed, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"]).alias("n_repeated_words"),
        F.array_join(F.transform(listed, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",").alias("spans"),
        F.when((F.col("n") > 1) & (F.col("words") >= PASSAGE) | F.col("least").isNotNull(), F.coalesce("least", "rep")).alias("group"),
    )
    out = texts.join(label, "th")
    return out.select("doc_id", F.col("words").alias("n_words"), "n_passages", "n_repeated_words", "spans", F.coalesce("group", "doc_id").alias("component_id"))


def op6_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
