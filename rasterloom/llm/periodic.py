"""Periodic runs of words: suffix array, common prefixes, longest previous factors, Lempel-Ziv blocks, Main's extensions, copying.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and a length of at least
``max(least, 2 * q)`` that no neighbouring word extends. All runs of a text are found:

1. Suffixes of many documents are sorted together by prefix doubling. Words of different documents count as different, so no
   comparison leaves its document and each document's suffix array is a slice. The ranks of each doubling step are kept: they
   tell in one comparison whether two stretches of 2^k words are the same.
2. Common prefixes of neighbouring suffixes come from these ranks. A run repeats at least ``least / 2`` words at another place, so
   documents whose longest common prefix is shorter have none and are done.
3. Longest previous factors follow from suffix array and common prefixes by unlinking positions from last to first; cutting the
   text greedily at them gives the Lempel-Ziv blocks.
4. A run that is not strictly inside one block touches the start b of the block with its last word (or the text's end). Main's
   extensions to both sides of b and of its partners, q before or after it, find it. Its last word is in the block [b, b + u),
   so either it reaches q words beyond b, with q <= u, or it starts q words before b; in that case the block before, of v
   words, would have been longer unless q < u + v. So all blocks together have partners in proportion to the text's length.
5. A run strictly inside a block is a copy of one that starts earlier by the distance to the block's earlier occurrence; runs are
   held in buckets by their start, so copying takes time in proportion to the block and to what is copied.

Every document is worked on alone, in tasks over Arrow batches, without a shuffle. A task holds as many documents at once as
make about ``WORDS`` words, or one longer one.

Null text counts as empty: no words, no runs. Repeated rows give a result each. A null id stays null. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.llm.rows import pieces

#: Words that a task sorts together, unless one document has more; pairs of positions that are compared at once.
WORDS, PAIRS = 1 << 18, 1 << 20

#: Least length of a run in words.
LEAST = 12

Runs = list[tuple[int, int, int]]
Prepare = Callable[[object, list[bytes]], list[bytes]]


class Suffixes:
    """Suffixes of many documents: ranks after each doubling step, suffix array, common prefixes of neighbours.

    ``code`` numbers the words from zero, with other numbers, and higher ones, in each later document; ``end`` is
    the end of each position's document.
    """

    def __init__(self, code: np.ndarray, end: np.ndarray) -> None:
        self.end = end
        self.levels = self._sort(code)
        self.sa = np.empty(len(code), np.int64)
        self.sa[self.levels[-1]] = np.arange(len(code))
        self.lcp = np.zeros(len(code), np.int64)
        if len(code) > 1:
            self.lcp[1:] = self.forward(self.sa[:-1], self.sa[1:])

    def _sort(self, code: np.ndarray) -> list[np.ndarray]:
        count = np.bincount(code)
        rank = (np.cumsum(count) - count)[code].astype(np.int32)
        levels, step = [rank], 1
        open_ = np.flatnonzero(count[code] > 1)
        while len(open_):
            beyond = open_ + step
            inside = beyond < self.end[open_]
            second = np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
            key = rank[open_].astype(np.int64) << 32 | second
            order = np.argsort(key)
            key, at = key[order], open_[order]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            first_of_class = np.concatenate(([True], (key[1:] >> 32) != (key[:-1] >> 32)))
            i = np.arange(len(at))
            shift = np.maximum.accumulate(np.where(first, i, 0)) - np.maximum.accumulate(np.where(first_of_class, i, 0))
            finer = rank.copy()
            finer[at] += shift.astype(np.int32)
            open_ = at[~(first & np.concatenate((first[1:], [True])))]
            rank, step = finer, step * 2
            levels.append(rank)
        return levels

    def _common(self, x: np.ndarray, y: np.ndarray, first: np.ndarray | None) -> np.ndarray:
        """Words that are the same from x and y on, or up to x and y where ``first`` has the document's start: up to the longest power of two, then down again."""

        def equal(k: int, some: np.ndarray) -> np.ndarray:
            if first is None:
                a, b = x[some] + out[some], y[some] + out[some]
                inside = (a < len(self.end)) & (b < len(self.end))
            else:
                a, b = (z[some] - out[some] - (1 << k) + 1 for z in (x, y))
                inside = a >= first[some]
            return inside & (self.levels[k][np.where(inside, a, 0)] == self.levels[k][np.where(inside, b, 0)])

        out, held, some = np.zeros(len(x), np.int64), [], np.arange(len(x))
        for k in range(len(self.levels)):
            some = some[equal(k, some)]
            if not len(some):
                break
            held.append(some)
        for k in range(len(held) - 1, -1, -1):
            out[held[k]] += equal(k, held[k]).astype(np.int64) << k
        return out

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that are the same from x and from y on; none at the end of all words."""
        return self._common(x, y, None)

    def backward(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Words that are the same up to and with x and y, both in the document that starts at ``first``; x < y."""
        return self._common(x, y, first)


def previous_factors(sa: list[int], lcp: list[int]) -> tuple[list[int], list[int]]:
    """For each position the longest stretch from there that also starts earlier, and where it does (-1: nowhere)."""
    n = len(sa)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    size, origin = [0] * n, [-1] * n
    common = [*lcp, 0]
    common[0] = 0
    for i in range(n - 1, -1, -1):
        r = rank[i]
        p, q = before[r], after[r]
        a, b = common[r], common[q]
        if a >= b:
            if a:
                size[i], origin[i] = a, sa[p]
            if q < n:
                before[q] = p
        else:
            size[i], origin[i] = b, sa[q]
            common[q] = a
            before[q] = p
        if p >= 0:
            after[p] = q
    return size, origin


def blocks(size: list[int]) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end."""
    cuts, at = [], 0
    while at < len(size):
        cuts.append(at)
        at += size[at] or 1
    cuts.append(at)
    return cuts


def _extended(s: Suffixes, code: np.ndarray, cut: np.ndarray, before: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """Rows of start, end and period of what Main's extensions find at block starts.

    ``before`` and ``own`` are the sizes of the blocks before and after each start, ``low`` and ``high`` the document's bounds.
    """
    right = np.minimum(own, high - cut)
    left = np.minimum(before + own - 1, cut - low)
    sizes = np.maximum(np.concatenate([right, left]), 0)
    upto = np.cumsum(sizes)
    found = [np.empty((0, 3), np.int64)]
    for lo in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        i = np.arange(lo, min(lo + PAIRS, int(upto[-1])))
        k = np.searchsorted(upto, i, "right")
        q = i - upto[k] + sizes[k] + 1
        c = k % len(cut)
        x = cut[c] - np.where(k < len(cut), 0, q)
        y, first, last = x + q, low[c], high[c]
        meets = (y < last) & (code[x] == code[np.where(y < last, y, 0)])
        meets |= (x > first) & (code[x - (x > first)] == code[y - 1])
        x, y, q, first = x[meets], y[meets], q[meets], first[meets]
        ahead = s.forward(x, np.where(y < last[meets], y, len(code)))
        behind = s.backward(x - 1, y - 1, first)
        some = (ahead + behind >= q) & (ahead + behind + q >= least)
        found.append(np.column_stack([x - behind, y + ahead, q])[some])
    return np.concatenate(found)


def find_runs(documents: list[list[bytes]], least: int = LEAST) -> list[Runs]:
    """Start, length and period of every run of each document's words, by start, then period."""
    out: list[Runs] = [[] for _ in documents]
    sizes = np.array([len(d) for d in documents], np.int64)
    total = int(sizes.sum())
    if not total:
        return out
    code, base, at = np.empty(total, np.int64), 0, 0
    for d in documents:
        number = {w: i for i, w in enumerate(dict.fromkeys(d), base)}
        code[at : at + len(d)] = np.fromiter(map(number.__getitem__, d), np.int64, len(d))
        base, at = base + len(number), at + len(d)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(documents)), sizes)
    s = Suffixes(code, ends[owner])
    longest = np.zeros(len(documents), np.int64)
    np.maximum.at(longest, owner, s.lcp)
    some = np.flatnonzero(longest >= least // 2)
    if not len(some):
        return out
    factored, cut, before, own, low, high = {}, [], [], [], [], []
    for d in some.tolist():
        a, b = int(ends[d] - sizes[d]), int(ends[d])
        size, origin = previous_factors((s.sa[a:b] - a).tolist(), s.lcp[a:b].tolist())
        cuts = blocks(size)
        factored[d] = cuts, origin
        edge = np.array(cuts, np.int64)
        wide = np.diff(edge)
        cut.append(edge + a)
        before.append(np.concatenate(([0], wide)))
        own.append(np.concatenate((wide, [0])))
        low.append(np.full(len(edge), a))
        high.append(np.full(len(edge), b))
    found = _extended(s, code, *map(np.concatenate, (cut, before, own, low, high)), least)
    if not len(found):
        return out
    found = found[np.lexsort(found.T[::-1])]  # by start, end, period: of one stretch the first has its smallest period
    found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(axis=1)))]
    of = owner[found[:, 0]]
    for d in np.unique(of).tolist():
        rows = found[of == d] - np.array([ends[d] - sizes[d], ends[d] - sizes[d], 0])
        out[d] = _copied(rows.tolist(), *factored[d], least)
    return out


def _copied(found: list[list[int]], cuts: list[int], origin: list[int], least: int) -> Runs:
    """Runs with those strictly inside blocks, copied from the blocks' earlier occurrences."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for a, e, q in found:
        buckets.setdefault(a, []).append((e, q))
    for b, to in zip(cuts, cuts[1:]):
        if to - b < least + 2:
            continue
        shift = b - origin[b]
        for a in range(b + 1, to - least):
            for e, q in buckets.get(a - shift, ()):
                if e + shift < to:
                    buckets.setdefault(a, []).append((e + shift, q))
    return sorted((a, e - a, q) for a, own in buckets.items() for e, q in own)


def collapsed(words: list[bytes], runs: Runs) -> list[bytes]:
    """Words without those that any run holds after its first period."""
    drop = bytearray(len(words))
    for a, size, q in runs:
        drop[a + q : a + size] = b"\x01" * (size - q)
    return [w for w, d in zip(words, drop) if not d] if runs else words


def planted(id: object, words: list[bytes]) -> list[bytes]:
    """The contract's words of a document: one in ten ids repeats a stretch of its own words to the end. Null ids: as they are."""
    if id is None or not words:
        return words
    h, n = zlib.crc32(str(id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _documents(batches: Iterator[pa.RecordBatch], prepare: Prepare | None, least: int) -> Iterator[tuple[pa.Array, list[list[bytes]], list[Runs]]]:
    """Ids, words and runs of as many rows at a time as have about ``WORDS`` words."""
    for b in pieces(batches):
        held, count, since = [], 0, 0
        for i in range(b.num_rows):
            words = (b.column(1)[i].as_py() or "").encode().split()  # of bytes, this splits at \x20 and \x09 to \x0D
            if prepare is not None:
                words = prepare(b.column(0)[i].as_py(), words)
            held.append(words)
            count += len(words)
            if count >= WORDS or i == b.num_rows - 1:
                yield b.column(0).slice(since, len(held)), held, find_runs(held, least)
                held, count, since = [], 0, i + 1


def find(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST, prepare: Prepare | None = None) -> DataFrame:
    """``id``, n_words, runs (array of start, length and period in words, by start, then period) and collapsed (text without repetitions).

    ``prepare`` may change the words of a row before they are looked at; it gets id and words.
    """
    kind = docs.schema[id].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, runs in _documents(batches, prepare, least):
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([len(w) for w in words], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], run_type),
                pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)], pa.string()),
            ], ["id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id)


def digest(docs: DataFrame, text: str = "text", id: str = "doc_id", least: int = LEAST, prepare: Prepare | None = planted) -> DataFrame:
    """``id``, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256 and collapsed_sha256.

    Found as in :func:`find`; the digests are taken in the worker. Of runs of one length the first counts, then that of the
    smallest period; without a run the four are null.
    """
    kind = docs.schema[id].dataType.simpleString()
    names = ("n_runs", "start", "length", "period", "exponent_milli")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for ids, words, runs in _documents(batches, prepare, least):
            numbers, of_runs, of_text = [], [], []
            for w, r in zip(words, runs):
                a, size, q = min(r, key=lambda x: (-x[1], x[0], x[2])) if r else (None, None, None)
                numbers.append((len(r), a, size, q, 1000 * size // q if r else None))
                of_runs.append(sha("".join(f"{a},{n},{q}\n" for a, n, q in r).encode()).hexdigest())
                of_text.append(sha(b" ".join(collapsed(w, r))).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in zip(*numbers)), pa.array(of_runs, pa.string()), pa.array(of_text, pa.string())], ["id", *names, "runs_sha256", "collapsed_sha256"])

    longs = ", ".join(f"{n} long" for n in names)
    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, {longs}, runs_sha256 string, collapsed_sha256 string").withColumnRenamed("id", id)
