"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are lower-cased and cut at white space and ASCII punctuation. A seed is a run of ``N`` words of a test item (all
words of a shorter item). Seeds are rare: a run that stands in more than ``RARE`` places of the items is made longer until it
does not, or is left out where its item ends before that. How long a run has to be follows from a suffix array over the items, by
the common prefixes of ``RARE + 1`` neighbours, so repetitive items cost no more than others. Items with the same text are one.
Seeds that stand in a text, by 64 bits of hash, join the text to the item. Each passage with a seed, with a margin
around its seeds, is aligned with the item word by word (local alignment with gaps), however many rows hold its seeds; the
score is the alignment's share of a perfect one. A passage that has too few of the item's words for the least score, in
whatever order, is not aligned: each word of the item matches once at most.

The items travel to the workers in slices of at most ``SLICE`` words, which bounds what is broadcast; each slice takes one
pass over the texts. An item of more than ``PART`` words is cut into parts of that length, every half of it, and has the
score of its best part: a copy of a part of a book is one, though a small share of the book.

Null or empty texts and items match nothing. Rows that share an id, and items that share an item id, give one row with
their best alignment.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.periodic import Suffixes
from rasterloom.llm.rows import pieces, row_key, without

N = 4
#: Words of all items that are broadcast at once.
SLICE = 2_000_000
#: Places of the items that a seed stands in at most, and words of an item that are aligned as a whole.
RARE, PART = 64, 4096
#: Least share of a perfect alignment, and what a match, a mismatch and a gap add to an alignment.
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

_BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split()


def align(passage: list[bytes], item: list[bytes]) -> tuple[float, int, int]:
    """Share of a perfect local alignment of the whole item, and the passage's words that the best one spans."""
    number = {w: i for i, w in enumerate(item)}
    p = np.fromiter((number.get(w, -1) for w in passage), np.int64, len(passage))
    ramp = -GAP * np.arange(1, len(p) + 1)
    above = np.zeros(len(p) + 1, np.int64)
    begun = np.arange(len(p) + 1)  # where the best alignment that ends here begins
    best = (0, 0, 0)
    for w in item:
        step = np.where(p == number[w], MATCH, MISMATCH)
        diagonal, down = above[:-1] + step, above[1:] + GAP
        here = np.maximum(np.maximum(diagonal, down), 0)
        start = np.where(here == 0, np.arange(1, len(p) + 1), np.where(diagonal >= down, begun[:-1], begun[1:]))
        # gaps in the item: the best cell to the left, less the way from it
        lifted = here + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(len(p)), 0))
        value = top - ramp
        above = np.concatenate(([0], np.maximum(value, 0)))
        begun = np.concatenate(([0], np.where(value > 0, start[source], np.arange(1, len(p) + 1))))
        at = int(above.argmax())
        if above[at] > best[0]:
            best = (int(above[at]), int(begun[at]), at)
    return best[0] / (MATCH * len(item)), best[1], best[2]


def _parts(words: list[bytes]) -> list[list[bytes]]:
    """The item itself, or its overlapping parts if it is long."""
    if len(words) <= PART:
        return [words] if words else []
    return [words[a : a + PART] for a in range(0, len(words) - PART // 2, PART // 2)]


def _slices(items: DataFrame, text: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Different texts of items with their digests, in slices of at most ``SLICE`` words, as the driver reads them one after the other."""
    held, size = [], 0
    for row in items.select(items[text].alias("text")).where(F.col("text").isNotNull()).distinct().select(F.md5("text").alias("key"), "text").orderBy("key").toLocalIterator():
        for words in _parts(words_of(row["text"])):
            if held and size + len(words) > SLICE:
                yield held
                held, size = [], 0
            held.append((row["key"], words))
            size += len(words)
    if held:
        yield held


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    out, have = x if len(x) >= width else x[:0], 1
    while have < width and len(out):
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def numbered(items: list[list[bytes]]) -> dict[bytes, int]:
    """A number from zero for each word of the items."""
    return {w: i for i, w in enumerate(dict.fromkeys(w for words in items for w in words))}


def seeds(items: list[list[bytes]], rare: int = RARE) -> np.ndarray:
    """Rows of item, first word and number of words of each seed."""
    number = numbered(items)
    sizes = np.array([len(w) + 1 for w in items], np.int64)
    ends = np.cumsum(sizes) - 1
    # an end of its own after each item, so that no common prefix goes beyond
    code = np.fromiter((c for k, words in enumerate(items) for c in (*map(number.__getitem__, words), len(number) + k)), np.int64, int(sizes.sum()))
    if not len(code):
        return np.empty((0, 3), np.int64)
    s = Suffixes(code, np.full(len(code), len(code)))
    # shared[r]: the longest run at suffix r that more than ``rare`` places have, from the windows of rare + 1 neighbours with r
    least = _least_of(s.lcp[1:], rare)
    padded = np.concatenate([np.zeros(rare, np.int64), least, np.zeros(rare, np.int64)])
    shared = -_least_of(-padded, rare + 1)[: len(code)] if len(least) else np.zeros(len(code), np.int64)
    size = np.empty(len(code), np.int64)
    size[s.sa] = np.maximum(N, shared + 1)
    item = np.repeat(np.arange(len(items)), sizes)
    place = np.arange(len(code)) - (ends - sizes + 1)[item]
    left = ends[item] - np.arange(len(code))
    whole = (place == 0) & (left > 0) & (size > left)
    size = np.where(whole, left, size)
    fits = (left > 0) & (size <= left)
    return np.column_stack([item, place, size])[fits]


class Hashes:
    """Hashes of all runs of a text's words: runs of powers of two by doubling, others from two that overlap."""

    A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, numbers: np.ndarray) -> None:
        h = (numbers.astype(np.uint64) + np.uint64(2)) * self.A
        self.levels = [h ^ h >> np.uint64(29)]
        self.size = len(numbers)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a * self.B + b
        h ^= h >> np.uint64(32)
        return h * self.A

    def at(self, places: np.ndarray, n: int) -> np.ndarray:
        """Hashes of runs of ``n`` words from some places, which all have as many."""
        k = n.bit_length() - 1
        while len(self.levels) <= k:
            x, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(self._joined(x[: max(0, len(x) - step)], x[step:]))
        x = self.levels[k]
        return self._joined(x[places], x[places + n - (1 << k)]) ^ np.uint64(n)


class Seeds:
    """The seeds of items, by length and hash, and which runs of ``N`` words begin longer ones."""

    def __init__(self, items: list[list[bytes]]) -> None:
        self.number = numbered(items)
        rows = seeds(items)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        begun = []
        for own in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1) if len(rows) else []:
            h = self.hashed(items[int(own[0, 0])])
            for n in np.unique(own[:, 2]).tolist():
                at = own[own[:, 2] == n]
                found.setdefault(n, []).append((h.at(at[:, 1], n), at[:, :2]))
                if n > N:
                    begun.append(h.at(at[:, 1], N))
        #: By length: hashes in order, and the items and places that have them.
        self.tables = {}
        for n, parts in sorted(found.items()):
            h, places = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            self.tables[n] = h[order], places[order]
        self.begun = np.unique(np.concatenate(begun)) if begun else np.empty(0, np.uint64)

    def hashed(self, words: list[bytes]) -> Hashes:
        get = self.number.get
        return Hashes(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))

    def hits(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(item, word, place in the item) of each seed in a text."""
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out, h = [], Hashes(numbers)
        # runs of N words that the items have
        upto = np.concatenate(([0], np.cumsum(numbers >= 0)))
        every = np.flatnonzero(upto[N:] - upto[:-N] == N) if len(numbers) >= N else np.empty(0, np.int64)
        short = h.at(every, N) if len(every) else np.empty(0, np.uint64)
        longer = every[_in(self.begun, short)] if len(self.begun) and len(every) else every[:0]
        for n, (keys, places) in self.tables.items():
            at = every if n == N else longer[longer <= h.size - n] if n > N else np.flatnonzero(numbers[: max(0, h.size - n + 1)] >= 0)
            if not len(at):
                continue
            own = short if n == N else h.at(at, n)
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                out += [(k, p, q) for k, q in places[a:b].tolist()]
        return out


def _in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(keys, x)
    return keys[np.minimum(at, len(keys) - 1)] == x


def _passages(words: list[bytes], hits: list[tuple[int, int, int]], items: list[tuple[object, list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(item, first word, end) of each passage; hits: (item, word, place in the item), in order."""
    hits.sort()
    at = 0
    while at < len(hits):
        k, first = hits[at][0], at
        size = len(items[k][1])
        margin = 4 + size // 4
        while at + 1 < len(hits) and hits[at + 1][0] == k and hits[at + 1][1] - hits[at][1] <= size + margin:
            at += 1
        part = hits[first : at + 1]
        begin = max(0, min(p - q for _, p, q in part) - margin)
        end = min(len(words), max(p - q for _, p, q in part) + size + margin)
        yield k, begin, end
        at += 1


def matches(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", least: float = LEAST) -> DataFrame:
    """``id, item_id, score, start, end`` for each row and item that align at ``least``; offsets count words, end exclusive."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    found = None
    for part in _slices(items, item_text):
        one = _matches_of(docs, part, text, id, kind, least)
        found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], f"id {kind}, item_id {item_kind}, score double, start long, end long").withColumnsRenamed({"id": id, "item_id": item_id})
    best = found.groupBy("id", "key").agg(F.max(F.struct(F.col("score"), (-F.col("start")).alias("start"), F.col("end"))).alias("b"))
    named = items.select(items[item_id].alias("item_id"), F.md5(items[item_text]).alias("key"))
    best = best.join(named, "key").groupBy("id", "item_id").agg(F.max("b").alias("b"))
    return best.select(F.col("id").alias(id), F.col("item_id").alias(item_id), "b.score", (-F.col("b.start")).alias("start"), "b.end")


def _matches_of(docs: DataFrame, items: list[tuple[str, list[bytes]]], text: str, id: str, kind: str, least: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, Seeds([words for _, words in items])))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = sent.value
        for b in pieces(batches):
            row, item, first, passage = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                hits = known.hits(words)
                for k, begin, end in _passages(words, hits, items):
                    row.append(i)
                    item.append(k)
                    first.append(begin)
                    passage.append(b" ".join(words[begin:end]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.int32()), pa.array(first, pa.int64()), pa.array(passage, pa.binary())], ["id", "item", "first", "passage"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value[0]
        bags: dict[int, Counter] = {}
        for b in batches:
            row, item, value, start, end = [], [], [], [], []
            aligned: dict[tuple[int, bytes], tuple[float, int, int]] = {}
            for i, (k, first, passage) in enumerate(zip(*(b.column(c).to_pylist() for c in range(1, 4)))):
                words, whole = passage.split(), items[k][1]
                if k not in bags:
                    bags[k] = Counter(whole)
                if sum((Counter(words) & bags[k]).values()) >= least * len(whole):
                    if (k, passage) not in aligned:
                        aligned[k, passage] = align(words, whole)
                    v, a, z = aligned[k, passage]
                    if v >= least:
                        row.append(i)
                        item.append(items[k][0])
                        value.append(v)
                        start.append(first + a)
                        end.append(first + z)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(item, pa.string()), pa.array(value, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["id", "key", "score", "start", "end"])

    run = lambda batches: score(seek(batches))
    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, key string, score double, start long, end long")


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that align with no item; as ids may repeat or be null, rows are told apart by id and text."""
    keyed = docs.select(row_key(docs, id, text).alias("_key"), docs[text].alias("_text"))
    return without(docs, matches(keyed, items, "_text", "_key").select("_key").distinct(), id, text)
