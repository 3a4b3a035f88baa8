"""External induced suffix sorting with common-prefix values.

A text's suffixes are sorted by induction from its leftmost S-suffixes: a pass in ascending order of characters finds the
L-suffixes, a pass in descending order the S-suffixes. Which leftmost S-suffix comes first follows from their substrings,
sorted by the same two passes and named, and by recursion on the string of names until all names differ. Each pass works through
a bucket priority queue whose items, tuples of a suffix and its common prefix with the suffix before, are kept in sorted runs; above
its memory bound the queue writes them to disk. Buckets are asked for in order, so runs are read once, from front to back. A
range of adjacent buckets comes out as one wave, whose predecessors are found by a few vector operations.

Common prefixes are carried through all passes and levels:

- Two neighbours in a bucket share one character more than the least value between the suffixes that they were induced from.
- In the pass that sorts substrings the seeds of a bucket count as equal (``EQUAL``), and what is induced from equal ones is
  equal, so the values also say which substrings get the same name.
- Two leftmost S-suffixes share the substrings whose names they share, as the level below says, and after these as much as the
  next two names do, which is the least value between these names (:class:`RangeMin`).

Texts, types, orders, names and values are mapped files that are read and written in blocks; what is held in memory
follows the bound and not the text. Suffixes come out in descending order, block by block.
"""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Callable, Iterator

import numpy as np

#: Value of neighbours that the sort of substrings cannot tell apart.
EQUAL = 1 << 30

Block = tuple[np.ndarray, np.ndarray]


class Store:
    """Arrays in mapped files of a folder; a file goes with the last view of its array."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory, self.count = folder, memory, 0
        #: Items that are handled at once.
        self.step = max(1 << 10, memory // 256)

    def name(self) -> str:
        self.count += 1
        return os.path.join(self.folder, f"{self.count}")

    def array(self, dtype: type, size: int) -> np.ndarray:
        if not size:
            return np.empty(0, dtype)
        name = self.name()
        out = np.asarray(np.memmap(name, dtype, "w+", shape=(size,)))
        os.unlink(name)
        return out

    def blocks(self, size: int) -> Iterator[tuple[int, int]]:
        for a in range(0, size, self.step):
            yield a, min(size, a + self.step)


class Run:
    """Items sorted by key, in memory or in mapped files, taken from front to back."""

    def __init__(self, keys: np.ndarray, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.columns, self.at = (keys, suffixes, common), 0
        self.head = int(keys[0])

    def __len__(self) -> int:
        return len(self.columns[0]) - self.at

    def before(self, key: int) -> int:
        """Number of items left with a lesser key."""
        return int(np.searchsorted(self.columns[0][self.at :], np.int64(key))) if self.head < key else 0

    def front(self, n: int) -> tuple[np.ndarray, ...]:
        return tuple(x[self.at : self.at + n] for x in self.columns)

    def skip(self, n: int) -> None:
        self.at += n
        if len(self):
            self.head = int(self.columns[0][self.at])


class BucketQueue:
    """First in, first out within a bucket; buckets are asked for in ascending (or descending) order, one or a range of them at once.

    Items are kept in runs sorted by bucket. A new run is merged with the one before while that is not much larger, so that there are
    few runs in memory; beyond ``memory`` bytes all of these go to disk as one. Runs on disk are merged likewise where there are more
    than ``RUNS``. Older runs come first.
    """

    RUNS = 8

    def __init__(self, store: Store, memory: int, dtype: type, descending: bool = False) -> None:
        self.store, self.memory, self.dtype, self.sign = store, memory, dtype, -1 if descending else 1
        self.item = 16 + np.dtype(dtype).itemsize
        self.disk: list[Run] = []
        self.held: list[Run] = []

    def push(self, chars: np.ndarray, suffixes: np.ndarray, common: np.ndarray) -> None:
        """Add items in the order of their buckets."""
        self.held.append(Run(self.sign * chars.astype(np.int64), suffixes, common.astype(self.dtype)))
        while len(self.held) > 1 and len(self.held[-2]) <= 2 * len(self.held[-1]):
            self._merge(2)
        if self.item * sum(len(run.columns[0]) for run in self.held) > self.memory:
            self._merge(len(self.held))
            if 2 * self.item * len(self.held[0]) > self.memory:
                columns = []
                for x in self.held.pop().columns:
                    columns.append(self.store.array(x.dtype, len(x)))
                    columns[-1][:] = x
                self.disk.append(Run(*columns))
                while len(self.disk) > self.RUNS and len(self.disk[-2]) <= 2 * len(self.disk[-1]):
                    self.disk[-2:] = [self._merged(*self.disk[-2:])]

    def _merge(self, n: int) -> None:
        """Make the last ``n`` runs in memory one."""
        parts = [run.front(len(run)) for run in self.held[-n:]]
        columns = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(columns[0], kind="stable")
        self.held[-n:] = [Run(*(x[order] for x in columns))]

    def _merged(self, one: Run, two: Run) -> Run:
        """Two runs on disk as one, block by block; of a bucket the older run's items come first."""
        n, m = len(one), len(two)
        left, right = one.front(n), two.front(m)
        columns = [self.store.array(x.dtype, n + m) for x in left]
        for own, other, side in ((left, right, "left"), (right, left, "right")):
            for a, b in self.store.blocks(len(own[0])):
                to = np.arange(a, b) + np.searchsorted(other[0], own[0][a:b], side)
                for x, y in zip(columns, own):
                    x[to] = y[a:b]
        return Run(*columns)

    def _clean(self) -> None:
        self.disk = [run for run in self.disk if len(run)]
        self.held = [run for run in self.held if len(run)]

    def peek(self, bound: int, most: int) -> tuple[np.ndarray, ...] | None:
        """Buckets, suffixes and values of all items before the bucket ``bound``; None: more than ``most``."""
        found, size, key = [], 0, self.sign * bound
        for run in (*self.disk, *self.held):
            n = run.before(key)
            size += n
            if size > most:
                return None
            if n:
                found.append(run.front(n))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)
        keys, suffixes, common = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys, kind="stable")
        return self.sign * keys[order], suffixes[order], common[order]

    def drop(self, bound: int) -> None:
        """Take the items before the bucket ``bound`` out."""
        for run in (*self.disk, *self.held):
            run.skip(run.before(self.sign * bound))
        self._clean()

    def pop(self, bucket: int) -> Block | None:
        """At most ``store.step`` items of the bucket, which is the next one, in the order in which they came; None: it is empty."""
        parts, left, key = [], self.store.step, self.sign * bucket
        for run in (*self.disk, *self.held):
            n = min(left, run.before(key + 1))
            if n:
                parts.append(tuple(x.copy() for x in run.front(n)[1:]))
                run.skip(n)
                left -= n
            if not left:
                break
        if not parts:
            return None
        self._clean()
        return tuple(np.concatenate(x) for x in zip(*parts))


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of ``values[low..high]``, both ends included, for each pair."""
    if not len(low):
        return values[:0]
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    tables = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    tables[0] = values
    for k in range(1, len(tables)):
        half = 1 << (k - 1)
        np.minimum(tables[k - 1, : -2 * half + 1 or None], tables[k - 1, half : len(values) - half + 1], out=tables[k, : len(values) - 2 * half + 1])
    return np.minimum(tables[level, low], tables[level, high + 1 - (1 << level)])


class RangeMin:
    """Least values of ranges of a mapped array: mapped tables for ranges up to two blocks, minima of whole blocks beyond."""

    LEVELS = 10

    def __init__(self, values: np.ndarray, store: Store) -> None:
        self.tables, n = [values], len(values)
        for k in range(1, self.LEVELS + 1):
            half, below = 1 << (k - 1), self.tables[-1]
            if n < 1 << k:
                break
            table = store.array(values.dtype, n - (1 << k) + 1)
            for a, b in store.blocks(len(table)):
                np.minimum(below[a:b], below[a + half : b + half], out=table[a:b])
            self.tables.append(table)
        whole = n >> self.LEVELS
        self.minima = np.array(self.tables[-1][: whole << self.LEVELS : 1 << self.LEVELS]) if len(self.tables) > self.LEVELS else values[:0]

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value of ``low..high``, both ends included, for each pair."""
        out = np.empty(len(low), self.tables[0].dtype)
        level = np.minimum(np.frexp((high - low + 1).astype(np.float64))[1] - 1, self.LEVELS)
        for k, table in enumerate(self.tables):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        far = np.flatnonzero(high - low + 1 > 2 << self.LEVELS)
        if len(far):
            first, end = -(-low[far] >> self.LEVELS), (high[far] + 1) >> self.LEVELS
            out[far] = np.minimum(out[far], _range_min(self.minima, first, end - 1))
        return out


class Since:
    """Least common prefix since the last item of each bucket, over the waves of a pass."""

    def __init__(self, store: Store, width: int, cap: int, dtype: type) -> None:
        self.cap, self.dtype, self.wave = cap, dtype, 0
        self.last, self.rest = store.array(np.int64, width), store.array(np.uint32, width)
        # later waves with their least values; a value that a later one undercuts goes, so that values rise
        self.waves: list[int] = []
        self.values: list[int] = []

    def dispatch(self, queue: BucketQueue, chars: np.ndarray, suffixes: np.ndarray, chosen: np.ndarray, common: np.ndarray) -> None:
        """Push the predecessors ``suffixes`` (with first characters ``chars``) of the chosen ones of a wave.

        ``common`` has the common prefix of each suffix of the wave with the one before.
        """
        self.wave += 1
        if len(chars):
            chars = chars.astype(np.int64)
            order = np.argsort(queue.sign * chars, kind="stable")
            chars, suffixes, at = chars[order], suffixes[order], chosen[order]
            first = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
            heads = chars[first]
            low = np.empty(len(at), np.int64)
            low[1:] = at[:-1] + 1
            low[first] = 0
            values = _range_min(common, low, at).astype(np.int64)
            since = np.array([*self.values, self.cap], np.int64)[np.searchsorted(np.array(self.waves, np.int64), self.last[heads], "right")]
            values[first] = np.minimum(values[first], np.minimum(self.rest[heads], since))  # of a bucket's first item: not used
            values = np.minimum(values + 1, self.cap).astype(self.dtype)
            last = at[np.append(first[1:], len(at)) - 1]
            self.last[heads] = self.wave
            behind = np.append(np.minimum.accumulate(common[::-1])[::-1], self.cap)
            self.rest[heads] = behind[last + 1]
            queue.push(chars, suffixes, values)
        least = int(common.min())
        while self.values and self.values[-1] >= least:
            self.values.pop()
            self.waves.pop()
        self.values.append(least)
        self.waves.append(self.wave)


def picked(blocks: Iterator[Block], choose: Callable[[np.ndarray], np.ndarray], cap: int) -> Iterator[Block]:
    """The chosen suffixes, each with its common prefix with the chosen one before it."""
    least = cap
    for p, common in blocks:
        at = np.flatnonzero(choose(p))
        if not len(at):
            least = min(least, int(common.min()))
            continue
        between = np.minimum.reduceat(common[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
        between[0] = min(int(between[0]), least)
        yield p[at], between
        rest = common[at[-1] + 1 :]
        least = int(rest.min()) if len(rest) else cap


class Sorter:
    """Sorts the suffixes of ``text`` (integers from zero below ``width``, the last one the least and unique); common prefixes up to ``cap``."""

    def __init__(self, text: np.ndarray, width: int, store: Store, cap: int) -> None:
        self.text, self.width, self.store, self.cap = np.asarray(text), width, store, cap
        self._types()

    def _types(self) -> None:
        """Which suffixes are S-suffixes, and where the leftmost ones are."""
        text, n = self.text, len(self.text)
        self.s = s = self.store.array(np.bool_, n)
        s[n - 1] = after = True
        for a, b in reversed(list(self.store.blocks(n - 1))):
            x = text[a : b + 1]
            rises, falls = x[:-1] < x[1:], x[:-1] > x[1:]
            change = np.where(rises | falls, np.arange(b - a), b - a)
            s[a:b] = np.append(rises, after)[np.minimum.accumulate(change[::-1])[::-1]]
            after = s[a]
        size = sum(int(np.count_nonzero(s[a + 1 : b + 1] & ~s[a:b])) for a, b in self.store.blocks(n - 1))
        self.lms, at = self.store.array(np.int64, size), 0
        for a, b in self.store.blocks(n - 1):
            found = np.flatnonzero(s[a + 1 : b + 1] & ~s[a:b]) + a + 1
            self.lms[at : at + len(found)] = found
            at += len(found)

    def _common(self, a: int, b: int, cap: int) -> int:
        """Common prefix of two suffixes that differ soon, up to the cap."""
        text, k, more, end = self.text, 0, 64, min(cap, len(self.text) - max(a, b))
        while k < end:
            upto = min(end, k + more)
            differ = np.flatnonzero(text[a + k : a + upto] != text[b + k : b + upto])
            if len(differ):
                return k + int(differ[0])
            k, more = upto, more * 2
        return end

    def _commons(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for pairs."""
        text, k, live = self.text, np.zeros(len(a), np.int64), np.arange(len(a))
        while len(live):
            live = live[text[a[live] + k[live]] == text[b[live] + k[live]]]
            k[live] += 1
            live = live[k[live] < self.cap]
        return k

    def _wave(self, parts: tuple[tuple[np.ndarray, ...], ...], cap: int, sign: int) -> tuple[np.ndarray, ...]:
        """Buckets, suffixes, values and parts (0, 1) of two parts of whole buckets; in a bucket the first part comes first."""
        keys, p, common = (np.concatenate(x) for x in zip(*parts))
        kind = np.repeat((False, True), [len(x[0]) for x in parts])
        order = np.argsort(sign * keys, kind="stable")
        keys, p, common, kind = keys[order], p[order], common[order], kind[order]
        same = keys[1:] == keys[:-1]
        common[np.concatenate(([0], np.flatnonzero(~same) + 1))[: len(keys)]] = 0
        turn = np.flatnonzero(same & (kind[1:] != kind[:-1])) + 1
        # how long a run of a character goes on after a substring's end is not part of the substring
        common[turn] = 1 if cap == EQUAL else self._commons(p[turn - 1], p[turn])
        return keys, p, common, kind

    def _predecessors(self, p: np.ndarray, kind: bool) -> Block:
        """Which of the suffixes have a predecessor of the type, and these predecessors."""
        chosen = np.flatnonzero(p > 0)
        before = p[chosen] - 1
        own = self.s[before] == kind
        return chosen[own], before[own]

    def induce(self, seeds: tuple[np.ndarray, np.ndarray | None, np.ndarray], cap: int, dtype: type) -> Iterator[Block]:
        """All suffixes in descending order with common prefixes, from the leftmost S-suffixes.

        seeds: these by bucket, their values (None: ``EQUAL``), and where each bucket begins. The value of each suffix is the common
        prefix with the one that came out before it. A range of buckets is one wave up to the first bucket that the wave itself feeds;
        the next range is twice as wide as what that was. A bucket that feeds itself, or has more than a block, goes block by block.
        """
        text, store, width = self.text, self.store, self.width
        share, step = store.memory // 4, store.step
        up, up_values, bounds = seeds
        queue, since = BucketQueue(store, share, dtype), Since(store, width, cap, dtype)
        n = len(text)
        ls, l_common = store.array(np.int64, n - self.n_s), store.array(dtype, n - self.n_s)
        ends, at = store.array(np.int64, width), 0

        def seeded(a: int, b: int) -> Block:
            return np.array(up[a:b]), np.full(b - a, EQUAL, dtype) if up_values is None else up_values[a:b].astype(dtype)

        def single(p: np.ndarray, common: np.ndarray, kind: bool) -> None:
            chosen, before = self._predecessors(p, kind)
            since.dispatch(queue, text[before], before, chosen, common)

        c, reach = 0, 2
        while c < width:
            d = min(width, c + reach)
            found = None
            if d - c > 1:
                x, y = int(bounds[c]), int(bounds[d])
                found = queue.peek(d, step - (y - x)) if y - x <= step else None
                if found is None:
                    reach = (d - c) // 2
                    continue
                some = seeded(x, y)
                keys, p, common, kind = self._wave((found, (text[some[0]].astype(np.int64), *some)), cap, 1)
                chosen, before = self._predecessors(p, False)
                chars = text[before]
                fed = chars[chars < d]
                t = int(fed.min()) if len(fed) else d
                if t > c:
                    reach = 2 * (t - c)
                    if t < d:
                        size = int(np.searchsorted(keys, t))
                        keys, p, common, kind = keys[:size], p[:size], common[:size], kind[:size]
                        inside = chosen < size
                        chosen, before, chars = chosen[inside], before[inside], chars[inside]
                    queue.drop(t)
                    ends[c:t] = at + np.searchsorted(keys[~kind], np.arange(c, t), "right")
                    size = int(np.count_nonzero(~kind))
                    ls[at : at + size], l_common[at : at + size] = p[~kind], common[~kind]
                    at += size
                    if len(p):
                        since.dispatch(queue, chars, before, chosen, common)
                    c = t
                    continue
            last = None
            while (found := queue.pop(c)) is not None:
                if last is None:
                    found[1][0] = 0
                last = int(found[0][-1])
                ls[at : at + len(found[0])], l_common[at : at + len(found[0])] = found
                at += len(found[0])
                single(*found, False)
            ends[c] = at
            x, y = int(bounds[c]), int(bounds[c + 1])
            for a in range(x, y, step):
                found = seeded(a, min(y, a + step))
                if a == x:
                    found[1][0] = 0 if last is None else 1 if cap == EQUAL else self._common(last, int(found[0][0]), cap)
                single(*found, False)
            c, reach = c + 1, max(2, reach // 2)
        queue, since = BucketQueue(store, share, dtype, descending=True), Since(store, width, cap, dtype)
        c, reach = width - 1, 2
        while c >= 0:
            d = max(-1, c - reach)
            begin, end = int(ends[d]) if d >= 0 else 0, int(ends[c])
            if c - d > 1:
                found = queue.peek(d, step - (end - begin)) if end - begin <= step else None
                if found is None:
                    reach = (c - d) // 2
                    continue
                down = ls[begin:end][::-1]
                values = np.zeros(len(down), dtype)
                values[1:] = l_common[begin + 1 : end][::-1]
                keys, p, common, kind = self._wave((found, (text[down].astype(np.int64), down, values)), cap, -1)
                chosen, before = self._predecessors(p, True)
                chars = text[before]
                fed = chars[chars.astype(np.int64) > d]
                t = int(fed.max()) if len(fed) else d
                if t < c:
                    reach = 2 * (c - t)
                    if t > d:
                        size = int(np.searchsorted(-keys, -t))
                        p, common = p[:size], common[:size]
                        inside = chosen < size
                        chosen, before, chars = chosen[inside], before[inside], chars[inside]
                    queue.drop(t)
                    if len(p):
                        yield p, common
                        since.dispatch(queue, chars, before, chosen, common)
                    c = t
                    continue
            last = None
            while (found := queue.pop(c)) is not None:
                if last is None:
                    found[1][0] = 0
                last = int(found[0][-1])
                yield found
                single(*found, True)
            begin = int(ends[c - 1]) if c else 0
            after = 0  # common prefix of the block's greatest suffix with what came out before
            if end > begin and last is not None:
                after = self._common(last, int(ls[end - 1]), cap)
            while end > begin:
                a = max(begin, end - step)
                down, values = ls[a:end][::-1].copy(), np.empty(end - a, dtype)
                values[0] = after
                values[1:] = l_common[a + 1 : end][::-1]
                after, end = l_common[a], a
                yield down, values
                single(down, values, True)
            c, reach = c - 1, max(2, reach // 2)
        yield np.array([n - 1]), np.zeros(1, dtype)

    @property
    def n_s(self) -> int:
        """Number of S-suffixes."""
        if not hasattr(self, "_n_s"):
            self._n_s = sum(int(np.count_nonzero(self.s[a:b])) for a, b in self.store.blocks(len(self.s)))
        return self._n_s

    def _is_lms(self, p: np.ndarray) -> np.ndarray:
        return self.s[p] & (p > 0) & ~self.s[p - 1]

    def _named(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Leftmost S-suffixes in descending order of their substrings, the common prefix of each with the one before, and the number of different ones."""
        store, lms, text = self.store, self.lms, self.text
        bounds = self._bounds(lms)
        up, free = store.array(np.int64, len(lms)), store.array(np.int64, self.width)
        free[:] = bounds[:-1]
        for a, b in store.blocks(len(lms)):
            own = np.array(lms[a:b])
            c = text[own]
            by = np.argsort(c, kind="stable")
            c, own = c[by].astype(np.int64), own[by]
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            sizes = np.diff(np.append(first, len(c)))
            up[free[c] + np.arange(len(c)) - np.repeat(first, sizes)] = own
            free[c[first]] += sizes
        seeds = up, None, bounds
        order, common, at, kinds = store.array(np.int64, len(lms)), store.array(np.uint32, len(lms)), 0, 0
        for p, least in picked(self.induce(seeds, EQUAL, np.uint32), self._is_lms, EQUAL):
            order[at : at + len(p)], common[at : at + len(p)] = p, least
            at += len(p)
            kinds += int(np.count_nonzero(least < EQUAL))
        return order, common, kinds

    def _bounds(self, p: np.ndarray) -> np.ndarray:
        """Where the bucket of each character begins among the suffixes sorted, and their number."""
        bounds, total = self.store.array(np.int64, self.width + 1), 0
        for a, b in self.store.blocks(len(p)):
            c, n = np.unique(self.text[p[a:b]], return_counts=True)
            bounds[c.astype(np.int64) + 1] += n
        for a, b in self.store.blocks(self.width + 1):
            bounds[a:b] = np.cumsum(bounds[a:b]) + total
            total = int(bounds[b - 1])
        return bounds

    def seeds(self) -> Block:
        """The leftmost S-suffixes in ascending order, with the common prefix of each with the one before, up to the cap."""
        store, lms, m, cap = self.store, self.lms, len(self.lms), self.cap
        order, common, kinds = self._named()
        up, values = store.array(np.int64, m), store.array(np.uint16, m)
        if kinds == m:
            at, last = m, order[:1]
            for a, b in store.blocks(m):
                p = np.array(order[a:b])
                at = self._turned(up, values, at, p, np.concatenate((last, p[:-1])), common[a:b].astype(np.int64))
                last = p[-1:]
            return up, values
        # leftmost S-suffixes are never next to each other, so that half their place is theirs alone
        names, between, at = store.array(np.int64, len(self.text) // 2 + 1), store.array(np.uint16, kinds), kinds
        for a, b in store.blocks(m):
            new = common[a:b] < EQUAL
            names[order[a:b] >> 1] = at - np.cumsum(new)
            below = at - np.cumsum(new)[new]
            kept = below + 1 < kinds
            between[below[kept] + 1] = np.minimum(common[a:b][new][kept], cap)
            at = int(at - np.count_nonzero(new))
        reduced = store.array(np.int64, m)
        for a, b in store.blocks(m):
            reduced[a:b] = names[lms[a:b] >> 1]
        del names, order, common
        ranges, most = RangeMin(between, store), cap // 2 + 2
        at, last = m, None
        for p, shared in Sorter(reduced, kinds, store, most).sorted():
            before = np.concatenate((p[:1] if last is None else last, p[:-1]))
            last, q = p[-1:], np.minimum(shared, most).astype(np.int64)
            value = np.full(len(p), cap, np.int64)
            some = np.flatnonzero((q < most) & (p != before))
            q, x, y = q[some], p[some], before[some]
            one, two = reduced[x + q], reduced[y + q]
            value[some] = lms[x + q] - lms[x] + ranges.least(np.minimum(one, two) + 1, np.maximum(one, two))
            at = self._turned(up, values, at, lms[p], lms[before], value)
        return up, values

    def _turned(self, up: np.ndarray, values: np.ndarray, at: int, p: np.ndarray, before: np.ndarray, least: np.ndarray) -> int:
        """Put suffixes that come in descending order, with what they share at least with the ones before, before place ``at`` in ascending order.

        Where a substring ends in a run of characters, more may be shared.
        """
        text, live = self.text, np.flatnonzero((least < self.cap) & (p != before))
        while len(live):
            live = live[text[p[live] + least[live]] == text[before[live] + least[live]]]
            least[live] += 1
            live = live[least[live] < self.cap]
        begin = at - len(p)
        up[begin:at] = p[::-1]
        # in ascending order a value belongs to the greater one of its pair
        shared = np.minimum(least, self.cap)[::-1]
        values[begin + 1 : at + 1] = shared[: min(at + 1, len(values)) - begin - 1]
        values[0] = 0
        return begin

    def sorted(self) -> Iterator[Block]:
        """All suffixes in descending order with the common prefix with the one before, up to the cap."""
        up, values = self.seeds()
        return self.induce((up, values, self._bounds(up)), self.cap, np.uint16)


class Shard:
    """Strings, written to a mapped text as they come; then the starts among each one's first ones whose bytes start elsewhere too.

    Bytes that many strings share may stand in the text as one symbol, a name; ``length`` counts symbols.
    """

    def __init__(self, length: int, memory: int) -> None:
        self.length, self.memory, self.width = length, memory, 258
        self.folder = tempfile.TemporaryDirectory(prefix="induced-")
        self.file = open(os.path.join(self.folder.name, "text"), "w+b")
        self.begin, self.windows, self.size = array("q"), array("q"), 0

    def __len__(self) -> int:
        return len(self.begin)

    def name(self) -> int:
        """A new symbol, greater than all others."""
        self.width += 1
        return self.width - 1

    def add(self, string: bytes, windows: int, named: tuple[int, int, int] | None = None) -> None:
        """named: from where to where the string's bytes are one symbol, and this symbol; no start is behind its place."""
        left, right, name = named or (len(string), len(string), 1)
        codes = np.ones(left + 1 + len(string) - right + (named is not None), np.uint32)  # one ends a string
        raw = np.frombuffer(string, np.uint8)
        codes[:left] = raw[:left]
        codes[:left] += 2
        if named:
            codes[left] = name
            codes[left + 1 : -1] = raw[right:]
            codes[left + 1 : -1] += 2
        self.file.write(codes.tobytes())
        self.begin.append(self.size)
        self.windows.append(windows)
        self.size += len(codes)

    def repeated(self) -> Iterator[np.ndarray]:
        """For each string the starts, among its first ``windows`` ones, whose ``length`` symbols start at another such place too."""
        with self.folder, self.file:
            self.file.write(np.zeros(1, np.uint32).tobytes())
            self.file.flush()
            text = np.asarray(np.memmap(self.file.name, np.uint32, "r"))
            store, length = Store(self.folder.name, self.memory), self.length
            own, hit, last = store.array(np.bool_, len(text)), store.array(np.bool_, len(text)), -1
            for a, n in zip(self.begin, self.windows):
                own[a : a + n] = True
            for p, common in picked(Sorter(text, self.width, store, length).sorted(), lambda p: own[p], length):
                before = np.concatenate(([last], p[:-1]))
                match = (common >= length) & (before >= 0)
                hit[p[match]] = True
                hit[before[match]] = True
                last = int(p[-1])
            for a, n in zip(self.begin, self.windows):
                yield np.flatnonzero(hit[a : a + n])


def repeated_starts(strings: list[bytes], windows: list[int], length: int, memory: int) -> list[np.ndarray]:
    """:meth:`Shard.repeated` of a list of strings."""
    shard = Shard(length, memory)
    for x, n in zip(strings, windows):
        shard.add(x, n)
    return list(shard.repeated())
