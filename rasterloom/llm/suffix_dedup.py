"""Suffix-array deduplication: removes all bytes of strings of ``LENGTH`` bytes that start in more than one place.

Strings are sorted in shards that fit the way of a suffix array, and every two equal strings meet in a shard:

1. Each start of a string belongs to the anchor of that string, the place of its least hashed ``GRAM`` bytes (the leftmost of
   equal ones). Equal strings have equal anchors at equal distances. The starts of an anchor are consecutive; the bytes that
   their strings cover are its context. Contexts are counted by anchor and content: what is in equal contexts twice is
   repeated, what alone has its anchor is not.
2. The rest, different contexts of one anchor, are cut by the distance to the anchor into parts of ``PART`` starts. The
   bytes that all strings of a part share are its core. Parts with a core of their own hold nothing repeated, equal
   parts are repeated. Of a core with more than ``HOT`` different parts these are cut into finer parts of the next of ``FINER``
   sizes, whose cores are longer and therefore rarer, so no core is gathered in one task; a part of one start is its core.
3. What is left goes, one of each different part, to shards by core. There the suffixes are sorted by external induced
   sorting, and starts with a common prefix of ``LENGTH`` bytes with a neighbour are repeated. All strings of a part hold its
   core whole, so the core stands in the shard's text as one symbol, that of its hash and, compared byte by byte, its content:
   strings are equal as before, and a part of 463 bytes has 127 symbols. A shard's text is written to disk as it comes, and the
   sorter keeps to ``MEMORY``, however large the shard.

Texts are UTF-8 bytes, null counts as empty. Strings never cross rows; repeated rows repeat each other. Rows are told apart by
96 bits of their text's hashes, as equal texts have equal results.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.induced import Shard
from rasterloom.llm.rows import pieces
from rasterloom.runtime import checkpoint, staged

LENGTH, GRAM, PART = 400, 32, 64
#: Different parts of a core that are sorted together at most, and the sizes of finer parts.
HOT, FINER = 1024, (8, 1)
#: Bytes of a text whose grams are hashed at once, and bytes that the sorter of a shard keeps in memory.
CHUNK, MEMORY = 1 << 19, 4 << 20
#: Symbols of parts that one call of the sorter takes, its arrays and queues some 50 bytes for each; the parts of a core stay together.
SHARD = 4 << 20

_PLACE = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each place, by doubling."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, width = _ODD, 1
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * factor + h[width:]
            factor, width = factor * factor, width * 2
        h ^= h >> np.uint64(32)
        h *= _ODD
    return h ^ (h >> np.uint64(32))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, from prefix and suffix minima of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor, its first start and the number of its starts."""
    out = []
    for base in range(0, max(0, len(text) - length + 1), CHUNK):
        part = np.frombuffer(text, np.uint8)[base : base + CHUNK + length - 1]
        g = _gram_hashes(part, gram)
        # the leading bits decide, then the place; within a chunk places have at most 20 bits
        least = _window_min((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
        at = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out.append((g[at[first]] & ~_PLACE, at[first] + base, first + base, np.diff(np.append(first, len(at)))))
    if not out:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _key(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.hash(whole).alias("k2")]


def _contexts(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """``k1, k2, anchor, content, start, n`` of each anchor of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in pieces(batches):
            row, anchor, content, start, number = [], [], [], [], []
            for i, t in enumerate(b.column(2).to_pylist()):
                raw = (t or "").encode()
                a, p, s, n = anchors(raw, length, gram)
                row.append(np.full(len(a), i))
                anchor.append(a)
                start.append(s)
                number.append(n)
                content += [digest(raw[x : x + m + length - 1], seed=d) for x, m, d in zip(s.tolist(), n.tolist(), (p - s).tolist())]
            join = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
            at = pa.array(join(row, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(join(anchor, np.uint64).view(np.int64)), _signed(content), pa.array(join(start, np.int32)), pa.array(join(number, np.int32))], ["k1", "k2", "anchor", "content", "start", "n"])

    return docs.select(*_key(docs[text]), docs[text]).mapInArrow(run, "k1 long, k2 int, anchor long, content long, start int, n int")


def _flagged(rows: DataFrame, group: str, place: list[str]) -> DataFrame:
    """Contents whose group has several of them, or that occur several times: ``group, content, times, kinds`` and one place."""
    contents = rows.groupBy(group, "content").agg(F.count("*").alias("times"), F.min(F.struct(*place)).alias("one"))
    groups = contents.groupBy(group).agg(F.count("*").alias("kinds"), F.max("times").alias("most")).where("kinds > 1 or most > 1").drop("most")
    return contents.join(groups, group).where("times > 1 or kinds > 1")


PARTS = "k1 long, k2 int, core long, content long, start int, n int, place int, body binary"


def _cut(place: int, n: int, size: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Parts of ``size`` distances of ``n`` starts, the first of them at the distance ``place`` before the anchor.

    Distances are cut at multiples of ``size``, so that equal strings are in equal parts. Of each part: its number, its first start and
    number of starts, and from where to where its core goes: the bytes that all strings of a whole part have, whichever are here.
    """
    for k in range((place - n + 1) // size, place // size + 1):
        first, last = max(0, place - (k + 1) * size + 1), min(n - 1, place - k * size)
        yield k, first, last - first + 1, place - k * size, place - (k + 1) * size + 1 + length


def _parts(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """Parts of the wanted contexts. texts: ``k1, k2, text, wanted`` (array of start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in pieces(batches):
            row, core, content, start, number, place, held = [], [], [], [], [], [], []
            for i, (t, wanted) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                raw, wanted = (t or "").encode(), {w["start"]: w["n"] for w in wanted}
                for a, p, s, n in zip(*(x.tolist() for x in anchors(raw, length, gram))):
                    if wanted.get(s) != n:
                        continue
                    for k, first, m, left, right in _cut(p - s, n, PART, length):
                        row.append(i)
                        core.append(digest(raw[s + left : s + right], seed=(a ^ k) & ((1 << 64) - 1)))
                        body = raw[s + first : s + first + m - 1 + length]
                        content.append(digest(body, seed=p - s - first))
                        start.append(s + first)
                        number.append(m)
                        place.append(p - s - first)
                        held.append(body)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _signed(core), _signed(content), *(pa.array(x, pa.int32()) for x in (start, number, place)), pa.array(held, pa.binary())], ["k1", "k2", "core", "content", "start", "n", "place", "body"])

    return texts.mapInArrow(run, PARTS)


def _finer(parts: DataFrame, size: int, length: int) -> DataFrame:
    """The same parts, cut into finer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in pieces(batches):
            row, core, content, start, number, place, held = [], [], [], [], [], [], []
            for i, (c, s, n, p, body) in enumerate(zip(*(b.column(k).to_pylist() for k in (2, 4, 5, 6, 7)))):
                for k, first, m, left, right in _cut(p, n, size, length):
                    row.append(i)
                    core.append(digest(body[left:right], seed=(c ^ k) & ((1 << 64) - 1)))
                    held.append(body[first : first + m - 1 + length])
                    content.append(digest(held[-1], seed=p - first))
                    start.append(s + first)
                    number.append(m)
                    place.append(p - first)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), _signed(core), _signed(content), *(pa.array(x, pa.int32()) for x in (start, number, place)), pa.array(held, pa.binary())], ["k1", "k2", "core", "content", "start", "n", "place", "body"])

    return parts.select("k1", "k2", "core", "content", "start", "n", "place", "body").mapInArrow(run, PARTS)


def _sorted_shards(parts: DataFrame, size: int, length: int, memory: int, shard: int) -> DataFrame:
    """Repeated starts among ``core, k1, k2, start, n, place, body``, parts of ``size`` distances: spans ``k1, k2, a, b`` of bytes."""
    keyed = parts.select("core", "k1", "k2", "start", "n", "place", "body").repartition("core").sortWithinPartitions("core")
    shared = max(0, length + 1 - size)
    symbols = length - shared + 1 if shared else length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, before, cores = Shard(symbols, memory), tuple(array("q") for _ in range(3)), None, {}

        def found() -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int, int, int]] = []

            def batch() -> pa.RecordBatch:
                k1, k2, a, b = zip(*out) if out else ((), (), (), ())
                return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), *(pa.array(x, pa.int32()) for x in (k2, a, b))], ["k1", "k2", "a", "b"])

            for k1, k2, start, at in zip(*rows, held.repeated()):
                if len(at):
                    cut = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
                    out += [(k1, k2, start + x, start + y + length) for x, y in zip(at[cut].tolist(), at[np.append(cut[1:], len(at)) - 1].tolist())]
                if len(out) >= 1 << 14:
                    yield batch()
                    out.clear()
            yield batch()

        for batch in pieces(batches):
            for core, k1, k2, start, n, place, body in zip(*(c.to_pylist() for c in batch.columns)):
                if core != before:
                    if held.size >= shard:
                        yield from found()
                        held, rows = Shard(symbols, memory), tuple(array("q") for _ in range(3))
                    before, cores = core, {}
                left = place % size
                content = body[left : left + shared]
                if content not in cores:
                    cores[content] = held.name()
                held.add(body, n, (left, left + shared, cores[content]) if shared else None)
                for to, x in zip(rows, (k1, k2, start)):
                    to.append(x)
        if len(held):
            yield from found()

    return keyed.mapInArrow(run, "k1 long, k2 int, a int, b int")


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``k1, k2, spans``: spans of bytes to remove (may touch and overlap) of each different text that has any."""
    bytes_of = lambda df: df.select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b"))
    contexts = staged(_contexts(docs, text, length, gram))
    flagged = staged(_flagged(contexts, "anchor", ["k1", "k2", "start", "n"]))
    every = bytes_of(contexts.join(flagged.where("times > 1").select("anchor", "content"), ["anchor", "content"], "left_semi"))
    # contexts that differ from others of their anchor, one of each
    wanted = flagged.where("kinds > 1").select("one.*").groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "n")).alias("wanted"))
    texts = docs.select(*_key(docs[text]), docs[text].alias("text")).where(F.octet_length("text") >= length).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    parts = staged(_parts(texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted"), length, gram))
    for own, size in zip((PART, *FINER), (*FINER, None)):
        mixed = staged(_flagged(parts, "core", ["k1", "k2", "start", "n"]))
        every = every.union(bytes_of(parts.join(mixed.where("times > 1").select("core", "content"), ["core", "content"], "left_semi")))
        some = lambda kinds, parts=parts, mixed=mixed: parts.join(mixed.where(kinds).select("core", "content", "one.*"), ["core", "content", "k1", "k2", "start", "n"], "left_semi")
        few = "kinds > 1" if size is None else f"kinds > 1 and kinds <= {hot}"
        every = every.union(_sorted_shards(some(few), own, length, memory, shard))
        many = mixed.where(F.col("kinds") > hot)
        if size is None or many.isEmpty():
            break
        parts = staged(_finer(some(f"kinds > {hot}"), size, length))
    return checkpoint(every.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "b")).alias("spans")))


def _with_spans(docs: DataFrame, text: str, id: str, length: int, gram: int, memory: int, shard: int, hot: int) -> DataFrame:
    removed = spans(docs, text, length, gram, memory, shard, hot)
    keyed = docs.select(*_key(docs[text]), docs[id].alias("id"), docs[text].alias("text"))
    return keyed.join(removed, ["k1", "k2"], "left").select("id", "text", "spans")


def _kept(raw: bytes, first: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    """The bytes that stay, and the number of maximal removed runs."""
    if not len(first):
        return raw, 0
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    start = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1])))
    begins, ends = first[start].tolist(), reach[np.append(start[1:], len(first)) - 1].tolist()
    return b"".join(raw[x:y] for x, y in zip([0, *ends], [*begins, len(raw)])), len(begins)


def _rows_kept(b: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, int]]:
    """Bytes of each row, those that stay, and the runs removed. b: id, text, spans."""
    spans = b.column(2)
    sizes = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    first, end = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(b.num_rows):
        raw = (b.column(1)[i].as_py() or "").encode()
        yield raw, *_kept(raw, first[at[i] : at[i + 1]], end[at[i] : at[i + 1]])


def deduplicated(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``id, kept`` (binary: cuts may fall inside a character) of each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            kept = [x for _, x, _ in _rows_kept(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary())], ["id", "kept"])

    return _with_spans(docs, text, id, length, gram, memory, shard, hot).mapInArrow(run, f"id {kind}, kept binary").withColumnRenamed("id", id)


def digest(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            size, gone, runs, sha = [], [], [], []
            for raw, kept, n in _rows_kept(b):
                size.append(len(raw))
                gone.append(len(raw) - len(kept))
                runs.append(n)
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(docs, text, id, length, gram, memory, shard, hot).mapInArrow(run, schema).withColumnRenamed("id", id)
