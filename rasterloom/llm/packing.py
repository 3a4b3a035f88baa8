"""Packing of documents into windows by minimum bin slack over the histogram of piece lengths.

Documents are tokenised and cut into full windows and a rest. What is packed is not pieces but their lengths: of the histogram
(at most as many lengths as a window has tokens) the longest remaining length opens a window, and subset sums over the other
lengths, as a bitset with as many bits as tokens are free, tell which multiset of lengths comes closest to the capacity; the
counts are traced back through the bitsets of all steps. The same multiset fills as many windows as the histogram allows, so
each one uses up a length and there are at most as many multisets as lengths, whatever the number of documents.

Pieces of one length are interchangeable. They are numbered in salted groups of a length, so that a length that a third of all
pieces has is no single task's work; the number of a piece gives its window, its place there and its offset, from a table whose
size is bounded by the window: a multiset of L tokens has fewer than sqrt(2 L) different lengths.

Tokens are those of the ``tokenizers`` library. Words between ASCII white space are tokenised once for each worker; none of the
tokenizer's steps looks beyond one. Words of ASCII and Latin letters go to its model without its regular expressions.

Null text counts as empty; each document has the end mark as its last id, so that empty ones have one. Repeated rows are packed
each on their own, null ids stay null, other columns are not read. No rows: no windows.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.rows import pieces as few_rows
from rasterloom.runtime import staged

WINDOW, END = 4096, 2

#: Words, and parts of words, whose ids a worker keeps; all go when there are more.
MEMO = 500_000

#: Largest tokenizer file that is broadcast.
MAX_TOKENIZER_BYTES = 64 << 20

#: Groups of each length among which its pieces are numbered: so many at least, and one more for each so many pieces.
GROUPS, GROUP = 256, 20_000

# -- tokens ------------------------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    """Results of a function of one argument."""

    def __init__(self, f: Callable[[Any], bytes]) -> None:
        self.f = f

    def __missing__(self, key: Any) -> bytes:
        found = self[key] = self.f(key)
        return found


class Words:
    """Packed ids (four bytes each, little-endian) of words without ASCII white space.

    ``data`` is a tokenizer file. The short way, for words below U+0250, holds for tokenizers that lower-case and split as the
    one that ``SHORT`` describes; all others and all other words take the library's whole way.
    """

    #: What a tokenizer file has to say for the short way.
    SHORT = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    }
    #: The same split for lower-cased words below U+0250.
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xbaß-öø-ɏ]+|[0-9²³¹¼-¾]|[^a-z\xaa\xb5\xbaß-öø-ɏ0-9²³¹¼-¾\x85\xa0]+")

    def __init__(self, data: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data)
        self.tokenizer.encode_special_tokens = True
        said = json.loads(data)
        self.short = all(said.get(k) == v for k, v in self.SHORT.items())
        self.letters = {ord(chr(b)): c for b, c in _byte_letters().items()}
        self.split = self.tokenizer.model.tokenize
        self.packed = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.known = _Memo(self.word)
        self.parts = _Memo(self._part)

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() and part.isalnum() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.split(shown)])

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        low = text.lower()
        if self.short and (text.isascii() or max(low) < "ɐ" and max(text) < "ɐ"):
            return self.parts[low] if low.isalpha() else b"".join(map(self.parts.__getitem__, self.PARTS.findall(low)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        for known in (self.known, self.parts):
            if len(known) >= MEMO:
                known.clear()
        return b"".join(map(self.known.__getitem__, text.encode().split()))


_READY: dict[int, Words] = {}


def cut(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """Pieces of each row: ``id``, start, length, ids_crc32, doc_tokens, salt (tells pieces apart), with ``ids`` also the ids.

    All but the last piece of a document are whole windows.
    """
    with open(path, "rb") as f:
        data = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is no tokenizer file: over {MAX_TOKENIZER_BYTES} bytes")
    sent, key = docs.sparkSession.sparkContext.broadcast(data.decode()), zlib.crc32(data)
    kind, mark, step = docs.schema[id].dataType.simpleString(), int(end).to_bytes(4, "little"), 4 * window
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "salt", *["ids"] * ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY[key] = Words(sent.value)
        words, salts = _READY[key], itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        for b in few_rows(batches):
            row, start, size, crc, total, own = [], [], [], [], [], []
            for i in range(b.num_rows):
                packed = words.text(b.column(1)[i].as_py() or "") + mark
                for at in range(0, len(packed), step):
                    part = packed[at : at + step]
                    row.append(i)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(packed) // 4)
                    if ids:
                        own.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total, list(itertools.islice(salts, len(row)))))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(own, pa.list_(pa.int32()))] * ids], names)

    longs = ", ".join(f"{n} long" for n in names[1:6])
    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, {longs}" + ", ids array<int>" * ids)


# -- windows -----------------------------------------------------------------------------------------------------------


def fullest(have: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths, of which ``have`` gives the most, whose sum comes closest to ``room`` without exceeding it.

    Longer lengths come first and no more are looked at once the room can be filled, so short ones stay for later windows.
    """
    mask, steps = (1 << room + 1) - 1, [(0, 1)]
    for size in sorted((x for x in have if x <= room), reverse=True):
        reach, left, by = steps[-1][1], min(have[size], room // size), 1
        while left:
            take = min(by, left)
            reach |= reach << take * size & mask
            left, by = left - take, by * 2
        steps.append((size, reach))
        if reach >> room & 1:
            break
    at, counts = steps[-1][1].bit_length() - 1, {}
    for (size, _), (_, reach) in zip(steps[:0:-1], steps[-2::-1]):
        used = 0
        while not reach >> at & 1:
            at -= size
            used += 1
        if used:
            counts[size] = used
    return counts


def multisets(have: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Lengths with counts of each kind of window, and how many windows there are of it."""
    have, out = dict(have), []
    while have:
        longest = max(have)
        rest = have | {longest: have[longest] - 1}
        counts = fullest({k: v for k, v in rest.items() if v}, window - longest)
        counts[longest] = counts.get(longest, 0) + 1
        times = min(have[k] // v for k, v in counts.items())
        out.append((counts, times))
        for k, v in counts.items():
            have[k] -= v * times
            if not have[k]:
                del have[k]
    return out


def places(made: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows of length, first number, first window, pieces of the length in a window, and their offset there; by length and number."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for counts, times in made:
        offset = 0
        for size in sorted(counts, reverse=True):
            rows.append((size, used.get(size, 0), sequence, counts[size], offset))
            used[size] = used.get(size, 0) + counts[size] * times
            offset += counts[size] * size
        sequence += times
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id", window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """``id``, start, length, ids_crc32, doc_tokens, with ``ids`` the ids, sequence_id and offset of every piece.

    ``path`` is a tokenizer file; each document's ids are followed by ``end``.
    """
    parts = staged(cut(docs, path, text, id, window, end, ids))
    have = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most as many as a window has tokens
    table = docs.sparkSession.sparkContext.broadcast(places(multisets(have, window)))
    groups = GROUPS + sum(have.values()) // GROUP
    own = [c for c in parts.columns if c != "salt"]
    placed = parts.withColumn("group", F.pmod(F.xxhash64("salt"), F.lit(groups)))
    numbered = placed.withColumn("number", F.row_number().over(Window.partitionBy("length", "group").orderBy("salt")) - 1)
    sizes = placed.groupBy("length", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = numbered.join(sizes, ["length", "group"]).select(*own, (F.col("number") + F.col("before")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t[:, 0] << 44 | t[:, 1]
        for b in batches:
            size, number = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "number"))
            _, first, sequence, each, offset = t[np.searchsorted(keys, size << 44 | number, "right") - 1].T
            nth, slot = np.divmod(number - first, each)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence + nth), pa.array(offset + slot * size)], [*own, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "number")
    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long").withColumnRenamed("id", id)
