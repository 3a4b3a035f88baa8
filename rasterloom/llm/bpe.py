"""Byte-level BPE in linear time: longest matches, backtracking and memoised token compatibility.

The bytes of a piece are mapped one to one to Latin-1, so that a pyahocorasick automaton over the vocabulary finds the
longest token that starts at each byte. The encoder walks from left to right with these longest tokens. A token may
stand after its neighbour only if merging would really have kept the border between the two; whether it does depends
on the two tokens alone and is memoised. Where a token does not fit, the next shorter token that is its prefix is
tried, and where none fits the last token is taken back and its end position is marked as dead. Each position is
marked once, so the work is linear in the length. The result equals the merge loop's result.

Null text counts as empty (no ids). Repeated rows are encoded each on their own. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from rasterloom.llm.rows import pieces

#: Pieces kept by each worker's memo, and compatible or incompatible token pairs; both are emptied when full.
MEMO_PIECES, MEMO_PAIRS = 300_000, 1_000_000

#: Largest rank file that is broadcast: vocabularies are files of fixed size that do not grow with the corpus.
MAX_RANK_BYTES = 64 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token, blank, rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class Encoder:
    """Exact BPE over the ranks of a vocabulary whose rank order is its merge order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.vocab = {r: t for t, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.vocab}
        self.find = regex.compile(pattern).findall
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), None)
        automaton.make_automaton()
        self.automaton = automaton
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank in sorted(self.vocab):
            self._split(rank)

    def _split(self, rank: int) -> None:
        """Find the two tokens whose merge makes this token."""
        token, left = self.vocab[rank], self.shorter[rank]
        while left is not None:
            right = self.ranks.get(token[len(self.vocab[left]) :])
            if right is not None and left < rank and right < rank and self._keeps_border(left, right):
                self.halves[rank] = (left, right)
                self.merged[left, right] = rank
                return
            left = self.shorter[left]
        self.halves[rank] = (rank, rank)

    def _keeps_border(self, left: int, right: int) -> bool:
        """Undo the merges on both sides of the border, latest first; the border holds if no earlier merge crosses it."""
        bound = 1 << 62
        halves, merged = self.halves, self.merged
        while True:
            crossing = merged.get((left, right))
            if crossing is not None and crossing < bound:
                return False
            whole_left, whole_right = halves[left][1] == left, halves[right][0] == right
            if whole_left and whole_right:
                return True
            if not whole_left and (left > right or whole_right):
                bound, left = left, halves[left][1]
            else:
                bound, right = right + 1, halves[right][0]

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._keeps_border(left, right)
        return known

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        n, vocab, shorter = len(piece), self.vocab, self.shorter
        longest: list[int | None] = [None] * n
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # matches come by their end, so the longest from each start stays
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else None
        while at < n:
            if token is not None:
                end = at + len(vocab[token])
                if alive[end] and (not out or self.fits(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else None
                    continue
                token = shorter[token]
                if token is not None:
                    continue
            if not out:
                raise ValueError("the vocabulary lacks a single byte of this text")
            alive[at] = 0
            last = out.pop()
            at -= len(vocab[last])
            token = last  # its end is dead now, so a shorter one follows
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        known, parts = self.pieces, []
        for piece in self.find(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= MEMO_PIECES:
                    known.clear()
                ids = self.encode_bytes(piece.encode())
                if len(piece) <= 64:
                    known[piece] = ids
            parts.append(ids)
        return list(chain.from_iterable(parts))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))

    def digits(self, ids: list[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.text_of.__getitem__, ids))


_READY: dict[tuple[str, str], Encoder] = {}


def _encoder(data: bytes, key: str, pattern: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (key, pattern) not in _READY:
        _READY[key, pattern] = Encoder(parse_ranks(data), pattern)
    return _READY[key, pattern]


def _ranks(df: DataFrame, path: str) -> tuple[Broadcast, str]:
    with open(path, "rb") as f:
        data = f.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is no vocabulary: over {MAX_RANK_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, ids (array of int) and decoded (binary, made from the ids) of each row; row by row, without a shuffle."""
    data, key = _ranks(docs, path)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value, key, pattern)
        for b in pieces(batches):
            ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([enc.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])

    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id)


def digest_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id``, n_tokens, ids_sha256 and decoded_sha256 of each row.

    The same encoder and decoder as :func:`encode_documents`; the digests are taken in the worker, so that neither the
    ids nor the decoded bytes travel back to the JVM.
    """
    data, key = _ranks(docs, path)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sha = _encoder(data.value, key, pattern), hashlib.sha256
        for b in pieces(batches):
            n, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                ids = enc.encode(t or "")
                n.append(len(ids))
                of_ids.append(sha(enc.digits(ids).encode()).hexdigest())
                of_text.append(sha(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)
