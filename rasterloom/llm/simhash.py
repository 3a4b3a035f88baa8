"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A fingerprint has one bit for each bit that over half of the shingle hashes set. Two fingerprints that differ in at
most ``d`` bits, cut in ``b`` blocks, agree in ``b - d`` whole blocks at least; so each fingerprint is dealt to one
bucket for every choice of ``b - d`` blocks, and only fingerprints that meet in a bucket are compared. With six blocks
and three bits a bucket's key has 31 to 33 bits, which keeps chance meetings rare for billions of fingerprints.

Equal fingerprints are one node from the start. Inside a bucket not all close pairs are emitted, but links that span
them (at most one a member), which leaves the components as they are. Buckets above ``TILE`` members are dealt to
pairs of tiles, so no task holds more than two tiles of one bucket, and every two members still meet.

Null or empty texts have the fingerprint zero and are linked like any other; null ids never become a component's
id unless all ids of it are null; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.graph import components
from rasterloom.llm.rows import pieces, row_key, unused
from rasterloom.runtime import checkpoint

SEED, WIDTH = 42, 3
BLOCKS, DISTANCE = 6, 3
#: Members of a bucket that are compared at once.
TILE = 2048


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, as a signed number."""
    words = (text or "").encode().lower().split()  # bytes: ASCII only, both for case and for white space
    if not words:
        return 0
    if len(words) <= WIDTH:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -WIDTH])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[WIDTH - 1 :] - 1).tolist())]
    total = np.zeros(64, np.int64)
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        total += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > len(raw), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``id, fp`` of each row."""
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())], ["id", "fp"])

    return docs.select(docs[id], docs[text]).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For each choice of ``blocks - distance`` blocks the mask of their bits, as signed numbers."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << j for j in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _spanning(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by links of at most ``distance`` bits among these."""
    rest, out = fps, []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count((rest ^ at).view(np.uint64)) <= distance  # signed numbers would count their magnitude
            if near.any():
                found = rest[near]
                out += [(int(at), int(x)) for x in found]
                front += list(found)
                rest = rest[~near]
    return out


def near_links(nodes: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` of ``nodes`` that span all pairs within ``distance`` bits."""
    masks = block_masks(blocks, distance)
    dealt = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("c", "m"))
    sizes = dealt.groupBy("c", "m").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    met = dealt.join(sizes, ["c", "m"]).withColumn("s", tiles).withColumn("t", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    pairs = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    keyed = pairs.select("c", "m", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "fp")
    keyed = keyed.repartition("c", "m", "i", "j").sortWithinPartitions("c", "m", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            out = [x for group in np.split(rows[:, 4], change) if len(group) > 1 for x in _spanning(group, distance)]
            a, b = (list(x) for x in zip(*out)) if out else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            if not len(rows):
                continue
            held.append(rows)
            if (rows[0, :4] == rows[-1, :4]).all() and (held[0][0, :4] == rows[-1, :4]).all():
                continue  # one group so far; it has two tiles at most
            rows = np.concatenate(held)
            last = int(np.argmax((rows[:, :4] == rows[-1, :4]).all(axis=1)))
            yield links(rows[:last])
            held = [rows[last:]]
        if held:
            yield links(np.concatenate(held))

    return keyed.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", blocks: int = BLOCKS, distance: int = DISTANCE, tile: int = TILE) -> DataFrame:
    """``id, fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable) of each row."""
    marked = _with_components(checkpoint(fingerprints(docs, text, id)), id, blocks, distance, tile)
    return marked.select(id, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(marked: DataFrame, id: str, blocks: int, distance: int, tile: int) -> DataFrame:
    nodes = checkpoint(marked.groupBy("fp").agg(F.min(id).alias("first")))
    roots = components(near_links(nodes, blocks, distance, tile))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(placed.join(ids, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the least id stays, once.

    Null ids come last. Rows are told apart by id and text; only where such rows repeat are they compared with each other.
    """
    who = F.struct(docs[id].isNull().alias("last"), docs[id].alias("id"), row_key(docs, id, text).alias("key"))
    marked = checkpoint(fingerprints(docs.select(who.alias("who"), docs[text].alias("text")), "text", "who"))
    kept = _with_components(marked, "who", BLOCKS, DISTANCE, TILE).select(F.col("component_id.key").alias("_kept")).distinct()
    name = unused(docs, "_key")
    out = docs.withColumn(name, row_key(docs, id, text)).join(kept, F.col(name) == F.col("_kept"), "left_semi")
    again = checkpoint(marked.groupBy("who.key").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_again")))
    if not again.isEmpty():
        once = out.join(again, F.col(name) == F.col("_again"), "left_semi").dropDuplicates([name])
        out = out.join(again, F.col(name) == F.col("_again"), "left_anti").unionByName(once)
    return out.select(*docs.columns)
