"""Join of two geometry columns by a partition of the plane.

A sample of both sides' boxes, bounded on the driver, gives a quad-tree whose leaves hold about as many boxes each; leaves at the
rim reach to infinity. A row goes to every leaf that its box touches, rows meet on equal leaves, and of the leaves that a pair
has in common only the one with the pair's reference point, the lower left corner of what both boxes share, keeps it, so no
pair comes twice. What meets are the different geometries, not the rows: boxes and predicates are asked once for each pair of
geometries that differ, and Spark joins the rows of both sides to the pairs that hold, the smaller side first. Rows of a geometry
that very many rows have are dealt to parts in these joins, the other side is repeated for each part. Leaves that cannot be split further, as very many boxes lie at one place,
are cut by salt: the side with more rows there is dealt to parts, the other one is repeated for each part.

The sample decides where rows meet, never which rows do: the result is the same for every sample. What is broadcast is the
tree, of at most ``SAMPLE`` times a few nodes. The exact predicate is asked last, of pairs whose boxes meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.geometry import UDF_BOX, UDF_PREDICATES

#: Boxes of each side that the driver gets, and how many of them a leaf may have before it is split.
SAMPLE, LEAF = 8192, 64

#: Splits of the plane at most, one above the other; rows of one side that a part of a hot leaf should have.
DEPTH, HOT = 24, 50_000

CELL_TYPE = T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("leaf", T.IntegerType()), ("x0", T.DoubleType()), ("y0", T.DoubleType()), ("x1", T.DoubleType()), ("y1", T.DoubleType()))]))
_ARROW_CELL = pa.struct([("leaf", pa.int32()), *((n, pa.float64()) for n in ("x0", "y0", "x1", "y1"))])

#: Predicates that hold only for geometries whose boxes meet.
MEETING = ("intersects", "contains", "covers", "within", "touches", "crosses", "overlaps")


@dataclass
class Tree:
    """Nodes: rectangle, first of four children (-1: a leaf), number of the leaf (-1: none), and how salt cuts the leaf."""

    box: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    #: By leaf: parts that the left and the right side are dealt to; one of both is 1.
    left_parts: np.ndarray
    right_parts: np.ndarray

    def touched(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``boxes`` (minX, maxX, minY, maxY) and the leaves' nodes that they touch, by row."""
        row, node = np.arange(len(boxes)), np.zeros(len(boxes), np.int64)
        rows, nodes = [], []
        while len(row):
            b, t = boxes[row], self.box[node]
            meets = (b[:, 0] < t[:, 2]) & (b[:, 1] >= t[:, 0]) & (b[:, 2] < t[:, 3]) & (b[:, 3] >= t[:, 1])
            row, node = row[meets], node[meets]
            end = self.child[node] < 0
            rows.append(row[end])
            nodes.append(node[end])
            row, node = np.repeat(row[~end], 4), (self.child[node[~end]][:, None] + np.arange(4)).ravel()
        row, node = np.concatenate([*rows, np.empty(0, np.int64)]), np.concatenate([*nodes, np.empty(0, np.int64)])
        order = np.argsort(row, kind="stable")
        return row[order].astype(np.int64), node[order].astype(np.int64)


def grow(left: np.ndarray, right: np.ndarray, n_left: float, n_right: float) -> Tree:
    """A tree for samples of boxes that stand for so many rows."""
    both = np.concatenate([left, right])
    x, y = both[:, :2].sum(axis=1) / 2, both[:, 2:].sum(axis=1) / 2
    of_left = np.arange(len(both)) < len(left)
    finite = lambda v, f, d: float(f(v)) if len(v) else d
    x0, x1, y0, y1 = finite(x, np.min, 0.0), finite(x, np.max, 1.0), finite(y, np.min, 0.0), finite(y, np.max, 1.0)
    box, child, leaf = [(-math.inf, -math.inf, math.inf, math.inf)], [-1], [-1]
    shares: list[tuple[float, float]] = []
    todo = [(0, (x0, y0, x1, y1), np.arange(len(both)), 0)]
    while todo:
        node, (a, b, c, d), own, depth = todo.pop()
        mx, my = (a + c) / 2, (b + d) / 2
        if len(own) > LEAF and depth < DEPTH and a < mx < c and b < my < d:
            child[node] = len(box)
            o = box[node]
            right_half, upper = x[own] >= mx, y[own] >= my
            for k in range(4):
                east, north = k & 1, k >> 1
                box.append((mx if east else o[0], my if north else o[1], o[2] if east else mx, o[3] if north else my))
                child.append(-1)
                leaf.append(-1)
                inner = (mx if east else a, my if north else b, c if east else mx, d if north else my)
                todo.append((child[node] + k, inner, own[(right_half == east) & (upper == north)], depth + 1))
        else:
            leaf[node] = len(shares)
            l = int(of_left[own].sum())
            shares.append((l * n_left / max(len(left), 1), (len(own) - l) * n_right / max(len(right), 1)))
    share = np.array(shares)
    parts = np.maximum(np.ceil(share / HOT), 1).astype(np.int64)
    more = share[:, 0] >= share[:, 1]
    return Tree(np.array(box), np.array(child), np.array(leaf), np.where(more, parts[:, 0], 1), np.where(more, 1, parts[:, 1]))


@dataclass
class Sample:
    """Boxes of different geometries, rows and different geometries that they stand for, and parts of geometries (hash) with very many rows."""

    boxes: np.ndarray
    rows: float
    different: float
    parts: dict[int, int]


def _sampled(df: DataFrame, geometry: str) -> Sample:
    """From at most ``SAMPLE`` rows with a box: the smallest of random numbers, one for each row."""
    boxes = df.select(UDF_BOX(df[geometry]).alias("_box"), F.xxhash64(df[geometry]).alias("h"))
    rows = boxes.select("_box.*", "h", F.rand(7).alias("r")).where("minX is not null").orderBy("r").limit(SAMPLE).collect()
    found = np.array([r[:4] for r in rows], float).reshape(-1, 4)
    number = len(rows) / rows[-1]["r"] if len(rows) == SAMPLE else float(len(rows))
    _, first, times = np.unique(np.array([r["h"] for r in rows], np.int64), return_index=True, return_counts=True)
    each = number / max(len(rows), 1)
    parts = {rows[i]["h"]: math.ceil(t * each / HOT) for i, t in zip(first.tolist(), times.tolist()) if t * each > HOT and t > 1}
    found = found[first]
    return Sample(found[np.isfinite(found).all(axis=1)], number, each * len(first), parts)


def _cells(tree, left: bool):
    """The leaves of a box, with their parts as further leaf numbers; on the left with the leaves' rectangles."""

    @F.arrow_udf(CELL_TYPE)
    def run(box: pa.Array, salt: pa.Array) -> pa.Array:
        t: Tree = tree.value
        boxes = np.column_stack([box.field(k).to_numpy(zero_copy_only=False) for k in range(4)]).astype(float)
        boxes[~box.is_valid().to_numpy(zero_copy_only=False)] = np.nan  # meets nothing
        row, node = t.touched(boxes)
        leaf = t.leaf[node]
        first = np.concatenate(([0], np.cumsum(t.left_parts * t.right_parts)))
        own, other = (t.left_parts, t.right_parts) if left else (t.right_parts, t.left_parts)
        dealt = salt.to_numpy(zero_copy_only=False)[row] % own[leaf]
        times = other[leaf]  # one of both is 1: a side is dealt or repeated
        i = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        number = first[leaf[i]] + dealt[i] + nth
        count = np.bincount(row[i], minlength=len(boxes))
        rect = t.box[node[i]]
        cells = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), *(pa.array(rect[:, k].copy()) for k in range(4))], fields=list(_ARROW_CELL))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), cells)

    return run


def _unused(name: str, *frames: DataFrame) -> str:
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def geometry_join(left: DataFrame, right: DataFrame, left_geometry: str, right_geometry: str, predicate: str = "intersects") -> DataFrame:
    """Pairs of rows for whose geometries (WKB) ``predicate(left, right)`` holds, with all columns of both sides.

    ``predicate`` is one of ``MEETING``. Rows with a null or empty geometry or with coordinates that are no numbers join nothing;
    repeated rows join each on their own (rows that are equal in all columns share one part of a hot leaf); columns of the same name stay apart only by their frames, as in Spark's joins.
    """
    if predicate not in MEETING:
        raise ValueError(f"no join by {predicate}: one of {', '.join(MEETING)}")
    sample_a, sample_b = _sampled(left, left_geometry), _sampled(right, right_geometry)
    key_a, key_b, part_a, part_b, pair_a, pair_b, pair_part = (_unused(n, left, right) for n in ("_left_geometry", "_right_geometry", "_left_part", "_right_part", "_left_pair", "_right_pair", "_pair_part"))
    pairs = _pairs(left.select(left[left_geometry].alias(pair_a)), right.select(right[right_geometry].alias(pair_b)), sample_a, sample_b, pair_a, pair_b, predicate)
    spark = left.sparkSession

    def with_part(df: DataFrame, g: str, key: str, part: str, parts: dict[int, int]) -> DataFrame:
        """All rows, with their geometry as a key and the part of it that they are dealt to."""
        salt = F.pmod(F.xxhash64(*[df[c] for c in df.columns if _hashable(df.schema[c].dataType)]), F.lit(1 << 30))
        own = df.select("*", df[g].alias(key), salt.alias(part)) if parts else df.select("*", df[g].alias(key), F.lit(0).alias(part))
        return _dealt(own, key, part, lambda n: F.pmod(F.col(part), n).cast("int"), spark, parts).where(F.col(key).isNotNull())

    def with_parts(df: DataFrame, key: str, parts: dict[int, int]) -> DataFrame:
        return _dealt(df.withColumn(pair_part, F.lit(0)), key, pair_part, lambda n: F.explode(F.sequence(F.lit(0), n - 1)), spark, parts)

    a = with_part(left, left_geometry, key_a, part_a, sample_a.parts)
    b = with_part(right, right_geometry, key_b, part_b, sample_b.parts)
    on_a = (F.col(key_a) == F.col(pair_a)) & (F.col(part_a) == F.col(pair_part))
    on_b = (F.col(key_b) == F.col(pair_b)) & (F.col(part_b) == F.col(pair_part))
    own = (key_a, key_b, part_a, part_b, pair_a, pair_b, pair_part)
    if sample_a.rows <= sample_b.rows:
        some = a.join(with_parts(pairs, pair_a, sample_a.parts), on_a).drop(key_a, part_a, pair_a, pair_part)
        return with_parts(some, pair_b, sample_b.parts).join(b, on_b).drop(*own)
    some = with_parts(pairs, pair_b, sample_b.parts).join(b, on_b).drop(key_b, part_b, pair_b, pair_part)
    return a.join(with_parts(some, pair_a, sample_a.parts), on_a).drop(*own)


def _dealt(df: DataFrame, key: str, part: str, value, spark, parts: dict[int, int]) -> DataFrame:
    """``part`` made by ``value(number of parts)`` of the key; where no key has parts the rows are as they come."""
    if not parts:
        return df
    hash, number = _unused("_hash", df), _unused("_parts", df)
    table = F.broadcast(spark.createDataFrame(sorted(parts.items()), f"{hash} long, {number} int"))
    found = df.join(table, F.xxhash64(F.col(key)) == F.col(hash), "left")
    return found.withColumn(part, value(F.coalesce(F.col(number), F.lit(1)))).drop(hash, number)


def _pairs(left: DataFrame, right: DataFrame, sample_a: Sample, sample_b: Sample, geometry_a: str, geometry_b: str, predicate: str) -> DataFrame:
    """The different geometries of both sides (one column each) for which the predicate holds, each pair once."""
    tree = left.sparkSession.sparkContext.broadcast(grow(sample_a.boxes, sample_b.boxes, sample_a.different, sample_b.different))

    def placed(df: DataFrame, g: str, box: str, cell: str, is_left: bool) -> DataFrame:
        with_box = df.where(F.col(g).isNotNull()).distinct().withColumn(box, UDF_BOX(F.col(g))).where(F.col(box).isNotNull())
        return with_box.withColumn(cell, F.explode(_cells(tree, is_left)(F.col(box), F.pmod(F.xxhash64(g), F.lit(1 << 30)))))

    a, b = placed(left, geometry_a, "_box_a", "_cell_a", True), placed(right, geometry_b, "_box_b", "_cell_b", False)
    p, q, c = F.col("_box_a"), F.col("_box_b"), F.col("_cell_a")
    x, y = F.greatest(p["minX"], q["minX"]), F.greatest(p["minY"], q["minY"])
    meet = (p["minX"] <= q["maxX"]) & (q["minX"] <= p["maxX"]) & (p["minY"] <= q["maxY"]) & (q["minY"] <= p["maxY"])
    here = (x >= c["x0"]) & (x < c["x1"]) & (y >= c["y0"]) & (y < c["y1"])
    pairs = a.join(b, (c["leaf"] == F.col("_cell_b")["leaf"]) & meet & here)
    return pairs.where(UDF_PREDICATES[predicate](F.col(geometry_a), F.col(geometry_b))).select(geometry_a, geometry_b)


def _hashable(kind: T.DataType) -> bool:
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()

