"""Blocks of vectors that lie together, and bounds that say which rows can have a near neighbour in which block.

A vector is seen through a few principal axes and the length of what they leave out. These numbers form a unit vector
too, and two of them are never farther apart than the vectors that they stand for. So the distance from a row to a block's
box, the range of each number over the block's rows, is a lower bound of its distance to any row there. The axes are
fitted on a bounded sample; they decide how much is pruned, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.ordered import meet
from memspark.session import materialize

#: Vectors on which the axes are fitted.
SAMPLE = 2048
#: Principal axes; a vector of 1024 doubles is seen as this many floats and one.
AXES = 48
#: Most leaves of the tree that cuts the space; a leaf with more rows than a block is sliced further.
LEAVES = 256
#: Slices of a leaf; beyond them blocks are cut by hash.
SLICES = 64
#: Rows whose distances to all boxes of their scope are taken in one task.
ROUTE_ROWS = 1 << 16
#: More than the numbers' rounding can make of a squared distance.
SLACK = 1e-5


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of unit length; a zero row stays zero."""
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


@dataclass(frozen=True)
class Space:
    """Axes (as columns), and a complete binary tree over what they show: each node's axis and cut, each leaf's widest axis."""

    axes: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    widest: np.ndarray

    def place(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the axes show of unit vectors, and their leaves."""
        x = m @ (self.axes if len(self.axes) else np.zeros((m.shape[1], 0)))  # no axes were found in an empty sample
        x = np.concatenate([x, np.sqrt(np.maximum(0.0, (m * m).sum(axis=1) - (x * x).sum(axis=1)))[:, None]], axis=1)
        node = np.zeros(len(x), dtype=np.int64)
        while len(self.axis) and node.min(initial=len(self.axis)) < len(self.axis):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.cut[node])
        return x.astype(np.float32), node - len(self.axis)


def fit(sample: np.ndarray, leaves: int) -> Space:
    """The principal axes of unit vectors, and a tree of about ``leaves`` leaves cut at medians of the widest axis."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    axes = vectors[:, np.argsort(-values)[:AXES]]
    depth = max(0, min(int(np.ceil(np.log2(max(1, leaves)))), int(np.log2(max(1, len(sample) // 8)))))
    groups, axis, cut = [Space(axes, *[np.zeros(0, np.int64)] * 3).place(sample)[0]], [], []

    def wide(g: np.ndarray) -> int:
        return int(g.var(axis=0).argmax()) if len(g) else 0

    for _ in range(2**depth - 1):
        g = groups.pop(0)
        k = wide(g)
        c = float(np.median(g[:, k])) if len(g) else 0.0
        groups += [g[g[:, k] <= c], g[g[:, k] > c]]
        axis.append(k)
        cut.append(c)
    return Space(axes, np.array(axis, np.int64), np.array(cut), np.array([wide(g) for g in groups], np.int64))


def sampled(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``SAMPLE`` unit vectors of the ``n`` ``rows`` (_row, embedding), by a hash."""
    some = rows.filter(F.pmod(F.xxhash64("_row"), F.lit(n)) < 2 * SAMPLE).limit(SAMPLE).select("embedding").toPandas().dropna()
    return unit(np.stack(some["embedding"].to_numpy()).astype(np.float64)) if len(some) else np.zeros((0, 0))


def blocked(rows: DataFrame, n: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Per row of ``rows`` (_row, _scope, _t, embedding; ``n`` rows) its _x and _block; per block its box.

    Rows with a null or zero vector leave. A block holds about ``block_rows`` rows of one scope that lie together, a scope of fewer rows is one block.
    """
    space = rows.sparkSession.sparkContext.broadcast(fit(sampled(rows, n), min(LEAVES, -(-n // block_rows))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.is_valid(b.column(3)))
            m = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            live = m.any(axis=1)
            if not live.any():
                continue
            b, m = b.filter(pa.array(live)), m[live]
            x, leaf = space.value.place(unit(m))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            slide = x[np.arange(len(x)), space.value.widest[leaf]]
            columns = [*b.columns[:3], lists, pa.array(leaf), pa.array(slide)]
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "_scope", "_t", "_x", "_leaf", "_c"])

    kind = rows.schema["_row"].dataType.simpleString()
    seen = rows.select("_row", "_scope", "_t", "embedding").mapInArrow(place, f"_row {kind}, _scope string, _t long, _x array<float>, _leaf long, _c float")
    seen = materialize(seen)
    sizes = seen.groupBy("_scope").agg(F.count("*").alias("_n"))
    seen = meet(seen, sizes, ["_scope"], F.col("_row")).withColumn("_leaf", F.when(F.col("_n") > block_rows, F.col("_leaf")).otherwise(0))
    places = [i / SLICES for i in range(1, SLICES)]
    leaves = seen.groupBy("_scope", "_leaf").agg(F.count("*").alias("_m"), F.percentile_approx("_c", places, 1000).alias("_cuts"))
    seen = meet(seen, leaves, ["_scope", "_leaf"], F.col("_row"))
    parts = F.least(F.lit(SLICES), F.ceil(F.col("_m") / block_rows))
    passed = F.size(F.filter("_cuts", lambda c: c < F.col("_c")))
    seen = seen.withColumn("_slice", F.floor(passed * parts / SLICES).cast("long")).select("_row", "_scope", "_t", "_x", "_leaf", "_slice")
    # Equal numbers may fill a slice beyond its size; it is cut by hash.
    full = seen.groupBy("_scope", "_leaf", "_slice").agg(F.count("*").alias("_k"))
    seen = meet(seen, full, ["_scope", "_leaf", "_slice"], F.col("_row"))
    sub = F.pmod(F.xxhash64("_row"), F.ceil(F.col("_k") / block_rows))
    block = (F.col("_leaf") * SLICES + F.col("_slice")) * (1 << 32) + sub
    seen = materialize(seen.select("_row", "_scope", "_t", "_x", block.cast("long").alias("_block")))
    width = space.value.axes.shape[1] + 1
    ends = [F.array(*[f(F.col("_x")[i]) for i in range(width)]).alias(name) for f, name in ((F.min, "_lo"), (F.max, "_hi"))]
    boxes = seen.groupBy("_scope", "_block").agg(*ends, F.min("_t").alias("_first"))
    return seen, materialize(boxes)


def routes(seen: DataFrame, boxes: DataFrame, earlier: bool) -> DataFrame:
    """(_row, _scope, _target): the other blocks of its scope in which a row may have a neighbour of similarity ``_least`` or more.

    ``seen`` has _row, _scope, _t, _x, _block and _least. With ``earlier``, a block must have a row that isn't later.
    Rows meet boxes, never rows; a scope's boxes are repeated for each ``ROUTE_ROWS`` of its rows.
    """
    sizes = materialize(seen.groupBy("_scope").agg(F.ceil(F.count("*") / ROUTE_ROWS).cast("int").alias("_parts")))
    left = meet(seen, sizes, ["_scope"], F.col("_row")).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")).drop("_parts")
    right = meet(boxes, sizes, ["_scope"], F.col("_block")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    # New names for the columns, or the two sides cannot be told apart.
    names = {"_scope": "_scope", "_salt": "_salt", "_block": "_target", "_lo": "_lo", "_hi": "_hi", "_first": "_first"}
    right = right.select(*[F.col(c).alias(name) for c, name in names.items()])

    def route(rows: pd.DataFrame, boxes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(boxes) > 1:
            x, lo, hi = (np.stack(c.to_numpy()) for c in (rows["_x"], boxes["_lo"], boxes["_hi"]))
            target, first = boxes["_target"].to_numpy(), boxes["_first"].to_numpy()
            own, least, t = rows["_block"].to_numpy(), rows["_least"].to_numpy(), rows["_t"].to_numpy()
            step = max(1, (1 << 20) // len(boxes))
            for i in range(0, len(x), step):
                part = slice(i, i + step)
                apart = np.zeros((len(x[part]), len(boxes)))
                for k in range(x.shape[1]):
                    v = x[part, k, None]
                    apart += np.maximum(0, np.maximum(lo[None, :, k] - v, v - hi[None, :, k])) ** 2
                ok = (apart <= 2 - 2 * least[part, None] + SLACK) & (target[None, :] != own[part, None])
                if earlier:
                    ok &= first[None, :] <= t[part, None]
                a, b = np.nonzero(ok)
                out.append(pd.DataFrame({"_row": rows["_row"].to_numpy()[part][a], "_scope": rows["_scope"].to_numpy()[part][a], "_target": target[b]}))
        return pd.concat(out) if out else pd.DataFrame({"_row": np.zeros(0, np.int64), "_scope": pd.Series([], dtype=object), "_target": np.zeros(0, np.int64)})

    return left.groupBy("_scope", "_salt").cogroup(right.groupBy("_scope", "_salt")).applyInPandas(route, "_row long, _scope string, _target long")
