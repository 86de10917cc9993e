"""Exact inner-product search with a bit-sliced index: slices are added as bitmaps, the boundary is settled exactly."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a block of the index, and queries that meet a block together.
INDEX_ROWS, QUERY_ROWS = 16_384, 1_024
#: Slices of an attribute that are indexed: its highest bits. The bits below them widen the boundary.
SLICES = 6
#: Scaled components are cut to this size, so that sums of products have 38 digits at most.
LARGEST = float(1 << 57)
#: Bits of a query's weight that are multiplied; the rest widens the boundary too.
WEIGHT_BITS = 7


class SlicedIndex:
    """Attributes of a block of rows as bitmaps, one for each of the highest ``SLICES`` bits, and their complements.

    With x = low + (h << shift) + r, 0 <= r < 1 << shift, slice j of an attribute holds bit j of h for every row, 64 rows to
    a word.
    """

    def __init__(self, values: np.ndarray):
        self.values, self.rows = values, len(values)
        self.low = values.min(axis=0)
        self.span = values.max(axis=0) - self.low
        self.shift = np.array([max(0, int(s).bit_length() - SLICES) for s in self.span], dtype=np.int64)
        high = (values - self.low) >> self.shift
        words = -(-self.rows // 64)
        self.valid = self._bitmap(np.ones(self.rows, dtype=bool), words)
        self.slices = [np.stack([self._bitmap((high[:, d] >> j) & 1, words) for j in range(max(1, int(self.span[d] >> self.shift[d]).bit_length()))]) for d in range(values.shape[1])]
        self.top = np.array([(1 << len(s)) - 1 for s in self.slices], dtype=np.int64)

    @staticmethod
    def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
        packed = np.zeros(words * 8, dtype=np.uint8)
        raw = np.packbits(bits.astype(np.uint8), bitorder="little")
        packed[: len(raw)] = raw
        return packed.view(np.uint64)

    def _add(self, query: np.ndarray) -> tuple[list[np.ndarray], float]:
        """(Slices of an approximate score in units, lowest first; how much the exact score can gain on it, most less least).

        The score is sum q * x. A positive weight adds its attribute's h, a negative one adds the complement, so that all
        terms add up. Weights are cut to ``WEIGHT_BITS`` bits; what the cuts leave out is bounded by the attribute's span.
        """
        size = np.abs(query.astype(np.float64)) * np.exp2(self.shift)
        unit = max(1.0, size.max(initial=0.0) / (1 << WEIGHT_BITS))
        weight = np.rint(size / unit).astype(np.int64)
        columns: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(weight):
            own = self.slices[d] if query[d] > 0 else self.slices[d] ^ np.uint64(0xFFFFFFFFFFFFFFFF)
            for j in range(int(weight[d]).bit_length()):
                if weight[d] >> j & 1:
                    for k in range(len(own)):
                        columns.setdefault(j + k, []).append(own[k])
        # In units, the exact score has more: |q| r, from 0 to |q| ((1 << shift) - 1), and the cut of the weight for each h.
        off = float((np.abs(query) * (np.exp2(self.shift) - 1)).sum() / unit + (np.abs(size / unit - weight) * self.top).sum()) * (1 + 1e-9)
        sums, at = [], 0
        stacks = {w: np.stack(v) for w, v in columns.items()}
        while stacks:
            if at not in stacks:
                sums.append(np.zeros_like(self.valid))
                at += 1
                continue
            rows = stacks.pop(at)
            while len(rows) > 1:  # three of a weight become one of it and one of the next, all threes at once
                n = len(rows) // 3 * 3 if len(rows) > 2 else 2
                a, b = rows[0:n:3] if n > 2 else rows[:1], rows[1:n:3] if n > 2 else rows[1:2]
                c = rows[2:n:3] if n > 2 else None
                half = a ^ b
                carry = a & b if c is None else (a & b) | (half & c)
                rows = np.concatenate([half if c is None else half ^ c, rows[n:]])
                stacks[at + 1] = np.concatenate([stacks[at + 1], carry]) if at + 1 in stacks else carry
            sums.append(rows[0])
            at += 1
        return sums, off

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the ``k`` best, the boundary included; found from the highest slice downward."""
        if self.rows <= k:
            return np.arange(self.rows)
        sums, off = self._add(query)
        # The k-th highest approximate score, bit by bit: ``sure`` rows are above it, ``open`` ones may be.
        sure, still, kth, found = np.zeros_like(self.valid), self.valid, 0, 0
        for j in range(len(sums) - 1, -1, -1):
            with_bit = still & sums[j]
            n = int(np.bitwise_count(with_bit).sum())
            if found + n >= k:
                still, kth = with_bit, kth | 1 << j
            else:
                sure, found = sure | with_bit, found + n
                still = still & ~sums[j]
        least = kth - int(np.ceil(off)) - 1
        return np.flatnonzero(np.unpackbits(self._at_least(sums, least).view(np.uint8), bitorder="little", count=self.rows))

    def _at_least(self, sums: list[np.ndarray], least: int) -> np.ndarray:
        if least <= 0:
            return self.valid
        if least >> len(sums):
            return np.zeros_like(self.valid)
        above, equal = np.zeros_like(self.valid), self.valid
        for j in range(len(sums) - 1, -1, -1):
            if least >> j & 1:
                equal = equal & sums[j]
            else:
                above = above | (equal & sums[j])
                equal = equal & ~sums[j]
        return above | equal

    def best(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(Scores, ids) of the ``k`` best rows but those of id ``own``, exactly; ties to the smaller id."""
        rows = self.candidates(query, k + int((ids == own).sum()))
        rows = rows[ids[rows] != own]
        score = exact_products(self.values[rows], query)
        order = np.lexsort((ids[rows], -score)) if score.dtype != object else sorted(range(len(rows)), key=lambda i: (-score[i], ids[rows[i]]))
        return score[order[:k]], ids[rows][order[:k]]


def exact_products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact, which is faster, in Python's integers where 64 bits are too few."""
    most = float(np.abs(values).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if most < 2**53:
        return (values.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return values @ query if most < 2**62 else values.astype(object) @ query.astype(object)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, scale: int = 256, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Per query (rows whose ``key`` is divisible by ``every``) its ``k`` best rows: query_id, rank, ``key``, score.

    Components become floor(``scale`` * x); the score is their integer inner product, ties go to the smaller ``key``; a
    query's own row (all rows of its ``key``) is none of its candidates; fewer rows are returned if there are fewer.

    Rows are dealt by a hash to blocks of about ``index_rows``, queries to blocks of about ``query_rows``; each pair of
    blocks is one group that builds the bit-sliced index of its rows and returns k rows for each of its queries.

    Rows with a null key, a null or empty vector, or a null or non-finite component take no part. Vectors are compared
    with those of the same length only. Repeated rows are candidates of their own; as queries equal rows are one, and
    different vectors of one ``key`` are answered together. Components of a size over 2^57 / ``scale`` are cut
    to it; a score beyond 64 bits ranks by its value and is returned as null. An empty table gives an empty one; other columns are not looked at.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
    rows = rows.filter(F.coalesce(usable, F.lit(False))).select("id", F.size("x").alias("dims"), whole.alias("x"))
    queries = rows.filter(F.col("id") % every == 0).dropDuplicates(["id", "x"])
    n, m = rows.count(), queries.count()
    blocks, query_blocks = max(1, round(n / index_rows)), max(1, -(-m // query_rows))
    # By id and place, so that a repeated id does not fill a block.
    spread = F.xxhash64(F.col("id"), F.monotonically_increasing_id())
    left = rows.withColumn("i", F.pmod(spread, F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("asks", F.lit(False))
    right = queries.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(True))
    both = left.select("dims", F.col("i").cast("long").alias("i"), "q", "asks", "id", "x").unionByName(right.select("dims", F.col("i").cast("long").alias("i"), "q", "asks", "id", "x"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(dtype=bool)
        ids = pdf["id"].to_numpy(dtype=np.int64)
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": object})
        values = np.stack(pdf["x"].to_numpy()).astype(np.int64)
        index, own = SlicedIndex(values[~asks]), ids[~asks]
        made = []
        for query, qid in zip(values[asks], ids[asks], strict=True):
            score, found = index.best(query, own, qid, k)
            made.append((np.full(len(found), qid), found, np.array([Decimal(int(s)) for s in score], dtype=object)))
        return pd.DataFrame(dict(zip(("query_id", "id", "score"), map(np.concatenate, zip(*made, strict=True)), strict=True)))

    found = both.groupBy("dims", "i", "q").applyInPandas(search, "query_id long, id long, score decimal(38,0)")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), F.expr("try_cast(score AS long)").alias("score"))
