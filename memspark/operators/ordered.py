"""Row numbers, previous rows and running sums over long ordered groups.

A plain window sends each group to one task. Here the rows are range-partitioned on (keys, order), so
that one large group spreads over many partitions; the parts are joined up through a table with one
row per (group, partition).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.session import materialize, small_enough

CHUNK = "_chunk"
POS = "_pos"


def range_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` range-partitioned and sorted on (keys, order), with ``_chunk`` (partition) and ``_pos``.

    ``_pos`` rises along the order inside each chunk. The frame is materialised: partition ids must not
    change between the reads that follow.
    """
    cols = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return materialize(spread.withColumn(CHUNK, F.spark_partition_id()).withColumn(POS, F.monotonically_increasing_id()))


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _join_chunks(rows: DataFrame, per_chunk: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with what its group's part in its chunk holds; rows with a null key are a group too."""
    facts = [c for c in per_chunk.columns if c not in (*keys, CHUNK)]
    own = per_chunk.select(*[F.col(k).alias(f"_own_{k}") for k in (*keys, CHUNK)], *facts)
    on = [F.col(k).eqNullSafe(F.col(f"_own_{k}")) for k in (*keys, CHUNK)]
    return rows.join(own, on).select(*keys, CHUNK, *[c for c in rows.columns if c not in (*keys, CHUNK)], *facts)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """1-based position of each row in its group. Equal to ``row_number()``; null keys are a group."""
    rows = range_chunks(df, keys, order)
    per_chunk = rows.groupBy(*keys, CHUNK).agg(F.min(POS).alias("_first"), F.count("*").alias("_n"))
    offsets = per_chunk.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    joined = _join_chunks(rows, offsets, keys)
    return joined.withColumn(name, F.col(POS) - F.col("_first") + F.col("_offset") + 1).drop(
        CHUNK, POS, "_first", "_offset"
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], previous: dict[str, str]
) -> DataFrame:
    """Add columns of the preceding row in the group: ``previous`` maps new name -> source column."""
    rows = range_chunks(df, keys, order)
    local = Window.partitionBy(*keys, CHUNK).orderBy(POS)
    packed = F.struct(*[F.col(src).alias(new) for new, src in previous.items()])
    last = rows.groupBy(*keys, CHUNK).agg(F.max_by(packed, F.col(POS)).alias("_last"))
    edge = last.withColumn("_edge", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK))).drop("_last")
    out = _join_chunks(rows.withColumn("_prev", F.lag(packed).over(local)), edge, keys)
    out = out.withColumn("_prev", F.coalesce("_prev", "_edge"))
    for new in previous:
        out = out.withColumn(new, F.col(f"_prev.{new}"))
    return out.drop("_prev", "_edge", CHUNK, POS)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str
) -> DataFrame:
    """Inclusive running sum of ``value`` along each group."""
    rows = range_chunks(df.withColumn("_value", value), keys, order)
    local = Window.partitionBy(*keys, CHUNK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(_before(keys)), F.lit(0))).drop("_total")
    out = _join_chunks(rows.withColumn("_here", F.sum("_value").over(local)), offsets, keys)
    return out.withColumn(name, F.col("_here") + F.col("_offset")).drop("_here", "_offset", "_value", CHUNK, POS)


# Lookup tables up to this many rows are broadcast (a few MB).
BROADCAST_ROWS = 100_000


def meet(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join on a key that may be hot in ``big``: the other side is broadcast if its counted size allows, else salted."""
    if small_enough(small, bound):
        return big.join(F.broadcast(small), list(on), how)
    return join_hot(big, small, on, spread, how=how)


def join_hot(big: DataFrame, small: DataFrame, on: Sequence[str], spread: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """Inner or left join where a key of ``big`` may hold a large share of its rows.

    ``small`` holds few rows per key. The rows of ``big`` are spread over ``salts`` sub-keys by the hash of
    ``spread`` and ``small`` is repeated once per sub-key, so no key lands in a single task.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def key_segments(pdf: pd.DataFrame, keys: Sequence[str]) -> list[tuple[int, int, str]]:
    """(start, end, key text) of the stretches with equal keys in a sorted batch."""
    if not keys:
        return [(0, len(pdf), "")]
    changes = np.zeros(len(pdf), dtype=bool)
    changes[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        changes[1:] |= v[1:] != v[:-1]
    at = np.flatnonzero(changes)
    ends = [*at[1:].tolist(), len(pdf)]
    return [(i, j, json.dumps([str(pdf[k].iat[i]) for k in keys])) for i, j in zip(at.tolist(), ends)]


Columns = dict[str, np.ndarray]


def chunked_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    fold: Callable[[Columns, str | None], tuple[Columns, str]],
    schema: str,
) -> DataFrame:
    """A sequential fold per key whose carried state is small, run over range chunks in parallel.

    ``fold(columns of rows in order, state) -> (output columns, state)``; the state is a string, None at the start of
    a key. Only the first key of a chunk can have begun earlier, so a chunk needs one state from its predecessor: the
    driver holds one row per chunk. Chunks start from the state their predecessor ended with in the last pass, and
    only chunks whose start changed run again; when nothing changes the result is the sequential one. Folds that soon
    forget their start settle in two or three passes; at worst one pass per chunk is needed.
    """
    rows = range_chunks(df, keys, order)
    shared = rows.sparkSession.sparkContext

    def walk(starts: dict[int, str], emit: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        given = shared.broadcast(starts)

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chunk = first = key = state = None
            for pdf in batches:
                if pdf.empty:
                    continue
                arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
                outs = []
                for i, j, k in key_segments(pdf, keys):
                    if chunk is None:
                        chunk, first, key = int(pdf[CHUNK].iat[0]), k, k
                        state = given.value.get(chunk)
                    elif k != key:
                        key, state = k, None
                    out, state = fold({c: a[i:j] for c, a in arrays.items()}, state)
                    outs.append(out)
                if emit:
                    yield pd.DataFrame({c: np.concatenate([o[c] for o in outs]) for c in outs[0]})
            if not emit and chunk is not None:
                yield pd.DataFrame({"chunk": [chunk], "first": [first], "last": [key], "state": [state]})

        return go

    starts: dict[int, str] = {}
    if rows.rdd.getNumPartitions() > 1:
        ends: dict[int, tuple[str, str, str]] = {}
        todo = rows
        while True:
            ran = todo.mapInPandas(walk(starts, False), "chunk int, first string, last string, state string")
            for r in ran.collect():  # one row per chunk
                ends[r["chunk"]] = (r["first"], r["last"], r["state"])
            new: dict[int, str] = {}
            before = None
            for c in sorted(ends):
                if before is not None and ends[before][1] == ends[c][0]:
                    new[c] = ends[before][2]
                before = c
            changed = [c for c in ends if new.get(c) != starts.get(c)]
            starts = new
            if not changed:
                break
            todo = rows.filter(F.col(CHUNK).isin(changed))
    return rows.mapInPandas(walk(starts, True), schema)


def leading_edge(df: DataFrame, keys: Sequence[str], id_col: str, ts: str, interval: int) -> DataFrame:
    """Throttle: an event passes when at least ``interval`` has gone by since the last one that passed.

    ``ts`` is an integer time. Gives the keys, id and time with accepted and previous (time of the last accepted event
    before this one).
    """

    def fold(cols: Columns, state: str | None) -> tuple[Columns, str]:
        times = cols[ts].astype(np.int64)
        accepted = np.zeros(len(times), dtype=bool)
        start = int(state) if state is not None else None
        last = start
        i = 0 if last is None else int(np.searchsorted(times, last + interval))
        while i < len(times):
            accepted[i] = True
            last = int(times[i])
            i = int(np.searchsorted(times, last + interval))
        # Index of the latest accepted event strictly before each event.
        seen = np.maximum.accumulate(np.where(accepted, np.arange(len(times)), -1))
        seen = np.concatenate([[-1], seen[:-1]])
        none = np.nan if start is None else float(start)
        previous = np.where(seen >= 0, times[seen].astype(float), none)
        out = {c: cols[c] for c in (*keys, id_col, ts)}
        return {**out, "accepted": accepted, "previous": previous}, str(last)

    kinds = dict(df.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, id_col, ts))
    slim = df.select(*keys, id_col, ts)
    return chunked_fold(slim, keys, [ts, id_col], fold, f"{head}, accepted boolean, previous double")
