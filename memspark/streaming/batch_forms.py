"""Batch forms of the stream operators that need no custom state: bursts, sessions, throttled turns, run lengths."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators import filters as fl
from memspark.operators.ordered import chunked_fold, running_sum, with_previous


def bursts(events: DataFrame, keys: Sequence[str], id_col: str, ts: str, gap: int) -> DataFrame:
    """(keys, first_at, fire_at, events): events less than ``gap`` apart belong together; one run follows each burst.

    ``ts`` is an integer time. Works without keys as well: the order is spread over range partitions.
    """
    prev = with_previous(events.select(*keys, id_col, ts), keys, [ts, id_col], {"_before": ts})
    start = F.col("_before").isNull() | (F.col(ts) - F.col("_before") >= gap)
    numbered = running_sum(prev, keys, [ts, id_col], start.cast("int"), "_burst")
    return numbered.groupBy(*keys, "_burst").agg(
        F.min(ts).alias("first_at"), (F.max(ts) + gap).alias("fire_at"), F.count("*").alias("events")
    ).drop("_burst")


def session_buffer(entries: DataFrame, key: str, order: str, keep: int = 20, read: int = 10) -> DataFrame:
    """The last ``read`` of the ``keep`` newest entries per session, oldest first by ``place``."""
    last = fl.top_per_group(entries, [key], [F.col(order).desc()], min(keep, read), "_back")
    return last.withColumn("place", -F.col("_back")).drop("_back")


def take_turns(blocks: Iterable[str], failures: Iterable[bool], held: Sequence | None, every: int, limit: int | None = None) -> tuple[list, list, list | None]:
    """(text and refreshed of each turn, [text, age] held at the end) for the turns of one key in order."""
    held = list(held) if held else None
    texts, fresh = [], []
    for new, bad in zip(blocks, failures):
        refresh = held is None or held[1] >= every
        if not refresh:
            held[1] += 1
        elif not bad:
            held = [new[:limit], 0] if new else None
        texts.append(held[0] if held else None)
        fresh.append(refresh)
    return texts, fresh, held


def throttled_turns(turns: DataFrame, key: str, order: str, block: str, failed: str, every: int = 3, limit: int | None = None) -> DataFrame:
    """(key, order, text, refreshed): the context block that goes with each turn.

    A new block is taken when there is none or ``every`` turns have passed; an empty one clears it; after a failed request
    the old one stays and the next turn tries again. ``block`` is the text a request would give, ``failed`` whether it
    would fail.
    """

    def fold(cols: dict[str, np.ndarray], state: str | None):
        texts, fresh, held = take_turns(cols[block], cols[failed], json.loads(state) if state else None, every, limit)
        out = {c: cols[c] for c in (key, order)}
        return {**out, "text": np.array(texts, dtype=object), "refreshed": np.array(fresh, dtype=bool)}, json.dumps(held)

    kinds = dict(turns.dtypes)
    shape = f"{key} {kinds[key]}, {order} {kinds[order]}, text string, refreshed boolean"
    return chunked_fold(turns.select(key, order, block, failed), [key], [order], fold, shape)


def run_lengths(observations: DataFrame, keys: Sequence[str], id_col: str, ts: str, status: str, down_alert: int = 20,
                slow_alert: int = 40) -> DataFrame:
    """Each observation with the length of the run of equal status it stands in, and whether it raises the alert.

    A run alerts once, when it reaches its limit; ``up`` never does.
    """
    prev = with_previous(observations.select(*keys, id_col, ts, status), keys, [ts, id_col], {"_before": status})
    changed = ~F.col("_before").eqNullSafe(F.col(status))
    runs = running_sum(prev, keys, [ts, id_col], changed.cast("int"), "_run")
    counted = running_sum(runs.drop("_before"), [*keys, "_run"], [ts, id_col], F.lit(1), "consecutive")
    limit = F.when(F.col(status) == "down", down_alert).when(F.col(status) == "slow", slow_alert)
    return counted.withColumn("alert", F.coalesce(F.col("consecutive") == limit, F.lit(False)))


def probe_status(ok: Column, latency_ms: Column, slow_ms: float = 3000.0) -> Column:
    return F.when(~ok, "down").when(latency_ms > slow_ms, "slow").otherwise("up")


def last_event(events: DataFrame, keys: Sequence[str], ts: str, id_col: str) -> DataFrame:
    """The newest event per key."""
    rest = [c for c in events.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(ts, id_col)).alias("r")
    return events.groupBy(*keys).agg(packed).select(*keys, "r.*")
