"""Mood: keyword triggers, per-text affect, and the time-ordered state with decay and bounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.functions import lexicons as lx
from memspark.functions import text as tx
from memspark.functions.time import clamp
from memspark.operators import filters as fl
from memspark.operators.ordered import CHUNK, key_segments, leading_edge, range_chunks

Lexicon = Sequence[Mapping[str, Mapping[str, float]]]
FULL: Lexicon = (lx.TRIGGERS, lx.MORE_TRIGGERS)
DIMS = tuple(lx.DEFAULT_STATE)
# Pull towards the baseline per hour, its cap, and the shortest time between two pulls.
DECAY_PER_HOUR = 0.5
DECAY_CAP = 0.5
MIN_DECAY_MICROS = 3_600_000


def trigger_hits(text: Column, lexicon: Lexicon = FULL, negations: Sequence[str] = lx.NEGATIONS,
                 window: int = lx.NEGATION_WINDOW) -> Column:
    """Array of (keyword, shifts) in lexicon order. Only the first occurrence of a keyword is looked at."""
    entries = [
        F.struct(
            F.lit(k).alias("keyword"),
            F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(float(v)).alias("shift")) for d, v in shifts.items()]).alias("shifts"),
        )
        for table in lexicon
        for k, shifts in table.items()
    ]
    neg = F.array(*[F.lit(n) for n in negations])

    def holds(low: Column, e: Column) -> Column:
        def affirmed(at: Column) -> Column:
            start = F.greatest(F.lit(1), at - window)
            return (at > 0) & _once(F.substring(low, start, at - start), lambda before: ~F.exists(neg, lambda n: F.contains(before, n)))

        return _once(F.instr(low, e["keyword"]), affirmed)

    return _once(F.lower(tx.text_or_empty(text)), lambda low: F.filter(F.array(*entries), lambda e: holds(low, e)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def affect(text: Column, lexicon: Lexicon = FULL, negations: Sequence[str] = lx.NEGATIONS, chars: int | None = None) -> Column:
    """struct(dominant, valence, color) of a text, or of its first ``chars`` characters."""
    shifts = F.flatten(F.transform(trigger_hits(tx.opening(text, chars), lexicon, negations), lambda h: h["shifts"]))
    colors = F.create_map(*[F.lit(x) for kv in lx.DIMENSION_COLOR.items() for x in kv])

    def largest(shifts: Column) -> Column:
        dims = F.array_distinct(F.transform(shifts, lambda s: s["dim"]))
        sums = F.transform(
            dims,
            lambda d, i: F.struct(
                F.abs(_sum_of(shifts, lambda s: s["dim"] == d)).alias("size"), (-i).alias("back"), d.alias("dim")
            ),
        )
        return F.array_max(sums)["dim"]

    def feel(shifts: Column, dominant: Column) -> Column:
        good = _sum_of(shifts, lambda s: s["dim"].isin(*lx.POSITIVE_DIMS))
        bad = _sum_of(shifts, lambda s: s["dim"].isin(*lx.NEGATIVE_DIMS))
        return F.struct(
            dominant.alias("dominant"),
            F.round(clamp(good - bad, -1.0, 1.0), 3).alias("valence"),
            F.coalesce(F.try_element_at(colors, dominant), F.lit(lx.DEFAULT_COLOR)).alias("color"),
        )

    return _once(shifts, lambda s: _once(largest(s), lambda d: feel(s, d)))


def _sum_of(shifts: Column, keep) -> Column:
    return F.aggregate(F.filter(shifts, keep), F.lit(0.0), lambda a, s: a + s["shift"])


def steps(hits: Column, importance: Column | None = None) -> Column:
    """Hits as a flat array of (dim, shift) to be applied one after the other."""
    factor = F.lit(1.0) if importance is None else F.coalesce(F.lit(0.5) + clamp(importance), F.lit(1.0))
    return F.transform(
        F.flatten(F.transform(hits, lambda h: h["shifts"])),
        lambda s: F.struct(s["dim"].alias("dim"), (s["shift"] * factor).alias("shift")),
    )


def structural_hits(kind: Column, table: Mapping[str, Mapping[str, float]] = lx.STRUCTURAL_TRIGGERS) -> Column:
    """Hits of an event without text; empty for an unknown kind."""
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("keyword"),
                F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(float(v)).alias("shift")) for d, v in s.items()]).alias("shifts"),
            )
            for k, s in table.items()
        ]
    )
    return F.filter(entries, lambda e: e["keyword"] == kind)


def offset_hits(offsets: Column, fallback: Column) -> Column:
    """Hits from a map of outside estimates per dimension; the lexicon's hits where the map is null."""
    known = F.map_filter(offsets, lambda d, _: d.isin(*DIMS))
    as_hits = F.transform(
        F.map_entries(known),
        lambda e: F.struct(
            F.when(e["value"] > 0.05, e["key"]).alias("keyword"),
            F.array(F.struct(e["key"].alias("dim"), e["value"].alias("shift"))).alias("shifts"),
        ),
    )
    return F.when(offsets.isNotNull(), as_hits).otherwise(fallback)


# --- The state over time ------------------------------------------------------------------------------
# One event changes a dimension by x -> min(h, max(l, a * x + c)) with a >= 0. Such maps are closed under
# composition, so whole chunks of events are condensed first and only their results are chained.


def _identity(n: int):
    return np.ones(n), np.zeros(n), np.full(n, -math.inf), np.full(n, math.inf)


def _then_affine(f, a, c):
    return f[0] * a, f[1] * a + c, f[2] * a + c, f[3] * a + c


def _then_clamp(f, j: int):
    f[2][j] = min(1.0, max(0.0, f[2][j]))
    f[3][j] = min(1.0, max(0.0, f[3][j]))


def _event_maps(elapsed: np.ndarray, steps: np.ndarray):
    """(pull towards the baseline, [(dimension, shift), ...]) of each event."""
    at = {d: j for j, d in enumerate(DIMS)}
    for gap, ops in zip(elapsed, steps):
        rate = 0.0 if gap != gap else min(DECAY_PER_HOUR * gap / 3.6e9, DECAY_CAP)
        yield rate, [(at[o["dim"]], o["shift"]) for o in (ops if ops is not None else ()) if o["dim"] in at]


def _advance(x: np.ndarray, base: np.ndarray, rate: float, ops) -> np.ndarray:
    x = x + (base - x) * rate if rate else x.copy()
    for j, s in ops:
        x[j] = min(1.0, max(0.0, x[j] + s))
    return x


def fold_states(
    events: DataFrame, keys: Sequence[str], id_col: str, ts: str, baseline: Mapping[str, float] = lx.DEFAULT_STATE
) -> DataFrame:
    """State after every event: the key columns, ``id_col``, and one column per dimension.

    Events need an integer time in microseconds and ``steps``. Before an event is applied the state is pulled towards
    the baseline by half the elapsed hours (at most half way), unless the last pull is under 3.6 seconds ago; then
    the steps follow in order, each bounded to 0..1. Keys must not be null.
    """
    pulls = leading_edge(events, keys, id_col, ts, MIN_DECAY_MICROS)
    gap = F.when(F.col("accepted"), F.col(ts).cast("double") - F.col("previous"))
    timed = events.select(*keys, id_col, ts, "steps").join(pulls.select(id_col, gap.alias("_gap")), id_col)
    rows = range_chunks(timed, keys, [ts, id_col])
    base = np.array([baseline[d] for d in DIMS])
    shared = rows.sparkSession.sparkContext

    def condense(batches):
        """Per chunk: the map of its first key's events, and the end state of its last key if that is another."""
        chunk = first = key = None
        f = [x.copy() for x in _identity(len(DIMS))]
        x = base
        for pdf in batches:
            for i, j, k in key_segments(pdf, keys) if len(pdf) else ():
                if chunk is None:
                    chunk, first, key = int(pdf[CHUNK].iat[0]), k, k
                elif k != key:
                    key, x = k, base
                for rate, ops in _event_maps(pdf["_gap"].to_numpy()[i:j], pdf["steps"].to_numpy()[i:j]):
                    if key != first:
                        x = _advance(x, base, rate, ops)
                        continue
                    if rate:
                        f = list(_then_affine(f, 1.0 - rate, base * rate))
                    for d, s in ops:
                        f[1][d] += s
                        f[2][d] += s
                        f[3][d] += s
                        _then_clamp(f, d)
        if chunk is not None:
            end = None if key == first else x.tolist()
            yield pd.DataFrame({"chunk": [chunk], "first": [first], "last": [key], "end": [end], "a": [f[0].tolist()],
                                "c": [f[1].tolist()], "lo": [f[2].tolist()], "hi": [f[3].tolist()]})

    shape = "chunk int, first string, last string, end array<double>, a array<double>, c array<double>, lo array<double>, hi array<double>"
    starts: dict[int, list[float]] = {}
    if rows.rdd.getNumPartitions() > 1:
        chunks = sorted(rows.mapInPandas(condense, shape).collect(), key=lambda r: r["chunk"])  # one row per chunk
        last, end = None, None
        for r in chunks:
            x = np.array(end) if r["first"] == last else base
            starts[r["chunk"]] = x.tolist()
            after = np.minimum(r["hi"], np.maximum(r["lo"], np.array(r["a"]) * x + np.array(r["c"])))
            last, end = r["last"], (r["end"] if r["end"] is not None else after.tolist())
    given = shared.broadcast(starts)

    def apply(batches):
        chunk = key = None
        x = base
        for pdf in batches:
            if pdf.empty:
                continue
            out = np.empty((len(pdf), len(DIMS)))
            gaps, steps_ = pdf["_gap"].to_numpy(), pdf["steps"].to_numpy()
            for i, j, k in key_segments(pdf, keys):
                if chunk is None:
                    chunk, key = int(pdf[CHUNK].iat[0]), k
                    x = np.array(given.value.get(chunk, base))
                elif k != key:
                    key, x = k, base
                for n, (rate, ops) in enumerate(_event_maps(gaps[i:j], steps_[i:j]), i):
                    x = _advance(x, base, rate, ops)
                    out[n] = x
            yield pd.concat([pdf[[*keys, id_col, ts]].reset_index(drop=True), pd.DataFrame(out, columns=list(DIMS))], axis=1)

    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, id_col, ts])
    return rows.mapInPandas(apply, head + ", " + ", ".join(f"{d} double" for d in DIMS))


def last_states(states: DataFrame, keys: Sequence[str], id_col: str, ts: str) -> DataFrame:
    """The state of each key after its last event."""
    packed = F.max_by(F.struct(ts, *DIMS), F.struct(ts, id_col)).alias("s")
    return states.groupBy(*keys).agg(packed).select(*keys, "s.*")


def decayed(states: DataFrame, ts: str, as_of_micros: Column, baseline: Mapping[str, float] = lx.DEFAULT_STATE) -> DataFrame:
    """States as seen at a later time, without moving them."""
    gap = as_of_micros - F.col(ts)
    rate = F.when(gap < MIN_DECAY_MICROS, 0.0).otherwise(F.least(DECAY_PER_HOUR * gap / F.lit(3.6e9), F.lit(DECAY_CAP)))
    return states.withColumns({d: F.col(d) + (F.lit(baseline[d]) - F.col(d)) * rate for d in DIMS})


def named_state(dim: Mapping[str, Column] | None = None) -> Column:
    """Name of the first state whose conditions all hold."""
    get = dim or {d: F.col(d) for d in DIMS}
    out = None
    for name, _, _, _, conditions in lx.NAMED_STATES:
        if not conditions:
            return out.otherwise(F.lit(name))
        ok = F.lit(True)
        for d, op, level in conditions:
            ok = ok & (get[d] > level if op == ">" else get[d] < level)
        out = F.when(ok, F.lit(name)) if out is None else out.when(ok, F.lit(name))
    return out


def named_value(name: Column, field: int) -> Column:
    """English name (1) or colour (3) of a named state."""
    table = F.create_map(*[F.lit(x) for row in lx.NAMED_STATES for x in (row[0], row[field])])
    return F.element_at(table, name)


def intensity(name: Column, digits: int = 2) -> Column:
    """Value of the dimension behind the named state; for calm, how close all dimensions are to rest."""
    out = None
    for state, _, d, _, _ in lx.NAMED_STATES:
        if d is not None:
            out = F.when(name == state, F.col(d)) if out is None else out.when(name == state, F.col(d))
    spread = sum((F.abs(F.col(d) - v) for d, v in lx.DEFAULT_STATE.items()), F.lit(0.0)) / len(DIMS)
    return F.round(out.otherwise(F.greatest(F.lit(0.0), 1.0 - spread * 2)), digits)


def primary_emotion() -> Column:
    """The dimension with the highest value, the first listed among equals."""
    ranked = F.array(*[F.struct(F.col(d).alias("v"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DIMS)])
    return F.array_max(ranked)["d"]


def summary(states: DataFrame) -> DataFrame:
    """Display columns: primary emotion, named state, English name, colour, intensity."""
    s = states.withColumn("named_state", named_state())
    return s.withColumns(
        {
            "primary_emotion": primary_emotion(),
            "named_state_en": named_value(F.col("named_state"), 1),
            "color": named_value(F.col("named_state"), 3),
            "intensity": intensity(F.col("named_state")),
        }
    )


def daily_snapshots(states: DataFrame, ts: str, id_col: str) -> DataFrame:
    """One row per day: the day's last state. A later run overwrites an earlier one."""
    day = F.to_date(F.timestamp_micros(F.col(ts)))
    packed = F.max_by(F.struct(*DIMS), F.struct(ts, id_col)).alias("s")
    return states.groupBy(day.alias("snapshot_date")).agg(packed).select("snapshot_date", "s.*").withColumn(
        "named_state", named_state()
    )


def history(states: DataFrame, keys: Sequence[str], id_col: str, ts: str, shown: int = 10, keep: int = 500,
            cap: int = 1000) -> DataFrame:
    """The last ``shown`` states per key and how many the history holds (cut to ``keep`` when it passes ``cap``)."""
    n = F.col("n")
    length = F.when(n <= cap, n).otherwise(keep + (n - cap - 1) % (cap - keep + 1))
    counts = states.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("history_count", length).drop("n")
    last = fl.top_per_group(states, keys, [F.col(ts).desc(), F.col(id_col).desc()], min(shown, keep), "back")
    return last.join(counts, list(keys))


def dominant_triggers(texts: DataFrame, hits: Column, n: int = 3) -> DataFrame:
    """(keyword, count, rank): how many texts each keyword fired in. One row per keyword, so the order is cheap."""
    flat = texts.select(F.posexplode(F.transform(hits, lambda h: h["keyword"])).alias("at", "keyword"))
    counts = flat.groupBy("keyword").count().orderBy(F.col("count").desc(), "keyword").limit(n)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), "keyword")))


def baseline_adjustment(items: DataFrame, hits: Column, importance: Column, baseline: Mapping[str, float] = lx.DEFAULT_STATE,
                        weight: float = 0.3) -> DataFrame:
    """New resting levels from consolidated rows: (dim, delta, baseline). Mean shift per item times ``weight``."""
    n = items.agg(F.count("*")).scalar()
    flat = items.select(F.explode(steps(hits, importance)).alias("s"))
    sums = flat.groupBy(F.col("s.dim").alias("dim")).agg(F.sum("s.shift").alias("total"))
    rest = F.create_map(*[F.lit(x) for kv in baseline.items() for x in kv])
    delta = F.col("total") / n
    return sums.filter(F.col("dim").isin(*DIMS)).select(
        "dim", F.round(delta, 4).alias("delta"),
        clamp(F.element_at(rest, F.col("dim")) + delta * weight).alias("baseline"),
    )
