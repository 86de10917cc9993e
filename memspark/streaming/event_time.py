"""Stateful stream operators in event-time order, with state that ends.

A row waits until the watermark has passed its time; then the rows of its key that are due are handled in (time, id)
order. Files and micro-batches may therefore come in any order, up to the ``late`` interval: the result is that of the
batch form. Rows later than that are dropped and counted (``run_now``). A key that stays silent for longer than
``forget`` starts afresh with its next row, and its state is removed when the watermark has passed that point; ``None``
keeps it for good. Rows without a time have no place in the order and are left out. Spark's watermark begins at the start
of 1970, so rows up to that moment are late.

State per key: the rows of the last ``late`` interval, and what the fold holds (five texts, or one mood).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memspark.functions import text as tx
from memspark.functions.time import micros
from memspark.operators import affect as af
from memspark.operators.ordered import running_sum, with_previous
from memspark.streaming import batch_forms as bf
from memspark.streaming import stateful as sf

LATE = "10 minutes"


class InOrder(StatefulProcessor):
    """Holds the rows of a key back until the watermark, then folds those that are due.

    A subclass names the columns of a row besides ``us`` and ``id`` (``row``), the fields it holds between rows
    (``held``), and gives ``fold(rows, held) -> (output columns, held)``; ``held`` is None at the start of a life.
    """

    row: dict[str, str]
    held: dict[str, str]

    def __init__(self, forget: int | None):
        self.forget = forget

    def fold(self, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        raise NotImplementedError

    def silenced(self, us: int) -> pd.DataFrame | None:
        """What to give out when a key has been silent for too long, at ``us``: nothing, unless a subclass says so."""
        return None

    def init(self, handle: StatefulProcessorHandle) -> None:
        shape = {"us": "bigint", "id": "bigint", **self.row}
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{c} {k}" for c, k in shape.items()))
        self.kept = handle.getValueState("kept", ", ".join(f"{c} {k}" for c, k in {"seen": "bigint", **self.held}.items()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            if len(pdf):
                earliest = int(pdf["us"].min())
                first = earliest if first is None else min(first, earliest)
                self.waiting.appendList([plain(r) for r in pdf[["us", "id", *self.row]].itertuples(index=False, name=None)])
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for r in self.waiting.get() if self.waiting.exists() else ():
            (due if r[0] < now else later).append(plain(r))
        seen, held = None, None
        if self.kept.exists():
            seen, *held = self.kept.get()
            held = tuple(held)
        if due:
            if later:
                self.waiting.put(later)
                self._wake(min(r[0] for r in later))
            else:
                self.waiting.clear()
            pdf = pd.DataFrame(due, columns=["us", "id", *self.row]).sort_values(["us", "id"], ignore_index=True)
            for life in self._lives(pdf, seen):
                if self._over(seen, int(life["us"].iat[0])):
                    held = None
                    yield from self._keyed(key, self.silenced(seen + self.forget))
                out, held = self.fold(life, held)
                seen = int(life["us"].iat[-1])
                yield from self._keyed(key, out)
            self.kept.update((seen, *held))
            if self.forget is not None:
                self._wake(seen + self.forget)
        if self._over(seen, now):
            self.kept.clear()
            yield from self._keyed(key, self.silenced(seen + self.forget))

    def close(self) -> None:
        pass

    def _keyed(self, key: Any, out: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        if out is not None and len(out):
            out.insert(0, "key", key[0])
            yield out

    def _over(self, seen: int | None, us: int) -> bool:
        return self.forget is not None and seen is not None and us - seen > self.forget

    def _lives(self, pdf: pd.DataFrame, seen: int | None) -> list[pd.DataFrame]:
        """The rows cut where the key was silent for too long."""
        if self.forget is None:
            return [pdf]
        us = pdf["us"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(us) > self.forget) + 1).tolist(), len(pdf)]
        return [pdf.iloc[i:j] for i, j in zip(cuts, cuts[1:])]

    def _wake(self, us: int) -> None:
        """A timer that rings once the watermark is past ``us``: timers ring when they lie before it, in whole milliseconds."""
        self.handle.registerTimer(us // 1000)


def plain(row: Sequence[Any]) -> tuple:
    """The row with arrays as lists and numpy numbers as Python's own."""
    return tuple(v.tolist() if isinstance(v, np.ndarray | np.generic) else v for v in row)


def ordered_stream(rows: DataFrame, processor: InOrder, at: str, out: str, late: str) -> DataFrame:
    """``rows`` (key, id, us, the columns of the processor, and the time ``at``) through the processor."""
    timed = rows.filter(F.col(at).isNotNull()).withWatermark(at, late)
    return timed.groupBy("key").transformWithStateInPandas(processor, out, "Append", "EventTime")


def lives(rows: DataFrame, keys: Sequence[str], id_col: str, us: str, forget: int | None) -> DataFrame:
    """Batch twin of forgetting: ``_life`` numbers the stretches of a key without a silence longer than ``forget``."""
    if forget is None:
        return rows.withColumn("_life", F.lit(0).cast("bigint"))
    before = with_previous(rows, keys, [us, id_col], {"_before": us})
    silent = F.coalesce(F.col(us) - F.col("_before") > forget, F.lit(False))
    return running_sum(before, keys, [us, id_col], silent.cast("int"), "_life").drop("_before")


# --- Duplicate gate -------------------------------------------------------------------------------------


class OrderedGate(InOrder):
    """Texts as hashes of their bigrams; the last accepted ones are held."""

    row = {"grams": "array<bigint>"}
    held = {"recent": "array<array<bigint>>"}

    def __init__(self, n: int, threshold: float, forget: int | None):
        super().__init__(forget)
        self.n, self.threshold = n, threshold

    def fold(self, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        recent = [list(r) for r in held[0]] if held else []
        flags = sf._gate(rows["grams"], recent, self.n, self.threshold)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "duplicate": flags}), (recent,)


def duplicate_gate_in_order(texts: DataFrame, late: str = LATE, forget: int | None = None, n: int = sf.GATE_RECENT,
                            threshold: float = sf.GATE_SIMILARITY) -> DataFrame:
    """``texts`` streams (key string, id bigint, at timestamp, text string); gives (key, id, duplicate).

    Bigrams are compared by a 64-bit hash, which is what goes to Python and into the state.
    """
    grams = F.transform(tx.bigram_set(F.col("text")), lambda g: F.xxhash64(g))
    rows = texts.select("key", "id", "at", micros(F.col("at")).alias("us"), grams.alias("grams"))
    return ordered_stream(rows, OrderedGate(n, threshold, forget), "at", "key string, id bigint, duplicate boolean", late)


def duplicate_gate_in_lives(texts: DataFrame, forget: int | None = None, n: int = sf.GATE_RECENT,
                            threshold: float = sf.GATE_SIMILARITY) -> DataFrame:
    """Batch form of ``duplicate_gate_in_order``: (id, duplicate)."""
    rows = lives(texts.select("key", "id", micros(F.col("at")).alias("us"), "text").filter("us is not null"), ["key"], "id", "us", forget)
    return sf.duplicate_gate(rows, ["key", "_life"], "id", "us", "text", n, threshold)


# --- Throttled mood -------------------------------------------------------------------------------------


class OrderedMood(InOrder):
    """The mood, the last accepted time and the last time it was pulled towards its base are held."""

    row = {"dims": "array<string>", "shifts": "array<double>"}
    held = {"last": "bigint", "pulled": "bigint", "mood": "array<double>"}

    def __init__(self, interval: int, forget: int | None):
        super().__init__(forget)
        self.interval = interval

    def fold(self, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        steps = ([{"dim": d, "shift": s} for d, s in zip(*r)] for r in zip(rows["dims"], rows["shifts"]))
        held, ids, states = sf.mood_walk(rows["id"], rows["us"], steps, held, self.interval)
        return pd.concat([pd.DataFrame({"id": ids}), pd.DataFrame(states, columns=list(af.DIMS))], axis=1), held


def throttled_mood_in_order(events: DataFrame, late: str = LATE, interval: int = sf.THROTTLE_MICROS, forget: int | None = None) -> DataFrame:
    """``events`` streams (key string, id bigint, at timestamp, steps); gives the mood after each accepted event."""
    parts = [F.col("steps.dim").alias("dims"), F.col("steps.shift").alias("shifts")]
    rows = events.select("key", "id", "at", micros(F.col("at")).alias("us"), *parts)
    shape = "key string, id bigint, " + ", ".join(f"{d} double" for d in af.DIMS)
    return ordered_stream(rows, OrderedMood(interval, forget), "at", shape, late)


def throttled_mood_in_lives(events: DataFrame, interval: int = sf.THROTTLE_MICROS, forget: int | None = None) -> DataFrame:
    """Batch form of ``throttled_mood_in_order``."""
    rows = events.select("key", "id", micros(F.col("at")).alias("us"), "steps").filter("us is not null")
    return sf.throttled_mood(lives(rows, ["key"], "id", "us", forget), ["key", "_life"], "id", "us", interval).drop("_life")


# --- Turns ----------------------------------------------------------------------------------------------


class OrderedTurns(InOrder):
    """The held context block and its age."""

    row = {"block": "string", "failed": "boolean"}
    held = {"text": "string", "age": "bigint"}

    def __init__(self, every: int, forget: int | None):
        super().__init__(forget)
        self.every = every

    def fold(self, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        held = held if held and held[0] is not None else None
        texts, fresh, held = bf.take_turns(rows["block"], rows["failed"], held, self.every)
        return pd.DataFrame({"id": rows["id"].to_numpy(), "text": pd.Series(texts, dtype=object), "refreshed": fresh}), tuple(held) if held else (None, 0)


def throttled_turns_in_order(turns: DataFrame, late: str = LATE, every: int = 3, forget: int | None = None) -> DataFrame:
    """``turns`` streams (key string, id bigint, at timestamp, block string, failed boolean); gives (key, id, text, refreshed)."""
    rows = turns.select("key", "id", "at", micros(F.col("at")).alias("us"), "block", "failed")
    return ordered_stream(rows, OrderedTurns(every, forget), "at", "key string, id bigint, text string, refreshed boolean", late)


# --- Liveness -------------------------------------------------------------------------------------------


class Liveness(InOrder):
    """The status of the last probe and the length of its run; a key that sends nothing for too long is down."""

    row = {"status": "string"}
    held = {"status": "string", "run": "bigint"}

    def __init__(self, silence: int, alerts: dict[str, int]):
        super().__init__(silence)
        self.alerts = alerts

    def fold(self, rows: pd.DataFrame, held: tuple | None) -> tuple[pd.DataFrame, tuple]:
        status, run = held or (None, 0)
        runs = []
        for now in rows["status"]:
            status, run = now, run + 1 if run and now == status else 1
            runs.append(run)
        alert = [self.alerts.get(s) == n for s, n in zip(rows["status"], runs)]
        out = pd.DataFrame({"id": rows["id"].to_numpy(), "us": rows["us"].to_numpy(), "status": rows["status"].to_numpy(), "consecutive": runs, "alert": alert})
        return out, (status, run)

    def silenced(self, us: int) -> pd.DataFrame:
        return pd.DataFrame({"id": pd.Series([None], dtype="Int64"), "us": [us], "status": ["down"], "consecutive": [0], "alert": [True]})


WATCHED = "key string, id bigint, us bigint, status string, consecutive bigint, alert boolean"


def liveness_stream(probes: DataFrame, silence: int, late: str = LATE, down_alert: int = 20, slow_alert: int = 40) -> DataFrame:
    """``probes`` streams (key string, id bigint, at timestamp, status string); gives the run length after each probe.

    When a key was silent for more than ``silence`` microseconds, a row without id says "down", with an alert, at the
    time it should have spoken; runs start afresh after it.
    """
    rows = probes.select("key", "id", "at", micros(F.col("at")).alias("us"), "status")
    return ordered_stream(rows, Liveness(silence, {"down": down_alert, "slow": slow_alert}), "at", WATCHED, late)


def liveness(probes: DataFrame, silence: int, until: int, down_alert: int = 20, slow_alert: int = 40) -> DataFrame:
    """Batch form of ``liveness_stream`` for all that lies before the time ``until``."""
    rows = probes.select("key", "id", micros(F.col("at")).alias("us"), "status").filter(F.col("us") < until)
    split = lives(rows, ["key"], "id", "us", silence)
    runs = bf.run_lengths(split, ["key", "_life"], "id", "us", "status", down_alert, slow_alert)
    spoke = split.groupBy("key", "_life").agg(F.max("us").alias("seen"))
    newest = split.groupBy("key").agg(F.max("_life").alias("_newest"))
    on = F.col("key").eqNullSafe(F.col("_key"))
    ends = spoke.join(newest.withColumnRenamed("key", "_key"), on).filter((F.col("_life") < F.col("_newest")) | (F.col("seen") + silence < until))
    silent = ends.select("key", F.lit(None).cast("bigint").alias("id"), (F.col("seen") + silence).alias("us"), F.lit("down").alias("status"),
                         F.lit(0).cast("bigint").alias("consecutive"), F.lit(True).alias("alert"))
    return runs.select("key", "id", "us", "status", F.col("consecutive").cast("bigint").alias("consecutive"), "alert").unionByName(silent)


# --- Running --------------------------------------------------------------------------------------------


def run_now(stream: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, int, int]:
    """(output so far, late rows dropped, rows in state): runs a stream over what is there now, writing to files.

    The counts come from the progress reports of this run, of which Spark keeps the last 100 micro-batches.
    """
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    run = writer.outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    states = [s for p in run.recentProgress for s in p["stateOperators"][:1]]
    late = sum(s["numRowsDroppedByWatermark"] for s in states)
    return stream.sparkSession.read.schema(stream.schema).parquet(path), late, states[-1]["numRowsTotal"] if states else 0
