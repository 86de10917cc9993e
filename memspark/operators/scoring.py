"""Model hooks that may fail: bounded requests, retries, a reason instead of an exception, and each text scored once.

A hook is a plain function from lists (one per column, equally long) to a list of answers, say a call of a model server.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.ordered import meet
from memspark.session import materialize

Hook = Callable[..., Sequence[Any]]
Answer = tuple[Any, str | None]
MEMO = "content_hash string, value double"


def ask(hook: Hook, rows: Sequence[tuple], tries: int) -> list[Answer]:
    """(value, reason) per row, in order. A request that fails ``tries`` times is halved, down to the rows at fault."""
    reason = ""
    for _ in range(tries):
        try:
            values = list(hook(*map(list, zip(*rows))))
            if len(values) != len(rows):
                raise ValueError(f"{len(values)} answers to {len(rows)} rows")
            return [(v, None) if v is not None and v == v else (None, "no answer") for v in values]
        except Exception as e:  # noqa: BLE001
            reason = f"{type(e).__name__}: {e}"
    if len(rows) == 1:
        return [(None, reason)]
    half = len(rows) // 2
    return ask(hook, rows[:half], tries) + ask(hook, rows[half:], tries)


def guarded(hook: Hook, kind: str = "double", size: int = 32, in_flight: int = 4, tries: int = 2) -> Callable[..., Column]:
    """A column function (columns) -> struct<value, reason> around ``hook``; exactly one of the two is null.

    Requests hold ``size`` rows, ``in_flight`` of them run at a time in a task; rows keep their order. An exception, an
    answer of another length, None and NaN give a null value with a reason, for the rows at fault only. A hook that
    hangs must bring its own time limit. ``kind`` is the type of an answer; arrays are Python lists.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                rows = list(batch.itertuples(index=False, name=None))
                requests = [rows[i:i + size] for i in range(0, len(rows), size)]
                answers = [a for got in pool.map(lambda r: ask(hook, r, tries), requests) for a in got]
                yield pd.DataFrame({"value": pd.Series([a[0] for a in answers], dtype=object), "reason": pd.Series([a[1] for a in answers], dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    # Declared as not deterministic, so that the optimiser does not call a model twice for one row.
    call = F.pandas_udf(run, f"value {kind}, reason string").asNondeterministic()
    return lambda *cols: call(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]))


def scored_once(rows: DataFrame, text: str, hook: Hook, memo: str, size: int = 32, in_flight: int = 4, tries: int = 2) -> DataFrame:
    """``rows`` with content_hash, value, reason and fresh (scored in this call); each different text is scored once, ever.

    ``memo`` is a folder of (content_hash, value) that calls share: a text found there is not sent again. Answers are
    appended once they are all there; failed texts are not, so the next call tries them anew. A null text has no hash, is
    not sent, and gets the reason "no text". Only hashes are shuffled for texts that are known.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], MEMO).write.mode("ignore").parquet(memo)
    known = spark.read.schema(MEMO).parquet(memo).groupBy("content_hash").agg(F.min("value").alias("value"))
    hashed = rows.withColumn("content_hash", F.sha2(F.col(text), 256))
    spread = F.monotonically_increasing_id()
    new = materialize(hashed.select("content_hash").filter("content_hash is not null").distinct().join(known, "content_hash", "left_anti"))
    texts = meet(hashed.select("content_hash", F.col(text).alias("_text")), new, ["content_hash"], spread)
    once = texts.groupBy("content_hash").agg(F.first("_text").alias("_text"))
    answer = guarded(hook, "double", size, in_flight, tries)(F.col("_text")).alias("a")
    made = materialize(once.select("content_hash", answer).select("content_hash", "a.value", "a.reason"))
    known = materialize(known.withColumns({"reason": F.lit(None).cast("string"), "fresh": F.lit(False)}))
    made.filter("reason is null").select("content_hash", "value").write.mode("append").parquet(memo)
    answers = known.unionByName(made.withColumn("fresh", F.lit(True)))
    out = meet(hashed, answers, ["content_hash"], spread, "left")
    nothing = F.col("content_hash").isNull()
    return out.withColumns({"reason": F.when(nothing, "no text").otherwise(F.col("reason")), "fresh": F.coalesce("fresh", F.lit(False))})
