"""Event-time streams against their batch forms, on rows that come in the wrong order over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.operators import affect as af
from memspark.sources import events as ev
from memspark.streaming import batch_forms as bf
from memspark.streaming import event_time as et

SECOND = 1_000_000
SHAPE = "key string, id long, us long, text string"


def texts(n=240, seed=3):
    """A hot key, times a few seconds apart with silences of 500 seconds, texts that often repeat."""
    r = random.Random(seed)
    now, out = 1, []
    for i in range(n):
        now += 500 if i % 60 == 59 else r.randrange(0, 4)
        out.append(("hot" if r.random() < 0.6 else f"k{r.randrange(4)}", i, now * SECOND, f"number {r.randrange(5)} of the texts"))
    return out


def at(df):
    return df.withColumn("at", F.timestamp_micros("us"))


def in_files(spark, rows, path, files, disorder, shape=SHAPE):
    """The rows by time, shuffled within ``disorder`` neighbours, dealt to files that are read one after the other."""
    r = random.Random(9)
    mixed = [x for _, x in sorted(((i + r.uniform(0, disorder), x) for i, x in enumerate(rows)), key=lambda p: p[0])]
    for k in range(files):
        part = mixed[k * len(mixed) // files:(k + 1) * len(mixed) // files]
        at(spark.createDataFrame(part, shape)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return at_stream(spark, path, shape)


def at_stream(spark, path, shape=SHAPE):
    return spark.readStream.schema(f"{shape}, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def before(rows, late):
    """Ids that the watermark has passed at the end."""
    end = max(r[2] for r in rows) - late * SECOND
    return {r[1] for r in rows if r[2] < end}


@pytest.mark.parametrize("forget", [None, 200 * SECOND])
def test_gate_in_any_order_equals_batch(spark, tmp_path, forget):
    rows = texts()
    stream = in_files(spark, rows, tmp_path, 4, disorder=12)
    out, late, _ = et.run_now(et.duplicate_gate_in_order(stream, "60 seconds", forget), f"{tmp_path}/out", f"{tmp_path}/cp")
    want = {(r["id"], r["duplicate"]) for r in et.duplicate_gate_in_lives(at(spark.createDataFrame(rows, SHAPE)), forget).collect()}
    got = [(r["id"], r["duplicate"]) for r in out.collect()]
    closed = before(rows, 60)
    assert late == 0 and len(got) == len(set(got)) and set(got) == {w for w in want if w[0] in closed}
    assert {d for _, d in got} == {True, False}


def test_forgetting_changes_the_gate(spark):
    rows = at(spark.createDataFrame([("a", 1, 0, "same words"), ("a", 2, 100 * SECOND, "same words"), ("a", 3, 201 * SECOND, "same words")], SHAPE))
    flags = {f: [r["duplicate"] for r in et.duplicate_gate_in_lives(rows, f).orderBy("id").collect()] for f in (None, 100 * SECOND)}
    assert flags == {None: [False, True, True], 100 * SECOND: [False, True, False]}


def test_late_rows_are_counted_and_silent_keys_leave_the_state(spark, tmp_path):
    """Two runs over one checkpoint: the second brings a row behind the watermark, and one far ahead."""
    first = [(f"k{i}", i, (i + 1) * SECOND, f"text {i}") for i in range(100)] + [("x", 1000, 400 * SECOND, "end")]
    make = lambda: et.duplicate_gate_in_order(at_stream(spark, tmp_path), "10 seconds", 60 * SECOND)
    in_files(spark, first, tmp_path, 1, 0)
    out, late, kept = et.run_now(make(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert late == 0 and {r["id"] for r in out.collect()} == set(range(100))
    in_files(spark, [("k1", 2000, 5 * SECOND, "too late"), ("y", 2001, 900 * SECOND, "ahead"), (None, 2002, 901 * SECOND, None)], tmp_path, 1, 0)
    out, late, after = et.run_now(make(), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert late == 1 and {r["id"] for r in out.collect()} == set(range(100)) | {1000}
    assert kept < 20 and after < 20  # the rows that wait and their timers, not the hundred keys seen


def test_mood_in_any_order_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, i, us, [(r.choice(list(lx.DEFAULT_STATE)), r.uniform(-0.3, 0.3)) for _ in range(r.randrange(3))]) for k, i, us, _ in texts()]
    shape = "key string, id long, us long, steps array<struct<dim:string,shift:double>>"
    stream = in_files(spark, rows, tmp_path, 3, 10, shape)
    out, late, _ = et.run_now(et.throttled_mood_in_order(stream, "60 seconds", 2 * SECOND, 200 * SECOND), f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = et.throttled_mood_in_lives(at(spark.createDataFrame(rows, shape)), 2 * SECOND, 200 * SECOND)
    closed = before(rows, 60)
    want = {x["id"]: [x[d] for d in af.DIMS] for x in batch.collect() if x["id"] in closed}
    got = {x["id"]: [x[d] for d in af.DIMS] for x in out.collect()}
    assert late == 0 and got.keys() == want.keys() and 0 < len(got) < len(closed)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in got)


def test_turns_in_any_order_equal_batch(spark, tmp_path):
    r = random.Random(6)
    rows = [(k, i, us, r.choice(["", "one", "two"]), r.random() < 0.3) for k, i, us, _ in texts()]
    shape = "key string, id long, us long, block string, failed boolean"
    stream = in_files(spark, rows, tmp_path, 3, 10, shape)
    out, late, _ = et.run_now(et.throttled_turns_in_order(stream, "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/cp")
    # Ids rise with time, so the batch form may order by them.
    batch = bf.throttled_turns(spark.createDataFrame(rows, shape), "key", "id", "block", "failed")
    closed = before(rows, 60)
    want = {(x["id"], x["text"], x["refreshed"]) for x in batch.collect() if x["id"] in closed}
    assert late == 0 and want and {(x["id"], x["text"], x["refreshed"]) for x in out.collect()} == want


def test_liveness_in_any_order_equals_batch_with_a_restart(spark, tmp_path):
    r = random.Random(7)
    rows = [(k, i, us, r.choice(["up", "down", "down", "slow"])) for k, i, us, _ in texts()]
    shape = "key string, id long, us long, status string"
    make = lambda: et.liveness_stream(at_stream(spark, tmp_path, shape), 200 * SECOND, "60 seconds", 2, 2)
    for part in (rows[:120], rows[120:]):
        in_files(spark, part, tmp_path, 2, 8, shape)
        out, late, _ = et.run_now(make(), f"{tmp_path}/out", f"{tmp_path}/cp")
        assert late == 0
    end = (max(x[2] for x in rows) // 1000 - 60_000) * 1000
    want = et.liveness(at(spark.createDataFrame(rows, shape)), 200 * SECOND, end, 2, 2)
    got = out.collect()
    assert sorted(map(repr, got)) == sorted(repr(x) for x in want.select(out.columns).collect())
    assert any(x["id"] is None and x["alert"] for x in got) and any(x["id"] is not None and x["alert"] for x in got)


def test_rows_without_time_and_empty_input(spark, tmp_path):
    rows = [("a", 1, None, "x"), ("a", 2, SECOND, "x"), ("a", 3, 100 * SECOND, "y")]
    stream = in_files(spark, rows, f"{tmp_path}/some", 1, 0)
    out, late, _ = et.run_now(et.duplicate_gate_in_order(stream, "1 second"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [r["id"] for r in out.collect()] == [2] and late == 0
    (tmp_path / "none" / "in").mkdir(parents=True)
    out, late, kept = et.run_now(et.duplicate_gate_in_order(at_stream(spark, f"{tmp_path}/none")), f"{tmp_path}/out2", f"{tmp_path}/cp2")
    assert (out.count(), late, kept) == (0, 0, 0)


def test_log_is_taken_once(spark, tmp_path):
    def lines(*names):
        good = [('{"data": {"action": "store", "memory_id": "%s", "source": "other", "timestamp": "t"}}' % n,) for n in names]
        spark.createDataFrame([*good, ("{broken",)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/log")

    def load():
        return sorted(r["memory_id"] for r in ev.load_log(spark, f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/cp").collect())

    lines("a", "b")
    assert load() == ["a", "b"]
    assert load() == ["a", "b"]
    lines("c", "a")
    assert load() == ["a", "a", "b", "c"]
