"""Hooks that fail, and texts that are scored once."""

import os

import pytest
from pyspark.sql import functions as F

from memspark.operators import scoring as sc


def test_a_failed_request_is_halved_down_to_its_rows():
    calls = []

    def hook(xs):
        calls.append(len(xs))
        if 7 in xs:
            raise ValueError("seven")
        return [None if x == 3 else float("nan") if x == 4 else x * 2.0 for x in xs]

    got = sc.ask(hook, [(i,) for i in range(16)], 2)
    assert [v for v, _ in got] == [None if i in (3, 4, 7) else i * 2.0 for i in range(16)]
    assert [r for _, r in got if r] == ["no answer", "no answer", "ValueError: seven"]
    assert len(calls) == 2 * 5 + 4  # five requests with the seven, each tried twice, and the other halves


def test_a_retry_helps_and_a_wrong_length_is_a_failure():
    tried = []

    def flaky(xs):
        tried.append(1)
        if len(tried) == 1:
            raise OSError("once")
        return [1.0] * len(xs)

    assert sc.ask(flaky, [(1,), (2,)], 2) == [(1.0, None)] * 2 and len(tried) == 2
    assert sc.ask(lambda xs: [], [(1,)], 1) == [(None, "ValueError: 0 answers to 1 rows")]


@pytest.mark.parametrize("size", [1, 5])
def test_order_is_kept_over_requests_in_flight(spark, size):
    def slow_first(xs, ys):
        import time

        time.sleep(0.02 if xs[0] % 2 == 0 else 0)
        if any(x % 3 == 0 for x in xs):
            raise RuntimeError("third")
        return [x * 10.0 + len(y) for x, y in zip(xs, ys)]

    df = spark.range(60).repartition(2).select("id", F.lit("ab").alias("t"))
    a = sc.guarded(slow_first, size=size, tries=1)(F.col("id"), F.col("t")).alias("a")
    rows = df.select("id", a).select("id", "a.*").collect()
    assert len(rows) == 60
    assert all((r["value"], r["reason"]) == ((None, "RuntimeError: third") if r["id"] % 3 == 0 else (r["id"] * 10.0 + 2, None)) for r in rows)


def test_answers_may_be_vectors(spark):
    a = sc.guarded(lambda xs: [[x, 1.0] for x in xs], kind="array<double>")(F.col("id").cast("double"))["value"]
    assert [r[0] for r in spark.range(2).select(a).collect()] == [[0.0, 1.0], [1.0, 1.0]]


def test_each_text_is_sent_once(spark, tmp_path):
    log = str(tmp_path / "sent")

    def hook(xs):
        if any(x == "bad" for x in xs):
            raise ValueError("bad")
        with open(log, "a") as f:
            f.writelines(f"{x}\n" for x in xs)
        return [float(len(x)) for x in xs]

    def run(*texts):
        df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        got = sc.scored_once(df, "text", hook, str(tmp_path / "memo"), tries=1).collect()
        sent = sorted(open(log).read().split()) if os.path.exists(log) else []
        return {r["id"]: (r["value"], r["reason"], r["fresh"]) for r in got}, sent

    got, sent = run("a", "bb", "a", None, "bad")
    assert got == {0: (1.0, None, True), 1: (2.0, None, True), 2: (1.0, None, True), 3: (None, "no text", False), 4: (None, "ValueError: bad", True)}
    assert sent == ["a", "bb"]
    got, sent = run("bb", "ccc", "a")
    assert got == {0: (2.0, None, False), 1: (3.0, None, True), 2: (1.0, None, False)} and sent == ["a", "bb", "ccc"]
    assert run("a", "bb")[1] == ["a", "bb", "ccc"]
    assert run() == ({}, ["a", "bb", "ccc"])
