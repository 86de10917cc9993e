"""Ordered helpers against plain Python, with one group on most rows and groups spread over partitions."""

import random

from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.operators import affect as af
from memspark.operators import ordered as o
from memspark.streaming import batch_forms as bf
from memspark.streaming import stateful as sf


def rows(n=600, seed=1):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.6 else f"k{r.randrange(6)}", i, r.randrange(0, 4000) * 1_000_000, r.random()) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "k string, id long, us long, v double").repartition(3)


def by_key(data):
    groups = {}
    for row in sorted(data, key=lambda x: (x[0], x[2], x[1])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_hot_group_is_spread(many_chunks):
    chunks = o.range_chunks(frame(many_chunks, rows()), ["k"], ["us", "id"])
    assert chunks.filter("k = 'hot'").select(o.CHUNK).distinct().count() > 1


def test_row_numbers(many_chunks):
    data = rows()
    got = {r["id"]: r["n"] for r in o.row_numbers(frame(many_chunks, data), ["k"], ["us", "id"], "n").collect()}
    want = {row[1]: i for g in by_key(data).values() for i, row in enumerate(g, 1)}
    assert got == want


def test_row_numbers_without_keys_descending(many_chunks):
    data = rows()
    out = o.row_numbers(frame(many_chunks, data), [], [F.col("us").desc(), F.col("id")], "n")
    want = {row[1]: i for i, row in enumerate(sorted(data, key=lambda x: (-x[2], x[1])), 1)}
    assert {r["id"]: r["n"] for r in out.collect()} == want


def test_previous_and_running_sum(many_chunks):
    data = rows()
    got = o.with_previous(frame(many_chunks, data), ["k"], ["us", "id"], {"p": "id"}).collect()
    want = {b[1]: (a[1] if a else None) for g in by_key(data).values() for a, b in zip([None, *g], g)}
    assert {r["id"]: r["p"] for r in got} == want
    sums = {r["id"]: r["s"] for r in o.running_sum(frame(many_chunks, data), ["k"], ["us", "id"], F.lit(2), "s").collect()}
    assert sums == {row[1]: 2 * i for g in by_key(data).values() for i, row in enumerate(g, 1)}


def throttle(group, interval):
    last, out = None, {}
    for row in group:
        ok = last is None or row[2] - last >= interval
        out[row[1]] = (ok, last)
        if ok:
            last = row[2]
    return out


def test_leading_edge(many_chunks):
    data = rows()
    for interval in (3_000_000, 90_000_000, 10_000_000_000):
        got = o.leading_edge(frame(many_chunks, data), ["k"], "id", "us", interval).collect()
        want = {k: v for g in by_key(data).values() for k, v in throttle(g, interval).items()}
        assert {r["id"]: (r["accepted"], None if r["previous"] is None or r["previous"] != r["previous"] else int(r["previous"])) for r in got} == want


def test_fold_states_equals_sequential_walk(many_chunks):
    data = rows()
    dims = ["worry", "happiness", "focus"]
    steps = {row[1]: [(random.Random(row[1]).choice(dims), random.Random(row[1] + 7).uniform(-0.4, 0.4)) for _ in range(row[1] % 4)] for row in data}
    df = many_chunks.createDataFrame(
        [(k, i, us, [{"dim": d, "shift": s} for d, s in steps[i]]) for k, i, us, _ in data],
        "k string, id long, us long, steps array<struct<dim:string,shift:double>>",
    ).repartition(3)
    got = {r["id"]: r for r in af.fold_states(df, ["k"], "id", "us").collect()}
    assert len(got) == len(data)
    for group in by_key(data).values():
        x, pulled = dict(lx.DEFAULT_STATE), None
        for _, i, us, _ in group:
            if pulled is None or us - pulled >= 3_600_000:
                if pulled is not None:
                    rate = min(0.5 * (us - pulled) / 3.6e9, 0.5)
                    x = {d: v + (lx.DEFAULT_STATE[d] - v) * rate for d, v in x.items()}
                pulled = us
            for d, s in steps[i]:
                x[d] = min(1.0, max(0.0, x[d] + s))
            for d in dims:
                assert abs(got[i][d] - x[d]) < 1e-9


def test_clamp_comes_after_every_step(spark):
    df = spark.createDataFrame([("a", 1, 0, [{"dim": "worry", "shift": 0.85}, {"dim": "worry", "shift": 0.2}, {"dim": "worry", "shift": -0.1}])],
                               "k string, id long, us long, steps array<struct<dim:string,shift:double>>")
    assert abs(af.fold_states(df, ["k"], "id", "us").first()["worry"] - 0.9) < 1e-12


def test_duplicate_gate(many_chunks):
    r = random.Random(5)
    words = ["alpha beta", "alpha beta gamma", "delta", "delta eps", "zeta eta theta"]
    data = [("hot" if r.random() < 0.7 else "b", i, i, " ".join(r.sample(words, 2))) for i in range(300)]
    df = many_chunks.createDataFrame(data, "k string, id long, ord long, text string").repartition(3)
    got = {x["id"]: x["duplicate"] for x in sf.duplicate_gate(df, ["k"], "id", "ord", "text", threshold=0.7).collect()}
    want = {}
    for key in ("hot", "b"):
        recent = []
        for row in (d for d in data if d[0] == key):
            own = {row[3][i : i + 2] for i in range(len(row[3]) - 1)}
            dup = any(len(own & s) / len(own | s) > 0.7 for s in recent[-5:])
            want[row[1]] = dup
            if not dup:
                recent.append(own)
    assert got == want and any(got.values()) and not all(got.values())


def test_bursts_without_keys(many_chunks):
    data = rows()
    got = sorted((r["first_at"], r["fire_at"], r["events"]) for r in bf.bursts(frame(many_chunks, data), [], "id", "us", 20_000_000).collect())
    want, times = [], sorted(row[2] for row in data)
    for t in times:
        if want and t - want[-1][1] < 20_000_000:
            want[-1][1], want[-1][2] = t, want[-1][2] + 1
        else:
            want.append([t, t, 1])
    assert got == [(a, b + 20_000_000, n) for a, b, n in want]


def test_run_lengths_alert_once(many_chunks):
    status = ["up"] + ["down"] * 6 + ["slow"] * 3 + ["down"] * 2
    df = many_chunks.createDataFrame([(i, i, s) for i, s in enumerate(status)], "id long, us long, status string").repartition(3)
    got = {r["id"]: (r["consecutive"], r["alert"]) for r in bf.run_lengths(df, [], "id", "us", "status", 4, 3).collect()}
    assert [got[i][0] for i in range(len(status))] == [1, 1, 2, 3, 4, 5, 6, 1, 2, 3, 1, 2]
    assert [i for i in got if got[i][1]] and sorted(i for i in got if got[i][1]) == [4, 9]


def test_turn_throttle(spark):
    turns = [(1, 0, "a", False), (1, 1, "b", False), (1, 2, "c", False), (1, 3, "d", False), (1, 4, "e", True), (1, 5, "", False), (1, 6, "f", False)]
    df = spark.createDataFrame(turns, "conv long, turn long, block string, failed boolean")
    got = [(r["text"], r["refreshed"]) for r in bf.throttled_turns(df, "conv", "turn", "block", "failed").orderBy("turn").collect()]
    assert got == [("a", True), ("a", False), ("a", False), ("a", False), ("a", True), (None, True), ("f", True)]


def test_history_length(spark):
    s = spark.createDataFrame([("a", i, i, *([0.0] * len(af.DIMS))) for i in range(25)], "k string, id long, us long, " + ", ".join(f"{d} double" for d in af.DIMS))
    h = af.history(s, ["k"], "id", "us", shown=3, keep=5, cap=10)
    kept = []
    for i in range(25):
        kept.append(i)
        if len(kept) > 10:
            kept = kept[-5:]
    assert {r["history_count"] for r in h.collect()} == {len(kept)} and {r["id"] for r in h.collect()} == {22, 23, 24}




def test_null_keys_are_a_group(many_chunks):
    rows = [(k, i) for i in range(40) for k in (None, "a")]
    df = many_chunks.createDataFrame(rows, "k string, i long").repartition(4)
    from memspark.operators import ordered

    got = ordered.row_numbers(df, ["k"], ["i"], "nth").collect()
    assert len(got) == 80 and all(r.nth == r.i + 1 for r in got)
    back = ordered.with_previous(df, ["k"], ["i"], {"before": "i"}).collect()
    assert len(back) == 80 and all(r.before == (r.i - 1 if r.i else None) for r in back)
