"""Mixing of sources: targets against a plain loop, sums, expectations and repeatability of the rounding."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from memspark.llm import mixing
from memspark.llm.queries import QUERIES, mixing_query

SCHEMA = "doc_id long, text string, source string, target string, copy int"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, bound = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in bound]
        rest = total - sum(bound.values())
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / whole > most * sizes[s]]
        if not over:
            return {s: float(bound[s]) if s in bound else rest * weight[s] / whole for s in names}
        bound |= {s: most * sizes[s] for s in over}


def table(spark, sizes, parts=4):
    return spark.createDataFrame([(i, None if n is None else " ".join(["w"] * n), s, "t", 1) for i, n, s in sizes], SCHEMA).repartition(parts)


def rows_of(r, n, sources, longest=400):
    return [(i, r.choice([None, 0, r.randrange(1, longest), r.randrange(1, 40)]), r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"] * 30 + ["b", None], ["é", "z", "Z", "a", "ab", "", None, "😀", "￿"], [None]])
def test_targets_and_sums(spark, sources):
    r = random.Random(len(sources))
    sizes = rows_of(r, 700, sources)
    got = mixing.mix_sources(table(spark, sizes)).collect()
    assert sorted(x.doc_id for x in got) == list(range(700))
    by = collections.defaultdict(int)
    for _, n, s in sizes:
        by[s] += n or 0
    want = plain_targets(by)
    for x in got:
        assert x.size == (sizes[x.doc_id][1] or 0) and x.source_size == by[x.source] and x.target == pytest.approx(want[x.source], rel=1e-9, abs=1e-9)
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 3
    for s in by:
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - want[s]) <= max(40, by[s] / 200)


def test_runs_agree_whatever_the_partitions(spark):
    sizes = rows_of(random.Random(1), 500, ["a", "b", "b", "b", None])
    sizes += sizes[:50] + [(None, 5, "a"), (None, 5, "a"), (None, None, None)]
    runs = [sorted(map(str, mixing.mix_sources(table(spark, sizes, n)).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def test_a_hot_source_takes_several_levels_of_the_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    monkeypatch.setattr(mixing, "HEAVY", 1 / 50)
    sizes = [(i, 1 + i % 50, "hot" if i % 10 else "cold") for i in range(3000)]
    got = mixing.mix_sources(table(spark, sizes)).collect()
    for s in ("hot", "cold"):
        mine = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= 50


def test_copies_are_right_on_average(spark):
    sizes = [(i, 3 + 7 * (i % 9), "a" if i % 3 else "b") for i in range(60)]
    docs = table(spark, sizes, 1).cache()
    seen, runs = collections.defaultdict(float), 5
    for k in range(runs):
        for x in mixing.mix_sources(docs, seed=f"s{k}").collect():
            seen[x.source, x.size] += x.copies / runs
    for s in "ab":
        own = [n for _, n, q in sizes if q == s]
        rate = plain_targets({q: sum(n for _, n, w in sizes if w == q) for q in "ab"})[s] / sum(own)
        for n in set(own):
            assert abs(seen[s, n] / own.count(n) - rate) < 0.5


def test_word_counts_and_odd_tables(spark):
    texts = ["a  b\n\tc", "a b c", " ", "", None, "\x0bx\x0c", "e f"]
    docs = spark.createDataFrame([(i, t, "s", "x", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {x.doc_id: x.size for x in mixing.mix_sources(docs).collect()} == {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(texts)}
    assert mixing_query(docs.limit(0)).collect() == []
    blank = docs.withColumn("text", F.lit(""))
    assert {(x.size, x.source_size, x.target, x.taken) for x in mixing.mix_sources(blank).collect()} == {(0, 0, 0.0, 0)}


def test_no_python_in_the_plan_and_whole_tables(spark):
    got = QUERIES["op13_mix_sources"](spark, "/root/testdata/sf0.001")
    assert got.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "InArrow", "CartesianProduct"))
