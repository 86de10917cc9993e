"""First-come rules against the sequential walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import cluster as cl
from memspark.operators import similarity as si


def star(rows):
    seeds, out = [], {}
    for i, tags in rows:
        hit = next((s for s, t in seeds if t & set(tags)), None)
        if hit is None:
            seeds.append((i, set(tags)))
        out[str(i)] = i if hit is None else hit
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("bound", [200_000, 0])
def test_star_clusters(spark, seed, bound, monkeypatch):
    monkeypatch.setattr(cl, "BROADCAST_ROWS", bound)
    r = random.Random(seed)
    tags = [f"t{i}" for i in range(12)]
    rows = [(i, r.sample(tags, r.randrange(0, 4)) + (["hot"] if r.random() < 0.3 else [])) for i in range(1, 60)]
    df = spark.createDataFrame([(str(i), i, t) for i, t in rows], "id string, ord long, tags array<string>").repartition(3)
    assert {x["id"]: x["seed"] for x in cl.star_clusters(df).collect()} == star(rows)


def test_star_is_not_transitive(spark):
    df = spark.createDataFrame([("A", 1, ["x"]), ("B", 2, ["x", "y"]), ("C", 3, ["y"]), ("D", 4, None)], "id string, ord long, tags array<string>")
    assert {x["id"]: x["seed"] for x in cl.star_clusters(df).collect()} == {"A": 1, "B": 1, "C": 3, "D": 4}


@pytest.mark.parametrize("size", [64, 640, 1_000_000])
def test_star_clusters_walk_in_prefixes(spark, size, monkeypatch):
    monkeypatch.setattr(cl, "WALK_TAGS", size)
    r = random.Random(size)
    rows = [(i, [f"c{i}", f"c{i + 1}"] + ([f"r{r.randrange(30)}"] if i % 5 == 0 else [])) for i in range(1, 160)]
    df = spark.createDataFrame([(str(i), i, t) for i, t in rows], "id string, ord long, tags array<string>").repartition(3)
    assert {x["id"]: x["seed"] for x in cl.star_clusters(df).collect()} == star(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = cl.materialize
    monkeypatch.setattr(cl, "materialize", lambda df: rounds.append(1) or real(df))
    i = F.col("id")
    df = spark.range(100_000).select(i.cast("string").alias("id"), i.alias("ord"), F.array(F.concat(F.lit("c"), i), F.concat(F.lit("c"), i + 1)).alias("tags"))
    got = cl.star_clusters(df)
    assert got.filter("seed = ord").count() == 50_000 and got.filter("seed <> ord - ord % 2").count() == 0
    assert len(rounds) < 30


def test_a_chain_of_vectors_is_walked(spark):
    turn = np.arange(3000) * 0.4
    df = spark.createDataFrame([(str(i), i, [float(np.cos(a) * (1 + i)), float(np.sin(a) * (1 + i))]) for i, a in enumerate(turn)], "id string, ord long, embedding array<double>")
    want = first_come([np.array([np.cos(a), np.sin(a)]) for a in turn], 0.95)
    assert {r["id"] for r in cl.dedupe_vectors(df, threshold=0.95, sweep=4).collect()} == want


def first_come(v, threshold):
    kept, out = [], set()
    for i, x in enumerate(v):
        if x is None or not np.any(x):
            out.add(str(i))
            continue
        u = x / np.linalg.norm(x)
        if all(round(float(u @ k), 9) < threshold for k in kept):
            kept.append(u)
            out.add(str(i))
    return out


@pytest.mark.parametrize("sweep", [2048, 5])
def test_dedupe_vectors(spark, sweep, monkeypatch):
    """A third of the rows are near copies of one vector, a tenth exact copies."""
    monkeypatch.setattr(si, "BLOCK_ROWS", 16)
    g = np.random.default_rng(4)
    base = g.normal(size=8)
    v = []
    for i in range(120):
        if i % 3 == 0:
            v.append(base + g.normal(size=8) * 0.02)
        elif i % 10 == 1 and i > 20:
            v.append(v[1])
        elif i % 17 == 5:
            v.append(None if i % 2 else np.zeros(8))
        else:
            v.append(g.normal(size=8))
    df = spark.createDataFrame([(str(i), i, None if x is None else x.tolist()) for i, x in enumerate(v)], "id string, ord long, embedding array<double>")
    assert {r["id"] for r in cl.dedupe_vectors(df.repartition(3), threshold=0.8, sweep=sweep).collect()} == first_come(v, 0.8)


def test_dedupe_chain(spark):
    a, b, c = [1.0, 0.0], [0.9, 0.436], [0.62, 0.785]
    df = spark.createDataFrame([("a", 1, a), ("b", 2, b), ("c", 3, c), ("n", 4, None)], "id string, ord long, embedding array<double>")
    assert {r["id"] for r in cl.dedupe_vectors(df, threshold=0.89).collect()} == {"a", "c", "n"}
