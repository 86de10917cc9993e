"""What must not grow with the rounds of a loop, or with the rows that a task is given."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf

from memspark.llm.components import components
from memspark.operators import cluster as cl
from memspark.operators import graph as gr
from memspark.operators import search as se
from memspark.operators import similarity as si
from memspark.session import materialize


def test_size_estimates_do_not_grow_with_rounds(spark):
    df = spark.range(8).toDF("a")
    for _ in range(8):
        df = materialize(df.join(df.withColumnRenamed("a", "b"), df["a"] == df["a"] + 0).select("a").distinct())
    assert sorted(r[0] for r in df.collect()) == list(range(8))
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64


def test_components_of_a_chain_in_many_rounds(spark):
    names = list(range(1000))
    random.Random(1).shuffle(names)
    made = components(spark.createDataFrame(list(zip(names, names[1:])), "a long, b long"))
    assert made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 64
    assert sorted(map(tuple, made.collect())) == [(n, 0) for n in range(1000)]


def test_small_scopes_give_few_blocks_and_vectors_are_made_once(spark, monkeypatch):
    # 20 scopes of 40 rows each, one of 800: with blocks of 16 rows, a scope is cut as its size asks, not once for each leaf.
    r = np.random.default_rng(6)
    v = r.normal(size=(1600, 12))
    made = spark.sparkContext.accumulator(0)

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def embed(i: pa.Array) -> pa.Array:
        made.add(len(i))
        return pa.array([v[x].tolist() for x in i.to_pylist()], pa.list_(pa.float64()))

    n = F.col("id")
    df = spark.range(1600).select(n.cast("string").alias("id"), embed(n).alias("embedding"), F.when(n < 800, "all").otherwise((n % 20).cast("string")).alias("s"), n.alias("t"))
    written = []
    monkeypatch.setattr(si, "materialize", lambda d, f=si.materialize: written.append(f(d)) or written[-1])
    for kw in ({"earlier_by": "t"}, {"min_similarity": 0.5}):
        want = sorted(tuple(x) for x in si.knn_within(df, 3, scope=["s"], block_rows=1000, **kw).collect())
        before = made.value
        got = si.knn_within(df, 3, scope=["s"], block_rows=16, prune_rows=0, **kw)
        assert made.value - before <= 1600 + 1600  # the sample on which axes are fitted is all rows of so small a table
        assert sorted(tuple(x) for x in got.collect()) == want
        blocks = written[-1].groupBy("_scope").count()
        assert blocks.filter("_scope not like '%all%'").agg(F.max("count")).first()[0] <= 8


@pytest.mark.parametrize("bound", [100_000, 0])
def test_walks_write_a_row_for_an_entity_not_for_each_query(spark, bound, monkeypatch):
    # 90 walks over a hub, its 150 leaves and a ring; each is asked by three queries, some of two starts, one of a null.
    monkeypatch.setattr(gr, "BROADCAST_ROWS", bound, raising=False)
    monkeypatch.setattr(gr, "HUB_LINKS", 100, raising=False)
    links = [("hub", f"v{i}") for i in range(150)] + [(f"v{i}", f"v{(i + 1) % 150}") for i in range(150)] + [("v3", "v3"), ("v5", "x"), ("x", "y")]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = {q: ({f"v{q % 90}", "y"} if q % 30 == 0 else {f"v{q % 90}"}) for q in range(270)} | {300: {None}}
    want = set()
    for q, starts in asked.items():
        seen, front = set(starts), set(starts)
        want |= {(q, s, 0) for s in starts}
        for d in (1, 2):
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front
            want |= {(q, y, d) for y in front}
    written = []
    monkeypatch.setattr(gr, "materialize", lambda d, f=gr.materialize: written.append(f(d)) or written[-1])
    relations = spark.createDataFrame([(a, b, f"{a}>{b}", "to", 1.0) for a, b in links], "source_id string, target_id string, relation_id string, relation_type string, weight double")
    starts = spark.createDataFrame([(q, s) for q, ids in asked.items() for s in ids], "query_id long, id string")
    got = [tuple(r) for r in gr.neighbours_by_depth(None, relations, starts, 2).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(w.count() for w in written) < 1200


def test_block_search_copies_nothing_for_pairs_of_blocks(spark, monkeypatch):
    # 200 queries and 300 rows in blocks of 16: some 250 pairs of blocks, but each vector is written once and packed.
    monkeypatch.setattr(si, "BLOCK_ROWS", 16)
    r = np.random.default_rng(8)
    v = np.where(r.random((500, 256)) < 0.1, r.integers(-2, 3, (500, 256)), 0).astype(float)
    c = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v[:300])], "id string, embedding array<double>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v[300:])], "query_id long, embedding array<double>")
    want = sorted(tuple(x) for x in si.vector_topk(c, q, 5).collect())
    written = []
    monkeypatch.setattr(si, "materialize", lambda d, f=si.materialize: written.append(f(d)) or written[-1])
    got = si.vector_topk(c, q, 5, max_broadcast=0)
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) == 1000
    assert sum(len(x["vectors"]) for w in written for x in w.select("vectors").collect()) < v.nbytes / 4
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_recall_does_not_deal_texts_out_by_query(spark):
    talk = spark.createDataFrame([(q, t, "red sky" if t else "a RED sun") for q in range(3) for t in range(3)], "query_id long, seq int, text string")
    corpus = spark.createDataFrame([("a", "Red sky ", ["x"]), ("b", "blue", ["src1"]), ("c", "blue", []), ("d", " ", [])], "id string, content string, tags array<string>")
    fused = spark.createDataFrame([(q, i, p + 1) for q in range(3) for p, i in enumerate("abcd")], "query_id long, id string, position int")
    ask = spark.createDataFrame([(q, "red") for q in range(3)], "query_id long, text string")
    out = se.layered_recall(talk, fused, corpus, ask, lambda t: F.when(F.array_contains(t, "src1"), 0.15).otherwise(0.0), 3)
    got = sorted((r["query_id"], r["position"], r["layer"], r["id"], r["content"]) for r in out.collect())
    assert [x[1:] for x in got if x[0] == 1] == [(1, "preconscious", "b", "blue"), (2, "conscious", None, "a RED sun"), (3, "conscious", None, "red sky")]
    plan = out.select("query_id", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(" in plan and all("tags" not in x.split(")")[0] for x in plan.split("collect_list(struct(")[1:])


def test_rounds_of_near_duplicates_write_no_vectors(spark, monkeypatch):
    # 400 rows, most of them kept, in rounds of 20: vectors are coded once and packed once, however many rounds there are.
    r = np.random.default_rng(11)
    v = r.normal(size=(400, 16))
    v[200:300] = v[r.integers(0, 200, 100)] + 0.01 * r.normal(size=(100, 16))
    v[300:320] = v[:20]
    monkeypatch.setattr(si, "BLOCK_ROWS", 32)
    written = []
    monkeypatch.setattr(cl, "materialize", lambda d, f=cl.materialize: written.append(d.columns) or f(d))
    df = spark.createDataFrame([(f"v{i}", 3 * i, x.tolist()) for i, x in enumerate(v)], "id string, ord long, embedding array<double>")
    got = {x["id"] for x in cl.dedupe_vectors(df.repartition(3), threshold=0.95, sweep=20).collect()}
    u, want = v / np.linalg.norm(v, axis=1, keepdims=True), []
    for i in range(400):
        if not want or (np.round(u[want] @ u[i], 9) < 0.95).all():
            want.append(i)
    assert got == {f"v{i}" for i in want} and 150 < len(want) < 300
    assert len(written) == 2 and "embedding" not in written[0] + written[1]
