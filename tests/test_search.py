"""Retrieval against brute force, on every physical path."""

import math
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.functions import vectors as vec
from memspark.operators import filters as fl
from memspark.operators import pruning as pr
from memspark.operators import search as se
from memspark.operators import similarity as si

WORDS = "red green blue one two three four five six hot".split()


def corpus_rows(n=200, seed=3):
    r = random.Random(seed)
    return [(f"d{i}", " ".join(["hot"] * (r.random() < 0.5) + r.choices(WORDS[:9], k=r.randrange(1, 9))), f"u{r.randrange(3)}") for i in range(n)]


QUERIES = [(1, "red blue", None), (2, "hot", "u1"), (3, "hot hot two", None), (4, "", None), (5, "absent red", None), (6, "six five four", "u2")]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(corpus_rows(), "id string, content string, user_id string").repartition(3)
    return df.withColumn("tokens", tx.tokens(F.col("content"))).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, text string, user_id string")


def bm25(match):
    docs = [(i, c.split(), u) for i, c, u in corpus_rows()]
    n, avg = len(docs), sum(len(t) for _, t, _ in docs) / len(docs)
    out = {}
    for qid, text, user in QUERIES:
        terms = sorted(set(text.split()))
        df = {t: sum(t in d for _, d, _ in docs) for t in terms}
        for i, d, u in docs:
            found = [t for t in terms if t in d]
            if not terms or (user and user != u) or not (found if match == "any" else len(found) == len(terms)):
                continue
            out[(qid, i)] = sum(
                math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d.count(t) * 2.2 / (d.count(t) + 1.2 * (0.25 + 0.75 * len(d) / avg)) for t in found
            )
    return out


@pytest.mark.parametrize("match", ["all", "any"])
@pytest.mark.parametrize("bound", [100_000, 0])
def test_fulltext(corpus, queries, match, bound, monkeypatch):
    """A bound of 0 forces the paths that shuffle both sides."""
    monkeypatch.setattr(se, "BROADCAST_ROWS", bound)
    hits = se.search_fulltext(corpus, queries, 10_000, match=match, scopes=["user_id"]).collect()
    want = bm25(match)
    assert {(r["query_id"], r["id"]) for r in hits} == set(want)
    assert all(abs(r["score"] - want[(r["query_id"], r["id"])]) < 1e-6 for r in hits)
    top = [r for r in hits if r["query_id"] == 1]
    assert [r["id"] for r in sorted(top, key=lambda r: r["rank"])] == [r["id"] for r in sorted(top, key=lambda r: (-r["score"], r["id"]))]


def covers(tokens, terms):
    spans = []
    for p in range(len(tokens)):
        for q in range(p, len(tokens)):
            if set(terms) <= set(tokens[p : q + 1]):
                spans.append((p, q))
                break
    return sum(min(1.0, len(terms) / (q - p + 1)) for p, q in spans if not any((a > p and b <= q) or (a >= p and b < q) for a, b in spans))


def test_cover_density(corpus, queries):
    hits = se.search_fulltext(corpus, queries, 10_000, ranker="cover_density").collect()
    text = {i: c.split() for i, c, _ in corpus_rows()}
    terms = {q: sorted(set(t.split())) for q, t, _ in QUERIES}
    assert hits and all(abs(r["score"] - covers(text[r["id"]], terms[r["query_id"]])) < 1e-6 for r in hits)


def vectors(n, d, seed):
    g = np.random.default_rng(seed)
    v = g.normal(size=(n, d))
    v[n // 2] = 0
    v[n // 3] = v[n // 4]
    return v


def nearest(v, q, k):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), where=np.linalg.norm(m, axis=1, keepdims=True) > 0, out=np.zeros_like(m))
    dist = np.round(1 - unit(v) @ unit(q).T, 9)
    return {j: [i for _, i in sorted((dist[i, j], f"v{i:03d}") for i in range(len(v)) if v[i].any())[:k]] for j in range(len(q)) if q[j].any()}


@pytest.mark.parametrize("bound", [1000, 2])
def test_vector_topk(spark, bound, monkeypatch):
    monkeypatch.setattr(si, "BLOCK_ROWS", 7)
    v, q = vectors(40, 5, 1), vectors(9, 5, 2)
    c = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, embedding array<double>")
    asked = spark.createDataFrame([(j, x.tolist()) for j, x in enumerate(q)] + [(99, None)], "query_id long, embedding array<double>")
    got = {}
    for r in si.vector_topk(c, asked, 4, max_broadcast=bound).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == nearest(v, q, 4)


def test_vector_filters_and_noise(spark):
    c = spark.createDataFrame(
        [("a", [1.0, 0.0], "u1", "tool_result", 0.3), ("b", [1.0, 0.1], "u1", "tool_result", 0.7), ("c", [1.0, 0.2], "u2", "general", 0.1),
         ("d", [1.0, 0.3], "u1", "tool_result", None)],
        "id string, embedding array<double>, user_id string, type string, importance double",
    )
    ask = lambda **kw: spark.createDataFrame([(1, [1.0, 0.0], kw.get("user_id"), kw.get("type"))], "query_id long, embedding array<double>, user_id string, type string")
    ids = lambda df: [r["id"] for r in si.vector_topk(c, df, 10).orderBy("rank").collect()]
    assert ids(ask()) == ["b", "c"]
    assert ids(ask(type="tool_result")) == ["a", "b", "d"]
    assert ids(ask(user_id="u2")) == ["c"]


def test_knn_within_blocks_equal_one_block(spark):
    v = vectors(50, 4, 5)
    rows = spark.createDataFrame([(f"v{i:03d}", x.tolist(), i % 2, i) for i, x in enumerate(v)], "id string, embedding array<double>, s int, t long")
    for kw in ({}, {"scope": ["s"]}, {"scope": ["s"], "earlier_by": "t"}):
        small = {tuple(r) for r in si.knn_within(rows, 3, block_rows=6, **kw).collect()}
        assert small and small == {tuple(r) for r in si.knn_within(rows, 3, **kw).collect()}
    n = {r["id"]: r for r in si.knn_within(rows, 1, earlier_by="t", block_rows=6).collect()}
    assert all(r["neighbour"] < i for i, r in n.items())


def test_pruned_neighbours_equal_all_pairs(spark):
    # Clusters of different width, copies, a zero and a null vector; scopes of very different size, one of them null.
    r = np.random.default_rng(3)
    near = np.concatenate([c + s * r.normal(size=(40, 24)) for c, s in zip(r.normal(size=(8, 24)), [0.02, 0.1, 0.3, 1] * 2)])
    v = [*near, *[near[0]] * 30, np.zeros(24)]
    scopes = [None if i % 50 == 7 else "big" if i % 3 else "small" for i in range(len(v))]
    rows = [(f"v{i:03d}", x.tolist(), s, i // 2) for i, (x, s) in enumerate(zip(v, scopes))] + [("none", None, "big", 5)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, s string, t long").repartition(3)
    for kw in ({}, {"min_similarity": 0.9}, {"scope": ["s"]}, {"scope": ["s"], "earlier_by": "t"}):
        want = sorted(tuple(x) for x in si.knn_within(df, 4, block_rows=1000, **kw).collect())
        got = sorted(tuple(x) for x in si.knn_within(df, 4, block_rows=16, prune_rows=0, **kw).collect())
        assert want and got == want, kw


def test_boxes_never_hide_a_near_row_and_hide_far_ones(spark):
    r = np.random.default_rng(4)
    v = pr.unit(np.concatenate([c + 0.05 * r.normal(size=(50, 16)) for c in r.normal(size=(8, 16))]))
    rows = spark.createDataFrame([(i, "", 0, x.tolist()) for i, x in enumerate(v)], "_row long, _scope string, _t long, embedding array<double>")
    seen, boxes = pr.blocked(rows, len(v), 32)
    block = {x["_row"]: x["_block"] for x in seen.collect()}
    ways = {(x["_row"], x["_target"]) for x in pr.routes(seen.withColumn("_least", F.lit(0.9)), boxes, False).collect()}
    i, j = np.nonzero(v @ v.T >= 0.9)
    assert {(a, block[b]) for a, b in zip(i.tolist(), j.tolist()) if block[a] != block[b]} <= ways
    assert len(ways) < 0.4 * len(v) * boxes.count()


def test_rank_fusion_values_and_ties(spark):
    a = spark.createDataFrame([(1, "x", 9.0, 1), (1, "y", 5.0, 2)], "query_id long, id string, score double, rank int")
    b = spark.createDataFrame([(1, "z", 0.1, 1), (1, "y", 0.2, 3)], "query_id long, id string, distance double, rank int")
    got = [(r["id"], round(r["rrf_score"], 6)) for r in se.rank_fusion(a, b).orderBy("position").collect()]
    assert got == [("y", round(1 / 62 + 1 / 63, 6)), ("x", round(1 / 61, 6)), ("z", round(1 / 61, 6))]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_literals_equal_a_plain_search(spark, bound, monkeypatch):
    monkeypatch.setattr(se, "BROADCAST_ROWS", bound)
    r = random.Random(8)
    letters = "ab\né😀 "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 150))) for _ in range(60)] + ["", None, "a" * 5000]
    needles = {t[i : i + n] for t in texts[:40] for i in (0, 3) for n in (1, 2, 3, 6, 7, 14, 15, 40, 70)} | {"", "zz", "a" * 100}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, low string").repartition(3)
    asked = spark.createDataFrame([(n, k) for k, n in enumerate(sorted(needles))] + [("ab", 999)], "literal string, number long")
    got = sorted({(x.id, x.literal, x.number) for x in se.literal_pairs(rows, asked).collect()})
    numbers = [(n, k) for k, n in enumerate(sorted(needles))] + [("ab", 999)]
    assert got == sorted((i, n, k) for i, t in enumerate(texts) for n, k in numbers if n == "" or n in (t or ""))


def test_few_and_many_literals_give_the_same_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "abcabc\nx"), (2, None), (None, "bca"), (1, "zz")], "id long, low string")
    asked = spark.createDataFrame([("bca", 1), ("", 2), (None, 3), ("c\nx", 4), ("bca", 5)], "literal string, number long")
    found = []
    for few in (1_000, 0):
        monkeypatch.setattr(se, "FEW_LITERALS", few)
        found.append({(r.id, r.low, r.literal, r.number) for r in se.literal_pairs(rows, asked).collect()})
    assert found[0] == found[1] and (None, "bca", "bca", 5) in found[0]


def test_few_literals_do_not_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(se, "_text_grams", None)
    rows = spark.createDataFrame([(1, "some text")], "id long, low string")
    asked = spark.createDataFrame([("me te",), ("none",)], "needle string")
    assert [tuple(r) for r in se.substring_hits(rows, asked).collect()] == [(1, "me te")]


@pytest.mark.parametrize("bound", [100_000, 0])
def test_substring_paths(spark, bound, monkeypatch):
    monkeypatch.setattr(se, "BROADCAST_ROWS", bound)
    docs = [("1", "Alpha 100 percent", "", 1), ("2", "beta 100% sure", None, 2), ("3", "gamma", "an ALPHA summary", 3), ("4", "a_b", "", 4), ("5", "axb", "", 5)]
    c = spark.createDataFrame(docs, "id string, content string, summary string, at int").withColumn("created_at", F.timestamp_seconds("at").cast("timestamp_ntz"))
    asked = {1: "alpha", 2: "100%", 3: "a_b", 4: "%", 5: "zzz", 6: "al%summ"}
    q = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    got = {}
    for r in se.search_substring(c, q, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
        assert r["total"] >= r["rank"]
    like = lambda p, s: re.search(p.replace("%", ".*").replace("_", ".").lower(), (s or "").lower(), re.S) is not None
    want = {k: [d[0] for d in sorted(docs, key=lambda d: -d[3]) if like(p, d[1]) or like(p, d[2])] for k, p in asked.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_any_token_counts_repeats_and_lists_all_for_blank(spark):
    docs = spark.createDataFrame([("a", "Head", "the cat"), ("b", "x", "dog the"), ("c", "y", "bird")], "id string, heading string, content string")
    q = spark.createDataFrame([(1, "the the dog"), (2, "  "), (3, "nothing")], "query_id long, text string")
    got = [(r["query_id"], r["id"], r["hits"], r["rank"], r["total"]) for r in se.search_any_token(docs, q, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "b", 3, 1, 2), (1, "a", 2, 2, 2), (2, "a", 0, 1, 3), (2, "b", 0, 2, 3)]


def test_sparse_and_dense_embeddings_agree(spark):
    df = spark.createDataFrame([(1, "Hello hello World é 你好 x_1"), (2, "b b b a")], "id long, t string")
    dense = {r["id"]: r["e"] for r in df.select("id", vec.hash_embedding(F.col("t")).alias("e")).collect()}
    for r in vec.hash_embedding_sparse(df, "id", "t").collect():
        assert abs(dense[r["id"]][r["dim"]] - r["weight"]) < 1e-12
    assert all(abs(np.linalg.norm(v) - 1) < 1e-12 for v in dense.values())
    blank = df.select(vec.embed_text(F.lit("  ")).alias("e"), vec.hash_embedding(F.lit("!!")).alias("z")).first()
    assert blank["e"] is None and not any(blank["z"])


def test_merge_scopes_keeps_first(spark):
    h = spark.createDataFrame([(1, 0, 2, "a"), (1, 0, 1, "b"), (1, 1, 1, "a"), (1, 1, 2, "c")], "query_id long, scope_rank int, rank int, id string")
    assert [r["id"] for r in fl.merge_scopes(h).orderBy("position").collect()] == ["b", "a", "c"]


def test_layered_recall_excludes_the_query_itself(spark):
    s = spark.createDataFrame([(1, 1, "old hi there"), (1, 2, "hi")], "query_id long, seq long, text string")
    q = spark.createDataFrame([(1, "hi")], "query_id long, text string")
    fused = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2)], "query_id long, id string, position int")
    c = spark.createDataFrame([("m1", "Hi memory", ["love"]), ("m2", "hi memory ", [])], "id string, content string, tags array<string>")
    mood = lambda tags: se.mood_weight(tags, F.lit(0.9), F.lit(0.0))
    got = [(r["layer"], r["id"], r["score"]) for r in se.layered_recall(s, fused, c, q, mood, 5).orderBy("position").collect()]
    assert got == [("preconscious", "m1", round((1 / 62 + 1 / 61) * 1.15, 4)), ("conscious", None, round(2 / 61, 4))]
    own = se.layered_recall(s, fused, c, q, mood, 5, include_self=True).filter("layer = 'conscious'").count()
    assert own == 2


def test_neighbour_search_writes_vectors_once_and_packed(spark, monkeypatch):
    # Sparse vectors as of texts, some equal, in many small blocks: what is written must not grow with the pairs of blocks.
    r = np.random.default_rng(9)
    v = np.where(r.random((300, 512)) < 0.1, r.integers(-2, 3, (300, 512)), 0).astype(float)
    v[200:] = v[r.integers(0, 40, 100)]
    df = spark.createDataFrame([(f"v{i:03d}", x.tolist(), i) for i, x in enumerate(v)], "id string, embedding array<double>, t long")
    written = []
    monkeypatch.setattr(si, "materialize", lambda d, f=si.materialize: written.append(f(d)) or written[-1])
    for kw in ({}, {"earlier_by": "t"}, {"min_similarity": 0.5}):
        written.clear()
        got = sorted(tuple(x) for x in si.knn_within(df, 4, block_rows=16, **kw).collect())
        m = si._unit(v)
        s = np.round(m @ m.T, si.DIGITS)
        want = []
        for i in range(300):
            near = [j for j in range(300) if j != i and (j < i or "earlier_by" not in kw) and s[i, j] >= kw.get("min_similarity", -2)]
            for rank, j in enumerate(sorted(near, key=lambda j: (-s[i, j], j))[:4], 1):
                want.append((f"v{i:03d}", f"v{j:03d}", s[i, j], rank))
        assert m.any(axis=1).all() and [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want)], kw
        assert np.allclose([x[2] for x in got], [x[2] for x in sorted(want)], atol=1e-9)
        (blocks,) = written
        assert sum(len(x["vectors"]) for x in blocks.select("vectors").collect()) < v.nbytes / 4


def test_vectors_are_made_and_searched_in_slices(spark, monkeypatch):
    # However many rows an Arrow batch holds, no more than a slice of it is a matrix at a time.
    texts = spark.range(700).repartition(1).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("word "), F.col("id") % 97).alias("t"))
    want = {r["id"]: r["e"] for r in texts.select("id", vec.hash_embedding(F.col("t"), 64).alias("e")).collect()}
    assert all(want[str(i)] == want[str(i + 97)] for i in range(600)) and want["1"] != want["2"]
    seen = []
    monkeypatch.setattr(si, "_search_block", lambda best, qs, qm, rows, m, f=si._search_block: seen.append(len(m)) or f(best, qs, qm, rows, m))

    class Local:
        """The rows of a frame as one batch, searched here."""
        sparkSession = spark

        def mapInArrow(self, search, schema):
            e = pa.array([want[str(i)] for i in range(700)], pa.list_(pa.float64()))
            cols = {"id": pa.array([str(i) for i in range(700)])} | {n: pa.nulls(700, pa.string()) for n in ("user_id", "agent_id", "type")}
            return pa.Table.from_batches(search([pa.RecordBatch.from_pydict(cols | {"importance": pa.nulls(700, pa.float64()), "embedding": e})])).to_pandas()

    asked = pd.DataFrame({"query_id": [1], "user_id": [None], "agent_id": [None], "type": [None], "exclude_noise": [False], "embedding": [want["5"]]})
    out = si._topk_broadcast(Local(), asked, 3, "")
    assert out.sort_values(["distance", "id"])["id"].tolist() == ["102", "199", "296"]
    assert sum(seen) == 700 and max(seen) <= si.SEARCH_ROWS


def test_equal_requests_are_searched_once(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", f"red w{i} {'blue' if i % 3 else 'green'}", f"u{i % 2}") for i in range(30)], "id string, text string, user_id string")
    corpus = docs.withColumn("tokens", tx.tokens(F.col("text"))).withColumn("embedding", vec.hash_embedding(F.col("text")))
    texts = ["red", "blue", None, "red blue"]
    asked = spark.createDataFrame([(i, texts[i % 4], [None, "u0"][i // 4 % 2]) for i in range(40)], "query_id long, text string, user_id string")
    plain = {tuple(r) for r in se._hybrid(corpus, asked, 5, 8, ("user_id",), "hash").collect()}
    counted = []
    monkeypatch.setattr(se, "search_fulltext", lambda c, q, k, f=se.search_fulltext, **kw: counted.append(q.count()) or f(c, q, k, **kw))
    got = {tuple(r) for r in se.hybrid_search(corpus, asked, limit=5, pool=8, scopes=("user_id",)).collect()}
    assert got and got == plain and counted == [8]
