"""Near-duplicates by similarity, against all pairs of sets of shingles."""

import random

import numpy as np
import pytest

from memspark.llm import near_text, rows
from memspark.llm.components import components


def runs(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(r, text, times):
    w = text.split()
    for _ in range(times):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def table():
    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.choice([40, 150, 600]))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        texts += [changed(r, t, r.randrange(1, max(2, len(t.split()) // 30))) for _ in range(3)]
    texts += [base[0].upper(), base[1] + " one more end", None, "", " \n\t", "two words", "TWO\nwords", "other words"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (None, base[5]), (None, "only here " * 9)]


@pytest.mark.parametrize(("node", "part"), [(256, 20_000), (32, 12)])
def test_components_are_those_of_all_similar_pairs(spark, monkeypatch, node, part):
    monkeypatch.setattr(near_text, "NODE_TEXTS", node)
    monkeypatch.setattr(near_text, "PART_TEXTS", part)
    rows = table()
    sets, label = [runs(t) for _, t in rows], list(range(len(rows)))
    for _ in range(6):
        for i in range(len(rows)):
            for j in range(i):
                if alike(sets[i], sets[j]) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (k, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), k) if x is not None), default=None)
    df = spark.createDataFrame([(k, t, "r", 1) for k, t in rows], "doc_id long, text string, root string, print int")
    got = sorted(map(tuple, near_text.near_texts(df).collect()), key=str)
    want = sorted(((k, least[c]) for (k, _), c in zip(rows, label, strict=True)), key=str)
    assert len(set(label)) < len(rows) - 60
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= (0 if node == 256 else 4)  # with several tries, RECALL


def test_share_of_differing_bits_follows_the_similarity():
    r = np.random.default_rng(1)
    pool = r.integers(0, 2**63, 2000, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[111:1111])
    bits = np.bitwise_count(np.frombuffer(near_text.sketch(a), "<u8") ^ np.frombuffer(near_text.sketch(b), "<u8")).sum()
    assert abs(bits / 1024 - near_text.differing(889 / 1111)) < 0.045


def test_empty_table_and_one_group(spark):
    assert near_text.near_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = " ".join(f"w{i % 5000}" for i in range(30_000))
    rows = [(i, f"{long} {i}") for i in range(80)]
    got = near_text.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 80


def test_equal_sketches_of_unlike_texts_are_no_link(spark):
    """Of two shingles the smaller one decides every tie, so five of a text's six words often have its very sketch, at Jaccard 0.5."""
    texts = [" ".join(f"t{k}x{i}" for i in range(n)) for k in range(60) for n in (5, 6)]
    got = near_text.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_links_of_a_large_group_that_is_nearly_alike_are_all_settled(spark):
    """Pages of one template at 0.78; a few pairs at 0.81 whose sketches are no closer than chance makes those of many others."""
    template = " ".join(f"w{i}" for i in range(244))  # 240 shingles of 273
    tail = lambda k, n, m=0: " ".join([f"tail{k}x{i}" for i in range(n)] + [f"own{k}y{i}" for i in range(m)])
    texts = [f"{template} {tail(k, 33)}" for k in range(300)]
    texts += [f"{template} {tail(k, 4, 29)}" for k in range(0, 300, 10)]  # 244 of 302 shingles are shared
    sets = [runs(t) for t in texts]
    assert alike(sets[0], sets[300]) > 0.8 > alike(sets[0], sets[1])
    got = near_text.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    met = {r.doc_id: r.component_id for r in got}
    assert all(met[k] == k for k in range(300))
    assert sum(met[300 + n] == 10 * n for n in range(30)) >= 28  # RECALL


def test_sets_are_compared_outright_as_by_all_pairs():
    r = np.random.default_rng(5)
    base = [r.integers(0, 2**62, 40) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[r.random(40) < 0.93], np.arange(60)[: r.integers(0, 60)]])) for b in base for _ in range(9)]
    for part in (np.arange(108), np.arange(108) // 2):
        want = part.copy()
        for _ in range(8):
            for i in range(108):
                for j in range(i):
                    if alike(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6 or want[i] == want[j]:
                        want[(want == want[i]) | (want == want[j])] = min(want[i], want[j])
        got = part.copy()
        for i, j in zip(*near_text.alike(sets, part, 0.6), strict=True):
            assert got[i] != got[j] and alike(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.6
            got[(got == got[i]) | (got == got[j])] = min(got[i], got[j])
        assert (got == want).all() and 1 < len(set(want.tolist())) < len(set(part.tolist()))


@pytest.mark.parametrize("part", [1 << 20, 40])
def test_short_texts_at_the_threshold_are_all_linked(spark, monkeypatch, part):
    """Nine words and their first eight: five and four shingles, Jaccard exactly 0.8, but 192 differing bits on average."""
    monkeypatch.setattr(near_text, "NODE_TEXTS", 16)
    monkeypatch.setattr(near_text, "GROUP_SHINGLES", part)
    texts = [" ".join(f"t{k}x{i}" for i in range(n)) for k in range(60) for n in (8, 9)]
    texts += [f"one start for all {' '.join(f'u{k}x{i}' for i in range(20))}" for k in range(40)]
    got = near_text.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i - i % 2 if i < 120 else i for i in range(160)}


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_of_few_links_take_few_tasks(many_chunks, monkeypatch, few):
    """Each task leaves files and a line in the event log; with 100 parts a table this took 9,418 tasks before."""
    spark, sc = many_chunks, many_chunks.sparkContext
    monkeypatch.setattr(rows, "FEW_ROWS", few, raising=False)
    r = random.Random(6)
    nodes = r.sample(range(10**6), 60)
    links = spark.createDataFrame(list(zip(nodes, nodes[1:40] + nodes[41:], strict=False)), "a long, b long")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    sc.setJobGroup(f"few-{few}", "components of few links")
    try:
        got = {x.node: x.root for x in components(links).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        sc.setJobGroup("", "")
    stages = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(f"few-{few}") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert sum(s.numCompletedTasks for s in stages if s) < (1_500 if few else 4_000)
    first, want = {}, {}
    for a, b in zip(nodes, nodes[1:40] + nodes[41:], strict=False):
        x, y = want.get(a, a), want.get(b, b)
        first |= {a: 1, b: 1}
        want |= {n: min(x, y) for n in first if want.get(n, n) in (x, y)}
    assert got == want
