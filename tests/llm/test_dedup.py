"""Exact, line and near-duplicate removal against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from memspark.llm import exact_dedup, line_dedup, simhash
from memspark.llm.components import components


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.fixture
def docs(spark):
    r = random.Random(7)
    rows = [(i, r.choice(["same  text\nhere", "same text here", "other", "Other", "", None, " ", "x" * 70000, "x" * 69999 + "y", "a\u00a0b", f"own {i}"])) for i in range(120)]
    rows += [(5, rows[5][1]), (None, "other"), (None, None)]
    return spark.createDataFrame([(k, t, 0, "p", 1) for k, t in rows], "doc_id long, text string, size int, print string, row int").repartition(4)


@pytest.mark.parametrize("mask", [-1, 1, 0])
def test_exact_dedup_is_exact_even_if_fingerprints_lie(docs, mask):
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    groups = {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    got = exact_dedup.exact_dedup(docs, mask=mask).collect()
    want = sorted(((k, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_joins_keys_by_a_shuffle_beyond_the_bound(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs).drop("kept").collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", 1)
    monkeypatch.setattr(exact_dedup, "MEMBERS_PER_COPY", 2)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).drop("kept").collect())) == want


def test_fingerprints_compose():
    r = np.random.default_rng(0)
    powers = [exact_dedup._powers(*p, exact_dedup.CHUNK) for p in exact_dedup.POLYNOMIALS]
    data = r.integers(0, 256, 5000, dtype=np.uint8)
    whole = exact_dedup.chunk_hash(data, powers)
    for at in (1, 17, 4999):
        parts = (exact_dedup.shifted(exact_dedup.chunk_hash(data[:at], powers), 5000 - at), exact_dedup.chunk_hash(data[at:], powers))
        assert [sum(x) % p for x, (p, _) in zip(zip(*parts, strict=True), exact_dedup.POLYNOMIALS, strict=True)] == whole


def line_rule(rows, documents):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    found = {}
    for i, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            found.setdefault(key(line), set()).add(i)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(found[key(x)]) < documents]
        out.append((k, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup(spark, broadcast):
    r = random.Random(3)
    lines = ["Home | About", "home | about ", "\tHOME | ABOUT", "É", "é", "", "  ", "own", "a\x0bb", "Licensed"]
    rows = [(i, "\n".join(r.choice([*lines, f"line {i} {j}"]) for j in range(r.randint(0, 8)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, "Home | About\nx"), (61, None), (62, ""), (63, "Home | About\n" * 4000)]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, n_lines int, line string")
    got = line_dedup.line_dedup(df, documents=8, broadcast=broadcast)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_text"]
    assert sorted(map(tuple, got.collect()), key=str) == line_rule(rows, 8)
    digest = {r.doc_id: r.kept_sha256 for r in line_dedup.line_dedup(df, documents=8, digest=True, broadcast=broadcast).collect()}
    assert digest[61] == digest[62] == hashlib.sha256(b"").hexdigest()


def fingerprint_rule(text):
    import xxhash

    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_of_documents(spark):
    r = random.Random(11)
    words = ["Alpha", "beta", "gamma", "Delta", "É", "x\u00a0y", "omega", "pi"]
    base = [" ".join(r.choice(words) for _ in range(400)) for _ in range(8)]
    rows = [(i, t if r.random() < 0.3 else t.replace("beta", "zeta", 1)) for i, t in enumerate(base * 6)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "two words"), (104, "TWO\twords"), (7, rows[7][1]), (None, base[0])]
    df = spark.createDataFrame([(k, t, 1, "r") for k, t in rows], "doc_id long, text string, print int, root string")
    got = simhash.near_duplicates(df).collect()
    prints = [fingerprint_rule(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    least = {}
    for (k, _), c in zip(rows, label, strict=True):
        least[c] = min((x for x in (least.get(c), k) if x is not None), default=None)
    want = sorted(((k, f"{p:016x}", least[c]) for (k, _), p, c in zip(rows, prints, label, strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    stay = simhash.one_of_each(df, words=3)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(least.values()))


@pytest.mark.parametrize("budget", [0, 3, 6])
def test_trie_walk_finds_all_close_pairs(budget, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 8)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    r = np.random.default_rng(budget)
    centre = r.integers(0, 2**63, 40, dtype=np.uint64)
    noise = np.bitwise_or.reduce([np.uint64(1) << r.integers(0, 64, (40, 12), dtype=np.uint64) for _ in range(3)])
    left = np.unique(np.concatenate([centre, (centre[:, None] ^ noise).ravel()]))
    pairs = {(int(i), int(j)) for a, b in simhash.close_pairs(left, None, 0, budget) for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(left[:, None] ^ left[None, :]) <= budget
    assert pairs == {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j}
    right = np.unique(left ^ np.uint64(5))
    crossed = {(int(i), int(j)) for a, b in simhash.close_pairs(left, right, 0, budget) for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= budget
    assert crossed == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def test_deeper_cuts_give_the_same_components(spark, monkeypatch):
    r = np.random.default_rng(5)
    centre = r.integers(0, 2**63, 300, dtype=np.int64)
    prints = np.concatenate([centre, centre ^ (1 << r.integers(0, 62, 300)), centre ^ (7 << r.integers(0, 60, 300))])
    df = spark.createDataFrame([(int(x),) for x in prints], "print long")
    want = sorted(map(tuple, components(simhash.near_links(df)).collect()))
    monkeypatch.setattr(simhash, "NODE_ROWS", 20)
    assert sorted(map(tuple, components(simhash.near_links(df)).collect())) == want


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(400, 300), (300, 350), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 400: 300, 350: 300, 300: 300}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == line_dedup.line_dedup(empty).count() == simhash.near_duplicates(empty).count() == 0
