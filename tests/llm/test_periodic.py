"""Runs of repeated words against a plain search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from memspark.llm import periodic
from memspark.llm.queries import QUERIES, periodic_runs_query

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(words, length, exponent):
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(length, exponent * q):
                stretch = words[i : i + size]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((i, size, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made_text(r):
    words = [r.choice("abc" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randrange(0, 60))]
    for _ in range(r.randrange(0, 3)):
        part = [r.choice("abcd") for _ in range(r.randrange(1, 12))]
        words[len(words) // 2 : len(words) // 2] = (part * r.randrange(2, 7))[: -r.randrange(1, 4)]
    return words


@pytest.mark.parametrize("length,exponent", [(24, 3), (6, 3), (4, 2), (2, 2), (9, 2)])
def test_runs_equal_a_search_of_every_period(length, exponent):
    r = random.Random(length * 10 + exponent)
    texts = [made_text(r) for _ in range(150)] + [["a"] * 40, [], ["a"], ["a", "b"] * 30, ["a"] * 30 + ["b"] + ["a"] * 30]
    got = periodic.text_runs([[w.encode() for w in t] for t in texts], length, exponent)
    for t, runs in zip(texts, got, strict=True):
        assert runs == plain_runs(t, length, exponent)
        assert periodic.collapsed([w.encode() for w in t], runs).decode() == " ".join(plain_collapsed(t, runs))


def test_a_very_long_text_is_one_run():
    words = [b"x%d" % (i % 997) for i in range(300_000)]
    assert periodic.text_runs([words, [b"a"] * 100_000], 24, 3) == [[(0, 300_000, 997)], [(0, 100_000, 1)]]


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(plain_collapsed(words, runs)).encode()).hexdigest())


def test_the_query_equals_plain_python(spark):
    r = random.Random(3)
    rows = [(i, r.choice([" ", "\n", "\t ", "\x0b"]).join(made_text(r) * r.randrange(1, 4))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b " * 40), (1004, "no cut \x85 " * 30), (7, rows[7][1]), (2**40, "é " * 50)]
    docs = spark.createDataFrame([(k, t, 0, "p") for k, t in rows], "doc_id long, text string, runs int, n string").repartition(5)
    got = [tuple(x) for x in periodic_runs_query(docs).collect()]
    assert sorted(got, key=str) == sorted((plain_row(k, t) for k, t in rows), key=str)
    assert sum(x[1] > 0 for x in got) > 20


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a " * 50), (None, None)], "doc_id long, text string")
    assert sorted((x.n_words, len(x.runs), x.kept_text) for x in periodic.periodic_runs(docs).collect()) == [(0, 0, ""), (50, 1, "a")]
    assert sorted(x.n_runs for x in periodic_runs_query(docs).collect()) == [0, 1]
    assert periodic_runs_query(docs.limit(0)).collect() == []


def test_whole_documents_of_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count()
    assert all(got[k] == plain_row(k, t) for k, t in short.items())
