"""The joint tables of several language models, and the sample's independence of partitions."""

import random

import numpy as np
import pyarrow as pa

from memspark.llm import language_id


def some_words(r, alphabet, n):
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 9))) for _ in range(n)]


def test_joint_costs_equal_each_model():
    r = random.Random(4)
    models = [language_id.fit({w: r.randrange(1, 9) for w in some_words(r, a, 300)}, 12) for a in ("abcdef", "defghi", "aeiou")]
    joint, items = language_id.Joint(models), some_words(r, "abcdefghiouz", 200)
    want = np.column_stack([m.costs(items) for m in models])
    assert np.allclose(joint.costs(items), want, rtol=1e-5)


def test_remembered_units_change_nothing(monkeypatch):
    r = random.Random(5)
    joint = language_id.Joint([language_id.fit({w: 1 for w in some_words(r, "abc", 50)}, 5)])
    texts = [pa.array([" ".join(some_words(r, "abc", 30)) for _ in range(5)], pa.large_string()) for _ in range(6)]
    whole = language_id.Scorer(joint)
    want = [whole.entropies(t) for t in texts]
    monkeypatch.setattr(language_id, "CACHE_UNITS", 3)
    monkeypatch.setattr(language_id, "CACHE_WORDS", 3)
    small = language_id.Scorer(joint)
    for t, (bits, n) in zip(texts, want, strict=True):
        got = small.entropies(t)
        assert np.allclose(got[0], bits) and (got[1] == n).all()


def test_repartitioning_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ROWS", 20)
    r = random.Random(6)
    rows = [(i, " ".join(some_words(r, "abcd" if i % 2 else "cdef", 12)), "x" if i % 2 else "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    runs = [sorted(map(str, language_id.language_id(docs.repartition(n)).collect())) for n in (1, 6)]
    assert runs[0] == runs[1]
