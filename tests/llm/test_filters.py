"""Language identification, personal data, URL filters and search against plain Python."""

import math
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from memspark.llm import language_id, pii, top_k, url_filter


def test_model_is_a_distribution_over_next_characters():
    counts = {"the": 50, "then": 9, "that": 20, "cat": 3, "catch": 2, "hat": 4, "ten": 1}
    alphabet = sorted({c for w in counts for c in w})
    model = language_id.fit(counts, len(alphabet) + 1)
    # The chances of all letters and of the end after a prefix sum to 1 over the alphabet of the floor.
    for prefix in ("", "th", "ca", "zz"):
        before = model.costs([prefix + a for a in alphabet])
        ends = model.costs([prefix])
        chars, at = language_id._codes([prefix + a for a in alphabet])
        assert len(before) == len(alphabet) and ends[0] > 0 and len(at) == len(alphabet)
    assert model.costs(["the"])[0] < model.costs(["hte"])[0] < model.costs(["qxz"])[0]


def naive_cost(counts, alphabet, word, order=language_id.ORDER):
    """Interpolated Kneser-Ney by dictionaries, with the same discounts."""
    seqs = [("\x01" * (order - 1) + w + "\x02", c) for w, c in counts.items()]
    top = {}
    for s, c in seqs:
        for i in range(order - 1, len(s)):
            top[s[i - order + 1 : i + 1]] = top.get(s[i - order + 1 : i + 1], 0) + c
    tables = {order: top}
    every = {n: {s[i - n + 1 : i + 1] for s, _ in seqs for i in range(order - 1, len(s))} for n in range(1, order + 1)}
    for n in range(order - 1, 0, -1):
        tables[n] = {}
        for g in every[n + 1]:
            tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1

    def p(n, context, c):
        if n == 0:
            return 1 / alphabet
        t = tables[n]
        ones, twos = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        context = context[len(context) - (n - 1) :] if n > 1 else ""
        follow = {g: v for g, v in t.items() if g[:-1] == context}
        below = p(n - 1, context[1:], c)
        if not follow:
            return below
        total = sum(follow.values())
        return max(follow.get(context + c, 0) - d, 0) / total + d * len(follow) / total * below

    s = "\x01" * (order - 1) + word + "\x02"
    return sum(-np.log2(p(order, s[:i], s[i])) for i in range(order - 1, len(s)))


def test_costs_equal_a_naive_model():
    counts = {"the": 5, "then": 2, "that": 3, "cat": 1, "été": 2, "hat": 1}
    model = language_id.fit(counts, 12)
    words = ["the", "cat", "thing", "été", "x", "hatthe"]
    assert np.allclose(model.costs(words), [naive_cost(counts, 12, w) for w in words])


def test_language_id_on_odd_rows(spark):
    r = random.Random(0)
    say = {"en": "the house and this thing with that were have when".split(), "de": "das haus und nicht eine schön über für auch wenn".split()}
    rows = [(i, " ".join(r.choice(say[k]) for _ in range(60)), k) for i in range(300) for k in [r.choice(["en", "de"])]]
    rows += [(1000, None, "en"), (1001, "12 34 ²", "de"), (1002, "", None), (None, "the house and", "en"), (1003, "das haus", None), (5, *rows[5][1:])]
    df = spark.createDataFrame([(*x, 1.0, "q") for x in rows], "doc_id long, text string, lang string, score double, accepted string")
    out = language_id.language_id(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 and not got[k].accepted for k in (1000, 1001, 1002))
    assert got[1003].lang_pred == "de" and got[None].lang_pred == "en" and got[None].held_out is False
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    assert all(got[k].lang_pred == lang and got[k].accepted and 0.5 < got[k].score <= 1 for k, _, lang in rows[:300])
    none = language_id.language_id(df.withColumn("lang", df.lang.substr(1, 0)).filter("lang = 'x'"))
    assert none.count() == 0
    unlabelled = language_id.language_id(df.drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(docs).join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) > 0.98
    assert np.mean([r.accepted for r in out]) > 0.97


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(d):
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for nth, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}
            if ok[kind]():
                out.append((m.start(), nth, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii_base_spans_equal_plain_regexes(spark):
    r = random.Random(3)
    bits = ["a@b.co", "@", ".", "1", "23", " ", "+", "(", "-", "é😀", "4111111111111111", "255", "256", "x_y", "%", "1.2.3.4", " 00", "\n", "call ", "2125551234", "(212) 555-1234"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(500)]
    rows += [(1000, None), (1001, ""), (1002, "1" * 30000), (1003, "a@b.co " * 500), (None, "x 1.2.3.4"), (4, rows[4][1])]
    df = spark.createDataFrame([(*x, 0, "s") for x in rows], "doc_id long, text string, spans int, kind string")
    got = pii.pii_report(df).collect()
    digest = lambda t: hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == sorted((str(k), digest(t)) for k, t in rows)
    of = {k: t for k, t in rows}
    for r in got:
        spans, base = r.spans.split(",") if r.spans else [], base_spans(of[r.doc_id])
        assert set(base) <= set(spans)
        assert r.n_email == sum(s.startswith("email") for s in base) and r.n_phone == sum(s.startswith("phone") for s in base)
    assert pii.pii_report(df.limit(0)).count() == 0


def test_em_trusts_labelers_that_agree_with_the_rest():
    names = len(pii.LABELERS)
    good, bad = tuple([1] * names), (-1, -1, -1, 1, -1)
    patterns = [("phone", good, 500), ("phone", bad, 400), ("phone", (1, 1, 1, 1, 0), 50), ("phone", (-1, -1, 0, 1, -1), 50)]
    _, chance, post = pii.reliabilities(patterns)
    assert post["phone", good] > 0.99 and post["phone", bad] < 0.01
    assert chance[0][1][True] > 0.9 > 0.1 > chance[0][1][False]
    assert abs(chance[3][1][True] - chance[3][1][False]) < 0.1  # says the same of everything
    weights = pii.classifier([(k, v, 1, c) for k, v, c in patterns], post)
    odds = lambda v: sum(weights.get(f, 0) for f in pii.features("phone", v, 1))
    assert odds(good) > 2 and odds(bad) < -2


def test_masked_texts(spark):
    rows = [(1, "write a@b.co or +1 (212) 555-1234."), (2, None), (3, "clean é"), (4, "1.2.3.4"), (5, "")]
    df = spark.createDataFrame([(k, t, 9) for k, t in rows], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in pii.mask_pii(df).collect()}
    assert got == {1: "write <email> or <phone>.", 2: None, 3: "clean é", 4: "<ip>", 5: ""}


URLS = ["http://A.Example.org/es/1", "https://example.org/en/12", "https://example.org/en/2", "ftp://x.com/fr/", "http://notcom/fr/1", "http://x.com/de/9?q=/fr/", "http://org", "http://org/", "http://y.net/a/5", "nothing", "", None, "http://org?x", "a://b://c/d", "http://evilexample.org/es/1", "HTTP://X.COM#/fr/"]


def url_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_parts_and_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate([*URLS, *URLS[:3]])] + [(None, URLS[0], "h")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    of = {k: u for k, u, _ in rows}
    for r in got:
        host, path, rule, verdict = url_rule(of[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_generalise_and_reject_by_purity(spark):
    urls = [f"http://shop.example/item/{w}{i}x/view" for i in range(60) for w in ("red", "blue")]
    urls += [f"http://ads.bad.example/click/{i}" for i in range(40)] + [f"http://ads.bad.example/about/{i}" for i in range(40)]
    urls += [f"http://ads.bad.example/click/{i}.html" for i in range(5)]
    rules = [("bad.example", "/click/1", "block"), ("bad.example", "/click/2", "block"), ("bad.example", "/about/1", "allow"), ("bad.example", "/about/2", "allow"), ("shop.example", "/item/red1", "allow")]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_filter.judge_urls(rows, rules=rules).collect()}
    assert got["http://ads.bad.example/click/35"].verdict == "block" and got["http://ads.bad.example/click/35"].rule is None
    assert got["http://ads.bad.example/about/35"].verdict == "allow"
    assert got["http://shop.example/item/blue33x/view"].template == "shop.example/item/*/view"
    assert got["http://shop.example/item/blue33x/view"].verdict == "allow"


def best_rows(rows, k=5, every=50):
    """Brute force by rows of (id, vector)."""
    whole = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        (query,) = {tuple(v) for i, v in whole if i == q}
        scored = sorted(((-int(np.dot(query, v)), i) for i, v in whole if i != q and len(v) == len(query)))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return out


@pytest.mark.parametrize(("scale", "blocks"), [(1.0, 10_000), (40.0, 90), (1e-3, 70)])
def test_top_k_equals_brute_force(spark, scale, blocks):
    r = np.random.default_rng(int(scale * 10))
    rows = [(i, (scale * r.normal(size=6)).tolist()) for i in range(400)]
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (None, [1.0] * 6)]
    rows += [(600 + i, rows[3][1]) for i in range(20)] + [(650, [0.0] * 6), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    got = top_k.top_k(df, index_rows=blocks, query_rows=4)
    assert sorted(map(tuple, got.collect())) == best_rows(rows)
    assert top_k.top_k(df.limit(0)).count() == 0


def test_few_rows_are_candidates():
    r = np.random.default_rng(1)
    values = np.floor(256 * r.normal(size=(5000, 64)) / 8).astype(np.int64)
    index = top_k.SlicedIndex(values)
    sizes = [len(index.candidates(values[i], 5)) for i in range(20)]
    assert max(sizes) < 500
    for i in range(20):
        score = values @ values[i]
        assert set(np.argsort(-score)[:5]) <= set(index.candidates(values[i], 5))


def test_alike_siblings_are_pooled_and_one_label_blocks_nothing_else(spark):
    urls = [f"http://a.example/x/s{chr(97 + i)}/p{j}" for i in range(10) for j in "uv"] + [f"http://a.example/y/t{chr(97 + i % 26)}/q{i}" for i in range(40)]
    rules = tuple(("a.example", f"/x/s{chr(97 + i)}/pu", "block") for i in range(10)) + (("a.example", "/y/", "allow"),)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r for r in url_filter.judge_urls(rows, rules=rules).collect()}
    assert all(got[f"http://a.example/x/s{chr(97 + i)}/pv"].verdict == "block" for i in range(10))
    one = spark.createDataFrame([(1, "http://b.example/ads/1"), (2, "http://c.example/x"), (3, None), (4, "http://a.net//b///c/d/e"), (5, "http://a.net/" + "k/" * 5000)], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judge_urls(one, rules=(("b.example", "/ads/", "block"),)).collect()}
    assert [found[k].verdict for k in (1, 2, 3)] == ["block", "allow", "allow"]
    assert found[4].template == "a.net/b/c/d/e" and found[5].template == "a.net/k/k/k/k/**"


def test_top_k_of_large_components_is_exact(spark):
    r = random.Random(2)
    size = lambda: r.choice([1.0, 1e3, 1e9, 1e14, 1e30])
    rows = [(i, [r.uniform(-1, 1) * size() for _ in range(4)]) for i in range(120)]
    got = top_k.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), index_rows=40).collect()
    x = {i: [max(-(2**57), min(2**57, math.floor(256 * v))) for v in e] for i, e in rows}
    for q in (0, 50, 100):
        best = sorted(((-sum(a * b for a, b in zip(x[q], x[i], strict=True)), i) for i in x if i != q))[:5]
        mine = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [(k, i) for k, i, _ in mine] == [(k + 1, i) for k, (_, i) in enumerate(best)]
        assert [s for _, _, s in mine] == [-s if abs(s) < 2**63 else None for s, _ in best]
