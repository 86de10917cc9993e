"""Hand-made cases for text, files, lifecycle, consolidation, export and context."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.functions import text as tx
from memspark.functions.time import clamp, ntz
from memspark.functions import vectors as vec
from memspark.operators import affect as af
from memspark.operators import consolidate as co
from memspark.operators import context as cx
from memspark.operators import filters as fl
from memspark.operators import graph as gr
from memspark.operators import lifecycle as lc
from memspark.operators import profile as pr
from memspark.operators import stale as st
from memspark.sources import events as ev
from memspark.sources import export as ex
from memspark.sources import files as fi
from memspark.sources import rows as ro

NOW = dt.datetime(2024, 1, 31)
def as_of():
    return ntz("2024-01-31 00:00:00")



def ago(days):
    return NOW - dt.timedelta(days=days)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ask(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_tokens(spark):
    got = ask(spark, ["Hello, wörld_1 x", "你好吗 ok", "", None, "—"], tx.tokens)
    assert got == [["hello", "wörld_1", "x"], ["你", "好", "吗", "你好", "好吗", "ok"], [], [], []]


def test_title_slug_estimate(spark):
    df = spark.createDataFrame([("", "  first\nsecond", "0123456789"), ("sum\nx", "c", "1"), (None, " \n ", "0123456789")], "s string, c string, i string")
    assert [r[0] for r in df.select(tx.title(F.col("s"), F.col("c"), F.col("i"))).collect()] == ["first", "sum", "Memory 01234567"]
    assert ask(spark, ["  Hi — There!! ", "...", "a" * 70, "x" * 59 + " yy"], tx.slug) == ["hi-there", "untitled", "a" * 60, "x" * 59]
    assert ask(spark, ["", "abc", "abcdefghi", None], tx.token_estimate) == [0, 1, 2, 0]


def test_bigrams(spark):
    j = one(spark, tx.jaccard(tx.bigram_set(F.lit("Abc ")), tx.bigram_set(F.lit("abc"))), tx.jaccard(tx.bigram_set(F.lit("x")), tx.bigram_set(F.lit("x"))),
            tx.jaccard(tx.bigram_set(F.lit("abcd")), tx.bigram_set(F.lit("abce"))))
    assert tuple(j) == (1.0, 1.0, 0.5)


def test_headline(spark):
    rows = [
        ("tool_result", "good", "x"), ("g", " a  b ", "x"), ("g", "", '{\n[\nstatus: x\n- - Candidate: real text {"id":1\nmore'), ("g", "", "confidence: 1\n---"),
        ("g", '[emotion] {"type":1', "fallback → session: abc"), (None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, c string").orderBy("i")
    got = [r[0] for r in df.select(tx.headline(F.col("t"), F.col("s"), F.col("c"))).collect()]
    assert got == [None, "a b", "real text", None, "fallback", None]


def test_redact_and_labels(spark):
    assert ask(spark, ["the User said sk-abcdefghijklmnop1234 now", None], tx.redact) == ["the said *** now", ""]
    assert ask(spark, ['a"b[c]|d\ne', "  "], tx.graph_label) == ["a'b(c)/d e", "?"]
    assert ask(spark, ["a\x00b\x01c\nd\te"], tx.clean_control) == ["ab c\nd\te"]
    assert ask(spark, ["x\n来源记忆 (2): a, b\ny", "none"], tx.source_ids) == [["a", "b"], []]
    assert ask(spark, ["摘要: 总结： hi  there", "plain"], lambda c: tx.strip_prefixes(c, lx.SUMMARY_PREFIXES)) == ["hi there", "plain"]


def test_timestamps(spark):
    got = ask(spark, ["2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00Z", "2024-01-01T10:00:00", "no", None], tx.iso_to_utc)
    assert got == [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 10), None, None]


def test_snippet(spark):
    text = "0123456789" * 10 + " needle " + "abcdefghij" * 10
    got = ask(spark, [text, "short", ""], lambda c: tx.snippet(c, F.lit("needle"), 30))
    assert got[0].startswith("1234567") or "needle" in got[0]
    assert got[0].endswith("…") and len(got[0]) <= 31 and got[1:] == ["short", ""]


def test_clamp_keeps_null(spark):
    assert tuple(one(spark, clamp(F.lit(None).cast("double")), clamp(F.lit(2.0)), clamp(F.lit(-1.0)))) == (None, 1.0, 0.0)


FILES = [
    ("a/x.md", "---\ntitle: From Front\ntags: [One, two]\nimportance: 3\n---\n# Head ##\n\n## two\ntext"), ("a/y.md", "# Only Head\nbody"),
    ("b/z.md", "no heading"), ("b/w.md", "---\n: [broken\n---\nrest"), ("b/v.md", "---\ntags: p, q r\nimportance: -1\ntype: page\n---\nplain"),
]


def test_parse_markdown(spark):
    df = spark.createDataFrame(FILES, "path string, text string")
    p = fi.parse_markdown(df, "text", F.regexp_extract("path", "([^/]*)\\.md$", 1))
    got = {r["path"]: (r["title"], r["tags"], r["body"], r["meta"]["valid"]) for r in p.collect()}
    assert got["a/x.md"] == ("From Front", ["One", "two", "Head"], "# Head ##\n\n## two\ntext", True)
    assert got["a/y.md"][:2] == ("Only Head", ["Only Head"]) and got["b/z.md"][0] == "z"
    assert got["b/w.md"][0] == "w" and got["b/w.md"][3] is False and got["b/v.md"][1] == ["p", "q", "r"]
    m = {r["path"]: r for r in fi.to_memories(p, F.regexp_extract("path", "^([^/]*)/", 1)).collect()}
    assert m["a/x.md"]["importance"] == 1.0 and m["b/v.md"]["importance"] == 0.0 and m["b/z.md"]["importance"] == 0.5
    assert m["b/z.md"]["content"] == "# z\n\nno heading" and m["b/z.md"]["tags"] == ["b"] and m["b/v.md"]["type"] == "page"


def test_scan_files(spark, tmp_path):
    for name in ("a.md", "b.txt", "x/c.md", ".git/d.md", "x/e.markdown"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text(name)
    got = fi.scan_files(spark, [str(tmp_path)], ["*.md", "*.markdown"], [".git"])
    assert sorted(r["name"] for r in got.collect()) == ["a.md", "c.md", "e.markdown"]


def test_diff_upsert_delete(spark):
    now = spark.createDataFrame([("p1", "h1"), ("p2", "h2x"), ("p3", "h3"), ("p4", "h4")], "path string, hash string")
    state = spark.createDataFrame([("p1", "h1", "stored"), ("p2", "h2", "stored"), ("p3", "h3", "error")], "path string, hash string, status string")
    assert {r["path"]: r["change"] for r in fi.diff_files(now, state).collect()} == {"p1": "unchanged", "p2": "changed", "p3": "changed", "p4": "new"}
    shape = "collection string, path string, content_hash string, title string, embedding array<double>"
    t = spark.createDataFrame([("c", "1", "h", "old", [1.0]), ("c", "2", "h", "old", [2.0]), ("c", "3", "h", "old", [3.0])], shape)
    s = spark.createDataFrame([("c", "1", "h", "new", None), ("c", "2", "g", "new", None), ("c", "4", "h", "new", [4.0])], shape)
    got = {r["path"]: (r["action"], r["title"], r["embedding"]) for r in fi.upsert_documents(t, s).collect()}
    assert got == {"1": ("unchanged", "old", [1.0]), "2": ("update", "new", [2.0]), "3": ("kept", "old", [3.0]), "4": ("insert", "new", [4.0])}
    other = spark.createDataFrame([("d", "9", "h", "x", None)], shape)
    assert {r["path"] for r in fi.delete_missing(t.unionByName(other), s).collect()} == {"1", "2", "9"}


def test_new_memories(spark):
    df = spark.createDataFrame([("u", "text", 0.4, None, [1.0]), ("u", "", None, None, None), ("u", "t", 1.2, None, None), ("u", "t", None, "gone", None)],
                               "user_id string, content string, importance double, status string, embedding array<double>")
    good, bad = ro.new_memories(df, as_of())
    assert "embedding" not in good.columns and good.count() == 1 and good.first()["status"] == "active"
    assert sorted(r["reason"] for r in bad.collect()) == ["content empty", "importance out of range", "status unknown"]


def test_noise_and_wild_nulls(spark):
    df = spark.createDataFrame([("a", "tool_result", 0.4), ("b", "tool_result", None), ("c", "tool_result", 0.5), ("d", "g", None)], "id string, type string, importance double")
    assert {r["id"] for r in fl.exclude_noise(df).collect()} == {"c", "d"} and fl.exclude_noise(df, "tool_result").count() == 4


def test_classify_queries(spark):
    q = spark.createDataFrame([(1, " "), (2, "do you REMEMBER"), (3, "how to cook"), (4, "I feel sad"), (5, "remember how to"), (6, "hello")], "i int, text string")
    got = [(r["query_type"], r["ttl"], r["include_emotion"]) for r in fl.classify_queries(q).orderBy("i").collect()]
    assert got == [("memory_search", 300, False), ("memory_search", 1800, False), ("knowledge_search", 1800, False), ("emotion_query", 300, True),
                   ("context_build", 1800, False), ("context_build", 1800, False)]


MEMORY = "id string, content string, importance double, access_count long, status string, created_at timestamp_ntz, last_access timestamp_ntz"


def test_forget(spark):
    rows = [("a", "x", 0.05, 0, "active", ago(91), None), ("b", "x", 0.9, 3, "active", ago(400), ago(0)), ("c", "x", 0.9, 0, "archived", ago(1), None)]
    got = {r["id"]: r for r in lc.forget(spark.createDataFrame(rows, MEMORY), as_of()).collect()}
    assert [got[i]["suggested_action"] for i in "abc"] == ["delete", "keep", "archive"]
    want = (1 - 0.05) * (1 + math.log2(92) / 30) / 1
    assert got["a"]["forget_score"] == round(min(1, want), 4)
    out, counts = lc.apply_forget(spark.createDataFrame(rows, MEMORY), as_of())
    assert {r["id"]: r["status"] for r in out.collect()} == {"a": "archived", "b": "active"} and tuple(counts.first()) == (2, 1)


def test_touches_and_patches(spark):
    m = spark.createDataFrame([("a", "x", 0.5, 1, "active", ago(3), None), ("b", "y", 0.5, 0, "active", ago(3), ago(1))], MEMORY).withColumn("updated_at", F.col("created_at"))
    t = spark.createDataFrame([("a", 1, ago(2)), ("a", 1, ago(2)), ("a", 2, ago(4))], "id string, request_id int, ts timestamp_ntz")
    got = {r["id"]: (r["access_count"], r["last_access"]) for r in lc.apply_touches(m, t).collect()}
    assert got == {"a": (3, ago(2)), "b": (0, ago(1))}
    p = spark.createDataFrame([("a", ago(2), "new", None), ("a", ago(1), None, 0.9), ("a", ago(1.5), "newer", 0.1)], "id string, at timestamp_ntz, content string, importance double")
    got = {r["id"]: (r["content"], r["importance"], r["updated_at"], r["content_changed"]) for r in lc.apply_patches(m, p).collect()}
    assert got == {"a": ("newer", 0.9, ago(1), True), "b": ("y", 0.5, ago(3), False)}


def test_worth_storing(spark):
    df = spark.createDataFrame([(1, "嗯", "x"), (2, "short", "x"), (3, "好的 部署 完成 修复", "cli"), (4, "just some general text", "x")], "i int, content string, source string")
    got = [(r["should_store"], r["reason"], r["worth"]) for r in lc.evaluate(df).orderBy("i").collect()]
    assert got == [(False, "low_value_content", 0.3), (False, "too_short", 0.3), (True, "multiple_keywords_high_value", 0.64), (True, "general_content", 0.3)]


def test_review_scores_each_text_once(spark):
    df = spark.createDataFrame([("a", "same text here", "s", 0.9, "active", []), ("b", "same text here", "s", 0.9, "active", ["t"]), ("c", "嗯", "s", 0.9, "active", None),
                                ("d", "z", "s", 0.9, "active", [lc.REVIEWED_TAG])], "id string, content string, source string, importance double, status string, tags array<string>")
    seen = []

    def scorer(texts):
        seen.append(texts.count())
        return lc.rule_scorer(texts)

    got = {r["id"]: (r["status"], r["importance"], r["tags"]) for r in lc.review_noise(df, scorer).collect()}
    assert seen == [2] and got == {"a": ("active", 0.3, [lc.REVIEWED_TAG]), "b": ("active", 0.3, ["t", lc.REVIEWED_TAG]), "c": ("discarded", 0.9, [lc.REVIEWED_TAG])}


def test_signal_window_and_promotion(spark):
    s = spark.createDataFrame([("a", "rem", 0.08, "x", ago(14.9)), ("a", "light", 0.05, None, ago(15)), ("a", "rem", 0.08, "y", ago(1))],
                              "memory_id string, phase string, boost double, cluster_tag string, created_at timestamp_ntz")
    r = co.signal_summary(s, as_of()).first()
    assert abs(r["phase_boost"] - (0.08 * 2 ** (-14.9 / 14) + 0.08 * 2 ** (-1 / 14))) < 1e-9 and r["signal_days"] == 2
    assert co.latest_cluster_tags(s, as_of()).first()["cluster_tag"] == "y"
    m = spark.createDataFrame([("a", 0.95, ["t", "promoted:deep:2024-01-31"])], "id string, importance double, tags array<string>")
    p = co.apply_promotion(m, as_of()).first()
    assert p["importance"] == 1.0 and p["tags"] == ["t", "promoted:deep:2024-01-31"]


def test_knowledge_upsert_guard(spark):
    shape = "group_key string, cluster_tag string, title string, content string, source_ids array<string>, importance double, common_tags array<string>, members long, agent_id string"
    e = spark.createDataFrame([("g", "dream-cluster:g", "T", "new", ["a", "b", "c"], 0.4, ["k"], 3, "x"), ("h", "dream-cluster:h", "T", "new", ["a"], 0.4, ["k"], 1, "x"),
                               ("n", "dream-cluster:n", "T", "new", ["a"], 0.4, [], 1, "x")], shape)
    m = spark.createDataFrame([("m1", "knowledge", "active", "x\n来源记忆 (4): a, b, c, d", 0.9, ["dream-cluster:g", "z"], ago(1)),
                               ("m2", "knowledge", "active", "x\n来源记忆 (2): a, q", 0.9, ["dream-cluster:h"], ago(1))],
                              "id string, type string, status string, content string, importance double, tags array<string>, created_at timestamp_ntz")
    got = {r["group_key"]: r for r in co.upsert_knowledge(e, m).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"g": "update", "h": "skip", "n": "insert"}
    assert got["g"]["tags"] == ["dream-cluster:g", "z", "k", "auto-knowledge"] and got["g"]["importance"] == 0.9 and got["g"]["existing_id"] == "m1"


def test_sparse_embedding_keeps_rows_without_an_id_and_adds_up_repeated_ones(spark):
    rows = spark.createDataFrame([(None, "one two"), (1, "one"), (1, "two")], "id long, s string")
    got = {}
    for r in vec.hash_embedding_sparse(rows, "id", "s").collect():
        got.setdefault(r.id, {})[r["dim"]] = round(r.weight, 9)
    assert got[None] == got[1] and len(got[1]) == 2


def test_affect_works_the_text_out_once(spark):
    assert str(af.affect(F.col("s"))).count("lower(") == 1


def test_negation_and_affect(spark):
    got = ask(spark, ["I am not happy, very happy", "so happy and tired", "不开心", ""], lambda c: F.transform(af.trigger_hits(c), lambda h: h["keyword"]))
    assert got == [[], ["happy", "tired"], [], []]
    r = spark.createDataFrame([("so tired and sad",)], "s string").select(af.affect(F.col("s")).alias("a")).first()["a"]
    assert (r["dominant"], r["valence"], r["color"]) == ("fatigue", -0.65, lx.DIMENSION_COLOR["fatigue"])
    assert spark.range(1).select(af.affect(F.lit("x")).alias("a")).first()["a"].asDict() == {"dominant": None, "valence": 0.0, "color": "#7C7C88"}


def test_named_states(spark):
    df = spark.createDataFrame([tuple({**lx.DEFAULT_STATE, **over}.values()) for over in ({}, {"closeness": 0.9, "happiness": 0.7}, {"anger": 0.4}, {"fatigue": 0.8, "curiosity": 0.1})],
                               ", ".join(f"{d} double" for d in af.DIMS))
    assert [r["named_state_en"] for r in af.summary(df).collect()] == ["calm", "attachment", "wronged", "tired"]
    assert af.summary(df).first()["intensity"] == 1.0


def test_preferences(spark):
    t = spark.createDataFrame([(1, "I love Music"), (2, "I love Music"), (3, "photo of music")], "i int, text string")
    got = {r["name"]: r for r in pr.preferences(t, "text", ["i"], days=5).collect()}
    assert got["music"]["mention_count"] == 3 and abs(got["music"]["score"] - 0.49) < 1e-9 and got["music"]["examples"] == ["I love Music", "photo of music"]
    assert got["nas"]["mention_count"] == 0 and got["nas"]["examples"] is None


def test_stale(spark):
    rows = [("old", "u", "a", "t", "fact one", [1.0, 0.0], ago(2), []), ("new", "u", "a", "t", "fact two", [1.0, 0.3], ago(1), []), ("same", "u", "a", "t", "fact two ", [1.0, 0.3], ago(0), []),
            ("else", "v", "a", "t", "fact one", [1.0, 0.0], ago(0), [])]
    df = spark.createDataFrame(rows, "id string, user_id string, agent_id string, type string, content string, embedding array<double>, created_at timestamp_ntz, tags array<string>").withColumn("status", F.lit("active"))
    m, c = st.flag_stale(df)
    assert [(r["old_memory_id"], r["new_memory_id"]) for r in c.collect()] == [("old", "new")]
    assert {r["id"]: r["tags"] for r in m.collect()} == {"old": ["stale"], "new": [], "same": [], "else": []}


def test_unique_slugs(many_chunks):
    rows = [("g", "x", i, f"i{i}") for i in range(4)] + [("g", "x-2", 9, "n"), ("g", "x-2", 10, "m"), ("h", "x", 1, "o")]
    df = many_chunks.createDataFrame(rows, "c string, base string, at int, id string").repartition(3)
    got = {r["id"]: r["slug"] for r in ex.unique_slugs(df, "c", "base", ["at", "id"]).collect()}
    assert got == {"i0": "x", "i1": "x-3", "i2": "x-4", "i3": "x-5", "n": "x-2", "m": "x-2-2", "o": "x"}


def test_reconcile(spark):
    shape = "id string, updated_at timestamp_ntz, content string, summary string, importance double, type string, status string, tags array<string>"
    m = spark.createDataFrame([(i, ago(1), "c", "s", 0.5, "t", "active", ["x"]) for i in "abcd"], shape)
    d = spark.createDataFrame([("a", ago(1), "new", "", 0.5000001, "", "", []), ("b", ago(2), "new", None, None, None, None, None), ("c", None, "c ", "s", 0.7, "t", "active", ["x"]),
                               ("d", ago(1), "", "", None, "t", "active", ["x"]), ("zz", None, "q", "", None, None, None, None)], shape.replace("id string", "memory_id string", 1))
    got = {r["id"]: (r["outcome"], r["changed"], r["content"], r["importance"]) for r in ex.reconcile(m, d, as_of()).collect()}
    assert got["a"] == ("updated", ["content"], "new", 0.5) and got["b"][0] == "conflict" and got["b"][2] == "c"
    assert got["c"] == ("updated", ["importance"], "c", 0.7) and got["d"][0] == "unchanged" and got["zz"][0] == "unmatched"


def test_read_knowledge_without_front_matter(spark):
    df = spark.createDataFrame([("a", "just text"), ("b", "---\ntitle: x\n---\n# T\n"), ("c", "---\nid: 7\nupdated_at: 2024-01-01T00:00:00\n---\n# T\n\n> quote\n\nbody\n\n---\n\nTags: #x\n")], "path string, text string")
    got = {r["path"]: r for r in ex.read_knowledge(df).collect()}
    assert (got["a"]["matched"], got["b"]["matched"], got["c"]["matched"]) == (False, False, True)
    assert (got["c"]["memory_id"], got["c"]["title"], got["c"]["summary"], got["c"]["content"]) == ("7", "T", "quote", "body")


def test_graph_text_and_neighbours(spark):
    e = spark.createDataFrame([("a-1", 'A "x"'), ("b", "B")], "id string, name string").withColumn("type", F.lit("t"))
    r = spark.createDataFrame([("a-1", "b", "r1", "knows", 1.0), ("b", "gone", "r2", "knows", 1.0)], "source_id string, target_id string, relation_id string, relation_type string, weight double")
    lines = [x["line"] for x in gr.mermaid_lines(e, r).orderBy("part", "id").collect()]
    assert lines == ["graph LR", "    na1[\"A 'x'\"]", '    nb["B"]', "    na1 -->|knows| nb"]
    assert gr.mermaid_lines(e.limit(0), r.limit(0)).count() == 1
    got = {(x["id"], x["neighbour_id"], x["neighbour_name"]) for x in gr.neighbours(e, r).collect()}
    assert got == {("a-1", "b", "B"), ("b", "a-1", 'A "x"'), ("b", "gone", None), ("gone", "b", "B")}


def test_prompt_sections(spark):
    p = spark.createDataFrame([(1, "sys", "", "# Own head\nx", None)], "i int, system string, personality string, memory string, conversation string")
    r = cx.build_prompts(p).first()
    assert r["prompt"] == "sys\n\n# Own head\nx" and r["sections"] == "system=3,memory=12" and r["token_count"] == 4


def test_event_round_trip(spark):
    df = spark.createDataFrame([("memory.created", {"a": "1"}, "s", "t"), ("bogus", {}, "s", "t")], "event_type string, payload map<string,string>, source string, timestamp string")
    back = ev.decode_events(ev.encode_events(df)).collect()
    assert len(back) == 1 and back[0]["payload"] == {"a": "1"}
    assert ev.decode_events(spark.createDataFrame([("{oops",)], "value string")).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_batch_for_any_file_split(spark, tmp_path, parts):
    from memspark.streaming import stateful as sf

    r = [("a" if i % 3 else "b", i, i, f"text number {i // 4}") for i in range(24)]
    df = spark.createDataFrame(r, "key string, id long, ord long, text string")
    for n in range(parts):
        df.filter((F.col("id") * parts / 24).cast("int") == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sf.drain(sf.duplicate_gate_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = sf.duplicate_gate(df, ["key"], "id", "ord", "text")
    assert {(x["id"], x["duplicate"]) for x in out.collect()} == {(x["id"], x["duplicate"]) for x in batch.collect()}
