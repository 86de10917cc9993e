"""The stages on a small table with awkward rows."""

import random

import corpus_pipeline


def table(spark, folder):
    r = random.Random(9)
    say = {"en": "the house and this thing with that were have when they from there people about".split(), "de": "das haus und nicht eine schön über für auch wenn dass einer werden haben durch".split()}
    text = lambda k, n: " ".join(r.choice(say[k]) for _ in range(n))
    rows = [(i, "Home | About | Login\n" + text(k, 150), k, "s") for i in range(120) for k in [r.choice(["en", "de"])]]
    twin = rows[10][1] + " tail"
    rows += [(200, twin, "en", "s"), (201, rows[10][1], "en", "t"), (202, None, "en", None), (203, "", None, None), (204, "漢字" * 200, None, "s"),
             (205, text("en", 60) + " a@b.co and " + text("en", 60), "en", "s"), (None, text("de", 100), "de", "s"), (20, rows[20][1], "de", "s"),
             (206, "Home | About | Login", "en", "s")]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), True, "c") for x in rows], "doc_id long, text string, lang string, source string, n_chars int, accepted boolean, component_id string")
    docs.write.parquet(f"{folder}/documents.parquet")
    return rows


def test_each_stage_takes_effect_and_keeps_the_columns(spark, tmp_path):
    rows = table(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {k: [r.doc_id for r in v] for k, v in seen.items()}
    assert not {202, 203, 204} & set(ids["language_id"]) and len(ids["language_id"]) == len(rows) - 3
    assert not any("Home" in r.text for r in seen["line_dedup"]) and all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert {200, 201} & set(ids["near_dedup"]) == set() and ids["near_dedup"].count(20) == 1 and set(range(120)) <= set(ids["near_dedup"])
    assert next(r.text for r in seen["pii"] if r.doc_id == 205).count("<email>") == 1
    assert {r.doc_id for r in seen["packing"]} == set(ids["pii"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset", "padded", "start", "length", "ids_crc32").distinct().collect()), key=str) == sorted({(r.doc_id, r.doc_tokens) for r in seen["packing"]}, key=str)
