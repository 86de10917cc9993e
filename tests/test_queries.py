"""The registered queries against their SQL on the smallest data set."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from memspark.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = (
    "s04_hybrid_search", "s06_any_token_search", "p02_substring_wildcards", "v03_near_duplicates", "v04_stale_flags", "c01_star_clusters",
    "c04_deep_score", "c07_knowledge_entries", "c11_forget_score", "c15_worth_storing", "e03_state_fold", "e05_structural_events", "g03_memory_graph",
    "i02_parse_markdown", "i05_document_upsert", "i19_render_knowledge", "i22_read_documents_back", "i23_reconcile", "k01_context_block",
    "d01_duplicate_gate_stream", "d02_throttled_mood_stream", "d10_run_lengths", "w05_unique_slugs",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no supplied tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return a == b


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=repr)
    rel = sql.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted(([r[i] for i in at] for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols and len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_name_has_a_survey_id():
    assert all(re.match(r"^(i|p|j|s|v|a|w|l|o|c|e|g|t|k|d|u)\d\d_[a-z0-9_]+$", n) for n in catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["s02_vector_search", "s06_any_token_search", "p02_substring_search", "j03_scoped_earlier_neighbours", "g02_best_match_neighbours", "k02_prompts"])
def test_plans_have_no_cross_join_and_no_row_udf(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))


def test_scan_reads_only_what_is_asked(spark):
    plan = entry.queries()["p01_scope_filter"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "EqualTo(lang,en)" in plan
