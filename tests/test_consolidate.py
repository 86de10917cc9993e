"""One-shot consolidation over a whole agent."""

from datetime import datetime, timedelta

from memspark.operators import consolidate as co


def test_all_rows_and_clusters_are_taken_unless_limited(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"m{i:03}", [f"a{i // 12}", f"b{i // 12}", f"c{i // 12}"], f"content {i}", "", 0.5, start + timedelta(hours=i), "en", "active", "note") for i in range(288)]
    df = spark.createDataFrame(rows, "id string, tags array<string>, content string, summary string, importance double, created_at timestamp, agent_id string, status string, type string")
    _, kept, patterns, knowledge = co.consolidate(df, agent_id="en")
    assert kept.count() == 288 and patterns.count() == 24 and knowledge.count() == 24
    _, kept, patterns, knowledge = co.consolidate(df, 200, "en", patterns=10, entries=5)
    assert kept.count() == 200 and patterns.count() == 10 and knowledge.count() == 5
