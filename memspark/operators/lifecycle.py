"""Decay, archiving, reinforcement, patches and review of low-trust rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.functions import text as tx
from memspark.functions.time import age_days, clamp
from memspark.operators import filters as fl
from memspark.operators.ordered import meet
from memspark.session import materialize

# Fixed values.
ARCHIVE_BELOW = 0.15
DELETE_BELOW = 0.05
DELETE_AFTER_DAYS = 90
DECAY = 0.95
REVIEWED_TAG = "noise_filter_v1:done"


def forget_score(importance: Column, access_count: Column, days: Column) -> Column:
    """0 = fresh, 1 = forgotten."""
    idle = F.log2(F.greatest(F.lit(1.0), days + 1)) / 30.0
    used = F.log2(F.greatest(F.lit(1.0), access_count + 1)) / 5.0
    return clamp((1 - importance) * (1 + idle) / (1 + used))


def forget(memories: DataFrame, as_of: Column) -> DataFrame:
    """Forget score, decayed importance and the suggested action of each row."""
    days = age_days(as_of, F.coalesce("last_access", "created_at"))
    faded = F.col("importance") * F.pow(F.lit(DECAY), days / 7.0)
    action = (
        F.when((faded <= DELETE_BELOW) & (days > DELETE_AFTER_DAYS), "delete")
        .when((faded <= ARCHIVE_BELOW) | (F.col("status") == "archived"), "archive")
        .otherwise("keep")
    )
    return memories.withColumns(
        {
            "forget_score": F.round(forget_score(F.col("importance"), F.col("access_count"), days), 4),
            "decayed_importance": F.round(faded, 4),
            "days_since_access": F.round(days, 1),
            "suggested_action": action,
        }
    )


def forget_detail(memories: DataFrame, as_of: Column) -> DataFrame:
    """Readable decay row: 80-character preview and rounded ages."""
    days = age_days(as_of, F.coalesce("last_access", "created_at"))
    return memories.select(
        "id", F.substring("content", 1, 80).alias("preview"), "importance", "access_count", "status",
        F.round(age_days(as_of, F.col("created_at")), 1).alias("days_since_created"),
        F.round(days, 1).alias("days_since_access"),
        F.round(forget_score(F.col("importance"), F.col("access_count"), days), 4).alias("forget_score"),
    )


def boost_on_access(importance: Column) -> Column:
    return F.least(F.lit(1.0), importance + 0.1)


def apply_forget(memories: DataFrame, as_of: Column, limit: int | None = None, agent_id: str | None = None):
    """(rows with new status, counts). Both archive and delete verdicts archive; nothing is removed.

    ``limit`` restricts the pass to the newest rows; without it the whole table is treated.
    """
    pool = fl.scope(memories, agent_id=agent_id)
    if limit is not None:
        pool = fl.recent(pool, limit)
    verdicts = forget(pool, as_of)
    goes = F.col("suggested_action").isin("archive", "delete")
    counts = verdicts.agg(F.count("*").alias("scanned"), F.count_if(goes).alias("archived"))
    rows = verdicts.withColumn("status", F.when(goes, "archived").otherwise(F.col("status")))
    return rows, counts


def apply_touches(memories: DataFrame, touches: DataFrame) -> DataFrame:
    """Reinforcement: +1 per request that recalled the row, last access = latest request. Needs (id, request_id, ts)."""
    use = touches.groupBy("id", "request_id").agg(F.max("ts").alias("ts")).groupBy("id").agg(
        F.count("*").alias("_hits"), F.max("ts").alias("_last")
    )
    return memories.join(use, "id", "left").withColumn(
        "access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("_hits", F.lit(0))
    ).withColumn("last_access", F.coalesce(F.greatest("last_access", "_last"), "_last", "last_access")).drop("_hits", "_last")


PATCHABLE = ("content", "summary", "importance", "tags", "status")


def apply_patches(memories: DataFrame, patches: DataFrame, fields: Sequence[str] = PATCHABLE) -> DataFrame:
    """Partial updates: the latest value given for a field wins, nulls leave it. Patches need (id, at, fields...).

    Adds ``content_changed`` so that search text and vector can be refreshed for those rows only.
    """
    latest = patches.groupBy("id").agg(
        F.max("at").alias("_at"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f"_new_{f}") for f in fields if f in patches.columns],
    )
    out = memories.join(latest, "id", "left")
    changed = F.col("_new_content").isNotNull() if "content" in patches.columns else F.lit(False)
    out = out.withColumn("content_changed", changed)
    for f in fields:
        if f in patches.columns:
            out = out.withColumn(f, F.coalesce(f"_new_{f}", f)).drop(f"_new_{f}")
    return out.withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_at")


def archive(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: rows stay with status archived."""
    marked = memories.join(ids.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    return marked.withColumn("status", F.when(F.col("_gone"), "archived").otherwise(F.col("status"))).drop("_gone")


def purge(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Hard delete: rows are gone."""
    return memories.join(ids.select("id"), "id", "left_anti")


# --- Is a text worth keeping? ---------------------------------------------------------------------------


def _matches(text: Column, words: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def evaluate(
    df: DataFrame,
    text: str = "content",
    source: str | None = "source",
    low_value: Sequence[str] = lx.LOW_VALUE_PATTERNS,
    keywords: Sequence[str] = lx.HIGH_IMPORTANCE_KEYWORDS,
    topics: Sequence[str] = lx.HIGH_VALUE_TOPICS,
    duplicate: Column | None = None,
) -> DataFrame:
    """should_store, worth, reason, suggested_tags per text. ``duplicate`` marks repeats of recent texts."""
    c = F.col(text)
    low = tx.strip(F.lower(c))
    n = F.length(c)
    kw, tp = F.col("_kw"), F.col("_tp")
    score = (
        0.3 + F.least(F.lit(0.4), F.size(kw) * 0.08) + F.least(F.lit(0.2), F.size(tp) * 0.05)
        + F.when(n > 100, 0.1).otherwise(0.0) + F.when(n > 300, 0.1).otherwise(0.0)
    )
    if source is not None:
        score = score + F.when(F.col(source).isin("cli", "code", "api", "mcp"), 0.1).otherwise(0.0)
    verdict = (
        F.when((F.size("_lv") > 0) & (F.size(kw) == 0), "low_value_content")
        .when((n < 10) & (F.size(kw) == 0), "too_short")
        .when(duplicate if duplicate is not None else F.lit(False), "duplicate_of_recent")
    )
    reason = (
        F.when(F.size(kw) >= 3, F.lit("multiple_keywords_high_value"))
        .when(F.size(kw) >= 1, F.concat(F.lit("keyword_match: "), F.get(kw, F.lit(0))))
        .otherwise("general_content")
    )
    tags = F.array_distinct(F.concat(F.slice(kw, 1, 3), F.slice(tp, 1, 2)))
    found = df.withColumns({"_lv": _matches(low, low_value), "_kw": _matches(low, keywords), "_tp": _matches(low, topics)})
    found = found.withColumn("_no", verdict)
    return found.withColumns(
        {
            "should_store": F.col("_no").isNull(),
            "worth": F.when(F.col("_no").isNull(), F.round(F.least(F.lit(1.0), score), 2)).otherwise(0.3),
            "reason": F.coalesce("_no", reason),
            "suggested_tags": F.when(F.col("_no").isNull(), tags).otherwise(F.array().cast("array<string>")),
        }
    ).drop("_lv", "_kw", "_tp", "_no")


Scorer = Callable[[DataFrame], DataFrame]


def rule_scorer(texts: DataFrame) -> DataFrame:
    """Default verdicts: (content, source) -> keep, new_importance, decided_by."""
    v = evaluate(texts, "content", "source")
    return v.select(
        "content_hash", "should_store", F.col("worth").alias("new_importance"), F.lit("heuristic_fallback").alias("decided_by")
    ).withColumnRenamed("should_store", "keep")


def review_noise(rows: DataFrame, scorer: Scorer = rule_scorer, tag: str = REVIEWED_TAG) -> DataFrame:
    """Verdicts for the given rows that lack the reviewed tag; each distinct text is scored once.

    Kept rows get the new importance, the others become discarded; both get the tag.
    """
    pending = rows.filter(~F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), tag))
    hashed = pending.withColumn("content_hash", F.sha2("content", 256))
    texts = hashed.groupBy("content_hash").agg(F.first("content").alias("content"), F.min("source").alias("source"))
    verdict = materialize(scorer(texts))
    # One text may be on a large share of the rows.
    out = meet(hashed, verdict, ["content_hash"], F.col("id"))
    return out.withColumns(
        {
            "status": F.when(F.col("keep"), F.col("status")).otherwise("discarded"),
            "importance": F.when(F.col("keep"), F.col("new_importance")).otherwise(F.col("importance")),
            "tags": F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(tag))),
        }
    ).drop("content_hash")


def review_distribution(reviewed: DataFrame) -> DataFrame:
    """Counts by verdict, by who decided, and by importance to one decimal."""
    by = F.explode(
        F.array(
            F.struct(F.lit("verdict").alias("measure"), F.when(F.col("keep"), "keep").otherwise("discard").alias("value")),
            F.struct(F.lit("decided_by").alias("measure"), F.col("decided_by").alias("value")),
            F.struct(F.lit("importance").alias("measure"), F.format_number(F.round("new_importance", 1), 1).alias("value")),
        )
    )
    return reviewed.select(by.alias("m")).groupBy("m.measure", "m.value").agg(F.count("*").alias("count"))
