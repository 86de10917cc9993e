"""Nightly consolidation: signals, scoring, promotion, clusters and knowledge entries.

Every step is a function of its input tables and an explicit ``as_of``; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.functions import text as tx
from memspark.functions.time import age_days, half_life, micros, whole_days
from memspark.operators import filters as fl
from memspark.operators.cluster import dedupe_vectors, star_clusters
from memspark.operators.ordered import meet, row_numbers
from memspark.session import materialize

# Windows, thresholds and weights.
LIGHT_HOURS = 6
LIGHT_BOOST = 0.05
REM_DAYS = 7
REM_BOOST = 0.08
REM_MIN_CLUSTER = 3
HALF_LIFE_DAYS = 14.0
SIGNAL_DAYS = 14
MAX_AGE_DAYS = 30
MIN_SCORE = 0.7
MIN_ACCESS = 3
PROMOTE_LIMIT = 10
MAX_PRIOR_LOSS = 0.25
PROMOTED_TAG = "promoted:deep:"
CLUSTER_TAG = "dream-cluster:"
AUTO_TAG = "auto-knowledge"


def created_within(memories: DataFrame, as_of: Column, hours: float) -> DataFrame:
    since = micros(as_of) - F.lit(int(hours * 3_600_000_000))
    return fl.active(memories).filter((micros(F.col("created_at")) >= since) & (F.col("created_at") <= as_of))


def not_signalled_today(rows: DataFrame, signals: DataFrame, phase: str, as_of: Column) -> DataFrame:
    """Rows without a signal of this phase on the day of ``as_of``."""
    today = signals.filter((F.col("phase") == phase) & (F.to_date("created_at") == F.to_date(as_of)))
    return rows.join(today.select(F.col("memory_id").alias("id")), "id", "left_anti")


def in_creation_order(rows: DataFrame) -> DataFrame:
    """``ord``: position by (created_at, id)."""
    return row_numbers(rows, [], ["created_at", "id"], "ord")


def light(memories: DataFrame, signals: DataFrame, as_of: Column, hours: float = LIGHT_HOURS, threshold: float = 0.9):
    """Short-term pass: (new signals, run statistics). New rows are deduplicated by vector, in creation order."""
    scanned = materialize(created_within(memories, as_of, hours))
    pending = materialize(not_signalled_today(scanned, signals, "light", as_of))
    kept = materialize(dedupe_vectors(in_creation_order(pending.select("id", "created_at", "embedding")), "ord", threshold))
    new = kept.select(
        F.col("id").alias("memory_id"), F.lit("light").alias("phase"), F.lit(LIGHT_BOOST).alias("boost"),
        F.lit(None).cast("string").alias("cluster_tag"), as_of.alias("created_at"),
    )
    n_scanned, n_pending, n_kept = (d.agg(F.count("*")).scalar() for d in (scanned, pending, kept))
    stats = scanned.sparkSession.range(1).select(
        n_scanned.alias("scanned"), (n_scanned - n_pending).alias("already_signalled_today"),
        (n_pending - n_kept).alias("deduped"), n_kept.alias("signals_added"),
    )
    return new, stats


def tag_counts(members: DataFrame, group: str = "seed") -> DataFrame:
    """(group, tag, count, first): tag frequencies per group. ``first`` orders ties by first appearance.

    ``members`` has the group column, ord and tags.
    """
    flat = members.select(group, "ord", F.posexplode("tags").alias("at", "tag"))
    return flat.groupBy(group, "tag").agg(F.count("*").alias("count"), F.min(F.struct("ord", "at")).alias("first"))


def top_tags(members: DataFrame, n: int, group: str = "seed") -> DataFrame:
    """The ``n`` most frequent tags of each group, ties by first appearance."""
    return fl.top_per_group(tag_counts(members, group), [group], [F.col("count").desc(), F.col("first")], n)


def cluster_summary(clusters: DataFrame, rows: DataFrame, min_size: int = 1) -> DataFrame:
    """(seed, size, tag): size and most frequent tag of each cluster. Members stay a table of their own."""
    sizes = clusters.groupBy("seed").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    members = clusters.join(rows.select("id", "tags"), "id")
    best = tag_counts(members).groupBy("seed").agg(
        F.max_by("tag", F.struct("count", -F.col("first.ord"), -F.col("first.at"))).alias("tag")
    )
    return sizes.join(best, "seed", "left").withColumn("tag", F.coalesce("tag", F.lit("未命名主题")))


def rem(memories: DataFrame, signals: DataFrame, runs: DataFrame | None, as_of: Column, days: float = REM_DAYS,
        min_size: int = REM_MIN_CLUSTER, force: bool = False):
    """Theme pass: (new signals, cluster summaries, members). Empty when a finished run exists today."""
    rows = created_within(memories, as_of, days * 24).filter(F.size("tags") > 0)
    if runs is not None and not force:
        rows = rows.filter(~already_ran(runs, "rem", as_of))
    ordered = materialize(in_creation_order(rows.select("id", "created_at", "tags")))
    clusters = materialize(star_clusters(ordered))
    summary = materialize(cluster_summary(clusters, ordered, min_size))
    members = meet(clusters, summary, ["seed"], F.col("id"))
    fresh = not_signalled_today(members, signals, "rem", as_of)
    new = fresh.select(
        F.col("id").alias("memory_id"), F.lit("rem").alias("phase"), F.lit(REM_BOOST).alias("boost"),
        F.col("tag").alias("cluster_tag"), as_of.alias("created_at"),
    )
    return new, summary, members


def already_ran(runs: DataFrame, phase: str, as_of: Column) -> Column:
    """True when a finished run of the phase started on the day of ``as_of``."""
    today = (F.col("phase") == phase) & (F.to_date("started_at") == F.to_date(as_of)) & F.col("finished_at").isNotNull()
    return runs.filter(today).agg(F.count("*") > 0).scalar()


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last started run of each phase."""
    return runs.groupBy("phase").agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")).select("r.*")


def latest_cluster_tags(signals: DataFrame, as_of: Column, days: float = REM_DAYS) -> DataFrame:
    """(memory_id, cluster_tag): the latest theme of each memory inside the window."""
    since = micros(as_of) - F.lit(int(days * 86_400_000_000))
    recent = signals.filter((F.col("phase") == "rem") & (micros(F.col("created_at")) >= since))
    recent = recent.filter(F.coalesce("cluster_tag", F.lit("")) != "")
    return recent.groupBy("memory_id").agg(F.max_by("cluster_tag", F.struct("created_at", "cluster_tag")).alias("cluster_tag"))


def signal_summary(signals: DataFrame, as_of: Column) -> DataFrame:
    """(memory_id, signal_days, phase_boost): distinct days and decayed boosts of at most 14 whole days."""
    boost = F.col("boost") * half_life(age_days(as_of, F.col("created_at")), HALF_LIFE_DAYS)
    counted = F.when(whole_days(as_of, F.col("created_at")) <= SIGNAL_DAYS, boost).otherwise(F.lit(0.0))
    return signals.groupBy("memory_id").agg(
        F.count_distinct(F.to_date("created_at")).alias("signal_days"), F.sum(counted).alias("phase_boost")
    )


def deep_score(memories: DataFrame, signals: DataFrame, as_of: Column, max_age: float = MAX_AGE_DAYS) -> DataFrame:
    """Score of every active memory created in the last ``max_age`` days, with its parts, rounded to 4."""
    rows = created_within(memories, as_of, max_age * 24)
    s = rows.join(signal_summary(signals, as_of).withColumnRenamed("memory_id", "id"), "id", "left")
    days = F.coalesce("signal_days", F.lit(0))
    seen = F.coalesce("last_access", "created_at")
    parts = s.withColumns(
        {
            "recency": half_life(age_days(as_of, seen), HALF_LIFE_DAYS),
            "frequency": F.least(F.coalesce("access_count", F.lit(0)) / 10.0, F.lit(1.0)),
            "consolidation": F.coalesce("importance", F.lit(0.0)) * 0.7 + F.least(days / 5.0, F.lit(1.0)) * 0.3,
            "conceptual": F.least(F.coalesce(F.size("tags"), F.lit(0)) / 5.0, F.lit(1.0)),
            "phase_boost": F.coalesce("phase_boost", F.lit(0.0)),
            "age_days": F.round(age_days(as_of, F.col("created_at")), 2),
        }
    )
    score = (
        0.30 * F.col("recency") + 0.28 * F.col("frequency") + 0.22 * F.col("consolidation")
        + 0.12 * F.col("conceptual") + F.col("phase_boost")
    )
    names = ("recency", "frequency", "consolidation", "conceptual", "phase_boost")
    return parts.withColumn("score", F.round(score, 4)).withColumns({n: F.round(n, 4) for n in names}).drop("signal_days")


def eligible(scored: DataFrame, min_score: float = MIN_SCORE, min_access: int = MIN_ACCESS, max_age: float = MAX_AGE_DAYS) -> DataFrame:
    return scored.filter((F.col("score") >= min_score) & (F.col("access_count") >= min_access) & (F.col("age_days") <= max_age))


def promoted(scored: DataFrame, limit: int = PROMOTE_LIMIT) -> DataFrame:
    """The best eligible rows, at most ``limit``; ties by creation, then id."""
    return eligible(scored).orderBy(F.col("score").desc(), "created_at", "id").limit(limit)


def apply_promotion(rows: DataFrame, as_of: Column) -> DataFrame:
    """Raise importance by 0.1 (at most 1) and add the dated tag once."""
    tag = F.concat(F.lit(PROMOTED_TAG), F.date_format(as_of, "yyyy-MM-dd"))
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    return rows.withColumn(
        "tags", F.when(F.array_contains(tags, tag), tags).otherwise(F.concat(tags, F.array(tag)))
    ).withColumn("importance", F.least(F.lit(1.0), F.coalesce("importance", F.lit(0.0)) + 0.1))


def top_unmet(scored: DataFrame, winners: DataFrame, n: int = 2) -> DataFrame:
    """Best scores that were not promoted."""
    rest = scored.join(F.broadcast(winners.select("id")), "id", "left_anti")
    return rest.orderBy(F.col("score").desc(), "created_at", "id").limit(n)


def deep_stats(scored: DataFrame, winners: DataFrame) -> DataFrame:
    ok = (F.col("score") >= MIN_SCORE) & (F.col("access_count") >= MIN_ACCESS) & (F.col("age_days") <= MAX_AGE_DAYS)
    return scored.agg(F.count("*").alias("scanned"), F.count_if(ok).alias("eligible")).withColumn(
        "promoted", winners.agg(F.count("*")).scalar()
    )


# --- Knowledge entries from promoted rows (at most ``limit`` rows, so groups are small) -----------------


def knowledge_groups(winners: DataFrame, cluster_tags: DataFrame) -> DataFrame:
    """(id, ord, group_key): by theme, else by shared tags among the rest, else alone.

    ``winners`` carries ``ord``, its promotion rank.
    """
    w = materialize(winners.join(cluster_tags.withColumnRenamed("memory_id", "id"), "id", "left"))
    themed = w.filter("cluster_tag is not null").select("id", "ord", F.concat(F.lit("rem-"), "cluster_tag").alias("group_key"))
    loose = star_clusters(w.filter("cluster_tag is null"))
    sized = loose.withColumn("_ids", F.array_sort(F.collect_list("id").over(Window.partitionBy("seed"))))
    adhoc = F.concat(F.lit("adhoc-"), F.substring(F.sha1(F.array_join("_ids", ",")), 1, 8))
    key = F.when(F.size("_ids") >= 2, adhoc).otherwise(F.concat(F.lit("solo-"), "id"))
    return themed.unionByName(sized.select("id", "ord", key.alias("group_key")))


def knowledge_entries(winners: DataFrame, groups: DataFrame) -> DataFrame:
    """One summary entry per group: title, content, tags, source ids, importance."""
    m = winners.drop("ord").join(groups, "id")
    members = m.select("*", tx.title(F.col("summary"), F.col("content"), F.col("id")).alias("_title"))
    text = F.when(tx.text_or_empty(F.col("summary")) != "", F.col("summary")).otherwise(tx.text_or_empty(F.col("content")))
    piece = F.substring(F.replace(tx.strip(text), F.lit("\n"), F.lit(" ")), 1, 120)
    weight = F.when(F.coalesce("importance", F.lit(0.0)) == 0, F.lit(0.5)).otherwise(F.col("importance"))
    entry = members.withColumn("_piece", piece).groupBy("group_key").agg(
        F.count("*").alias("members"),
        F.max_by("_title", F.struct(F.coalesce("importance", F.lit(0.0)), -F.col("ord"))).alias("title"),
        F.array_sort(F.collect_list("id")).alias("source_ids"),
        F.slice(F.array_sort(F.collect_list(F.struct("ord", "_piece"))), 1, 5).alias("_pieces"),
        F.least(F.lit(1.0), F.avg(weight) * 1.1).alias("importance"),
        F.min_by("agent_id", "ord").alias("agent_id"),
    )
    clean = members.withColumn("tags", tx.strip_system_tags(F.col("tags")))
    tags = top_tags(clean, 5, "group_key").groupBy("group_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda t: t["tag"]).alias("common_tags")
    )
    bullets = F.transform(F.filter("_pieces", lambda p: p["_piece"] != ""), lambda p: F.concat(F.lit("- "), p["_piece"]))
    ids = F.col("source_ids")
    body = F.concat(
        F.array(F.format_string("综合自 %d 条相关记忆的巩固摘要。", "members"), F.lit(""), F.lit("**关键片段：**")),
        bullets,
        F.array(F.lit(""), F.concat(F.format_string("来源记忆 (%d): ", F.size(ids)), F.array_join(ids, ", "))),
    )
    none = F.array().cast("array<string>")
    return (
        entry.join(tags, "group_key", "left")
        .withColumn("common_tags", F.coalesce("common_tags", none))
        .withColumn("content", F.array_join(body, "\n"))
        .withColumn("cluster_tag", F.concat(F.lit(CLUSTER_TAG), "group_key"))
        .drop("_pieces")
    )


def upsert_knowledge(entries: DataFrame, memories: DataFrame, max_loss: float = MAX_PRIOR_LOSS) -> DataFrame:
    """Entries matched with the stored entry of the same cluster tag, and what to do: insert, update or skip.

    An update that covers less than ``1 - max_loss`` of the stored source ids is skipped.
    """
    stored = fl.active(memories).filter(F.col("type") == "knowledge").select(
        F.col("id").alias("existing_id"), F.col("content").alias("old_content"), F.col("importance").alias("old_importance"),
        F.col("tags").alias("old_tags"), F.explode("tags").alias("cluster_tag"), "created_at",
    ).filter(F.col("cluster_tag").startswith(CLUSTER_TAG))
    newest = stored.groupBy("cluster_tag").agg(
        F.max_by(F.struct("existing_id", "old_content", "old_importance", "old_tags"), F.struct("created_at", "existing_id")).alias("o")
    ).select("cluster_tag", "o.*")
    j = entries.join(newest, "cluster_tag", "left")
    prior = tx.source_ids(F.col("old_content"))
    covered = F.size(F.array_intersect(F.array_distinct(prior), "source_ids")) / F.size(prior)
    action = F.when(F.col("existing_id").isNull(), "insert").when(
        (F.size(prior) > 0) & (covered < 1 - max_loss), "skip"
    ).otherwise("update")
    none = F.array().cast("array<string>")
    tags = F.array_distinct(F.concat(F.coalesce("old_tags", none), F.array("cluster_tag"), "common_tags", F.array(F.lit(AUTO_TAG))))
    return j.withColumn("action", action).withColumn("tags", tags).withColumn(
        "importance", F.greatest("importance", F.coalesce("old_importance", F.lit(0.0)))
    ).withColumn("prior_count", F.size(prior)).drop("old_content", "old_importance", "old_tags", "common_tags")


# --- One-shot consolidation -----------------------------------------------------------------------------


def keep_first_by_fingerprint(members: DataFrame, group: str = "seed", chars: int | None = None) -> DataFrame:
    """Inside each group one row per text, or per opening of ``chars`` characters: the most important one (earliest among equals)."""
    key = F.sha2(tx.fingerprint(F.col("content"), chars), 256)
    best = F.max_by(F.struct(*[F.col(c) for c in members.columns]), F.struct(F.coalesce("importance", F.lit(0.0)), -F.col("ord")))
    return members.groupBy(group, key.alias("_print")).agg(best.alias("_r")).select("_r.*")


def cluster_patterns(kept: DataFrame) -> DataFrame:
    """(seed, tags, frequency, avg_importance) of clusters with two rows or more and a repeated tag."""
    best = top_tags(kept, 3).filter("count >= 2").groupBy("seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda t: t["tag"]).alias("tags")
    )
    sizes = kept.groupBy("seed").agg(
        F.count("*").alias("frequency"), F.avg(F.coalesce("importance", F.lit(0.5))).alias("avg_importance")
    )
    return sizes.filter("frequency >= 2").join(best, "seed")


def cluster_knowledge(kept: DataFrame) -> DataFrame:
    """(seed, title, size, sources, importance) of clusters with two rows or more; the first five sources by rank."""
    order = F.struct(F.coalesce("importance", F.lit(0.0)), -F.col("ord"))
    name = F.when(tx.text_or_empty(F.col("summary")) != "", F.col("summary")).otherwise(F.substring("content", 1, 80))
    agg = kept.groupBy("seed").agg(
        F.max_by(name, order).alias("title"), F.count("*").alias("size"),
        F.least(F.lit(1.0), F.avg(F.coalesce("importance", F.lit(0.5))) * 1.2).alias("importance"),
    ).filter("size >= 2")
    ranked = fl.top_per_group(
        kept.select("seed", "id", F.coalesce("importance", F.lit(0.0)).alias("_i"), "ord"), ["seed"], [F.col("_i").desc(), F.col("ord")], 5
    )
    sources = ranked.groupBy("seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda t: t["id"]).alias("sources")
    )
    return agg.join(sources, "seed")


def consolidate(memories: DataFrame, limit: int | None = None, agent_id: str | None = None, patterns: int | None = None, entries: int | None = None, chars: int | None = None):
    """One-shot pass over an agent's rows: (clusters, kept rows, patterns, knowledge).

    ``limit`` takes its newest rows only, ``patterns`` and ``entries`` the first clusters of either kind; None takes all.
    Rows that agree in their text, or in its first ``chars`` characters, count once in a cluster.
    """
    newest = fl.scope(memories, agent_id=agent_id)
    newest = newest if limit is None else fl.recent(newest, limit)
    stamped = newest.withColumn("_stamp", -micros(F.col("created_at")))
    rows = materialize(row_numbers(stamped, [], ["_stamp", "id"], "ord").drop("_stamp").withColumn("ord", F.col("ord").cast("bigint")))
    clusters = materialize(star_clusters(rows))
    kept = materialize(keep_first_by_fingerprint(clusters.select("id", "seed").join(rows, "id"), chars=chars))
    repeated, knowledge = cluster_patterns(kept).orderBy("seed"), cluster_knowledge(kept).orderBy("seed")
    repeated = repeated if patterns is None else repeated.limit(patterns)
    return clusters, kept, repeated, knowledge if entries is None else knowledge.limit(entries)
