"""Row filters, scopes and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memspark.functions import text as tx

# Fixed values.
ACTIVE = "active"
NOISE_TYPE = "tool_result"
NOISE_IMPORTANCE = 0.5


def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == ACTIVE)


def scope(
    df: DataFrame,
    user_id: str | None = None,
    agent_id: str | None = None,
    shared: bool | None = None,
    type: str | None = None,
) -> DataFrame:
    """Active rows of the given owner, agent, visibility and type; an omitted filter does not apply."""
    out = active(df)
    for name, value in (("user_id", user_id), ("agent_id", agent_id), ("shared", shared), ("type", type)):
        if value is not None and value != "":
            out = out.filter(F.col(name) == F.lit(value))
    return out


def exclude_noise(df: DataFrame, type: str | None = None) -> DataFrame:
    """Drop low-importance tool results unless that type was asked for. Null importance is dropped too."""
    if type == NOISE_TYPE:
        return df
    return df.filter(~((F.col("type") == NOISE_TYPE) & (F.col("importance") < NOISE_IMPORTANCE)))


def low_trust(df: DataFrame, types: Sequence[str] = (NOISE_TYPE,), sources: Sequence[str] = ()) -> DataFrame:
    cond = F.col("type").isin(*types)
    return df.filter(cond | F.col("source").isin(*sources) if sources else cond)


def recent(df: DataFrame, limit: int, offset: int = 0, by: str = "created_at", id_col: str = "id") -> DataFrame:
    """One page, newest first."""
    return df.orderBy(F.col(by).desc(), F.col(id_col)).offset(offset).limit(limit)


def page_with_total(df: DataFrame, limit: int, offset: int = 0, by: str = "created_at", id_col: str = "id") -> DataFrame:
    """A page with the count of all rows it was cut from in ``total``."""
    return recent(df, limit, offset, by, id_col).withColumn("total", df.agg(F.count("*")).scalar())


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group with their position. Spark cuts to ``k`` per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def recent_then_important(df: DataFrame, keys: Sequence[str], pool: int, k: int | None = None) -> DataFrame:
    """Newest ``pool`` rows per scope, re-ordered by importance (newest first among equals), cut to ``k``."""
    newest = top_per_group(df, keys, [F.col("created_at").desc(), F.col("id")], pool, "recency")
    return top_per_group(
        newest, keys, [F.coalesce("importance", F.lit(0.0)).desc(), F.col("recency")], k or pool, "position"
    )


def capture_tool_results(
    events: DataFrame, denied: Sequence[str], label: str = "tool_result", limit: int | None = None
) -> DataFrame:
    """Tool outputs as low-importance rows; outputs of recall tools are not kept. Needs (tool, text)."""
    content = tx.opening(F.concat(F.lit(f"[{label}:"), F.col("tool"), F.lit("] "), F.col("text")), limit)
    return (
        events.filter(~F.col("tool").isin(*denied) & (F.coalesce("text", F.lit("")) != ""))
        .withColumn("content", content)
        .withColumn("type", F.lit(NOISE_TYPE))
        .withColumn("importance", F.lit(0.3))
    )


# Tools whose output quotes other rows.
DENIED_TOOLS = (
    "memory_search",
    "memory_get",
    "memory_list",
    "search_memories",
    "semantic_search",
    "hybrid_search",
    "recall",
    "get_recent_memories",
    "context",
)


def expand_scopes(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per (query, scope): the user's own id first, then the aliases, repeats dropped.

    ``aliases`` is (user_id, aliases array); users without a row search their own scope only.
    """
    joined = queries.join(aliases, "user_id", "left")
    own = F.array(F.col("user_id"))
    scopes = F.array_distinct(F.concat(own, F.coalesce("aliases", F.array().cast("array<string>"))))
    return joined.select("*", F.posexplode(scopes).alias("scope_rank", "scope")).drop("aliases")


def merge_scopes(hits: DataFrame) -> DataFrame:
    """Hits (query_id, scope_rank, rank, id) in scope order, first occurrence of an id kept, numbered again."""
    first = hits.groupBy("query_id", "id").agg(F.min(F.struct("scope_rank", "rank")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "id")
    return first.select("query_id", "id", "at.scope_rank", F.row_number().over(w).alias("position"))


# Cue phrases for sorting queries, lower case.
MEMORY_CUES = (
    "remember", "recall", "last time", "we discussed", "you said", "earlier", "previously", "my name", "who am i",
    "history",
)
KNOWLEDGE_CUES = (
    "how do i", "how to", "what is", "what are", "explain", "definition", "docs", "documentation", "reference", "guide",
)
EMOTION_CUES = (
    "feel", "feeling", "mood", "emotion", "how are you", "sad", "happy", "angry", "upset", "personality",
)


def classify_queries(
    queries: DataFrame,
    text: str = "text",
    memory: Sequence[str] = MEMORY_CUES,
    knowledge: Sequence[str] = KNOWLEDGE_CUES,
    emotion: Sequence[str] = EMOTION_CUES,
    ttl: int = 1800,
) -> DataFrame:
    """What each query asks for: query_type, providers, priority, ttl, include_emotion, reason."""
    from memspark.functions import text as tx

    q = F.lower(tx.collapse_spaces(tx.text_or_empty(F.col(text))))

    def any_cue(cues: Sequence[str]) -> Column:
        return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(q, c))

    flags = queries.withColumn("_q", q)
    flags = flags.withColumns({"_m": any_cue(memory), "_k": any_cue(knowledge), "_e": any_cue(emotion)})
    case = (
        (F.col("_q") == "", ("memory_search", "memory", 1, min(ttl, 300), False, "empty query -> recent memory browse")),
        (
            F.col("_e") & ~F.col("_m") & ~F.col("_k"),
            ("emotion_query", "emotion,memory", 2, min(ttl, 300), True, "emotion cue dominant"),
        ),
        (F.col("_m") & ~F.col("_k"), ("memory_search", "memory", 2, ttl, None, "memory cue dominant")),
        (F.col("_k") & ~F.col("_m"), ("knowledge_search", "knowledge", 2, ttl, None, "knowledge cue dominant")),
    )
    other = ("context_build", None, 3, ttl, None, "mixed/ambiguous signal -> full context build")

    def pick(i: int) -> Column:
        def value(row: tuple) -> Column:
            if i == 1 and row[1] is None:
                return F.concat(F.lit("memory,knowledge"), F.when(F.col("_e"), F.lit(",emotion")).otherwise(F.lit("")))
            if i == 4 and row[4] is None:
                return F.col("_e")
            return F.lit(row[i])

        out = None
        for cond, row in case:
            out = F.when(cond, value(row)) if out is None else out.when(cond, value(row))
        return out.otherwise(value(other))

    names = ("query_type", "providers", "priority", "ttl", "include_emotion", "reason")
    return flags.withColumns({n: pick(i) for i, n in enumerate(names)}).drop("_q", "_m", "_k", "_e")
