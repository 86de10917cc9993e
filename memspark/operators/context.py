"""Context blocks and prompts for a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import filters as fl


def headline_bullets(hits: DataFrame, limit: int) -> DataFrame:
    """Hits (query_id, position, type, summary, content) as at most ``limit`` distinct headlines per query."""
    named = hits.withColumn("headline", tx.headline(F.col("type"), F.col("summary"), F.col("content"))).filter("headline is not null")
    key = tx.strip(F.lower("headline"))
    first = named.groupBy("query_id", key.alias("_key")).agg(F.min_by("headline", "position").alias("headline"), F.min("position").alias("position"))
    return fl.top_per_group(first, ["query_id"], [F.col("position")], limit, "place").select("query_id", "place", "headline")


def _block(rows: DataFrame, heading: str, place: str, line: Column, name: str) -> DataFrame:
    """(query_id, name): heading and the lines in order. Callers cut the rows per query first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy("query_id").agg(F.concat(F.lit(f"## {heading}\n"), F.array_join(listed, "\n")).alias(name))


def context_blocks(
    queries: DataFrame, memory_hits: DataFrame, knowledge: DataFrame, limit: int = 10, mood: DataFrame | None = None
) -> DataFrame:
    """(query_id, context): memories, knowledge headings and mood, sections joined by a blank line.

    ``memory_hits``: query_id, position, type, summary, content of the candidate pool. ``knowledge``: query_id, rank,
    heading, at most ``limit`` per query. ``mood``: query_id, mood.
    """
    bullets = _block(headline_bullets(memory_hits, limit), "Relevant Memories", "place", F.concat(F.lit("- "), "headline"), "_m")
    known = _block(
        knowledge.filter(F.col("rank") <= limit), "Knowledge", "rank",
        F.rtrim(F.concat(F.lit("- "), tx.strip(tx.text_or_empty(F.col("heading")))), F.lit(" ")), "_k",
    )
    out = queries.select("query_id").join(bullets, "query_id", "left").join(known, "query_id", "left")
    parts = ["_m", "_k"]
    if mood is not None:
        feel = mood.select("query_id", F.concat(F.lit("## Emotional State\n- "), "mood").alias("_e"))
        out = out.join(feel, "query_id", "left")
        parts.append("_e")
    return out.select("query_id", F.concat_ws("\n\n", *parts).alias("context"))


SECTIONS = ("system", "personality", "emotion", "memory", "knowledge", "conversation")
HEADINGS = {
    "personality": "Personality", "emotion": "Emotional State", "memory": "Relevant Memories", "knowledge": "Knowledge",
    "conversation": "Conversation",
}


def section(name: str, body: Column) -> Column:
    """A section with its heading, unless the body brings one; null when empty."""
    b = tx.strip(tx.text_or_empty(body))
    if name not in HEADINGS:
        return F.nullif(b, F.lit(""))
    full = F.when(b.startswith("#"), b).otherwise(F.concat(F.lit(f"## {HEADINGS[name]}\n"), b))
    return F.when(b != "", full)


def conversation_text(turns: DataFrame, key: str = "conv_id", last: int | None = None) -> DataFrame:
    """(key, conversation): turns as ``role: text`` lines in order; ``last`` keeps only the newest turns."""
    role = F.when(tx.strip(tx.text_or_empty(F.col("role"))) == "", F.lit("user")).otherwise(tx.strip(F.col("role")))
    body = tx.strip(tx.text_or_empty(F.col("text")))
    lines = turns.select(key, "turn", role.alias("r"), body.alias("b")).filter("b <> ''")
    if last is not None:
        lines = fl.top_per_group(lines, [key], [F.col("turn").desc()], last, "_back")
    packed = F.array_sort(F.collect_list(F.struct("turn", F.concat("r", F.lit(": "), "b").alias("l"))))
    return lines.groupBy(key).agg(F.array_join(F.transform(packed, lambda x: x["l"]), "\n").alias("conversation"))


def build_prompts(parts: DataFrame, order: Sequence[str] = SECTIONS) -> DataFrame:
    """Adds prompt, tokens, sections and their sizes. ``parts`` has a text column per section (missing = empty)."""
    texts = {s: section(s, F.col(s)) for s in order if s in parts.columns}
    out = parts.withColumns({f"_s_{s}": c for s, c in texts.items()})
    prompt = F.concat_ws("\n\n", *[F.col(f"_s_{s}") for s in texts])
    used = F.filter(
        F.array(*[F.when(F.col(f"_s_{s}").isNotNull(), F.concat(F.lit(f"{s}="), F.length(f"_s_{s}"))) for s in texts]),
        lambda x: x.isNotNull(),
    )
    return out.withColumn("prompt", prompt).withColumns(
        {"token_count": tx.token_estimate(F.col("prompt")), "sections": F.array_join(used, ",")}
    ).drop(*[f"_s_{s}" for s in texts])


def session_recall(memories: DataFrame, keys: Sequence[str] = ("user_id", "agent_id"), pool: int = 20, k: int = 5,
                   mood: DataFrame | None = None) -> DataFrame:
    """Opening block per scope: its newest ``pool`` rows, the ``k`` most important of them, and the mood."""
    best = fl.recent_then_important(fl.active(memories), list(keys), pool, k)
    picked = F.when(tx.text_or_empty(F.col("summary")) != "", F.col("summary")).otherwise(F.col("content"))
    head = F.substring(F.split(picked, "\n", 2)[0], 1, 160)
    packed = F.array_sort(F.collect_list(F.struct("position", F.concat(F.lit("- "), head).alias("l"))))
    out = best.groupBy(*keys).agg(F.transform(packed, lambda x: x["l"]).alias("_l"))
    lines = F.concat(F.array(F.lit("[auto-recalled memories]")), "_l")
    if mood is not None:
        out = out.join(mood, list(keys), "left")
        lines = F.concat(lines, F.when(F.col("mood").isNotNull(), F.array(F.concat(F.lit("[emotion] "), "mood"))).otherwise(F.array().cast("array<string>")))
    return out.select(*keys, F.array_join(lines, "\n").alias("text"))


def nightly_report(stats: DataFrame, winners: DataFrame, unmet: DataFrame) -> DataFrame:
    """Report rows (part, place, title, score): the counts, the first 20 promoted titles, the nearest misses."""
    s = stats.select(F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("title"), F.col(n).cast("double").alias("score"))
                                         for i, n in enumerate(("scanned", "eligible", "promoted"), 1)])).alias("r"))
    head = s.select(F.lit("counts").alias("part"), "r.place", "r.title", "r.score")

    def titled(df: DataFrame, part: str, n: int) -> DataFrame:
        order = [F.col("score").desc(), F.col("created_at"), F.col("id")]
        ranked = fl.top_per_group(df.withColumn("part", F.lit(part)), ["part"], order, n, "place")
        name = F.substring(tx.redact(tx.title(F.col("summary"), F.col("content"), F.col("id"))), 1, 60)
        return ranked.select("part", "place", name.alias("title"), "score")

    return head.unionByName(titled(winners, "promoted", 20)).unionByName(titled(unmet, "unmet", 2))
