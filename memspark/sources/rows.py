"""New rows: defaults, validation, search text, vectors and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.functions import text as tx
from memspark.functions import vectors as vec

# Fixed values.
STATUSES = ("active", "discarded", "archived")
DEFAULTS = {
    "agent_id": "default",
    "shared": False,
    "type": "general",
    "summary": "",
    "importance": 0.5,
    "source": "api",
    "status": "active",
    "access_count": 0,
}


def new_memories(rows: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): defaults filled in, vectors sent by the client dropped, bad rows set apart with a reason."""
    r = rows.drop("embedding") if "embedding" in rows.columns else rows
    r = r.withColumns({n: F.coalesce(F.col(n), F.lit(v)) if n in r.columns else F.lit(v) for n, v in DEFAULTS.items()})
    r = r.withColumns(
        {
            "tags": F.coalesce("tags", F.array().cast("array<string>")) if "tags" in r.columns else F.array().cast("array<string>"),
            "created_at": F.coalesce("created_at", as_of) if "created_at" in r.columns else as_of,
            "updated_at": as_of,
        }
    )
    reason = (
        F.when(tx.text_or_empty(F.col("user_id")) == "", "user_id missing")
        .when(tx.text_or_empty(F.col("content")) == "", "content empty")
        .when(~F.col("importance").between(0.0, 1.0), "importance out of range")
        .when(~F.col("status").isin(*STATUSES), "status unknown")
    )
    marked = r.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def with_search_text(memories: DataFrame) -> DataFrame:
    return memories.withColumn(
        "search_text", tx.search_text(tx.text_or_empty(F.col("content")), tx.text_or_empty(F.col("summary")), tags=F.col("tags"))
    )


def documents_with_search_text(documents: DataFrame) -> DataFrame:
    text = F.concat(tx.text_or_empty(F.col("title")), F.lit("\n"), tx.text_or_empty(F.col("content")))
    return documents.withColumn("search_text", F.concat_ws(" ", tx.tokens(text)))


def backfill_embeddings(rows: DataFrame, head: str = "content", tail: str = "summary", embedder: str = "hash") -> DataFrame:
    """Vectors for rows that have none, from two text columns; blank text stays without."""
    text = F.concat(tx.text_or_empty(F.col(head)), F.lit("\n"), tx.text_or_empty(F.col(tail)))
    have = rows.filter(F.col("embedding").isNotNull())
    need = rows.filter(F.col("embedding").isNull()).withColumn("embedding", vec.embed_text(text, embedder))
    return have.unionByName(need)


def first_sentence(c: Column, chars: int | None = None) -> Column:
    """Default summariser: the first sentence of a text, or of its first ``chars`` characters."""
    s = tx.collapse_spaces(tx.opening(tx.strip(c), chars))
    one = F.regexp_extract(s, "^(.*?[.!?。！？])(?:\\s|$)", 1)
    return F.when(one != "", one).otherwise(s)


def backfill_summaries(memories: DataFrame, summarizer: Callable[[Column], Column] = first_sentence, short: int = 50,
                       limit: int = 120) -> DataFrame:
    """(id, new_summary) for active rows without summary: short contents are copied, others summarised.

    Keeps importance and created_at so that callers can work from the most important, newest row down."""
    empty = memories.filter((F.col("status") == "active") & (tx.text_or_empty(F.col("summary")) == ""))
    body = tx.strip(tx.text_or_empty(F.col("content")))
    copied = F.substring(tx.collapse_spaces(body), 1, limit)
    made = tx.strip_prefixes(summarizer(F.col("content")), lx.SUMMARY_PREFIXES, limit)
    new = F.when(body == "", F.lit(None)).when(F.length(body) <= short, copied).otherwise(made)
    return empty.select("id", "importance", "created_at", new.alias("new_summary")).filter("new_summary is not null")
