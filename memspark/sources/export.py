"""Knowledge documents, agent exports, snapshots, and reading edited documents back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.functions import text as tx
from memspark.functions.time import micros
from memspark.operators import filters as fl
from memspark.operators.ordered import row_numbers
from memspark.sources.files import FRONT, with_front_matter

MIN_IMPORTANCE = 0.6


def knowledge_rows(memories: DataFrame, min_importance: float = MIN_IMPORTANCE) -> DataFrame:
    """Active rows worth a document: no tool results; shared, or important enough."""
    return fl.active(memories).filter(
        (F.col("type") != fl.NOISE_TYPE) & (F.col("shared") | (F.col("importance") >= min_importance))
    )


def category(type_: Column, tags: Column) -> Column:
    """Folder of a document by type, else by its first known tag, else General."""
    table = F.create_map(*[F.lit(x) for kv in lx.CATEGORY_RULES.items() for x in kv])

    def look(c: Column) -> Column:
        return F.try_element_at(table, F.lower(tx.strip(c)))

    by_tag = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), look), lambda x: x.isNotNull())
    return F.coalesce(look(tx.text_or_empty(type_)), F.get(by_tag, F.lit(0)), F.lit(lx.DEFAULT_CATEGORY))


def unique_slugs(rows: DataFrame, group: str, base: str, order: list[str], name: str = "slug") -> DataFrame:
    """x, x-2, x-3, ... per group in the given order; numbers whose name is somebody's own slug are passed over."""
    numbered = row_numbers(rows, [group, base], order, "_k")
    own = numbered.select(group, base).distinct()
    parts = own.select(
        group, F.regexp_extract(base, "^(.*)-([0-9]{1,9})$", 1).alias(base), F.regexp_extract(base, "^(.*)-([0-9]{1,9})$", 2).alias("_t")
    ).filter("_t <> '' and _t not like '0%' and _t <> '1'")
    repeated = numbered.filter("_k = 2").select(group, base)
    taken = parts.join(repeated, [group, base], "left_semi").groupBy(group, base).agg(
        F.array_sort(F.collect_set(F.col("_t").cast("long"))).alias("_taken")
    )
    j = numbered.join(taken, [group, base], "left")
    none = F.array().cast("array<bigint>")
    skipped = F.size(F.filter(F.coalesce("_taken", none), lambda t, i: t - i <= F.col("_k")))
    return j.withColumn(
        name, F.when(F.col("_k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("_k") + skipped))
    ).drop("_k", "_taken")


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _front(pairs: list[tuple[str, Column]]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in pairs]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def document_text(with_tags: bool = True, front: list[tuple[str, Column]] | None = None) -> Column:
    """Markdown of one memory: front matter, title, summary quote, content, tag line."""
    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", _quoted), ", "), F.lit("]"))
    pairs = front or [
        ("id", _quoted(F.col("id"))), ("type", _quoted(F.col("type"))), ("user_id", _quoted(F.col("user_id"))),
        ("importance", F.col("importance").cast("string")), ("tags", tags), ("source", _quoted(F.col("source"))),
        ("status", _quoted(F.col("status"))), ("created_at", _quoted(_iso(F.col("created_at")))),
        ("updated_at", _quoted(_iso(F.col("updated_at")))),
    ]
    summary = tx.strip(tx.text_or_empty(F.col("summary")))
    quote = F.when((summary != "") & (summary != F.col("title")), F.concat(F.lit("> "), summary, F.lit("\n")))
    line = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), tx.slug(t))), " ")
    footer = F.when(F.size("tags") > 0, F.concat(F.lit("\n---\n\nTags: "), line)) if with_tags else F.lit(None)
    body = F.concat_ws(
        "\n", _front(pairs), F.concat(F.lit("# "), "title"), F.lit(""), quote, tx.strip(tx.text_or_empty(F.col("content"))), footer
    )
    return F.concat(F.rtrim(body, F.lit(tx.WHITESPACE)), F.lit("\n"))


def render_knowledge(memories: DataFrame) -> DataFrame:
    """One document per worthy row: id, category, title, slug, path, text."""
    rows = knowledge_rows(memories).withColumns(
        {"category": category(F.col("type"), F.col("tags")), "title": tx.title(F.col("summary"), F.col("content"), F.col("id"))}
    )
    rows = rows.withColumn("base", tx.slug(F.col("title")))
    named = unique_slugs(rows, "category", "base", ["created_at", "id"])
    return named.withColumn("path", F.concat_ws("/", "category", F.concat("slug", F.lit(".md")))).withColumn(
        "text", document_text()
    )


def index_lines(documents: DataFrame, group: str = "category", note: str = "document(s)", with_summary: bool = True) -> DataFrame:
    """Per-folder index as rows (group, part, slug, line): heading, count, then one line per document in slug order.

    The lines of a folder are rows, not one string, so that a large folder stays spread out."""
    summary = F.replace(tx.strip(tx.text_or_empty(F.col("summary"))), F.lit("\n"), F.lit(" "))
    tail = F.when((summary != "") & (summary != F.col("title")), F.concat(F.lit(" — "), F.substring(summary, 1, 120))).otherwise("")
    link = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("slug"), F.lit(".md)"))
    items = documents.select(group, F.lit(2).alias("part"), "slug", (F.concat(link, tail) if with_summary else link).alias("line"))
    counts = documents.groupBy(group).agg(F.count("*").alias("n"))
    head = counts.select(group, F.lit(0).alias("part"), F.lit("").alias("slug"), F.concat(F.lit("# "), F.col(group)).alias("line"))
    size = counts.select(group, F.lit(1).alias("part"), F.lit("").alias("slug"), F.concat(F.lit("_"), "n", F.lit(f" {note}._")).alias("line"))
    return head.unionByName(size).unionByName(items)


def master_index(documents: DataFrame, group: str = "category", always: tuple[str, ...] = lx.ALWAYS_INDEXED) -> DataFrame:
    """Folder and number of documents; the folders in ``always`` appear even when empty."""
    counts = documents.groupBy(group).agg(F.count("*").alias("documents"))
    if not always:
        return counts
    fixed = documents.sparkSession.createDataFrame([(a,) for a in always], f"{group} string")
    return counts.join(fixed, group, "full_outer").withColumn("documents", F.coalesce("documents", F.lit(0)))


def orphans(before: DataFrame, written: DataFrame) -> DataFrame:
    """Paths that existed before and were not written this time; index files do not count."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return before.filter(name != "readme.md").select("path").join(written.select("path"), "path", "left_anti")


def export_agents(memories: DataFrame) -> DataFrame:
    """One document per active row, in a folder per agent."""
    agent = F.when(tx.text_or_empty(F.col("agent_id")) == "", "default").otherwise(F.col("agent_id"))
    rows = fl.active(memories).withColumns(
        {"agent_id": agent, "title": tx.title(F.col("summary"), F.col("content"), F.col("id"))}
    ).withColumn("base", tx.slug(F.col("title")))
    named = unique_slugs(rows, "agent_id", "base", ["created_at", "id"])
    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", _quoted), ", "), F.lit("]"))
    front = [
        ("id", _quoted(F.col("id"))), ("type", _quoted(F.col("type"))), ("agent_id", _quoted(F.col("agent_id"))),
        ("user_id", _quoted(F.col("user_id"))), ("importance", F.col("importance").cast("string")), ("tags", tags),
        ("shared", F.col("shared").cast("string")), ("timestamp", _quoted(_iso(F.coalesce("updated_at", "created_at")))),
        ("created_at", _quoted(_iso(F.col("created_at")))),
    ]
    return named.withColumn("path", F.concat_ws("/", "agent_id", F.concat("slug", F.lit(".md")))).withColumn(
        "text", document_text(with_tags=False, front=front)
    )


def write_documents(documents: DataFrame, path: str, group: str = "category") -> None:
    """Documents as parquet, one folder per category or agent."""
    documents.select(group, "path", "text").write.mode("overwrite").partitionBy(group).parquet(path)


def write_snapshot(rows: DataFrame, path: str, day: str) -> None:
    """Full dump as JSON lines in the folder of one day."""
    rows.write.mode("overwrite").json(f"{path}/day={day}")


def expired_days(days: DataFrame, as_of: Column, keep_days: int = 14, col: str = "day") -> DataFrame:
    """Snapshot days that fall out of retention."""
    return days.filter(F.col(col) < F.date_sub(F.to_date(as_of), keep_days))


# --- Edited documents -----------------------------------------------------------------------------------


def read_knowledge(documents: DataFrame) -> DataFrame:
    """Documents (path, text) parsed back: memory_id, title, summary, content, importance, type, status, tags, updated_at.

    ``matched`` is false for files without front matter or id."""
    text = F.col("text")
    front = F.when(text.rlike(FRONT), F.regexp_extract(text, FRONT, 1))
    body = F.regexp_replace(F.regexp_replace(text, FRONT, ""), "(?s)\\r?\\n---\\r?\\n\\r?\\nTags:.*\\z", "")
    d = with_front_matter(documents, "_m", front).withColumn("_lines", tx.lines(body))
    stripped = F.transform("_lines", tx.strip)
    heads = F.transform(stripped, lambda s: s.startswith("# "))
    at = F.array_position(heads, F.lit(True))
    title = F.when(at > 0, tx.strip(F.substring(F.element_at(stripped, at.cast("int")), 3, 1_000_000_000))).otherwise("")
    d = d.withColumn("title", title).withColumn(
        "_rest", F.filter("_lines", lambda _, i: i + 1 != at)
    )
    # Quote lines count as summary until the first other line; the last of them wins.
    opening = F.aggregate(
        "_rest",
        F.struct(F.lit(True).alias("open"), F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda a, r: F.when(
            a["open"] & tx.strip(r).startswith(">"),
            F.struct(F.lit(True).alias("open"), tx.strip(F.ltrim(tx.strip(r), F.lit(">"))).alias("s"), (a["n"] + 1).alias("n")),
        ).otherwise(F.struct(F.lit(False).alias("open"), a["s"].alias("s"), a["n"].alias("n"))),
    )
    # The blank line after the title stands before the quote.
    d = d.withColumn("_rest", F.when(F.get("_rest", F.lit(0)) == "", F.slice("_rest", F.lit(2), F.size("_rest"))).otherwise(F.col("_rest")))
    d = d.withColumn("_o", opening)
    content = tx.strip(F.array_join(F.slice("_rest", F.col("_o.n") + 1, F.greatest(F.lit(0), F.size("_rest"))), "\n"))
    fields = "_m.fields"
    return d.select(
        "path", F.nullif(F.try_element_at(fields, F.lit("id")), F.lit("")).alias("memory_id"), "title",
        F.col("_o.s").alias("summary"), content.alias("content"), F.col("_m.importance").alias("importance"),
        F.try_element_at(fields, F.lit("type")).alias("type"), F.try_element_at(fields, F.lit("status")).alias("status"),
        F.col("_m.tags").alias("tags"), tx.iso_to_utc(F.try_element_at(fields, F.lit("updated_at"))).alias("updated_at"),
        (F.col("_m.valid") & F.coalesce(F.try_element_at(fields, F.lit("id")) != "", F.lit(False))).alias("matched"),
    )


MERGED_FIELDS = ("content", "summary", "importance", "type", "status", "tags")


def reconcile(memories: DataFrame, docs: DataFrame, as_of: Column) -> DataFrame:
    """Rows touched by edited documents: the merged values, the changed fields and the outcome.

    Empty document values never win. ``conflict`` when the row is newer than the document: it keeps its values.
    Outcomes: unchanged, updated, conflict, unmatched."""
    m = memories.select("id", "updated_at", *MERGED_FIELDS).select("id", F.struct("updated_at", *MERGED_FIELDS).alias("m"))
    d = docs.select(F.col("memory_id").alias("id"), F.struct("updated_at", *MERGED_FIELDS).alias("d"))
    j = d.join(m, "id", "left")

    def differs(f: str) -> Column:
        new, old = F.col(f"d.{f}"), F.col(f"m.{f}")
        if f == "importance":
            return new.isNotNull() & (old.isNull() | (F.abs(new - old) > 1e-6))
        if f == "tags":
            return (F.size(new) > 0) & ~new.eqNullSafe(F.coalesce(old, F.array().cast("array<string>")))
        if f in ("content", "summary"):
            new, old = tx.strip(tx.text_or_empty(new)), tx.strip(tx.text_or_empty(old))
        else:
            new, old = tx.text_or_empty(new), tx.text_or_empty(old)
        return (new != "") & (new != old)

    changed = F.filter(
        F.array(*[F.when(F.coalesce(differs(f), F.lit(False)), F.lit(f)) for f in MERGED_FIELDS]), lambda x: x.isNotNull()
    )
    newer = F.coalesce(micros(F.col("m.updated_at")) > micros(F.col("d.updated_at")), F.lit(False))
    outcome = (
        F.when(F.col("m").isNull(), "unmatched").when(F.size("changed") == 0, "unchanged").when(newer, "conflict").otherwise("updated")
    )
    j = j.withColumn("changed", F.when(F.col("m").isNull(), F.array().cast("array<string>")).otherwise(changed)).withColumn("outcome", outcome)
    take = lambda f: F.when((F.col("outcome") == "updated") & F.array_contains("changed", f), F.col(f"d.{f}")).otherwise(F.col(f"m.{f}"))
    return j.select(
        "id", "outcome", "changed", *[take(f).alias(f) for f in MERGED_FIELDS],
        F.when(F.col("outcome") == "updated", as_of).otherwise(F.col("m.updated_at")).alias("updated_at"),
    )


