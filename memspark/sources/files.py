"""Reading files and change detection."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions import lexicons as lx
from memspark.functions import text as tx
from memspark.functions.time import clamp


def scan_files(
    spark: SparkSession, roots: Sequence[str], patterns: Sequence[str] = ("*.md",), exclude: Sequence[str] = ()
) -> DataFrame:
    """Files under the roots whose name fits a pattern and whose path has no excluded folder: path, name,
    modificationTime, length, content. The bytes are read only if ``content`` is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if len(patterns) == 1:
        reader = reader.option("pathGlobFilter", patterns[0])
    files = reader.load(list(roots)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    wanted = "|".join(fnmatch.translate(p) for p in patterns).replace("\\Z", "$").replace("\\z", "$")
    files = files.filter(F.col("name").rlike(f"^(?:{wanted})$"))
    for folder in exclude:
        files = files.filter(~F.col("path").rlike(f"/{re.escape(folder)}(/|$)"))
    return files


# --- Markdown with front matter -----------------------------------------------------------------------

FRONT = "(?s)\\A---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*\\r?\\n?"
HEADING = "(?md)^(#{1,6})\\s+(.*?)\\s*#*\\s*$"

_FRONT_TYPE = T.StructType(
    [
        T.StructField("valid", T.BooleanType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("joined", T.BooleanType()),
        T.StructField("importance", T.DoubleType()),
    ]
)


def _front_row(raw: str | None) -> tuple:
    """A front-matter block as the fields of ``_FRONT_TYPE``: values as text, tags as they are written."""
    invalid = (False, {}, [], False, None)
    if raw is None:
        return invalid
    try:
        loaded = yaml.safe_load(raw)
    except yaml.YAMLError:
        return invalid
    mapping = loaded if isinstance(loaded, dict) else {}
    fields = {str(k): json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else str(v) for k, v in mapping.items() if v is not None}
    tags, weight = mapping.get("tags"), mapping.get("importance")
    written = list(map(str, tags)) if isinstance(tags, (list, tuple, set)) else [str(tags)] * (tags is not None)
    return True, fields, written, isinstance(tags, str), float(weight) if type(weight) in (int, float) else None


def with_front_matter(df: DataFrame, name: str, block: Column) -> DataFrame:
    """Adds ``name``, a front-matter text as struct(valid, fields, tags, joined, importance). YAML has no built-in reader in Spark.

    Tags written as one string (``joined``) are split, listed ones stripped.
    """

    @F.pandas_udf(_FRONT_TYPE)
    def read(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_front_row(r) for r in raw], columns=_FRONT_TYPE.names)

    tags = F.when(F.col(f"{name}.joined"), tx.split_tags(F.get(f"{name}.tags", F.lit(0))))
    listed = F.filter(F.transform(f"{name}.tags", tx.strip), lambda t: t != "")
    return df.withColumn(name, read(block)).withColumn(name, F.col(name).withField("tags", F.coalesce(tags, listed)))


def parse_markdown(df: DataFrame, text: str = "text", stem: Column | None = None) -> DataFrame:
    """Adds title, body, tags, meta. Title: front matter, else first heading, else ``stem``. Tags: front matter, then
    all headings, first spelling of each wins."""
    c = F.col(text)
    raw = F.when(c.rlike(FRONT), F.regexp_extract(c, FRONT, 1))
    parsed = with_front_matter(df, "meta", raw).withColumn("_body", F.regexp_replace(c, FRONT, ""))
    headings = F.filter(
        F.transform(F.regexp_extract_all("_body", F.lit(HEADING), F.lit(2)), tx.strip), lambda h: h != ""
    )
    parsed = parsed.withColumn("_h", headings)
    own = F.nullif(tx.strip(F.try_element_at("meta.fields", F.lit("title"))), F.lit(""))
    fallback = stem if stem is not None else F.lit("untitled")
    every = F.concat("meta.tags", "_h")
    low = F.transform(every, F.lower)
    return parsed.withColumn("title", F.coalesce(own, F.get("_h", F.lit(0)), fallback)).withColumn(
        "tags", F.filter(every, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    ).withColumn("body", tx.strip(F.col("_body"))).drop("_body", "_h")


def to_memories(parsed: DataFrame, folder: Column | None = None, user_id: str = "default", source: str = "scanner") -> DataFrame:
    """Memory rows from parsed files: heading put back, importance bounded, type ``note`` unless given."""
    body = F.col("body")
    content = F.when(
        (F.col("title") != "") & ~F.ltrim(body, F.lit(tx.WHITESPACE)).startswith("#"),
        F.concat(F.lit("# "), "title", F.lit("\n\n"), body),
    ).otherwise(body)
    extra = F.array().cast("array<string>") if folder is None else F.when(folder != "", F.array(folder)).otherwise(
        F.array().cast("array<string>")
    )
    return parsed.withColumns(
        {
            "content": content,
            "summary": F.col("title"),
            "importance": F.coalesce(clamp(F.col("meta.importance")), F.lit(0.5)),
            "type": F.coalesce(F.try_element_at("meta.fields", F.lit("type")), F.lit("note")),
            "tags": F.concat("tags", extra),
            "user_id": F.lit(user_id),
            "source": F.lit(source),
        }
    )


# --- State of files already seen ----------------------------------------------------------------------


def diff_files(current: DataFrame, state: DataFrame) -> DataFrame:
    """current (path, hash) against state (path, hash, status): new, changed or unchanged.

    A file counts as unchanged only if its last run stored it."""
    s = state.select("path", F.col("hash").alias("_old"), F.col("status").alias("_status"))
    return current.join(s, "path", "left").withColumn(
        "change",
        F.when(F.col("_old").isNull(), "new")
        .when((F.col("_old") == F.col("hash")) & (F.col("_status") == "stored"), "unchanged")
        .otherwise("changed"),
    ).drop("_old", "_status")


def link_files(files: DataFrame, memories: DataFrame) -> DataFrame:
    """File rows with the memory (and its document path) each of them produced."""
    m = memories.select(F.col("id").alias("memory_id"), "document_path")
    return files.join(m, "memory_id", "left")


def upsert_documents(target: DataFrame, source: DataFrame) -> DataFrame:
    """Full new version of ``target``: rows are matched by (collection, path); equal hashes leave a row alone; the old
    vector stays when the new one is null. ``action`` tells insert, update, unchanged or kept."""
    keys = ["collection", "path"]
    fields = [c for c in target.columns if c not in keys]
    t = target.select(*keys, F.struct(*fields).alias("t"))
    s = source.select(*keys, F.struct(*[F.col(c) if c in source.columns else F.lit(None).alias(c) for c in fields]).alias("s"))
    j = t.join(s, keys, "full_outer")
    action = (
        F.when(F.col("t").isNull(), "insert").when(F.col("s").isNull(), "kept")
        .when(F.col("t.content_hash") == F.col("s.content_hash"), "unchanged").otherwise("update")
    )
    j = j.withColumn("action", action)
    new = F.col("action").isin("insert", "update")

    def value(c: str) -> Column:
        if c == "embedding":
            return F.when(new, F.coalesce("s.embedding", "t.embedding")).otherwise(F.col("t.embedding"))
        return F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}"))

    return j.select(*keys, *[value(c).alias(c) for c in fields], "action")


def delete_missing(target: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the collections just scanned whose path was not found any more are dropped. ``found`` lists every path
    met, also skipped and failed ones."""
    scanned = found.select("collection").distinct().withColumn("_scanned", F.lit(True))
    seen = found.select("collection", "path").distinct().withColumn("_seen", F.lit(True))
    j = target.join(seen, ["collection", "path"], "left").join(F.broadcast(scanned) if scanned.count() < 100_000 else scanned, "collection", "left")
    return j.filter(F.col("_seen").isNotNull() | F.col("_scanned").isNull()).drop("_seen", "_scanned")


def import_chunks(chunks: DataFrame, memories: DataFrame, exclude: Sequence[str], prefix: str = "chunk_hash:") -> DataFrame:
    """Outside text chunks (chunk_id, path, text, updated_at) not yet imported; one row per text, the earliest.

    Imported hashes are found as ``prefix`` tags of the memories."""
    c = chunks
    for p in exclude:
        c = c.filter(~F.col("path").startswith(p))
    hashed = c.withColumn("content_hash", F.sha2("text", 256))
    row = F.struct("chunk_id", "path", "text", "updated_at")
    first = hashed.groupBy("content_hash").agg(F.min_by(row, F.struct("updated_at", "chunk_id")).alias("r"))
    known = memories.select(F.explode("tags").alias("tag")).filter(F.col("tag").startswith(prefix))
    known = known.select(F.substring("tag", len(prefix) + 1, 64).alias("content_hash"))
    return first.select("content_hash", "r.*").join(known, "content_hash", "left_anti")


def chunk_rows(new: DataFrame, source: str, prefix: str = "chunk_hash:", user_id: str = "default", agent_id: str = "import") -> DataFrame:
    """Memory rows for imported chunks, tagged with origin, hash, id and path."""
    return new.select(
        F.lit(user_id).alias("user_id"), F.lit(agent_id).alias("agent_id"), F.lit("imported").alias("type"),
        F.col("text").alias("content"), F.lit("").alias("summary"), F.lit(0.5).alias("importance"),
        F.array(F.lit(f"source:{source}"), F.concat(F.lit(prefix), "content_hash"), F.concat(F.lit("chunk_id:"), "chunk_id"),
                F.concat(F.lit("chunk_path:"), "path")).alias("tags"),
        F.lit(source).alias("source"),
    )


def index_workspace(files: DataFrame, folders: Mapping[str, str] = lx.WATCHED_FOLDERS, content_limit: int | None = None) -> DataFrame:
    """Markdown files (path, content) of the watched top folders: category, subcategory, title, summary, tags, text."""
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    table = F.create_map(*[F.lit(x) for kv in folders.items() for x in kv])
    f = files.withColumn("category", F.try_element_at(table, parts[0])).filter(
        F.col("category").isNotNull() & (F.size(parts) > 1) & name.endswith(".md") & ~name.isin(*lx.SKIPPED_FILES)
    )
    for p in lx.SKIPPED_PATTERNS:
        f = f.filter(~F.col("path").rlike(p))
    rows = F.split("content", "\n")
    heading = F.get(F.filter(rows, lambda r: r.startswith("# ")), F.lit(0))
    stem = F.initcap(F.replace(F.regexp_replace(name, "\\.md$", ""), F.lit("-"), F.lit(" ")))
    title = F.coalesce(F.nullif(tx.strip(F.substring(heading, 3, 1_000_000_000)), F.lit("")), stem)
    long_lines = F.filter(F.transform(rows, tx.strip), lambda r: ~r.startswith("#") & (F.length(r) > 10))
    found = F.regexp_extract_all("content", F.lit("#([\\p{L}\\p{N}_][\\p{L}\\p{N}_-]*)"), F.lit(1))
    return f.select(
        "path", title.alias("title"), F.coalesce(F.substring(F.get(long_lines, F.lit(0)), 1, 200), title).alias("summary"),
        (F.col("content") if content_limit is None else F.substring("content", 1, content_limit)).alias("content"), "category",
        F.when(F.size(parts) > 2, parts[1]).otherwise(F.col("category")).alias("subcategory"),
        F.array_distinct(F.concat(F.array("category"), F.slice(found, 1, 5))).alias("tags"),
    )


def classify_files(files: DataFrame, bootstrap: Sequence[str] = lx.BOOTSTRAP_FILES,
                   absorbable: Sequence[str] = lx.ABSORBABLE_PATTERNS) -> DataFrame:
    """kind of each file: bootstrap by name, absorbable by a pattern at the start of its path, else other."""
    name = F.element_at(F.split("path", "/"), -1)
    any_pattern = "^(?:" + "|".join(absorbable) + ")"
    return files.withColumn(
        "kind",
        F.when(name.isin(*bootstrap), "bootstrap")
        .when(name.endswith(".md") & F.col("path").rlike(any_pattern), "absorbable")
        .otherwise("other"),
    )
