"""Queries: sources, ingest, updates, exports and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.time import micros
from memspark.operators import lifecycle as lc
from memspark.plans.registry import query
from memspark.plans.selection import as_of
from memspark.plans.views import Tables
from memspark.sources import events as ev
from memspark.sources import export as ex
from memspark.sources import files as fi
from memspark.sources import rows as ro


@query("i01_discover_files")
def discover(t: Tables) -> DataFrame:
    """The table files themselves, by name pattern and excluded folder."""
    f = fi.scan_files(t.spark, [t.dir], ["*s.parquet", "part*"], exclude=["_tmp"])
    return f.select("name", "length")


def parsed(t: Tables) -> DataFrame:
    return fi.parse_markdown(t.markdown_files(), "text", F.concat(F.lit("p"), F.col("page_id").cast("string")))


@query("i02_parse_markdown", """SELECT page_id, h AS title, trim(inner_text, ' ' || chr(10)) AS body,
      array_to_string(list_filter(['web', host, h, 'Web'], lambda x, i: list_position(['web', lower(host), lower(h), 'web'], lower(x)) = i AND x <> ''), '|') AS tags
    FROM (SELECT *, rtrim(rtrim(heading, '#'), ' ') AS h FROM markdown_files)""")
def parse(t: Tables) -> DataFrame:
    return parsed(t).select("page_id", "title", "body", F.array_join("tags", "|").alias("tags"))


@query("i03_to_memories", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'page' ELSE 'note' END AS type, CASE WHEN page_id % 2 = 0 THEN 1e0 ELSE 0.5e0 END AS importance,
      rtrim(rtrim(heading, '#'), ' ') AS summary, length(trim(inner_text, ' ' || chr(10))) AS content_length, folder AS extra_tag FROM markdown_files""")
def to_memories(t: Tables) -> DataFrame:
    m = fi.to_memories(parsed(t), F.col("folder"))
    return m.select("page_id", "type", "importance", "summary", F.length("content").alias("content_length"), F.element_at("tags", -1).alias("extra_tag"))


@query("i04_change_detection", """SELECT d.path, CASE WHEN o.path IS NULL THEN 'new' WHEN o.content_hash = d.content_hash AND o.last_status = 'stored' THEN 'unchanged' ELSE 'changed' END AS change
    FROM doc_collection d LEFT JOIN doc_collection_old o ON o.path = d.path""")
def changes(t: Tables) -> DataFrame:
    state = t.doc_collection_old().select("path", F.col("content_hash").alias("hash"), F.col("last_status").alias("status"))
    return fi.diff_files(t.doc_collection().select("path", F.col("content_hash").alias("hash")), state).select("path", "change")


@query("i05_document_upsert", """SELECT coalesce(o.collection, d.collection) AS collection, coalesce(o.path, d.path) AS path,
      CASE WHEN o.path IS NULL THEN 'insert' WHEN d.path IS NULL THEN 'kept' WHEN o.content_hash = d.content_hash THEN 'unchanged' ELSE 'update' END AS action, coalesce(d.content_hash, o.content_hash) AS content_hash
    FROM doc_collection_old o FULL JOIN doc_collection d ON o.collection = d.collection AND o.path = d.path""")
def upsert(t: Tables) -> DataFrame:
    cols = ["collection", "path", "title", "content", "content_hash"]
    vector = F.array(F.lit(1.0)).alias("embedding")
    old = t.doc_collection_old().select(*cols, vector)
    new = t.doc_collection().select(*cols, F.lit(None).cast("array<double>").alias("embedding"))
    return fi.upsert_documents(old, new).select("collection", "path", "action", "content_hash")


@query("i06_delete_missing", """SELECT d.path FROM doc_collection d WHERE collection NOT IN (SELECT collection FROM doc_collection_old WHERE toxic = 0)
      OR path IN (SELECT path FROM doc_collection_old WHERE toxic = 0)""")
def delete_missing(t: Tables) -> DataFrame:
    """Only the labelled, non-toxic files were found this time."""
    found = t.doc_collection_old().filter("toxic = 0").select("collection", "path")
    return fi.delete_missing(t.doc_collection(), found).select("path")


@query("i07_import_chunks", """SELECT min(doc_id) AS first_doc, sha256(text) AS content_hash FROM documents WHERE source <> 'src0'
      AND sha256(text) NOT IN (SELECT content_hash FROM doc_collection_old WHERE quality = 1) GROUP BY 2""")
def chunks(t: Tables) -> DataFrame:
    """Labelled good documents count as imported already; one folder is left out."""
    known = t.doc_collection_old().filter("quality = 1").select(F.array(F.concat(F.lit("chunk_hash:"), "content_hash")).alias("tags"))
    new = fi.import_chunks(t.chunks(), known, ["a/src0/", "b/src0/"])
    rows = fi.chunk_rows(new, "sync")
    ids = F.get(F.filter("tags", lambda x: x.startswith("chunk_id:")), F.lit(0))
    hashes = F.get(F.filter("tags", lambda x: x.startswith("chunk_hash:")), F.lit(0))
    return rows.select(F.regexp_extract(ids, "([0-9]+)$", 1).cast("long").alias("first_doc"), F.substring(hashes, 12, 64).alias("content_hash"))


def event_lines(t: Tables, part: Column | None = None) -> DataFrame:
    """The feed, or a part of it, as lines of an event log; the lines of ``view`` events are broken."""
    e = t.feed() if part is None else t.feed().filter(part)
    action = F.when(F.col("event_type").isin("signup", "purchase"), "store").otherwise("update")
    source = F.when(F.col("user_id") % 4 == 0, "local").otherwise("client")
    data = F.struct(action.alias("action"), F.col("event_id").cast("string").alias("memory_id"), source.alias("source"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    good = F.to_json(F.struct(data.alias("data")))
    return e.select(F.when(F.col("event_type") == "view", F.concat(F.lit("{broken "), "props")).otherwise(good).alias("value"))


@query("i08_event_log", """SELECT CAST(event_id AS VARCHAR) AS memory_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events WHERE event_type IN ('signup', 'purchase') AND user_id % 4 <> 0""")
def event_log(t: Tables) -> DataFrame:
    return ev.stored_elsewhere(ev.parse_log(event_lines(t)), own_source="local").select("memory_id", "timestamp")


@query("i09_workspace_index", """WITH f AS (SELECT *, string_split(content, chr(10)) AS ls, CASE lang WHEN 'en' THEN 'project' ELSE 'rule' END AS category FROM workspace WHERE lang IN ('en', 'fr') AND path NOT LIKE '%/README.md'),
    x AS (SELECT *, list_filter(list_transform(ls, lambda l: trim(l)), lambda l: NOT starts_with(l, '#') AND length(l) > 10)[1] AS long_line, list_filter(ls, lambda l: starts_with(l, '# '))[1] AS head FROM f)
    SELECT path, coalesce(trim(substr(head, 3)), 'D ' || doc_id) AS title, coalesce(left(long_line, 200), coalesce(trim(substr(head, 3)), 'D ' || doc_id)) AS summary, category, source AS subcategory,
      length(content) AS size, array_to_string(list_sort(list_distinct(list_concat([category], (regexp_extract_all(content, '#([\\p{L}\\p{N}_][\\p{L}\\p{N}_-]*)', 1))[1:5]))), ',') AS tags FROM x""")
def workspace(t: Tables) -> DataFrame:
    w = fi.index_workspace(t.workspace().select("path", "content"))
    return w.select("path", "title", "summary", "category", "subcategory", F.length("content").alias("size"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("i10_classify_files", """SELECT doc_id, CASE WHEN path LIKE '%/README.md' THEN 'bootstrap' WHEN path LIKE 'memory/%' THEN 'absorbable' ELSE 'other' END AS kind FROM workspace""")
def classify(t: Tables) -> DataFrame:
    return fi.classify_files(t.workspace()).select("doc_id", "kind")


@query("a15_category_counts", "SELECT category, count(*) AS documents FROM (SELECT CASE lang WHEN 'en' THEN 'project' ELSE 'rule' END AS category FROM workspace WHERE lang IN ('en', 'fr') AND path NOT LIKE '%/README.md') GROUP BY 1")
def category_counts(t: Tables) -> DataFrame:
    return ex.master_index(fi.index_workspace(t.workspace().select("path", "content")), always=())


RAW = "(SELECT doc_id, text, n_chars, lang, CASE WHEN doc_id % 9 = 0 THEN '' ELSE text END AS content, CASE WHEN n_chars % 7 = 0 THEN 1.5e0 WHEN n_chars % 7 = 1 THEN NULL ELSE 0.4e0 END AS importance, CASE lang WHEN 'es' THEN 'lost' WHEN 'fr' THEN NULL ELSE 'active' END AS status FROM documents)"


def raw_rows(t: Tables) -> DataFrame:
    d, n = t.raw("documents"), F.col("n_chars")
    return d.select(
        "doc_id", F.lit("u1").alias("user_id"), F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("text")).alias("content"),
        F.when(n % 7 == 0, 1.5).when(n % 7 == 1, None).otherwise(0.4).alias("importance"),
        F.when(F.col("lang") == "es", "lost").when(F.col("lang") == "fr", None).otherwise("active").alias("status"), F.array(F.lit(9.9)).alias("embedding"),
    )


@query("i11_new_rows", f"""SELECT doc_id, coalesce(importance, 0.5) AS importance, 'default' AS agent_id, 'general' AS type, 'active' AS status, CASE WHEN content = '' THEN 'content empty' WHEN importance > 1 THEN 'importance out of range' WHEN status = 'lost' THEN 'status unknown' ELSE '' END AS reason FROM {RAW}
      WHERE reason = '' UNION ALL SELECT doc_id, coalesce(importance, 0.5), 'default', 'general', coalesce(status, 'active'), CASE WHEN content = '' THEN 'content empty' WHEN importance > 1 THEN 'importance out of range' ELSE 'status unknown' END FROM {RAW} WHERE content = '' OR importance > 1 OR status = 'lost'""")
def new_rows(t: Tables) -> DataFrame:
    good, bad = ro.new_memories(raw_rows(t), as_of())
    cols = ("doc_id", "importance", "agent_id", "type", "status", "reason")
    return good.withColumn("reason", F.lit("")).select(*cols).unionByName(bad.select(*cols))


@query("i12_search_text", """SELECT id, array_to_string(regexp_extract_all(lower(content || chr(10) || CASE WHEN summary = '' THEN '' ELSE summary || chr(10) END || array_to_string(tags, ' ')), '[\\p{L}\\p{N}_]+'), ' ') AS search_text FROM memories_base""")
def search_text(t: Tables) -> DataFrame:
    return ro.with_search_text(t.memories_base()).select("id", "search_text")


@query("i12_document_search_text", "SELECT doc_id, array_to_string(regexp_extract_all(lower(title || chr(10) || content), '[\\p{L}\\p{N}_]+'), ' ') AS search_text FROM doc_collection")
def document_search_text(t: Tables) -> DataFrame:
    return ro.documents_with_search_text(t.doc_collection()).select("doc_id", "search_text")


@query("i13_backfill_embeddings", """SELECT m.id, CASE WHEN m.type = 'general' THEN 1 ELSE (SELECT count(*) FROM memory_vectors v WHERE v.id = m.id) END AS used_dims FROM memories_base m""")
def backfill(t: Tables) -> DataFrame:
    m = t.memories_base().withColumn("embedding", F.when(F.col("type") == "general", F.array(F.lit(1.0))))
    return ro.backfill_embeddings(m).select("id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used_dims"))


@query("i14_backfill_summaries", """WITH s AS (SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g'), ' ') AS c, trim(regexp_replace(trim(content, ' ' || chr(10)), '\\s+', ' ', 'g'), ' ') AS head, length(trim(content, ' ' || chr(10))) AS n FROM memories_base WHERE status = 'active' AND summary = ''),
    o AS (SELECT *, regexp_extract(head, '^(.*?[.!?。！？])(?:\\s|$)', 1) AS one FROM s)
    SELECT id, left(CASE WHEN n <= 50 THEN c WHEN one <> '' THEN one ELSE head END, 120) AS new_summary FROM o""")
def summaries(t: Tables) -> DataFrame:
    return ro.backfill_summaries(t.memories_base()).select("id", "new_summary")


@query("i15_apply_patches", """SELECT m.id, coalesce(p.importance, m.importance) AS importance, coalesce(p.status, m.status) AS status, coalesce(p.summary, m.summary) AS summary, p.id IS NOT NULL AS touched FROM memories_base m LEFT JOIN patches p ON p.id = m.id""")
def patches(t: Tables) -> DataFrame:
    m = t.memories_base().withColumn("updated_at", F.lit(0))
    out = lc.apply_patches(m, t.patches())
    return out.select("id", "importance", "status", "summary", (F.col("updated_at") > 0).alias("touched"))


@query("i16_archive_and_purge", """SELECT id, CASE WHEN id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0) THEN 'archived' ELSE status END AS status FROM memories_base WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""")
def archive_purge(t: Tables) -> DataFrame:
    l = t.raw("labels").withColumn("id", F.col("doc_id").cast("string"))
    kept = lc.purge(lc.archive(t.memories_base(), l.filter("quality = 0")), l.filter("toxic = 1"))
    return kept.select("id", "status")


@query("i17_reinforcement", """SELECT m.id, count(DISTINCT t.request_id) AS access_count, coalesce(epoch_us(max(t.ts)), 0) AS last_us FROM memories_base m LEFT JOIN touches t ON t.n = m.n GROUP BY m.id""")
def reinforce(t: Tables) -> DataFrame:
    m = t.memories_base().withColumns({"access_count": F.lit(0).cast("long"), "last_access": F.lit(None).cast("timestamp_ntz")})
    out = lc.apply_touches(m, t.touches().select(F.col("n").cast("string").alias("id"), "request_id", "ts"))
    return out.select("id", "access_count", F.coalesce(micros(F.col("last_access")), F.lit(0)).alias("last_us"))


# --- Exports --------------------------------------------------------------------------------------------

WORTHY = "SELECT * FROM memories_base WHERE status = 'active' AND type <> 'tool_result' AND (shared OR importance >= 0.6)"
SLUGS = """t AS (SELECT *, CASE WHEN trim(summary) <> '' THEN left(trim(summary), 100) ELSE left(split_part(trim(content, ' ' || chr(10) || chr(9)), chr(10), 1), 100) END AS title FROM src),
    b AS (SELECT *, rtrim(left(trim(regexp_replace(lower(trim(title)), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-'), 60), '-') AS base0 FROM t),
    k AS (SELECT *, CASE WHEN base0 = '' THEN 'untitled' ELSE base0 END AS base FROM b),
    n AS (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY created_at, id) AS k FROM k),
    named AS (SELECT *, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM n)"""
FOLDER = "CASE type WHEN 'project' THEN 'Projects' WHEN 'preference' THEN 'Rules' ELSE 'General' END"


@query("i18_knowledge_rows", f"SELECT id FROM ({WORTHY})")
def knowledge_rows(t: Tables) -> DataFrame:
    return ex.knowledge_rows(t.memories_base()).select("id")


def documents(t: Tables) -> DataFrame:
    return ex.render_knowledge(t.memories_base().withColumn("updated_at", F.col("created_at")))


Q = "chr(34)"
DOC = f"""'---' || chr(10) || 'id: ' || {Q} || id || {Q} || chr(10) || 'type: ' || {Q} || type || {Q} || chr(10) || 'user_id: ' || {Q} || user_id || {Q} || chr(10) || 'importance: ' || importance || chr(10)
      || 'tags: [' || array_to_string(list_transform(tags, lambda x: {Q} || x || {Q}), ', ') || ']' || chr(10) || 'source: ' || {Q} || source || {Q} || chr(10) || 'status: ' || {Q} || status || {Q} || chr(10)
      || 'created_at: ' || {Q} || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || {Q} || chr(10) || 'updated_at: ' || {Q} || strftime(created_at, '%Y-%m-%dT%H:%M:%S') || {Q} || chr(10) || '---' || chr(10)
      || '# ' || title || chr(10) || chr(10) || CASE WHEN trim(summary) <> '' AND trim(summary) <> title THEN '> ' || trim(summary) || chr(10) || chr(10) ELSE '' END
      || trim(content, ' ' || chr(10) || chr(9)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Tags: ' || array_to_string(list_transform(tags, lambda x: '#' || x), ' ') || chr(10)"""


@query("i19_render_knowledge", f"WITH src AS (SELECT *, {FOLDER} AS folder FROM ({WORTHY})), {SLUGS} SELECT id, folder AS category, folder || '/' || slug || '.md' AS path, {DOC} AS text FROM named")
def render(t: Tables) -> DataFrame:
    return documents(t).select("id", "category", "path", "text")


@query("i19_knowledge_index", f"""WITH src AS (SELECT *, {FOLDER} AS folder FROM ({WORTHY})), {SLUGS}, c AS (SELECT folder, count(*) AS n FROM named GROUP BY folder)
    SELECT folder AS category, 0 AS part, '# ' || folder AS line FROM c UNION ALL SELECT folder, 1, '_' || n || ' document(s)._' FROM c
    UNION ALL SELECT folder, 2, '- [' || title || '](' || slug || '.md)' || CASE WHEN trim(summary) <> '' AND trim(summary) <> title THEN ' — ' || left(trim(summary), 120) ELSE '' END FROM named""")
def knowledge_index(t: Tables) -> DataFrame:
    return ex.index_lines(documents(t)).select("category", "part", "line")


@query("i19_master_index", f"""WITH src AS (SELECT *, {FOLDER} AS folder FROM ({WORTHY})) SELECT category, (SELECT count(*) FROM src WHERE folder = category) AS documents FROM (VALUES ('People'), ('Projects'), ('Rules'), ('General')) v(category)""")
def master(t: Tables) -> DataFrame:
    return ex.master_index(documents(t))


@query("i20_orphans", f"""WITH src AS (SELECT *, {FOLDER} AS folder FROM ({WORTHY})), {SLUGS}, w AS (SELECT folder || '/' || slug || '.md' AS path FROM named)
    SELECT path FROM (SELECT path FROM w UNION SELECT 'General/' || doc_id || '.md' FROM labels) WHERE path NOT IN (SELECT path FROM w)""")
def orphans(t: Tables) -> DataFrame:
    """Files that were there before: today's, and one per label."""
    now = documents(t).select("path")
    before = now.unionByName(t.raw("labels").select(F.concat(F.lit("General/"), "doc_id", F.lit(".md")).alias("path")))
    return ex.orphans(before, now)


@query("i21_agent_export", f"WITH src AS (SELECT *, agent_id AS folder FROM memories_base WHERE status = 'active'), {SLUGS} SELECT agent_id, id, folder || '/' || slug || '.md' AS path FROM named")
def agents(t: Tables) -> DataFrame:
    m = t.memories_base().withColumn("updated_at", F.col("created_at"))
    return ex.export_agents(m).select("agent_id", "id", "path")


@query("i22_read_documents_back", f"""WITH src AS (SELECT *, {FOLDER} AS folder FROM ({WORTHY})), {SLUGS}
    SELECT id AS memory_id, trim(title) AS title, CASE WHEN trim(summary) <> '' AND trim(summary) <> title THEN trim(summary) ELSE '' END AS summary, md5(trim(content, ' ' || chr(10) || chr(9))) AS content_md5, importance, type, array_to_string(tags, ',') AS tags, epoch_us(created_at) AS updated_us, true AS matched FROM named""")
def read_back(t: Tables) -> DataFrame:
    """The rendered documents parsed again give the rows they were made from."""
    r = ex.read_knowledge(documents(t).select("path", "text"))
    return r.select("memory_id", "title", "summary", F.md5("content").alias("content_md5"), "importance", "type", F.array_join("tags", ",").alias("tags"),
                    micros(F.col("updated_at")).alias("updated_us"), "matched")


EDITED = """ed AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN quality = 0 THEN 'edited text' END AS content, CASE WHEN toxic = 1 THEN 'archived' ELSE '' END AS status, doc_id % 3 AS old FROM labels),
    j AS (SELECT e.id, e.content AS dc, e.status AS ds, e.old, m.content, m.status, m.importance, m.created_at FROM ed e JOIN memories_base m ON m.id = e.id),
    ch AS (SELECT *, list_filter([CASE WHEN dc IS NOT NULL AND dc <> trim(content, ' ' || chr(10)) THEN 'content' END, CASE WHEN old = 1 THEN 'importance' END, CASE WHEN ds <> '' AND ds <> status THEN 'status' END], lambda x: x IS NOT NULL) AS changed FROM j)"""


@query("i23_reconcile", f"""WITH {EDITED}, o AS (SELECT *, CASE WHEN len(changed) = 0 THEN 'unchanged' WHEN old = 0 THEN 'conflict' ELSE 'updated' END AS outcome FROM ch)
    SELECT id, outcome, array_to_string(changed, ',') AS changed, CASE WHEN outcome = 'updated' AND list_contains(changed, 'content') THEN dc ELSE content END AS content,
      round(CASE WHEN outcome = 'updated' AND list_contains(changed, 'importance') THEN importance + 0.001 ELSE importance END, 6) AS importance, CASE WHEN outcome = 'updated' AND list_contains(changed, 'status') THEN ds ELSE status END AS status FROM o""")
def reconcile(t: Tables) -> DataFrame:
    """Edits from the labels; documents of every third row are a day older than the row."""
    l = t.raw("labels").withColumn("id", F.col("doc_id").cast("string"))
    old = F.col("doc_id") % 3
    m = t.memories_base().withColumn("updated_at", F.col("created_at"))
    d = l.join(m.select("id", "importance", "updated_at", "tags"), "id").select(
        F.col("id").alias("memory_id"), F.when(F.col("quality") == 0, "edited text").alias("content"), F.lit("").alias("summary"),
        F.when(old == 1, F.col("importance") + 0.001).otherwise(F.col("importance") + 0.0000001).alias("importance"), F.lit(None).cast("string").alias("type"),
        F.when(F.col("toxic") == 1, "archived").otherwise("").alias("status"), "tags",
        F.when(old == 0, F.col("updated_at") - F.expr("interval 1 day")).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    r = ex.reconcile(m, d, as_of())
    return r.select("id", "outcome", F.array_join("changed", ",").alias("changed"), "content", F.round("importance", 6).alias("importance"), "status")


@query("i24_snapshot_retention", "SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-31' - 14")
def retention(t: Tables) -> DataFrame:
    days = t.feed().select(F.to_date("ts").alias("day")).distinct()
    return ex.expired_days(days, as_of(), 14).select(F.col("day").cast("string").alias("day"))

