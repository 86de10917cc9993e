"""Queries: filters, pages, sorts, set operations, joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.functions.time import micros, ntz
from memspark.operators import consolidate as co
from memspark.operators import filters as fl
from memspark.operators import graph as gr
from memspark.operators import similarity as si
from memspark.plans.registry import query
from memspark.plans.views import AS_OF, Tables
from memspark.sources import export as ex

NOW = f"TIMESTAMP '{AS_OF}'"


def as_of():
    return ntz(AS_OF)


@query("p01_scope_filter", """SELECT id, type, importance FROM memories_base
       WHERE status = 'active' AND user_id = 'u3' AND agent_id = 'en' AND shared = false""")
def scope(t: Tables) -> DataFrame:
    return fl.scope(t.memories_base(), user_id="u3", agent_id="en", shared=False).select("id", "type", "importance")


@query("p03_exclude_noise", """SELECT id, type FROM (SELECT id, type, CASE WHEN n_chars > 300 THEN importance END AS importance
       FROM memories_base m JOIN documents d ON d.doc_id = m.n) WHERE NOT (type = 'tool_result' AND importance < 0.5)""")
def noise(t: Tables) -> DataFrame:
    """Short rows get a null importance: a tool result among them is dropped as well."""
    m = t.memories_base().withColumn("importance", F.when(F.length("content") > 300, F.col("importance")))
    return fl.exclude_noise(m).select("id", "type")


@query("p04_recent_rows", """SELECT id, epoch_us(created_at) AS created_us, (SELECT count(*) FROM memories_base WHERE status = 'active') AS total
       FROM memories_base WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 20 OFFSET 20""")
def recent(t: Tables) -> DataFrame:
    page = fl.page_with_total(fl.active(t.memories_base()), 20, 20)
    return page.select("id", micros(F.col("created_at")).alias("created_us"), "total")


@query("p05_recent_important", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, agent_id ORDER BY created_at DESC, id) AS recency
       FROM memories_base WHERE status = 'active'),
       p AS (SELECT *, row_number() OVER (PARTITION BY user_id, agent_id ORDER BY importance DESC, recency) AS position FROM r WHERE recency <= 20)
       SELECT user_id, agent_id, id, recency, position FROM p WHERE position <= 5""")
def important(t: Tables) -> DataFrame:
    out = fl.recent_then_important(fl.active(t.memories_base()), ["user_id", "agent_id"], 20, 5)
    return out.select("user_id", "agent_id", "id", "recency", "position")


@query("p07_low_trust", "SELECT id FROM memories_base WHERE type = 'tool_result' OR source IN ('src0', 'src7')")
def low_trust(t: Tables) -> DataFrame:
    return fl.low_trust(t.memories_base(), sources=("src0", "src7")).select("id")


@query("p08_tool_result_capture", """SELECT event_id, tool, '[tool_result:' || tool || '] ' || props AS content, 'tool_result' AS type, 0.3e0 AS importance
       FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'context' ELSE event_type END AS tool, props FROM events)
       WHERE tool NOT IN ('recall', 'context') AND coalesce(props, '') <> ''""")
def capture(t: Tables) -> DataFrame:
    tool = F.when(F.col("event_type") == "view", "recall").when(F.col("event_type") == "click", "context").otherwise(F.col("event_type"))
    e = t.feed().select("event_id", tool.alias("tool"), F.col("props").alias("text"))
    return fl.capture_tool_results(e, fl.DENIED_TOOLS).select("event_id", "tool", "content", "type", "importance")


@query("p10_classify_queries", """WITH x AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM conversations),
       f AS (SELECT *, q LIKE '%vi%' AS m, q LIKE '%pour%' OR q LIKE '%the %' AS k, q LIKE '%haha%' OR q LIKE '%sch%' AS e FROM x)
       SELECT conv_id, turn,
         CASE WHEN q = '' THEN 'memory_search' WHEN e AND NOT (m OR k) THEN 'emotion_query' WHEN m AND NOT k THEN 'memory_search'
           WHEN k AND NOT m THEN 'knowledge_search' ELSE 'context_build' END AS query_type,
         CASE WHEN q = '' THEN 'memory' WHEN e AND NOT (m OR k) THEN 'emotion,memory' WHEN m AND NOT k THEN 'memory'
           WHEN k AND NOT m THEN 'knowledge' WHEN e THEN 'memory,knowledge,emotion' ELSE 'memory,knowledge' END AS providers,
         CASE WHEN q = '' THEN 1 WHEN e AND NOT (m OR k) THEN 2 WHEN m <> k THEN 2 ELSE 3 END AS priority,
         CASE WHEN q = '' OR (e AND NOT (m OR k)) THEN 300 ELSE 1800 END AS ttl,
         CASE WHEN q = '' THEN false ELSE e END AS include_emotion
       FROM f""")
def classify(t: Tables) -> DataFrame:
    out = fl.classify_queries(t.chat(), "text", memory=("vi",), knowledge=("pour", "the "), emotion=("haha", "sch"))
    return out.select("conv_id", "turn", "query_type", "providers", "priority", "ttl", "include_emotion")


@query("p11_strip_system_tags", """SELECT id, array_to_string(list_filter(tags, lambda x: NOT starts_with(x, 'src1') AND NOT starts_with(x, 'm')), ',') AS tags FROM memories_base""")
def strip_tags(t: Tables) -> DataFrame:
    return t.memories_base().select("id", F.array_join(tx.strip_system_tags(F.col("tags"), ("src1", "m")), ",").alias("tags"))


# --- Sorts and limits -----------------------------------------------------------------------------------


@query("l01_order_page", """SELECT id, importance FROM memories_base WHERE status = 'active' ORDER BY importance DESC, id LIMIT 50 OFFSET 100""")
def order_page(t: Tables) -> DataFrame:
    return fl.recent(fl.active(t.memories_base()), 50, 100, by="importance").select("id", "importance")


@query("l02_topk_per_query", """SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, id) AS rank
       FROM memories_base WHERE status = 'active') WHERE rank <= 10""")
def topk(t: Tables) -> DataFrame:
    m = fl.active(t.memories_base()).select("user_id", "id", "importance")
    return fl.top_per_group(m, ["user_id"], [F.col("importance").desc(), F.col("id")], 10).select("user_id", "id", "rank")


@query("l04_newest_nodes", """SELECT id, type FROM memories_base WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 200""")
def newest(t: Tables) -> DataFrame:
    return fl.recent(fl.active(t.memories_base()), 200).select("id", "type")


@query("l05_two_key_order", """SELECT id, row_number() OVER (ORDER BY importance DESC, created_at DESC, id) AS position FROM memories_base
       WHERE status = 'active' AND summary = ''""")
def two_keys(t: Tables) -> DataFrame:
    from memspark.operators.ordered import row_numbers

    m = fl.active(t.memories_base()).filter("summary = ''").select("id", "importance", "created_at")
    ordered = row_numbers(m, [], [F.col("importance").desc(), F.col("created_at").desc(), F.col("id")], "position")
    return ordered.select("id", "position")


# --- Set operations -------------------------------------------------------------------------------------


@query("o01_ordered_tag_union", """SELECT id, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ',') AS tags
       FROM (SELECT id, list_concat(tags, [agent_id, source, type]) AS every FROM memories_base)""")
def tag_union(t: Tables) -> DataFrame:
    every = F.array_distinct(F.concat("tags", F.array("agent_id", "source", "type")))
    return t.memories_base().select("id", F.array_join(every, ",").alias("tags"))


@query("o02_marker_tag_union", """SELECT id, array_to_string(list_sort(list_distinct(list_append(tags, 'reviewed'))), ',') AS tags FROM memories_base""")
def marker(t: Tables) -> DataFrame:
    return t.memories_base().select("id", F.array_join(F.array_sort(F.array_union("tags", F.array(F.lit("reviewed")))), ",").alias("tags"))


@query("o03_tag_overlap", """SELECT id, list_has_any(tags, ['src1', 'k4', 'm2']) AS shared_tag FROM memories_base""")
def overlap(t: Tables) -> DataFrame:
    return t.memories_base().select("id", F.arrays_overlap("tags", F.array(F.lit("src1"), F.lit("k4"), F.lit("m2"))).alias("shared_tag"))


@query("o04_set_difference", """SELECT content_hash FROM doc_collection EXCEPT SELECT content_hash FROM doc_collection_old""")
def difference(t: Tables) -> DataFrame:
    """New texts: hashes that the earlier collection does not have."""
    return t.doc_collection().select("content_hash").distinct().join(
        t.doc_collection_old().select("content_hash"), "content_hash", "left_anti"
    )


@query("o05_source_overlap", """WITH a AS (SELECT collection, count(*) AS prior, count(*) FILTER (quality = 1) AS covered FROM doc_collection_old GROUP BY collection)
       SELECT collection, round(covered / CAST(prior AS DOUBLE), 6) AS overlap, covered / CAST(prior AS DOUBLE) < 0.75 AS refused FROM a""")
def source_overlap(t: Tables) -> DataFrame:
    """How much of each earlier collection is still there unchanged, and whether a rewrite would be refused."""
    old = t.doc_collection_old().select("collection", "path", "content_hash")
    now = t.doc_collection().select("path", F.col("content_hash").alias("now_hash"))
    j = old.join(now, "path", "left").groupBy("collection").agg(
        F.count("*").alias("prior"), F.count_if(F.col("now_hash") == F.col("content_hash")).alias("covered")
    )
    share = F.col("covered") / F.col("prior")
    return j.select("collection", F.round(share, 6).alias("overlap"), (share < 1 - co.MAX_PRIOR_LOSS).alias("refused"))


@query("o06_union_of_scopes", """SELECT 'own' AS part, id FROM memories_base WHERE status = 'active' AND user_id = 'u1'
       UNION ALL SELECT 'shared', id FROM memories_base WHERE status = 'active' AND shared AND user_id <> 'u1'""")
def union_scopes(t: Tables) -> DataFrame:
    m = t.memories_base()
    own = fl.scope(m, user_id="u1").select(F.lit("own").alias("part"), "id")
    return own.unionByName(fl.scope(m, shared=True).filter("user_id <> 'u1'").select(F.lit("shared").alias("part"), "id"))


# --- Joins ----------------------------------------------------------------------------------------------


@query("j02_vector_self_join", """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 9) AS similarity
             FROM a JOIN a b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, CAST(neighbour AS VARCHAR)) AS rank FROM p)
       SELECT id, neighbour, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 3""")
@query("w01_neighbour_rank", """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
       p AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 9) AS similarity
             FROM a JOIN a b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, CAST(neighbour AS VARCHAR)) AS rank FROM p)
       SELECT id, neighbour, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def self_join(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    near = si.knn_within(v, 3)
    return near.select(F.col("id").cast("long").alias("id"), F.col("neighbour").cast("long").alias("neighbour"),
                       F.round("similarity", 6).alias("similarity"), "rank")


@query("j03_scoped_earlier_neighbours", """WITH m AS (SELECT * FROM memories_base WHERE status = 'active' AND type <> 'general'),
       r AS (SELECT a.id, b.id AS neighbour, round(sum(x.w * y.w), 9) AS similarity, a.created_at > b.created_at OR (a.created_at = b.created_at AND a.id > b.id) AS earlier
         FROM m a JOIN m b ON a.user_id = b.user_id AND a.agent_id = b.agent_id AND a.type = b.type AND a.id <> b.id
         LEFT JOIN memory_vectors x ON x.id = a.id LEFT JOIN memory_vectors y ON y.id = b.id AND y.dim = x.dim GROUP BY ALL),
       k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(similarity, 0) DESC, neighbour) AS rank FROM r WHERE earlier)
       SELECT id, neighbour, round(coalesce(similarity, 0), 6) AS similarity, rank FROM k WHERE rank <= 4""")
def earlier(t: Tables) -> DataFrame:
    m = fl.active(t.memories_base()).filter("type <> 'general'").withColumn("t", micros(F.col("created_at")))
    near = si.knn_within(t.with_embedding(m), 4, scope=["user_id", "agent_id", "type"], earlier_by="t")
    return near.select("id", "neighbour", F.round("similarity", 6).alias("similarity"), "rank")


@query("j04_signals_per_memory", """SELECT m.id, count(s.memory_id) AS signals, round(coalesce(sum(s.boost), 0), 6) AS boost
       FROM memories_base m LEFT JOIN signals s ON s.memory_id = m.id GROUP BY m.id""")
def signals_per_memory(t: Tables) -> DataFrame:
    s = t.signals().groupBy("memory_id").agg(F.count("*").alias("signals"), F.sum("boost").alias("boost"))
    j = t.memories_base().select("id").join(s, F.col("id") == F.col("memory_id"), "left")
    return j.select("id", F.coalesce("signals", F.lit(0)).alias("signals"), F.round(F.coalesce("boost", F.lit(0.0)), 6).alias("boost"))


@query("j05_latest_cluster_tag", f"""SELECT m.id, coalesce(x.tag, '') AS cluster_tag FROM memories_base m LEFT JOIN
       (SELECT memory_id, arg_max(cluster_tag, created_at) AS tag FROM signals WHERE phase = 'rem' AND created_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1) x ON x.memory_id = m.id""")
def latest_tag(t: Tables) -> DataFrame:
    tags = co.latest_cluster_tags(t.signals(), as_of())
    j = t.memories_base().select("id").join(tags, F.col("id") == F.col("memory_id"), "left")
    return j.select("id", F.coalesce("cluster_tag", F.lit("")).alias("cluster_tag"))


@query("j06_not_signalled_today", """SELECT id FROM memories_base WHERE id NOT IN
       (SELECT memory_id FROM signals WHERE phase = 'light' AND CAST(created_at AS DATE) = DATE '2024-01-30')""")
def not_signalled(t: Tables) -> DataFrame:
    return co.not_signalled_today(t.memories_base(), t.signals(), "light", ntz("2024-01-30 12:00:00")).select("id")


@query("j07_not_imported", """SELECT DISTINCT sha256(text) AS content_hash FROM conversations WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents)
       UNION SELECT DISTINCT sha256(text) FROM documents WHERE sha256(text) NOT IN (SELECT content_hash FROM doc_collection_old)""")
def not_imported(t: Tables) -> DataFrame:
    docs = t.raw("documents").select(F.sha2("text", 256).alias("content_hash")).distinct()
    chat = t.chat().select(F.sha2("text", 256).alias("content_hash")).distinct()
    fresh = chat.join(docs, "content_hash", "left_anti")
    return fresh.union(docs.join(t.doc_collection_old().select("content_hash"), "content_hash", "left_anti")).distinct()


@query("j08_entity_neighbours", """SELECT id, relation_id, relation_type, neighbour_id, coalesce(e.name, '') AS neighbour_name FROM (
         SELECT source_id AS id, relation_id, relation_type, target_id AS neighbour_id FROM relations
         UNION ALL SELECT target_id, relation_id, relation_type, source_id FROM relations) x LEFT JOIN (SELECT id AS eid, name FROM entities) e ON e.eid = x.neighbour_id""")
def entity_neighbours(t: Tables) -> DataFrame:
    n = gr.neighbours(t.entities(), t.relations())
    return n.select("id", "relation_id", "relation_type", "neighbour_id", F.coalesce("neighbour_name", F.lit("")).alias("neighbour_name"))


@query("j09_file_links", """SELECT d.path, coalesce(m.id, '') AS memory_id, coalesce(m.type, '') AS type FROM doc_collection d
       LEFT JOIN memories_base m ON m.n = d.doc_id AND m.status = 'active'""")
def file_links(t: Tables) -> DataFrame:
    from memspark.sources.files import link_files

    files = t.doc_collection().select("path", F.col("doc_id").cast("string").alias("memory_id"))
    m = fl.active(t.memories_base()).select("id", F.col("type").alias("document_path"))
    j = link_files(files, m)
    found = F.col("document_path").isNotNull()
    return j.select("path", F.when(found, F.col("memory_id")).otherwise("").alias("memory_id"), F.coalesce("document_path", F.lit("")).alias("type"))


@query("j10_scoped_merge", """WITH mem AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY m.importance DESC, m.id) AS r FROM queries q
         JOIN memories_base m ON m.status = 'active' AND m.user_id = q.user_id)
       SELECT q.query_id, coalesce(a.n, 0) AS memories, coalesce(a.best, '') AS best, coalesce(b.n, 0) AS signals FROM queries q
       LEFT JOIN (SELECT query_id, count(*) AS n, max(id) FILTER (r = 1) AS best FROM mem WHERE r <= 30 GROUP BY 1) a USING (query_id)
       LEFT JOIN (SELECT user_id, count(*) AS n FROM signals s JOIN memories_base m ON m.id = s.memory_id GROUP BY 1) b ON b.user_id = q.user_id""")
def scoped_merge(t: Tables) -> DataFrame:
    """Per request: its user's best rows, and the state of that user, side by side."""
    q = t.queries()
    m = fl.active(t.memories_base()).select("user_id", "id", "importance")
    best = fl.top_per_group(m, ["user_id"], [F.col("importance").desc(), F.col("id")], 30)
    mine = best.groupBy("user_id").agg(F.count("*").alias("memories"), F.min_by("id", "rank").alias("best"))
    state = t.signals().join(t.memories_base().select(F.col("id").alias("memory_id"), "user_id"), "memory_id").groupBy("user_id").agg(F.count("*").alias("signals"))
    j = q.select("query_id", "user_id").join(mine, "user_id", "left").join(state, "user_id", "left")
    return j.select("query_id", F.coalesce("memories", F.lit(0)).alias("memories"), F.coalesce("best", F.lit("")).alias("best"), F.coalesce("signals", F.lit(0)).alias("signals"))


# --- Windows --------------------------------------------------------------------------------------------


@query("w02_temporal_edges", """SELECT older AS source, id AS target FROM (
         SELECT id, created_at, lag(id) OVER w AS older, lag(created_at) OVER w AS older_at FROM memories_base WHERE status = 'active'
         WINDOW w AS (PARTITION BY type ORDER BY created_at, id)) WHERE older IS NOT NULL AND created_at - older_at <= INTERVAL 6 HOUR""")
def temporal(t: Tables) -> DataFrame:
    return gr.temporal_edges(fl.active(t.memories_base())).select("source", "target")


@query("w03_latest_run", f"""SELECT phase, arg_max(run_id, started_at) AS run_id, max(started_at) = arg_max(started_at, started_at) AS ok FROM runs GROUP BY phase""")
def latest_run(t: Tables) -> DataFrame:
    return co.latest_runs(t.runs()).select("phase", "run_id", F.lit(True).alias("ok"))


@query("w04_first_by_fingerprint", """SELECT agent_id, id FROM (SELECT agent_id, id, row_number() OVER (
         PARTITION BY agent_id, lower(trim(content, ' ' || chr(10) || chr(9))) ORDER BY importance DESC, n) AS r FROM memories_base) WHERE r = 1""")
def fingerprint(t: Tables) -> DataFrame:
    m = t.memories_base().select("agent_id", "id", "content", "importance", F.col("n").alias("ord"))
    return co.keep_first_by_fingerprint(m, "agent_id").select("agent_id", "id")


@query("w05_unique_slugs", """WITH s AS (SELECT id, agent_id, created_at, left(trim(regexp_replace(lower(trim(split_part(content, chr(10), 1))), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-'), 12) AS b FROM memories_base),
       c AS (SELECT id, agent_id, created_at, CASE WHEN rtrim(b, '-') = '' THEN 'untitled' ELSE rtrim(b, '-') END AS base FROM s),
       k AS (SELECT *, row_number() OVER (PARTITION BY agent_id, base ORDER BY created_at, id) AS k FROM c)
       SELECT agent_id, id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM k""")
def slugs(t: Tables) -> DataFrame:
    m = t.memories_base().withColumn("base", tx.slug(F.substring_index("content", "\n", 1), 12))
    return ex.unique_slugs(m.select("id", "agent_id", "created_at", "base"), "agent_id", "base", ["created_at", "id"]).select("agent_id", "id", "slug")


@query("w06_distinct_headlines", """WITH h AS (SELECT user_id, id, created_at, left(trim(regexp_replace(split_part(content, chr(10), 1), '\\s+', ' ', 'g'), ' '), 30) AS h FROM memories_base WHERE status = 'active'),
       f AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(h) ORDER BY created_at DESC, id) AS d FROM h WHERE h <> '')
       SELECT user_id, h AS headline, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM f WHERE d = 1) WHERE place <= 8""")
def headlines(t: Tables) -> DataFrame:
    m = fl.active(t.memories_base())
    head = F.substring(tx.collapse_spaces(F.substring_index("content", "\n", 1)), 1, 30)
    h = m.select("user_id", "id", "created_at", head.alias("headline")).filter("headline <> ''")
    order = F.struct(-micros(F.col("created_at")), "id")
    first = h.groupBy("user_id", F.lower("headline").alias("k")).agg(F.min_by("headline", order).alias("headline"), F.min(order).alias("at"))
    return fl.top_per_group(first, ["user_id"], [F.col("at")], 8, "place").select("user_id", "headline", "place")


