"""Queries: vectors, clusters, consolidation and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import vectors as vec
from memspark.functions.time import micros, ntz
from memspark.operators import cluster as cl
from memspark.operators import consolidate as co
from memspark.operators import filters as fl
from memspark.operators import graph as gr
from memspark.operators import lifecycle as lc
from memspark.operators import scoring as sc
from memspark.operators import stale as st
from memspark.plans.registry import query
from memspark.plans.selection import NOW, as_of
from memspark.plans.views import Tables

# --- Vectors --------------------------------------------------------------------------------------------


@query("v01_hash_embedding", """SELECT doc_id, dim, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM (
         SELECT doc_id, dim, CAST(sum(sign) AS DOUBLE) AS raw FROM (
           SELECT doc_id, CAST('0x' || substr(sha256(t), 1, 4) AS INTEGER) % 1024 AS dim,
             CASE WHEN CAST('0x' || substr(sha256(t), 6, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign
           FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents)) GROUP BY ALL) WHERE raw <> 0""")
def embed_sparse(t: Tables) -> DataFrame:
    s = vec.hash_embedding_sparse(t.raw("documents"), "doc_id", "text")
    return s.select("doc_id", "dim", F.round("weight", 6).alias("weight"))


@query("v02_cosine", """WITH a AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
       SELECT a.vec_id, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 6) AS similarity
       FROM a JOIN a b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY a.vec_id""")
def cosine(t: Tables) -> DataFrame:
    """Similarity of each vector and the next one."""
    v = t.raw("embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


FIRST_COME = """
    near AS MATERIALIZED (SELECT b.id, list(a.rn) AS before FROM ordered b JOIN ordered a ON a.rn < b.rn
      JOIN pairs p ON p.a = a.id AND p.b = b.id GROUP BY b.id),
    walk AS (SELECT 0 AS rn, CAST([] AS BIGINT[]) AS kept
      UNION ALL SELECT w.rn + 1, CASE WHEN list_has_any(w.kept, coalesce(n.before, CAST([] AS BIGINT[]))) THEN w.kept ELSE list_append(w.kept, w.rn + 1) END
      FROM walk w JOIN ordered o ON o.rn = w.rn + 1 LEFT JOIN near n ON n.id = o.id)
"""


@query("v03_near_duplicates", f"""WITH RECURSIVE ordered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rn FROM memories_base WHERE status = 'active'),
    pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM memory_vectors x JOIN memory_vectors y ON x.dim = y.dim AND x.id <> y.id GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.9),
    {FIRST_COME}
    SELECT id FROM ordered WHERE list_contains((SELECT arg_max(kept, rn) FROM walk), rn)""")
def near_duplicates(t: Tables) -> DataFrame:
    m = fl.active(t.memories_base())
    # Numbered before there are vectors, which would be dealt out and written with the rows.
    order = co.in_creation_order(m.select("id", "created_at")).select("id", "ord")
    return cl.dedupe_vectors(t.with_embedding(m.join(order, "id").select("id", "ord", "content", "summary")))


@query("v03_near_duplicates_given_vectors", f"""WITH RECURSIVE ordered AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings),
    x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    pairs AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM x p JOIN x q ON p.i = q.i AND p.vec_id <> q.vec_id
      GROUP BY ALL HAVING round(sum(p.x * q.x) / (sqrt(sum(p.x * p.x)) * sqrt(sum(q.x * q.x))), 9) >= 0.25),
    {FIRST_COME}
    SELECT id FROM ordered WHERE list_contains((SELECT arg_max(kept, rn) FROM walk), rn)""")
def near_duplicates_given(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), "embedding")
    return cl.dedupe_vectors(v, "ord", 0.25).select(F.col("id").cast("long").alias("id"))


@query("v04_stale_flags", """WITH m AS MATERIALIZED (SELECT id, user_id, agent_id, type, created_at, sha256(trim(content, ' ' || chr(10) || chr(9))) AS h FROM memories_base WHERE status = 'active'),
    r AS (SELECT a.id, b.id AS old, a.h = b.h AS same, a.created_at,
        round(1 - coalesce(sum(x.w * y.w), 0), 9) AS distance
      FROM m a JOIN m b ON a.user_id = b.user_id AND a.agent_id = b.agent_id AND a.type = b.type AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id))
      LEFT JOIN memory_vectors x ON x.id = a.id LEFT JOIN memory_vectors y ON y.id = b.id AND y.dim = x.dim
      GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, old) AS rank FROM r),
    f AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY created_at, id) AS first FROM k WHERE rank <= 4 AND distance <= 0.25 AND NOT same)
    SELECT old AS old_memory_id, id AS new_memory_id, round(distance, 6) AS distance FROM f WHERE first = 1""")
def stale_flags(t: Tables) -> DataFrame:
    _, conflicts = st.flag_stale(t.with_embedding(t.memories_base()))
    return conflicts.select("old_memory_id", "new_memory_id", F.round("distance", 6).alias("distance"))


@query("v05_similarity_edges", """WITH a AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    p AS (SELECT a.vec_id AS s, b.vec_id AS d, round(sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))), 9) AS sim
      FROM a JOIN a b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, CAST(d AS VARCHAR)) AS rank FROM p)
    SELECT least(CAST(s AS VARCHAR), CAST(d AS VARCHAR)) AS source, greatest(CAST(s AS VARCHAR), CAST(d AS VARCHAR)) AS target, round(max(sim), 4) AS weight
    FROM r WHERE rank <= 5 AND sim >= 0.3 GROUP BY 1, 2""")
def edges(t: Tables) -> DataFrame:
    v = t.raw("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return gr.knn_edges(v, 5, 0.3)


@query("v06_embedder_registry", """SELECT id, count(DISTINCT dim) > 0 AS embedded FROM (SELECT m.id, v.dim FROM memories_base m LEFT JOIN memory_vectors v ON v.id = m.id AND m.type <> 'tool_result') GROUP BY id""")
def embedder(t: Tables) -> DataFrame:
    """An embedder under another name that fails (gives null) for the texts of tool results."""
    vec.register_embedder("partial", lambda c: F.when(~c.startswith("[tool]"), vec.hash_embedding(c, 64)))
    m = t.memories_base()
    text = F.when(F.col("type") == "tool_result", F.concat(F.lit("[tool] "), "content")).otherwise(F.col("content"))
    return m.select("id", vec.embed_text(text, "partial").isNotNull().alias("embedded"))


@query("u02_embedder_choice", """SELECT item_id AS query_id, count(DISTINCT h) AS dims FROM (
      SELECT item_id, CAST('0x' || substr(sha256(t), 1, 4) AS INTEGER) % 4096 AS h, sum(CASE WHEN CAST('0x' || substr(sha256(t), 6, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS w
      FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM benchmark) GROUP BY ALL) WHERE w <> 0 GROUP BY 1""")
def embedder_choice(t: Tables) -> DataFrame:
    """Vectors of another length by a second registered embedder: how many dimensions each text uses."""
    vec.register_embedder("hash4096", lambda c: vec.hash_embedding(c, 4096))
    v = t.raw("benchmark").select(F.col("item_id").alias("query_id"), vec.embed_text(F.col("text"), "hash4096").alias("v"))
    return v.select("query_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("dims"))


# --- Clusters -------------------------------------------------------------------------------------------

STAR = """
    rows_in AS MATERIALIZED ({0}),
    walk AS (SELECT 0 AS rn, CAST([] AS STRUCT(s BIGINT, t VARCHAR[])[]) AS seeds, CAST('' AS VARCHAR) AS id, CAST(0 AS BIGINT) AS seed
      UNION ALL SELECT rn, CASE WHEN hit IS NULL THEN list_append(seeds, {{s: rn, t: tags}}) ELSE seeds END, id, coalesce(hit, rn)
      FROM (SELECT r.rn, r.id, r.tags, w.seeds, list_filter(w.seeds, lambda x: list_has_any(x.t, r.tags))[1].s AS hit
            FROM walk w JOIN rows_in r ON r.rn = w.rn + 1)),
    star AS (SELECT id, rn, seed FROM walk WHERE rn > 0)
"""
ACTIVE_ROWS = "SELECT id, tags, row_number() OVER (ORDER BY created_at, id) AS rn FROM memories_base WHERE status = 'active'"
WEEK_ROWS = f"SELECT id, tags, row_number() OVER (ORDER BY created_at, id) AS rn FROM memories_base WHERE status = 'active' AND created_at >= {NOW} - INTERVAL 7 DAY AND created_at <= {NOW}"


def active_ordered(t: Tables) -> DataFrame:
    return co.in_creation_order(fl.active(t.memories_base()).select("id", "created_at", "tags", "content", "summary", "importance"))


@query("c01_star_clusters", f"WITH RECURSIVE {STAR.format(ACTIVE_ROWS)} SELECT id, seed FROM star")
def star(t: Tables) -> DataFrame:
    return cl.star_clusters(active_ordered(t)).select("id", "seed")


@query("a02_tag_frequency", """WITH f AS (SELECT unnest(tags) AS tag, created_at, id, generate_subscripts(tags, 1) AS i FROM memories_base WHERE status = 'active')
    SELECT tag, c AS count, row_number() OVER (ORDER BY c DESC, first) AS rank FROM (SELECT tag, count(*) AS c, min((created_at, id, i)) AS first FROM f GROUP BY tag) ORDER BY rank LIMIT 25""")
def tag_frequency(t: Tables) -> DataFrame:
    rows = active_ordered(t).withColumn("seed", F.lit(0))
    return co.top_tags(rows, 25).select("tag", "count", "rank")


@query("a03_cluster_summary", f"""WITH RECURSIVE {STAR.format(ACTIVE_ROWS)},
    sizes AS (SELECT seed, count(*) AS size FROM star GROUP BY seed),
    tg AS (SELECT s.seed, unnest(r.tags) AS tag, s.rn, generate_subscripts(r.tags, 1) AS i FROM star s JOIN rows_in r ON r.id = s.id),
    best AS (SELECT seed, tag, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, min((rn, i))) AS k FROM tg GROUP BY seed, tag)
    SELECT z.seed, z.size, b.tag FROM sizes z JOIN best b ON b.seed = z.seed AND b.k = 1 WHERE z.size >= 3""")
def summary(t: Tables) -> DataFrame:
    rows = co.materialize(active_ordered(t))
    return co.cluster_summary(cl.star_clusters(rows), rows, 3).select("seed", "size", "tag")


KEPT = f"""{STAR.format(ACTIVE_ROWS)},
    kept AS (SELECT * FROM (SELECT s.seed, s.rn, m.*, row_number() OVER (PARTITION BY s.seed, lower(trim(m.content, ' ' || chr(10) || chr(9))) ORDER BY m.importance DESC, s.rn) AS d
      FROM star s JOIN memories_base m ON m.id = s.id) WHERE d = 1)"""


def kept_rows(t: Tables) -> DataFrame:
    rows = co.materialize(active_ordered(t))
    clusters = cl.star_clusters(rows)
    return co.materialize(co.keep_first_by_fingerprint(clusters.select("id", "seed").join(rows, "id")))


@query("a04_cluster_patterns", f"""WITH RECURSIVE {KEPT},
    tg AS (SELECT seed, tag, c, row_number() OVER (PARTITION BY seed ORDER BY c DESC, f) AS k FROM
      (SELECT seed, tag, count(*) AS c, min((rn, i)) AS f FROM (SELECT seed, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i, rn FROM kept) GROUP BY ALL)),
    top AS (SELECT seed, string_agg(tag, ',' ORDER BY k) AS tags FROM tg WHERE k <= 3 AND c >= 2 GROUP BY seed)
    SELECT k.seed, any_value(t.tags) AS tags, count(*) AS frequency, round(avg(importance), 6) AS avg_importance FROM kept k JOIN top t ON t.seed = k.seed GROUP BY k.seed HAVING count(*) >= 2""")
def patterns(t: Tables) -> DataFrame:
    p = co.cluster_patterns(kept_rows(t))
    return p.select("seed", F.array_join("tags", ",").alias("tags"), "frequency", F.round("avg_importance", 6).alias("avg_importance"))


@query("a05_cluster_knowledge", f"""WITH RECURSIVE {KEPT},
    o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY importance DESC, rn) AS k FROM kept)
    SELECT seed, max(CASE WHEN k = 1 THEN CASE WHEN summary <> '' THEN summary ELSE left(content, 80) END END) AS title, count(*) AS size,
      round(least(1, avg(importance) * 1.2), 6) AS importance, string_agg(id, ',' ORDER BY k) FILTER (k <= 5) AS sources
    FROM o GROUP BY seed HAVING count(*) >= 2""")
def knowledge(t: Tables) -> DataFrame:
    k = co.cluster_knowledge(kept_rows(t))
    return k.select("seed", "title", "size", F.round("importance", 6).alias("importance"), F.array_join("sources", ",").alias("sources"))


# --- Phases ---------------------------------------------------------------------------------------------


@query("a06_signal_days", "SELECT memory_id, count(DISTINCT CAST(created_at AS DATE)) AS signal_days FROM signals GROUP BY 1")
def signal_days(t: Tables) -> DataFrame:
    return co.signal_summary(t.signals(), as_of()).select("memory_id", "signal_days")


BOOST = f"""boosts AS (SELECT memory_id, count(DISTINCT CAST(created_at AS DATE)) AS days,
      sum(CASE WHEN floor((epoch_us({NOW}) - epoch_us(created_at)) / 86400e6) <= 14
        THEN boost * pow(2, -greatest(0, (epoch_us({NOW}) - epoch_us(created_at)) / 86400e6) / 14) ELSE 0 END) AS boost
    FROM signals GROUP BY memory_id)"""


@query("a07_decayed_boost", f"WITH {BOOST} SELECT memory_id, round(boost, 6) AS phase_boost FROM boosts")
def boost(t: Tables) -> DataFrame:
    return co.signal_summary(t.signals(), as_of()).select("memory_id", F.round("phase_boost", 6).alias("phase_boost"))


@query("c02_light_phase", f"""WITH RECURSIVE scanned AS (SELECT * FROM memories_base WHERE status = 'active' AND created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 72 HOUR AND created_at <= TIMESTAMP '2024-01-30 12:00:00'),
    ordered AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rn FROM scanned
      WHERE id NOT IN (SELECT memory_id FROM signals WHERE phase = 'light' AND CAST(created_at AS DATE) = DATE '2024-01-30')),
    pairs AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM memory_vectors x JOIN ordered oa ON oa.id = x.id JOIN memory_vectors y ON x.dim = y.dim AND x.id <> y.id JOIN ordered ob ON ob.id = y.id
      GROUP BY ALL HAVING round(sum(x.w * y.w), 9) >= 0.9),
    {FIRST_COME}
    SELECT id AS memory_id, 'light' AS phase, 0.05e0 AS boost FROM ordered WHERE list_contains((SELECT arg_max(kept, rn) FROM walk), rn)""")
def light(t: Tables) -> DataFrame:
    """Light phase with a window of three days, so that it holds rows at every scale."""
    new, _ = co.light(t.with_embedding(t.memories_base()), t.signals(), ntz("2024-01-30 12:00:00"), hours=72)
    return new.select("memory_id", "phase", "boost")


@query("a09_light_statistics", """WITH scanned AS (SELECT * FROM memories_base WHERE status = 'active' AND created_at >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 72 HOUR AND created_at <= TIMESTAMP '2024-01-30 12:00:00'),
    seen AS (SELECT memory_id FROM signals WHERE phase = 'light' AND CAST(created_at AS DATE) = DATE '2024-01-30')
    SELECT count(*) AS scanned, count(*) FILTER (id IN (SELECT memory_id FROM seen)) AS already_signalled_today FROM scanned""")
def light_stats(t: Tables) -> DataFrame:
    _, stats = co.light(t.with_embedding(t.memories_base()), t.signals(), ntz("2024-01-30 12:00:00"), hours=72)
    return stats.select("scanned", "already_signalled_today")


REM = f"""{STAR.format(WEEK_ROWS)},
    sizes AS (SELECT seed, count(*) AS size FROM star GROUP BY seed HAVING count(*) >= 3),
    tg AS (SELECT s.seed, unnest(r.tags) AS tag, s.rn, generate_subscripts(r.tags, 1) AS i FROM star s JOIN rows_in r ON r.id = s.id),
    best AS (SELECT seed, tag, row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, min((rn, i))) AS k FROM tg GROUP BY seed, tag)"""


@query("c03_rem_phase", f"""WITH RECURSIVE {REM}
    SELECT s.id AS memory_id, b.tag AS cluster_tag, 0.08e0 AS boost FROM star s JOIN sizes z ON z.seed = s.seed JOIN best b ON b.seed = s.seed AND b.k = 1
    WHERE s.id NOT IN (SELECT memory_id FROM signals WHERE phase = 'rem' AND CAST(created_at AS DATE) = DATE '2024-01-31')
      AND NOT EXISTS (SELECT 1 FROM runs WHERE phase = 'rem' AND finished_at IS NOT NULL AND CAST(started_at AS DATE) = DATE '2024-01-31')""")
def rem(t: Tables) -> DataFrame:
    new, _, _ = co.rem(t.memories_base(), t.signals(), t.runs(), as_of())
    return new.select("memory_id", "cluster_tag", "boost")


SCORED = f"""{BOOST},
    base AS (SELECT m.*, greatest(0, (epoch_us({NOW}) - epoch_us(coalesce(last_access, created_at))) / 86400e6) AS idle, greatest(0, (epoch_us({NOW}) - epoch_us(created_at)) / 86400e6) AS age,
        coalesce(b.days, 0) AS days, coalesce(b.boost, 0) AS boost
      FROM memories m LEFT JOIN boosts b ON b.memory_id = m.id WHERE status = 'active' AND created_at >= {NOW} - INTERVAL 30 DAY AND created_at <= {NOW}),
    scored AS (SELECT *, round(0.30 * pow(2, -idle / 14) + 0.28 * least(access_count / 10e0, 1) + 0.22 * (importance * 0.7 + least(days / 5e0, 1) * 0.3)
        + 0.12 * least(len(tags) / 5e0, 1) + boost, 4) AS score, round(age, 2) AS age_days FROM base),
    win AS (SELECT *, row_number() OVER (ORDER BY score DESC, created_at, id) AS place FROM scored WHERE score >= 0.7 AND access_count >= 3 AND age_days <= 30 ORDER BY place LIMIT 10)"""


def scored(t: Tables) -> DataFrame:
    return co.deep_score(t.memories(), t.signals(), as_of())


@query("c04_deep_score", f"""WITH {SCORED} SELECT id, score, round(pow(2, -idle / 14), 4) AS recency, round(least(access_count / 10e0, 1), 4) AS frequency,
      round(boost, 4) AS phase_boost FROM scored""")
def deep_score(t: Tables) -> DataFrame:
    return scored(t).select("id", "score", "recency", "frequency", "phase_boost")


@query("l03_gate_then_top", f"WITH {SCORED} SELECT id, place FROM win")
def gate(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    best = co.promoted(scored(t))  # ten rows at most
    return best.select("id", F.row_number().over(Window.orderBy(F.col("score").desc(), "created_at", "id")).alias("place"))


@query("c05_promotion", f"""WITH {SCORED} SELECT id, round(least(1, importance + 0.1), 6) AS importance, array_to_string(list_append(tags, 'promoted:deep:2024-01-31'), ',') AS tags FROM win""")
def promotion(t: Tables) -> DataFrame:
    p = co.apply_promotion(co.promoted(scored(t)), as_of())
    return p.select("id", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"))


@query("a16_nearest_misses", f"""WITH {SCORED} SELECT id, score FROM scored WHERE id NOT IN (SELECT id FROM win) ORDER BY score DESC, created_at, id LIMIT 2""")
def misses(t: Tables) -> DataFrame:
    s = co.materialize(scored(t))
    return co.top_unmet(s, co.promoted(s)).select("id", "score")


@query("a09_deep_statistics", f"""WITH {SCORED} SELECT count(*) AS scanned, count(*) FILTER (score >= 0.7 AND access_count >= 3 AND age_days <= 30) AS eligible, (SELECT count(*) FROM win) AS promoted FROM scored""")
def deep_stats(t: Tables) -> DataFrame:
    s = co.materialize(scored(t))
    return co.deep_stats(s, co.promoted(s))


def winners(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    best = co.promoted(scored(t))
    order = Window.orderBy(F.col("score").desc(), "created_at", "id")
    return co.materialize(best.withColumn("ord", F.row_number().over(order).cast("bigint")))


GROUPS = f"""{SCORED},
    latest AS (SELECT memory_id, arg_max(cluster_tag, created_at) AS tag FROM signals WHERE phase = 'rem' AND created_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1),
    themed AS (SELECT w.id, w.place, 'rem-' || l.tag AS group_key FROM win w JOIN latest l ON l.memory_id = w.id),
    {STAR.format("SELECT id, tags, row_number() OVER (ORDER BY place) AS rn FROM win WHERE id NOT IN (SELECT memory_id FROM latest)")},
    loose AS (SELECT s.id, w.place, s.seed FROM star s JOIN win w ON w.id = s.id),
    keyed AS (SELECT seed, CASE WHEN count(*) >= 2 THEN 'adhoc-' || left(sha1(string_agg(id, ',' ORDER BY id)), 8) ELSE 'solo-' || any_value(id) END AS k FROM loose GROUP BY seed),
    grp AS (SELECT id, place, group_key FROM themed UNION ALL SELECT l.id, l.place, k.k FROM loose l JOIN keyed k ON k.seed = l.seed)"""


@query("c06_knowledge_groups", f"WITH RECURSIVE {GROUPS} SELECT id, group_key FROM grp")
def groups(t: Tables) -> DataFrame:
    w = winners(t)
    return co.knowledge_groups(w, co.latest_cluster_tags(t.signals(), as_of())).select("id", "group_key")


@query("c07_knowledge_entries", f"""WITH RECURSIVE {GROUPS},
    mem AS (SELECT g.group_key, w.*, CASE WHEN trim(w.summary) <> '' THEN left(trim(w.summary), 100) ELSE left(split_part(trim(w.content, ' ' || chr(10)), chr(10), 1), 100) END AS ttl FROM grp g JOIN win w ON w.id = g.id),
    tg AS (SELECT group_key, tag, row_number() OVER (PARTITION BY group_key ORDER BY count(*) DESC, min((place, i))) AS k FROM (SELECT group_key, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i, place FROM mem) GROUP BY group_key, tag),
    ct AS (SELECT group_key, string_agg(tag, ',' ORDER BY k) AS tags FROM tg WHERE k <= 5 GROUP BY group_key)
    SELECT m.group_key, arg_max(m.ttl, (m.importance, -m.place)) AS title, count(*) AS members, string_agg(m.id, ',' ORDER BY m.id) AS source_ids,
      round(least(1, avg(CASE WHEN m.importance = 0 THEN 0.5 ELSE m.importance END) * 1.1), 6) AS importance, 'dream-cluster:' || m.group_key || ',' || any_value(c.tags) || ',auto-knowledge' AS tags, 'insert' AS action
    FROM mem m JOIN ct c ON c.group_key = m.group_key GROUP BY m.group_key""")
def entries(t: Tables) -> DataFrame:
    w = winners(t)
    g = co.knowledge_groups(w, co.latest_cluster_tags(t.signals(), as_of()))
    e = co.upsert_knowledge(co.knowledge_entries(w, g), t.memories_base())
    return e.select("group_key", "title", "members", F.array_join("source_ids", ",").alias("source_ids"), F.round("importance", 6).alias("importance"),
                    F.array_join("tags", ",").alias("tags"), "action")


@query("c08_one_shot_page", f"""WITH RECURSIVE newest AS (SELECT * FROM memories_base WHERE status = 'active' AND agent_id = 'en' ORDER BY created_at DESC, id LIMIT 200),
    {STAR.format("SELECT id, tags, row_number() OVER (ORDER BY created_at DESC, id) AS rn FROM newest")},
    kept AS (SELECT * FROM (SELECT s.seed, s.rn, m.*, row_number() OVER (PARTITION BY s.seed, lower(trim(m.content, ' ' || chr(10) || chr(9))) ORDER BY m.importance DESC, s.rn) AS d
      FROM star s JOIN newest m ON m.id = s.id) WHERE d = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY importance DESC, rn) AS k FROM kept)
    SELECT seed, count(*) AS size, round(least(1, avg(importance) * 1.2), 6) AS importance, string_agg(id, ',' ORDER BY k) FILTER (k <= 5) AS sources FROM o GROUP BY seed HAVING count(*) >= 2 ORDER BY seed LIMIT 5""")
def one_shot(t: Tables) -> DataFrame:
    _, _, _, k = co.consolidate(t.memories_base(), 200, "en", patterns=10, entries=5)
    return k.select("seed", "size", F.round("importance", 6).alias("importance"), F.array_join("sources", ",").alias("sources"))


@query("c08_one_shot", f"""WITH RECURSIVE newest AS (SELECT * FROM memories_base WHERE status = 'active' AND agent_id = 'en'),
    {STAR.format("SELECT id, tags, row_number() OVER (ORDER BY created_at DESC, id) AS rn FROM newest")},
    kept AS (SELECT * FROM (SELECT s.seed, s.rn, m.*, row_number() OVER (PARTITION BY s.seed, lower(trim(m.content, ' ' || chr(10) || chr(9))) ORDER BY m.importance DESC, s.rn) AS d
      FROM star s JOIN newest m ON m.id = s.id) WHERE d = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY importance DESC, rn) AS k FROM kept)
    SELECT seed, count(*) AS size, round(least(1, avg(importance) * 1.2), 6) AS importance, string_agg(id, ',' ORDER BY k) FILTER (k <= 5) AS sources FROM o GROUP BY seed HAVING count(*) >= 2""")
def one_shot_whole(t: Tables) -> DataFrame:
    """Over all rows of the agent, all clusters."""
    _, _, _, k = co.consolidate(t.memories_base(), agent_id="en")
    return k.select("seed", "size", F.round("importance", 6).alias("importance"), F.array_join("sources", ",").alias("sources"))


@query("c09_already_ran", """SELECT CAST(d.day AS VARCHAR) AS day, p.phase, EXISTS (SELECT 1 FROM runs r WHERE r.phase = p.phase AND CAST(r.started_at AS DATE) = d.day AND r.finished_at IS NOT NULL) AS ran
    FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) d CROSS JOIN (VALUES ('light'), ('rem'), ('deep')) p(phase)""")
def already_ran(t: Tables) -> DataFrame:
    """Per day of the feed and phase: does the run log forbid another run?"""
    days = t.feed().select(F.to_date("ts").alias("day")).distinct()
    asked = days.withColumn("phase", F.explode(F.array(F.lit("light"), F.lit("rem"), F.lit("deep"))))
    done = t.runs().filter("finished_at is not null").select(F.to_date("started_at").alias("day"), "phase").distinct().withColumn("ran", F.lit(True))
    return asked.join(done, ["day", "phase"], "left").select(F.col("day").cast("string").alias("day"), "phase", F.coalesce("ran", F.lit(False)).alias("ran"))


@query("c10_run_status", "SELECT phase, arg_max(run_id, started_at) AS run_id, epoch_us(max(started_at)) AS started_us, arg_max(finished_at IS NOT NULL, started_at) AS finished, round(arg_max(scanned, started_at), 6) AS scanned FROM runs GROUP BY phase")
def run_status(t: Tables) -> DataFrame:
    r = co.latest_runs(t.runs())
    return r.select("phase", "run_id", micros(F.col("started_at")).alias("started_us"), F.col("finished_at").isNotNull().alias("finished"), F.round("scanned", 6).alias("scanned"))


# --- Lifecycle ------------------------------------------------------------------------------------------

FORGET = f"""fb AS (SELECT *, greatest(0, (epoch_us({NOW}) - epoch_us(coalesce(last_access, created_at))) / 86400e6) AS d FROM memories),
    fg AS (SELECT *, least(1, greatest(0, (1 - importance) * (1 + log2(greatest(1, d + 1)) / 30) / (1 + log2(greatest(1, access_count + 1)) / 5))) AS fs, importance * pow(0.95, d / 7) AS faded FROM fb),
    fv AS (SELECT *, CASE WHEN faded <= 0.05 AND d > 90 THEN 'delete' WHEN faded <= 0.15 OR status = 'archived' THEN 'archive' ELSE 'keep' END AS action FROM fg)"""


@query("c11_forget_score", f"WITH {FORGET} SELECT id, round(fs, 4) AS forget_score, round(faded, 4) AS decayed_importance, action AS suggested_action FROM fv")
def forget(t: Tables) -> DataFrame:
    f = lc.forget(t.memories(), as_of())
    return f.select("id", "forget_score", "decayed_importance", "suggested_action")


@query("c12_forget_apply", f"WITH {FORGET} SELECT id, CASE WHEN action IN ('archive', 'delete') THEN 'archived' ELSE status END AS status FROM fv WHERE fv.status = 'active'")
def forget_apply(t: Tables) -> DataFrame:
    rows, _ = lc.apply_forget(t.memories(), as_of())
    return rows.select("id", "status")


@query("c12_forget_dry_run_page", f"WITH {FORGET} SELECT count(*) AS scanned, count(*) FILTER (action <> 'keep') AS archived FROM (SELECT * FROM fv WHERE status = 'active' ORDER BY created_at DESC, id LIMIT 500)")
def forget_dry(t: Tables) -> DataFrame:
    """Counts over the newest 500 rows, the page the report is defined on."""
    return lc.apply_forget(t.memories(), as_of(), 500)[1]


@query("c12_forget_dry_run", f"WITH {FORGET} SELECT count(*) AS scanned, count(*) FILTER (action <> 'keep') AS archived FROM fv WHERE status = 'active'")
def forget_dry_whole(t: Tables) -> DataFrame:
    """Counts over all active rows."""
    return lc.apply_forget(t.memories(), as_of())[1]


@query("c13_forget_detail", f"WITH {FORGET} SELECT id, left(content, 80) AS preview, access_count, round(greatest(0, (epoch_us({NOW}) - epoch_us(created_at)) / 86400e6), 1) AS days_since_created, round(d, 1) AS days_since_access, round(fs, 4) AS forget_score, round(least(1, importance + 0.1), 6) AS boosted FROM fv")
def forget_detail(t: Tables) -> DataFrame:
    d = lc.forget_detail(t.memories(), as_of())
    return d.select("id", "preview", "access_count", "days_since_created", "days_since_access", "forget_score",
                    F.round(lc.boost_on_access(F.col("importance")), 6).alias("boosted"))


LOW, KEYS, TOPICS = ("haha", "oo"), ("tion", "ment", "eau", "vi", "sch"), ("the", "pour", "und")
_kw = "list_filter(['tion', 'ment', 'eau', 'vi', 'sch'], lambda k: contains(low, k))"
_tp = "list_filter(['the', 'pour', 'und'], lambda k: contains(low, k))"
WORTH = f"""ev AS (SELECT *, {_kw} AS kw, {_tp} AS tp, contains(low, 'haha') OR contains(low, 'oo') AS lv FROM (SELECT *, trim(lower(content), ' ' || chr(10) || chr(9)) AS low FROM src)),
    vd AS (SELECT *, CASE WHEN lv AND len(kw) = 0 THEN 'low_value_content' WHEN length(content) < 10 AND len(kw) = 0 THEN 'too_short' END AS no,
        round(least(1, 0.3 + least(0.4, len(kw) * 0.08) + least(0.2, len(tp) * 0.05) + CASE WHEN length(content) > 100 THEN 0.1 ELSE 0 END + CASE WHEN length(content) > 300 THEN 0.1 ELSE 0 END
          + CASE WHEN source IN ('cli', 'code', 'api', 'mcp') THEN 0.1 ELSE 0 END), 2) AS w FROM ev)"""


def rules(texts: DataFrame) -> DataFrame:
    v = lc.evaluate(texts, "content", "source", LOW, KEYS, TOPICS)
    return v.select("content_hash", F.col("should_store").alias("keep"), F.col("worth").alias("new_importance"), F.lit("rules").alias("decided_by"))


@query("c14_noise_review", f"""WITH src AS (SELECT * FROM memories_base WHERE status = 'active' AND (type = 'tool_result' OR source IN ('src0')) AND NOT list_contains(tags, 'k4')), {WORTH}
    SELECT id, CASE WHEN no IS NULL THEN 'active' ELSE 'discarded' END AS status, round(CASE WHEN no IS NULL THEN w ELSE importance END, 6) AS importance, array_to_string(list_append(tags, 'k4'), ',') AS tags FROM vd""")
def review(t: Tables) -> DataFrame:
    rows = fl.low_trust(fl.active(t.memories_base()), sources=("src0",))
    r = lc.review_noise(rows, rules, tag="k4")
    return r.select("id", "status", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"))


@query("a08_review_distribution", f"""WITH src AS (SELECT * FROM memories_base WHERE status = 'active'), {WORTH}, r AS (SELECT CASE WHEN no IS NULL THEN 'keep' ELSE 'discard' END AS verdict, round(CASE WHEN no IS NULL THEN w ELSE 0.3 END, 1) AS im FROM vd)
    SELECT 'verdict' AS measure, verdict AS value, count(*) AS count FROM r GROUP BY ALL UNION ALL SELECT 'decided_by', 'rules', count(*) FROM r
    UNION ALL SELECT 'importance', printf('%.1f', im), count(*) FROM r GROUP BY ALL""")
def distribution(t: Tables) -> DataFrame:
    return lc.review_distribution(lc.review_noise(fl.active(t.memories_base()), rules))


@query("c15_worth_storing", f"""WITH src AS (SELECT conv_id, turn, text AS content, role AS source FROM conversations), {WORTH}
    SELECT conv_id, turn, no IS NULL AS should_store, CASE WHEN no IS NULL THEN w ELSE 0.3e0 END AS worth,
      coalesce(no, CASE WHEN len(kw) >= 3 THEN 'multiple_keywords_high_value' WHEN len(kw) >= 1 THEN 'keyword_match: ' || kw[1] ELSE 'general_content' END) AS reason,
      CASE WHEN no IS NULL THEN array_to_string(list_concat(kw[1:3], tp[1:2]), ',') ELSE '' END AS tags FROM vd""")
def worth(t: Tables) -> DataFrame:
    v = lc.evaluate(t.chat().withColumnsRenamed({"text": "content", "role": "source"}), "content", "source", LOW, KEYS, TOPICS)
    return v.select("conv_id", "turn", "should_store", "worth", "reason", F.array_join("suggested_tags", ",").alias("tags"))


@query("u04_noise_scorer", """SELECT id, CASE WHEN length(content) > 400 THEN 'active' ELSE 'discarded' END AS status FROM memories_base WHERE type = 'tool_result'""")
def custom_scorer(t: Tables) -> DataFrame:
    """A scorer supplied by the caller: long texts stay."""
    def by_length(texts: DataFrame) -> DataFrame:
        return texts.select("content_hash", (F.length("content") > 400).alias("keep"), F.lit(0.5).alias("new_importance"), F.lit("length").alias("decided_by"))

    rows = t.memories_base().filter("type = 'tool_result'").withColumn("status", F.lit("active"))
    return lc.review_noise(rows, by_length).select("id", "status")


@query("u03_reranker", """SELECT query_id, id, rerank_position FROM (SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY length(m.content) DESC, f.position) AS rerank_position
    FROM fused f JOIN memories_base m ON m.id = f.id WHERE f.position <= 50) WHERE rerank_position <= 10""")
def custom_reranker(t: Tables) -> DataFrame:
    """A second-stage scorer supplied by the caller: longer texts first."""
    from memspark.operators import search as se
    from memspark.plans.retrieval import searchable

    corpus = searchable(t, vectors=True)
    top = se.hybrid_search(corpus, t.queries(), limit=50, pool=50)
    out = se.rerank(top, t.queries(), corpus, 10, scorer=lambda q, c: F.length(c).cast("double"), chars=1_000_000_000)
    return out.select("query_id", "id", "rerank_position")


def length_or_failure(*columns: list) -> list[float]:
    """A scorer that breaks down whenever the last column of a request holds a text whose length is a multiple of three."""
    if any(len(x) % 3 == 0 for x in columns[-1]):
        raise RuntimeError("model gone")
    return [float(len(x)) for x in columns[-1]]


@query("u04_failing_scorer", """SELECT doc_id, CASE WHEN length(text) % 3 <> 0 THEN CAST(length(text) AS DOUBLE) END AS value, CASE WHEN length(text) % 3 = 0 THEN 'RuntimeError: model gone' END AS reason FROM documents""")
def failing_scorer(t: Tables) -> DataFrame:
    """A scorer that fails on a third of the texts: null and a reason for these, answers for all others."""
    answer = sc.guarded(length_or_failure)(F.col("text")).alias("a")
    return t.raw("documents").select("doc_id", answer).select("doc_id", "a.value", "a.reason")


@query("s05_rerank_failing", """SELECT query_id, id, rerank_position FROM (SELECT f.query_id, f.id, row_number() OVER (PARTITION BY f.query_id ORDER BY CASE WHEN length(m.content) % 3 <> 0 THEN length(m.content) END DESC NULLS LAST, f.position) AS rerank_position
    FROM fused f JOIN memories_base m ON m.id = f.id WHERE f.position <= 50) WHERE rerank_position <= 10""")
def failing_reranker(t: Tables) -> DataFrame:
    """Candidates whose score failed keep their fused order, behind those that have one."""
    from memspark.operators import search as se
    from memspark.plans.retrieval import searchable

    corpus = searchable(t, vectors=True)
    top = se.hybrid_search(corpus, t.queries(), limit=50, pool=50)
    scorer = sc.guarded(length_or_failure)
    return se.rerank(top, t.queries(), corpus, 10, scorer=lambda q, c: scorer(q, c)["value"]).select("query_id", "id", "rerank_position")
