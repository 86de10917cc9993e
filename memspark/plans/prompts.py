"""Queries: context blocks, prompts, reports, and the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.functions.time import age_days, clamp, half_life, whole_days
from memspark.operators import consolidate as co
from memspark.operators import context as cx
from memspark.operators import filters as fl
from memspark.operators import search as se
from memspark.plans.nightly import SCORED, scored
from memspark.plans.registry import query
from memspark.plans.retrieval import ANY_TOKEN, searchable
from memspark.plans.selection import NOW, as_of
from memspark.plans.views import Tables
from memspark.sources import export as ex

# --- Context --------------------------------------------------------------------------------------------

HEAD = """CASE WHEN type = 'tool_result' THEN NULL ELSE left(nullif(rtrim(trim(regexp_replace(CASE WHEN trim(summary) <> '' THEN trim(summary) ELSE
      coalesce(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '[\\p{L}\\p{N}_]') AND NOT starts_with(lower(l), 'source '))[1], '') END, '\\s+', ' ', 'g'), ' '), ' -–—:;·|,'), ''), 200) END"""


@query("k01_context_block", f"""WITH {ANY_TOKEN},
    hits AS (SELECT f.query_id, f.position, {HEAD} AS h FROM fused f JOIN memories_base m ON m.id = f.id WHERE f.position <= 15),
    firsts AS (SELECT query_id, lower(h) AS k, arg_min(h, position) AS h, min(position) AS position FROM hits WHERE h IS NOT NULL GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS place FROM firsts),
    mem AS (SELECT query_id, '## Relevant Memories' || chr(10) || string_agg('- ' || h, chr(10) ORDER BY place) AS part FROM top WHERE place <= 5 GROUP BY 1),
    kn AS (SELECT a.query_id, '## Knowledge' || chr(10) || string_agg(rtrim('- ' || trim(split_part(d.text, chr(10), 1))), chr(10) ORDER BY a.rank) AS part FROM any_token a JOIN documents d ON d.doc_id = a.doc_id WHERE a.rank <= 5 GROUP BY 1)
    SELECT q.query_id, concat_ws(chr(10) || chr(10), m.part, k.part, '## Emotional State' || chr(10) || '- calm ' || q.user_id) AS context FROM queries q LEFT JOIN mem m USING (query_id) LEFT JOIN kn k USING (query_id)""")
def context(t: Tables) -> DataFrame:
    q = t.queries()
    corpus = searchable(t, vectors=True)
    hits = se.hybrid_search(corpus, q, limit=15, pool=50).join(corpus.select("id", "type", "summary", "content"), "id")
    docs = t.knowledge_docs()
    known = se.search_any_token(docs, q, 5).join(docs.select("id", "heading"), "id")
    mood = q.select("query_id", F.concat(F.lit("calm "), "user_id").alias("mood"))
    return cx.context_blocks(q, hits, known, 5, mood)


@query("k02_prompts", """WITH conv AS (SELECT conv_id, '## Conversation' || chr(10) || string_agg(role || ': ' || trim(text, ' ' || chr(10)), chr(10) ORDER BY turn) AS c FROM conversations WHERE trim(text, ' ' || chr(10)) <> '' GROUP BY conv_id),
    p AS (SELECT conv_id, concat_ws(chr(10) || chr(10), 'You are helpful.', CASE WHEN conv_id % 2 = 0 THEN '## Personality' || chr(10) || '- id: ' || conv_id END, '# Notes', c) AS prompt, c FROM conv)
    SELECT conv_id, md5(prompt) AS prompt_md5, CAST(greatest(1, length(prompt) // 4) AS INTEGER) AS token_count, 'system=16,' || CASE WHEN conv_id % 2 = 0 THEN 'personality=' || (21 + length(CAST(conv_id AS VARCHAR))) || ',' ELSE '' END || 'memory=7,conversation=' || length(c) AS sections FROM p""")
def prompts(t: Tables) -> DataFrame:
    conv = cx.conversation_text(t.chat())
    person = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("- id: "), "conv_id"))
    parts = conv.select("conv_id", F.lit(" You are helpful. ").alias("system"), person.alias("personality"), F.lit("").alias("emotion"),
                        F.lit("# Notes").alias("memory"), F.lit(None).cast("string").alias("knowledge"), "conversation")
    return cx.build_prompts(parts).select("conv_id", F.md5("prompt").alias("prompt_md5"), "token_count", "sections")


@query("k03_session_recall", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, agent_id ORDER BY created_at DESC, id) AS recency FROM memories_base WHERE status = 'active'),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id, agent_id ORDER BY importance DESC, recency) AS position FROM r WHERE recency <= 20)
    SELECT user_id, agent_id, '[auto-recalled memories]' || chr(10) || string_agg('- ' || left(split_part(CASE WHEN summary <> '' THEN summary ELSE content END, chr(10), 1), 160), chr(10) ORDER BY position)
      || CASE WHEN agent_id = 'en' THEN chr(10) || '[emotion] curious' ELSE '' END AS text FROM p WHERE position <= 5 GROUP BY user_id, agent_id""")
def recall(t: Tables) -> DataFrame:
    m = t.memories_base()
    mood = m.filter("agent_id = 'en'").select("user_id", "agent_id").distinct().withColumn("mood", F.lit("curious"))
    return cx.session_recall(m, mood=mood)


RED = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\\b(assistant|user|system|subagent)\\b', '', 'g'), '\\b(sk-[A-Za-z0-9]{{16,}}|[A-Za-z0-9_\\-]{{32,}})\\b', '***', 'g'), '\\s+', ' ', 'g'), ' ')"
TTL = "CASE WHEN trim(summary) <> '' THEN left(trim(summary), 100) ELSE left(split_part(trim(content, ' ' || chr(10) || chr(9)), chr(10), 1), 100) END"


@query("k04_nightly_report", f"""WITH {SCORED}, c AS (SELECT count(*) AS s, count(*) FILTER (score >= 0.7 AND access_count >= 3 AND age_days <= 30) AS e, (SELECT count(*) FROM win) AS p FROM scored),
    um AS (SELECT *, row_number() OVER (ORDER BY score DESC, created_at, id) AS place FROM scored WHERE id NOT IN (SELECT id FROM win))
    SELECT 'counts' AS part, 1 AS place, 'scanned' AS title, CAST(s AS DOUBLE) AS score FROM c UNION ALL SELECT 'counts', 2, 'eligible', e FROM c UNION ALL SELECT 'counts', 3, 'promoted', p FROM c
    UNION ALL SELECT 'promoted', place, left({RED.format(TTL)}, 60), score FROM win UNION ALL SELECT 'unmet', place, left({RED.format(TTL)}, 60), score FROM um WHERE place <= 2""")
def report(t: Tables) -> DataFrame:
    s = co.materialize(scored(t))
    w = co.promoted(s)
    return cx.nightly_report(co.deep_stats(s, w), w, co.top_unmet(s, w)).select("part", "place", "title", "score")


@query("a01_filtered_total", """SELECT user_id, count(*) AS total, count(*) FILTER (importance >= 0.5) AS important FROM memories_base WHERE status = 'active' AND NOT shared GROUP BY user_id""")
def totals(t: Tables) -> DataFrame:
    m = fl.scope(t.memories_base(), shared=False)
    return m.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("importance") >= 0.5).alias("important"))


# --- Scalar functions -----------------------------------------------------------------------------------


@query("t01_tokenise", "SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ')) AS tokens_md5 FROM documents")
def tokenise(t: Tables) -> DataFrame:
    d = t.raw("documents").select("doc_id", tx.tokens(F.col("text")).alias("k"))
    return d.select("doc_id", F.size("k").alias("n"), F.md5(F.concat_ws(" ", "k")).alias("tokens_md5"))


@query("t02_title", f"SELECT id, {TTL} AS title FROM memories_base")
def titles(t: Tables) -> DataFrame:
    return t.memories_base().select("id", tx.title(F.col("summary"), F.col("content"), F.col("id")).alias("title"))


@query("t03_slug", """SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT doc_id, rtrim(left(trim(regexp_replace(lower(trim(text, ' ' || chr(10) || chr(9))), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-'), 60), '-') AS s FROM documents)""")
def slugs(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", tx.slug(F.col("text")).alias("slug"))


@query("t04_headline", f"SELECT id, coalesce({HEAD}, '') AS headline FROM memories_base")
def headlines(t: Tables) -> DataFrame:
    h = tx.headline(F.col("type"), F.col("summary"), F.col("content"))
    return t.memories_base().select("id", F.coalesce(h, F.lit("")).alias("headline"))


@query("t05_redact", f"SELECT doc_id, md5({RED.format('text')}) AS redacted_md5, contains({RED.format('text')}, '***') AS masked FROM documents")
def redacted(t: Tables) -> DataFrame:
    r = tx.redact(F.col("text"))
    return t.raw("documents").select("doc_id", F.md5(r).alias("redacted_md5"), F.contains(r, F.lit("***")).alias("masked"))


@query("t06_clean_control", "SELECT page_id, md5(regexp_replace(html || chr(7) || 'x', '[\\x01-\\x08\\x0B\\f\\x0E-\\x1F]', ' ', 'g')) AS clean_md5 FROM pages")
def clean(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.md5(tx.clean_control(F.concat("html", F.lit("\x07x")))).alias("clean_md5"))


@query("t07_token_estimate", "SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM conversations")
def estimate(t: Tables) -> DataFrame:
    return t.chat().select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("tokens"))


@query("t08_bigram_jaccard", """WITH g AS MATERIALIZED (SELECT conv_id, turn, list_distinct(list_transform(range(1, length(s)), lambda i: substr(s, i, 2))) AS g FROM (SELECT *, trim(lower(text), ' ' || chr(10) || chr(9)) AS s FROM conversations))
    SELECT a.conv_id, a.turn, round(len(list_intersect(a.g, b.g)) / CAST(len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS DOUBLE), 6) AS similarity FROM g a JOIN g b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1""")
def jaccard(t: Tables) -> DataFrame:
    """Each turn and the next one."""
    c = t.chat().select("conv_id", "turn", tx.bigram_set(F.col("text")).alias("g"))
    n = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return c.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


@query("t09_split_tags", """SELECT page_id, array_to_string(list_filter(regexp_split_to_array(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '[,\\s]+'), lambda x: x <> ''), '|') AS tags FROM pages""")
def tags(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.array_join(tx.split_tags(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), "|").alias("tags"))


@query("t10_parse_timestamps", """SELECT event_id, CASE event_type WHEN 'error' THEN -1 WHEN 'click' THEN epoch_us(date_trunc('second', ts)) - 7200000000 ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events""")
def timestamps(t: Tables) -> DataFrame:
    """Broken text for errors, an offset for clicks, Z for views, naive text otherwise."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_type")
    s = F.when(kind == "error", "not a time").when(kind == "click", F.concat(text, F.lit("+02:00"))).when(kind == "view", F.concat(text, F.lit("Z"))).otherwise(text)
    parsed = tx.iso_to_utc(s)
    return t.feed().select("event_id", F.coalesce(F.unix_micros(parsed.cast("timestamp")), F.lit(-1)).alias("us"))


@query("t11_source_ids", "SELECT doc_id, doc_id || '|x' || n_chars || '|' || source AS ids FROM documents")
def sources(t: Tables) -> DataFrame:
    """Three ids written on the source line of a text, and read back."""
    ids = F.concat_ws(", ", "doc_id", F.concat(F.lit("x"), "n_chars"), "source")
    text = F.concat(F.col("text"), F.lit("\n来源记忆 (3): "), ids, F.lit("\nend"))
    return t.raw("documents").select("doc_id", F.array_join(tx.source_ids(text), "|").alias("ids"))


@query("t12_graph_label", """SELECT page_id, CASE WHEN s = '' THEN '?' ELSE s END AS label FROM (SELECT page_id, trim(replace(translate(regexp_extract(html, '<h1>([^<]*)</h1>', 1) || '[' || url || '|' || chr(34), '"[]|', '''()/'), chr(10), ' ')) AS s FROM pages)""")
def labels(t: Tables) -> DataFrame:
    raw = F.concat(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("["), "url", F.lit('|"'))
    return t.raw("pages").select("page_id", tx.graph_label(raw).alias("label"))


@query("t13_fingerprints", """SELECT doc_id, sha256(text) AS content_hash, md5(lower(trim(left(text, 100), ' ' || chr(10) || chr(9)))) AS first100, md5(lower(trim(left(text, 80), ' ' || chr(10) || chr(9)))) AS first80 FROM documents""")
def fingerprints(t: Tables) -> DataFrame:
    c = F.col("text")
    return t.raw("documents").select("doc_id", F.sha2(c, 256).alias("content_hash"), F.md5(tx.fingerprint(c, 100)).alias("first100"), F.md5(tx.fingerprint(c, 80)).alias("first80"))


@query("t14_decay_math", "SELECT event_id, round(pow(2, -value / 14), 6) AS half_life, round(log2(greatest(1, value + 1)), 6) AS log_term, greatest(0.1, least(20e0, value)) AS bounded FROM events")
def decay(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.feed().select("event_id", F.round(half_life(v, 14), 6).alias("half_life"), F.round(F.log2(F.greatest(F.lit(1.0), v + 1)), 6).alias("log_term"),
                           clamp(v, 0.1, 20.0).alias("bounded"))


@query("t15_category", """SELECT id, CASE WHEN type = 'project' THEN 'Projects' WHEN type = 'preference' THEN 'Rules' WHEN source = 'src3' THEN 'People' WHEN source = 'src4' THEN 'Timeline' ELSE 'General' END AS category FROM memories_base""")
def categories(t: Tables) -> DataFrame:
    tag = F.when(F.col("source") == "src3", " Person ").when(F.col("source") == "src4", "MILESTONE").otherwise("x")
    return t.memories_base().select("id", ex.category(F.col("type"), F.array(F.lit("none"), tag, F.lit("other"))).alias("category"))


@query("t16_strip_prefixes", "SELECT doc_id, left(CASE WHEN n_chars % 3 = 0 THEN substr(s, 1) ELSE s END, 120) AS summary FROM (SELECT doc_id, n_chars, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)")
def prefixes(t: Tables) -> DataFrame:
    """Every third text gets a label in front, which is taken off again."""
    labelled = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("摘要：总结: "), "text")).otherwise(F.col("text"))
    return t.raw("documents").select("doc_id", tx.strip_prefixes(labelled, ("摘要：", "摘要:", "总结：", "总结:")).alias("summary"))


@query("t18_ages", f"""SELECT id, round(greatest(0, (epoch_us({NOW}) - epoch_us(created_at)) / 86400e6), 6) AS age_days, CAST(floor((epoch_us({NOW}) - epoch_us(created_at)) / 86400e6) AS BIGINT) AS whole_days FROM memories_base""")
def ages(t: Tables) -> DataFrame:
    c = F.col("created_at")
    return t.memories_base().select("id", F.round(age_days(as_of(), c), 6).alias("age_days"), whole_days(as_of(), c).alias("whole_days"))


