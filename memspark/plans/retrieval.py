"""Queries: retrieval and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.operators import filters as fl
from memspark.operators import search as se
from memspark.plans.registry import query
from memspark.plans.views import Tables


def searchable(t: Tables, vectors: bool = False) -> DataFrame:
    """Active memories without noise, tokenised."""
    rows = t.with_tokens(fl.exclude_noise(fl.active(t.memories_base())))
    return t.with_embedding(rows) if vectors else rows


@query(
    "s01_fulltext_search",
    "SELECT query_id, id, round(score, 6) AS score, rank FROM text_ranked WHERE rank <= 20",
)
def fulltext(t: Tables) -> DataFrame:
    hits = se.search_fulltext(searchable(t), t.queries(), 20)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "s02_vector_search",
    """SELECT query_id, id, round(distance, 6) AS distance, round(1 - distance / 2, 6) AS score, rank
       FROM vector_ranked WHERE rank <= 10""",
)
def vector(t: Tables) -> DataFrame:
    from memspark.functions import vectors as vec

    q = t.queries().select("query_id", vec.embed_text(F.col("text")).alias("embedding"))
    hits = se.search_vector(searchable(t, vectors=True), q, 10)
    return hits.select("query_id", "id", F.round("distance", 6).alias("distance"), "score", "rank")


HYBRID_SQL = """SELECT query_id, id, round(rrf_score, 6) AS rrf_score, coalesce(bm25_rank, 0) AS bm25_rank, coalesce(vector_rank, 0) AS vector_rank, position
       FROM fused WHERE position <= 10"""


@query("s04_hybrid_search", HYBRID_SQL)
def hybrid(t: Tables) -> DataFrame:
    hits = se.hybrid_search(searchable(t, vectors=True), t.queries(), limit=10, pool=50)
    ranks = [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]
    return hits.select("query_id", "id", F.round("rrf_score", 6).alias("rrf_score"), *ranks, "position")


@query("j01_rank_fusion_join", "SELECT query_id, id, round(rrf_score, 6) AS rrf_score, bm25_rank, vector_rank FROM fused WHERE bm25_rank IS NOT NULL AND vector_rank IS NOT NULL")
def fusion_join(t: Tables) -> DataFrame:
    """Rows found by both branches."""
    hits = se.hybrid_search(searchable(t, vectors=True), t.queries(), limit=None, pool=50)
    both = hits.filter(F.col("bm25_rank").isNotNull() & F.col("vector_rank").isNotNull())
    return both.select("query_id", "id", F.round("rrf_score", 6).alias("rrf_score"), "bm25_rank", "vector_rank")


@query(
    "s03_rank_fusion",
    """SELECT query_id, id, round(rrf_score, 6) AS rrf_score, coalesce(bm25_rank, 0) AS bm25_rank, round(coalesce(bm25_score, -1), 6) AS bm25_score,
         coalesce(vector_rank, 0) AS vector_rank, round(coalesce(vector_distance, -1), 6) AS vector_distance, position FROM fused""",
)
def fusion(t: Tables) -> DataFrame:
    hits = se.hybrid_search(searchable(t, vectors=True), t.queries(), limit=None, pool=50)
    return hits.select(
        "query_id", "id", F.round("rrf_score", 6).alias("rrf_score"), "position",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")],
        *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("bm25_score", "vector_distance")],
    )


TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query(
    "s05_rerank",
    f"""SELECT query_id, id, position, rerank_score, rerank_position FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, position) AS rerank_position
        FROM (SELECT f.query_id, f.id, f.position,
            round(len(list_intersect(list_distinct({TOKENS.format('q.text')}), {TOKENS.format('m.content')}))
              / CAST(len(list_distinct({TOKENS.format('q.text')})) AS DOUBLE), 9) AS rerank_score
          FROM fused f JOIN queries q ON q.query_id = f.query_id JOIN memories_base m ON m.id = f.id
          WHERE f.position <= 50)) WHERE rerank_position <= 10""",
)
def reranked(t: Tables) -> DataFrame:
    corpus = searchable(t, vectors=True)
    top = se.hybrid_search(corpus, t.queries(), limit=50, pool=50)
    out = se.rerank(top, t.queries(), corpus, 10)
    return out.select("query_id", "id", "position", "rerank_score", "rerank_position")


ANY_TOKEN = f"""any_token AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, n_text) AS rank, count(*) OVER (PARTITION BY query_id) AS total
    FROM (SELECT q.query_id, d.doc_id, CAST(d.doc_id AS VARCHAR) AS n_text, sum(q.c) AS hits
      FROM (SELECT query_id, tok, count(*) AS c FROM (SELECT query_id, unnest({TOKENS.format('text')}) AS tok FROM queries) GROUP BY ALL) q
      JOIN documents d ON contains(lower(split_part(d.text, chr(10), 1) || chr(10) || d.text), q.tok)
      GROUP BY q.query_id, d.doc_id))"""


@query(
    "s06_any_token_search",
    f"WITH {ANY_TOKEN} SELECT query_id, n_text AS id, CAST(hits AS BIGINT) AS hits, rank, total FROM any_token WHERE rank <= 10",
)
def any_token(t: Tables) -> DataFrame:
    return se.search_any_token(t.knowledge_docs(), t.queries(), 10).select("query_id", "id", "hits", "rank", "total")


SUBSTRING = """substring_hits AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS total
    FROM (SELECT q.query_id, m.id, m.created_at FROM queries q JOIN memories_base m
            ON m.status = 'active' AND (m.content ILIKE '%' || q.text || '%' OR m.summary ILIKE '%' || q.text || '%')))"""


def first_words(t: Tables) -> DataFrame:
    """Requests of one word each, so that substring search finds something."""
    return t.queries().withColumn("text", F.substring_index("text", " ", 1))


ONE_WORD = "(SELECT query_id, split_part(text, ' ', 1) AS text FROM queries)"


@query(
    "p02_substring_search",
    f"WITH {SUBSTRING.replace('FROM queries q', 'FROM ' + ONE_WORD + ' q')} SELECT query_id, id, rank, total FROM substring_hits WHERE rank <= 20",
)
def substring(t: Tables) -> DataFrame:
    return se.search_substring(fl.active(t.memories_base()), first_words(t), 20).select("query_id", "id", "rank", "total")


WILD = "(SELECT query_id, left(split_part(text, ' ', 1), 2) || '_' || substr(split_part(text, ' ', 1), 4) || '%the' AS text FROM queries)"


@query(
    "p02_substring_wildcards",
    f"WITH {SUBSTRING.replace('FROM queries q', 'FROM ' + WILD + ' q')} SELECT query_id, id, rank, total FROM substring_hits WHERE rank > 5 AND rank <= 15",
)
def substring_wild(t: Tables) -> DataFrame:
    """Patterns with wildcards, second page of results."""
    word = F.substring_index("text", " ", 1)
    text = F.concat(F.substring(word, 1, 2), F.lit("_"), F.substring(word, 4, 100), F.lit("%the"))
    q = t.queries().withColumn("text", text)
    return se.search_substring(fl.active(t.memories_base()), q, 10, 5).select("query_id", "id", "rank", "total")


@query(
    "p06_lookup_by_id",
    f"""WITH wanted AS (SELECT item_id AS query_id, CAST(item_id * 41 AS VARCHAR) AS want, w.text FROM benchmark JOIN {ONE_WORD} w ON w.query_id = item_id),
        direct AS (SELECT query_id, m.id, 'id' AS found_by FROM wanted JOIN memories_base m ON m.id = want AND m.status = 'active')
        SELECT * FROM direct UNION ALL
        SELECT query_id, arg_max(id, (created_at, -n)) AS id, 'content' AS found_by
        FROM wanted JOIN memories_base m ON m.status = 'active' AND text <> '' AND (m.content ILIKE '%' || text || '%' OR m.summary ILIKE '%' || text || '%')
        WHERE query_id NOT IN (SELECT query_id FROM direct) GROUP BY query_id""",
)
def lookup(t: Tables) -> DataFrame:
    """Some ids asked for do not exist or are archived: those are looked up by content."""
    q = first_words(t).withColumn("want", (F.col("query_id") * 41).cast("string"))
    return se.get_by_id(fl.active(t.memories_base()), q.select("query_id", "want", "text"))


@query(
    "s07_layered_recall",
    """WITH talk AS (
      SELECT conv_id AS query_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
    ask AS (SELECT query_id, lower(regexp_extract(text, '[\\p{L}\\p{N}_]+')) AS text FROM talk WHERE back = 1),
    ask_terms AS (SELECT query_id, text AS term FROM ask WHERE text <> ''),
    tf AS (SELECT id, term, count(*) AS tf FROM searchable_terms GROUP BY ALL),
    len AS (SELECT id, count(*) AS len FROM searchable_terms GROUP BY id),
    st AS (SELECT count(*) AS n, avg(len) AS avg FROM len),
    dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    text_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
      SELECT a.query_id, tf.id, round(ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * len.len / st.avg)), 9) AS score
      FROM ask_terms a JOIN tf USING (term) JOIN len USING (id) JOIN dfs USING (term), st)),
    av AS (SELECT query_id, CAST('0x' || substr(sha256(term), 1, 4) AS INTEGER) % 1024 AS dim,
        CASE WHEN CAST('0x' || substr(sha256(term), 6, 1) AS INTEGER) % 2 = 1 THEN 1e0 ELSE -1e0 END AS w FROM ask_terms),
    vec_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
      SELECT av.query_id, m.id, round(1 - coalesce(av.w * v.w, 0), 9) AS distance
      FROM av CROSS JOIN searchable m LEFT JOIN memory_vectors v ON v.id = m.id AND v.dim = av.dim)),
    fuse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, tr NULLS LAST, vr NULLS LAST, id) AS position FROM (
      SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.id, v.id) AS id, t.rank AS tr, v.rank AS vr,
        coalesce(1e0 / (60 + t.rank), 0) + coalesce(1e0 / (60 + v.rank), 0) AS s
      FROM (SELECT * FROM text_hits WHERE rank <= 50) t FULL JOIN (SELECT * FROM vec_hits WHERE rank <= 50) v ON t.query_id = v.query_id AND t.id = v.id)),
    every AS (
      SELECT t.query_id, 0 AS layer, t.turn AS place, CAST(NULL AS VARCHAR) AS id, t.text AS content, CAST([] AS VARCHAR[]) AS tags
      FROM talk t JOIN ask a ON a.query_id = t.query_id AND t.back BETWEEN 2 AND 11 AND contains(lower(t.text), a.text)
      UNION ALL SELECT f.query_id, 1, f.position, f.id, m.content, m.tags FROM fuse f JOIN memories_base m ON m.id = f.id WHERE f.position <= 20
      UNION ALL SELECT f.query_id, 2, f.position, f.id, m.content, m.tags FROM fuse f JOIN memories_base m ON m.id = f.id WHERE f.position <= 10),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY layer) AS lr, row_number() OVER (PARTITION BY query_id, layer ORDER BY place) AS pos FROM every),
    scored AS (SELECT *, round((1e0 / (60 + lr) + 1e0 / (60 + pos)) * (1 + CASE WHEN list_contains(tags, 'src1') THEN 0.15e0 ELSE 0 END), 4) AS score FROM ranked),
    uniq AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(trim(content, ' ' || chr(10))) ORDER BY score DESC, layer, pos) AS dup
      FROM scored WHERE trim(content, ' ' || chr(10)) <> '')
    SELECT query_id, ['conscious', 'preconscious', 'subconscious'][layer + 1] AS layer, coalesce(id, '') AS id, score, position FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, layer, pos) AS position FROM uniq WHERE dup = 1) WHERE position <= 10""",
)
def layered(t: Tables) -> DataFrame:
    """The last turn of each conversation asks; earlier turns are its session, memories the deeper layers."""
    turns = t.chat().select(F.col("conv_id").alias("query_id"), F.col("turn").alias("seq"), "text")
    last = turns.groupBy("query_id").agg(F.max_by("text", "seq").alias("text"))
    ask = last.select("query_id", F.lower(F.regexp_extract("text", tx.WORD, 0)).alias("text"))
    corpus = searchable(t, vectors=True)
    fused = se.hybrid_search(corpus, ask, limit=20, pool=50)
    mood = lambda tags: se.mood_weight(tags, F.lit(0.8), F.lit(0.2), intimacy_tags=("src1",))
    out = se.layered_recall(turns, fused, corpus, ask, mood, 10)
    return out.select("query_id", "layer", F.coalesce("id", F.lit("")).alias("id"), "score", "position")


@query(
    "s08_mood_weight",
    """SELECT id, CASE WHEN importance > 0.7 AND (list_contains(tags, 'src1') OR list_contains(tags, 'src2')) THEN 0.15e0 ELSE 0e0 END
         + CASE WHEN importance > 0.6 AND (list_contains(tags, 'k1') OR list_contains(tags, 'm3')) THEN 0.10e0 ELSE 0e0 END AS weight FROM memories_base""",
)
def mood(t: Tables) -> DataFrame:
    m = t.memories_base()
    w = se.mood_weight(F.col("tags"), F.col("importance"), F.col("importance"), ("src1", "src2"), ("k1", "m3"))
    return m.select("id", w.alias("weight"))


@query(
    "s09_snippet",
    f"""WITH pairs AS (
      SELECT q.query_id, d.doc_id, d.text AS content, lower(d.text) AS low, list_concat([lower(q.text)], {TOKENS.format('q.text')}) AS needles
      FROM queries q JOIN documents d ON d.doc_id = q.query_id),
    found AS (SELECT *, list_filter(list_transform(list_filter(needles, lambda x: x <> ''), lambda x: instr(low, x)), lambda p: p > 0) AS hits FROM pairs),
    cut AS (SELECT *, trim(CASE WHEN len(hits) > 0 THEN substr(content, greatest(1, hits[1] - 26), 80) ELSE left(content, 80) END, ' ' || chr(10) || chr(9)) AS part FROM found)
    SELECT query_id, doc_id, part || CASE WHEN length(part) < length(trim(content, ' ' || chr(10) || chr(9))) THEN '…' ELSE '' END AS snippet FROM cut""",
)
def snippets(t: Tables) -> DataFrame:
    q = t.queries().select("query_id", F.col("text").alias("q"))
    d = t.raw("documents").join(q, F.col("doc_id") == F.col("query_id"))
    return d.select("query_id", "doc_id", tx.snippet(F.col("text"), F.col("q"), 80).alias("snippet"))


@query(
    "s01_fulltext_any",
    """SELECT query_id, id, round(score, 6) AS score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT q.query_id, p.id, round(sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * l.len / s.avg))), 9) AS score
        FROM query_terms q
        JOIN (SELECT id, term, count(*) AS tf FROM searchable_terms GROUP BY ALL) p ON p.term = q.term
        JOIN (SELECT id, count(*) AS len FROM searchable_terms GROUP BY id) l ON l.id = p.id
        JOIN (SELECT term, count(DISTINCT id) AS df FROM searchable_terms GROUP BY term) d ON d.term = q.term,
        (SELECT count(DISTINCT id) AS n, count(*) * 1.0e0 / count(DISTINCT id) AS avg FROM searchable_terms) s
        GROUP BY q.query_id, p.id)) WHERE rank <= 20""",
)
def fulltext_any(t: Tables) -> DataFrame:
    hits = se.search_fulltext(searchable(t), t.queries(), 20, match="any")
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "s01_cover_density",
    f"""WITH pos AS (SELECT id, unnest(k) AS term, generate_subscripts(k, 1) AS p FROM (
        SELECT id, {TOKENS.format("content || chr(10) || CASE WHEN summary = '' THEN '' ELSE summary || chr(10) END || array_to_string(tags, ' ')")} AS k FROM searchable)),
    wanted AS (SELECT query_id, count(*) AS n FROM query_terms GROUP BY 1),
    hit AS (SELECT q.query_id, s.id, s.term, s.p, w.n, lag(s.term) OVER o AS before, lag(s.p) OVER o AS before_p FROM query_terms q JOIN wanted w USING (query_id) JOIN pos s ON s.term = q.term
      WINDOW o AS (PARTITION BY q.query_id, s.id ORDER BY s.p)),
    sc AS (SELECT query_id, id, round(sum(CASE WHEN n = 1 THEN 1e0 WHEN before <> term THEN least(1e0, 2e0 / (p - before_p + 1)) ELSE 0e0 END), 6) AS score FROM hit GROUP BY query_id, id HAVING count(DISTINCT term) = max(n)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)
    SELECT query_id, id, score, rank FROM rk WHERE rank <= 20""",
)
def cover(t: Tables) -> DataFrame:
    """The SQL holds for queries of one or two tokens, which the given ones are."""
    hits = se.search_fulltext(searchable(t), t.queries(), 20, ranker="cover_density", digits=6)
    return hits.select("query_id", "id", "score", "rank")


@query(
    "p09_alias_scopes",
    f"""WITH al AS (SELECT DISTINCT user_id, 'u' || (CAST(substr(user_id, 2) AS INTEGER) + 1) % 7 AS other FROM memories_base WHERE CAST(substr(user_id, 2) AS INTEGER) <= 2),
    sc AS (SELECT query_id, text, user_id AS scope, 0 AS scope_rank FROM queries UNION ALL SELECT query_id, text, other, 1 FROM queries JOIN al USING (user_id)),
    hits AS (SELECT q.query_id, q.scope_rank, m.id, row_number() OVER (PARTITION BY q.query_id, q.scope ORDER BY m.created_at DESC, m.id) AS rank
      FROM (SELECT query_id, scope, scope_rank, split_part(text, ' ', 1) AS text FROM sc) q
      JOIN memories_base m ON m.status = 'active' AND m.user_id = q.scope AND (m.content ILIKE '%' || q.text || '%' OR m.summary ILIKE '%' || q.text || '%'))
    SELECT query_id, id, scope_rank, row_number() OVER (PARTITION BY query_id ORDER BY scope_rank, rank, id) AS position FROM hits WHERE rank <= 10""",
)
def alias_scopes(t: Tables) -> DataFrame:
    asked = fl.expand_scopes(first_words(t), t.aliases())
    per_scope = asked.select(
        F.concat_ws("|", "query_id", "scope_rank").alias("query_id"), "text", F.col("scope").alias("user_id")
    )
    hits = se.search_substring(fl.active(t.memories_base()), per_scope, 10, scopes=("user_id",))
    key = F.split("query_id", "\\|")
    hits = hits.select(key[0].cast("long").alias("query_id"), key[1].cast("int").alias("scope_rank"), "rank", "id")
    return fl.merge_scopes(hits)
