"""SQL twins of the derived tables, for the cross-check engine."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "memories_base": """
        SELECT doc_id AS n, CAST(doc_id AS VARCHAR) AS id, 'u' || (doc_id % 7) AS user_id, lang AS agent_id,
          doc_id % 5 = 0 AS shared,
          CASE doc_id % 10 WHEN 0 THEN 'tool_result' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'project'
            WHEN 3 THEN 'preference' ELSE 'general' END AS type,
          text AS content,
          CASE WHEN doc_id % 3 = 0 THEN '' ELSE left(split_part(text, chr(10), 1), 100) END AS summary,
          CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS importance,
          CASE WHEN doc_id % 2 = 0 THEN [source, 'k' || (doc_id * doc_id) % 53, 'm' || n_chars % 17]
            ELSE [source, 'k' || (doc_id * doc_id) % 53] END AS tags,
          source,
          CASE WHEN doc_id % 13 = 0 THEN 'archived' WHEN doc_id % 17 = 0 THEN 'discarded' ELSE 'active' END AS status,
          TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' MINUTE * (doc_id * 61 % 60000) AS created_at
        FROM documents""",
    "touches": """
        SELECT (user_id * 31 + event_id * event_id) % (SELECT count(*) FROM documents) AS n, ts, user_id,
          event_id AS request_id, event_type
        FROM events""",
    "memories": """
        SELECT m.*, coalesce(t.c, 0) AS access_count, t.last_access, coalesce(t.last_access, m.created_at) AS updated_at
        FROM memories_base m
        LEFT JOIN (SELECT n, count(*) AS c, max(ts) AS last_access FROM touches GROUP BY n) t ON t.n = m.n""",
    "memory_terms": """
        SELECT id, unnest(regexp_extract_all(lower(content || chr(10) || CASE WHEN summary = '' THEN '' ELSE summary || chr(10) END
          || array_to_string(tags, ' ')), '[\\p{L}\\p{N}_]+')) AS term
        FROM memories_base""",
    "memory_vectors": """
        SELECT id, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS w
        FROM (
          SELECT id, dim, CAST(sum(sign) AS DOUBLE) AS raw
          FROM (SELECT id, CAST('0x' || substr(sha256(t), 1, 4) AS INTEGER) % 1024 AS dim,
                  CASE WHEN CAST('0x' || substr(sha256(t), 6, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign
                FROM (SELECT id, unnest(regexp_extract_all(lower(content || chr(10) || summary), '[\\p{L}\\p{N}_]+')) AS t
                      FROM memories_base))
          GROUP BY id, dim)
        WHERE raw <> 0""",
    "queries": """
        SELECT item_id AS query_id, 'u' || item_id % 7 AS user_id,
          CASE WHEN w[9] IS NULL THEN coalesce(w[3], '') WHEN w[3] = w[9] THEN w[3] ELSE w[3] || ' ' || w[9] END AS text
        FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark)""",
    "query_terms": """
        SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM queries""",
    "query_vectors": """
        SELECT query_id, dim, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS w
        FROM (
          SELECT query_id, dim, CAST(sum(sign) AS DOUBLE) AS raw
          FROM (SELECT query_id, CAST('0x' || substr(sha256(t), 1, 4) AS INTEGER) % 1024 AS dim,
                  CASE WHEN CAST('0x' || substr(sha256(t), 6, 1) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS sign
                FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM queries))
          GROUP BY query_id, dim)
        WHERE raw <> 0""",
    "signals": """
        SELECT CAST(s.n AS VARCHAR) AS memory_id, phase, CASE WHEN phase = 'light' THEN 0.05e0 ELSE 0.08e0 END AS boost,
          CASE WHEN phase = 'rem' THEN d.source END AS cluster_tag, s.created_at
        FROM (SELECT n, CASE WHEN event_type IN ('view', 'click') THEN 'light' ELSE 'rem' END AS phase,
                CAST(ts AS DATE) AS day, min(ts) AS created_at
              FROM touches WHERE event_type IN ('view', 'click', 'purchase') GROUP BY ALL) s
        JOIN documents d ON d.doc_id = s.n""",
    "runs": """
        SELECT event_id AS run_id,
          CASE user_id % 3 WHEN 0 THEN 'light' WHEN 1 THEN 'rem' ELSE 'deep' END AS phase, ts AS started_at,
          CASE WHEN value > 5 THEN ts + INTERVAL '30' SECOND END AS finished_at, value AS scanned
        FROM events WHERE event_type IN ('error', 'signup')""",
    "doc_collection": """
        SELECT source AS collection, 'd' || doc_id || '.md' AS path, split_part(text, chr(10), 1) AS title,
          text AS content, sha256(text) AS content_hash, doc_id
        FROM documents""",
    "doc_collection_old": """
        SELECT collection, path, title, c AS content, sha256(c) AS content_hash, doc_id, quality, toxic,
          CASE WHEN toxic = 1 THEN 'error' ELSE 'stored' END AS last_status
        FROM (SELECT d.*, l.quality, l.toxic, CASE WHEN l.quality = 0 THEN content || ' (old)' ELSE content END AS c
              FROM doc_collection d JOIN labels l ON l.doc_id = d.doc_id)""",
    "markdown_files": """
        SELECT page_id, folder, folder || '/p' || page_id || '.md' AS path, host, heading, body,
          '# ' || heading || chr(10) || chr(10) || '## Web' || chr(10) || chr(10) || body AS inner_text
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*/([^/?]*)', 1) AS folder,
          trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages)""",
    "workspace": """
        SELECT doc_id, CASE lang WHEN 'en' THEN 'projects' WHEN 'fr' THEN 'rules' WHEN 'de' THEN 'memory' ELSE 'other' END || '/' || source || '/'
            || CASE WHEN n_chars % 10 = 0 THEN 'README.md' ELSE 'd-' || doc_id || '.md' END AS path, source, lang,
          CASE WHEN n_chars % 2 = 0 THEN '# Note ' || doc_id || ' #tag-a #tag_b' || chr(10) || chr(10) || text ELSE text END AS content
        FROM documents""",
    "patches": """
        SELECT CAST(doc_id AS VARCHAR) AS id, quality * 0.5e0 + 0.25e0 AS importance, CASE WHEN toxic = 1 THEN 'discarded' END AS status,
          CASE WHEN toxic = 1 THEN 'reviewed' END AS summary
        FROM labels""",
    "entities": """
        SELECT 'r' || r_regionkey AS id, r_name AS name, 'region' AS type, 0.9e0 AS importance FROM region
        UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', 0.8e0 FROM nation
        UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', round(s_acctbal / 20000, 4) FROM supplier
        UNION ALL SELECT 'c' || c_custkey, c_name, 'customer', round(c_acctbal / 20000, 4) FROM customer""",
    "relations": """
        SELECT *, source_id || '>' || target_id AS relation_id, 1e0 AS weight FROM (
          SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id, 'part_of' AS relation_type FROM nation
          UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier
          UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'located_in' FROM customer
          UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'ordered_by' FROM orders)""",
    "bm25_hits": """
        SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))), 9) AS score
        FROM (
          SELECT q.query_id, p.id, p.tf, l.len, d.df, s.n, s.avg,
            (SELECT count(*) FROM query_terms x WHERE x.query_id = q.query_id) AS wanted,
            count(*) OVER (PARTITION BY q.query_id, p.id) AS found
          FROM query_terms q
          JOIN (SELECT id, term, count(*) AS tf FROM searchable_terms GROUP BY ALL) p ON p.term = q.term
          JOIN (SELECT id, count(*) AS len FROM searchable_terms GROUP BY id) l ON l.id = p.id
          JOIN (SELECT term, count(DISTINCT id) AS df FROM searchable_terms GROUP BY term) d ON d.term = q.term,
          (SELECT count(DISTINCT id) AS n, count(*) * 1.0e0 / count(DISTINCT id) AS avg FROM searchable_terms) s)
        WHERE wanted = found GROUP BY query_id, id""",
    "searchable": """
        SELECT * FROM memories_base
        WHERE status = 'active' AND NOT (type = 'tool_result' AND importance < 0.5)""",
    "searchable_terms": """
        SELECT t.* FROM memory_terms t JOIN searchable s ON s.id = t.id""",
    "text_ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25_hits""",
    "vector_ranked": """
        SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
        FROM (
          SELECT q.query_id, m.id, round(1 - coalesce(sum(q.w * v.w), 0), 9) AS distance
          FROM (SELECT DISTINCT query_id FROM query_vectors) k CROSS JOIN searchable m
          JOIN query_vectors q ON q.query_id = k.query_id
          LEFT JOIN memory_vectors v ON v.id = m.id AND v.dim = q.dim
          GROUP BY q.query_id, m.id)""",
    "fused": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, id) AS position
        FROM (
          SELECT coalesce(t.query_id, v.query_id) AS query_id, coalesce(t.id, v.id) AS id,
            coalesce(1.0e0 / (60 + t.rank), 0) + coalesce(1.0e0 / (60 + v.rank), 0) AS rrf_score,
            t.rank AS bm25_rank, t.score AS bm25_score, v.rank AS vector_rank, v.distance AS vector_distance
          FROM (SELECT * FROM text_ranked WHERE rank <= 50) t
          FULL JOIN (SELECT * FROM vector_ranked WHERE rank <= 50) v ON v.query_id = t.query_id AND v.id = t.id)""",
}


def with_views(body: str) -> str:
    """``body`` preceded by the definitions of the views it names."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    text = body.strip()
    if not order:
        return text
    head = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    if text[:5].upper() == "WITH ":
        rest = text[5:]
        if rest.upper().startswith("RECURSIVE "):
            return f"WITH RECURSIVE {head},\n{rest[10:]}"
        return f"WITH {head},\n{rest}"
    return f"WITH {head}\n{text}"
