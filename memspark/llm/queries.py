"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import codec, exact_dedup, language_id, line_dedup, mixing, packing, periodic, pii, simhash, token_count, top_k, url_filter, whitening
from memspark.llm.register import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]


@query("op6_packing")
def packing_query(documents: DataFrame) -> DataFrame:
    return packing.pack_documents(documents)


@query("op7_token_counts")
def token_counts(documents: DataFrame) -> DataFrame:
    return token_count.count_tokens(documents)


@query("op8_bpe_round_trip")
def bpe_round_trip(documents: DataFrame) -> DataFrame:
    return codec.round_trip(documents)


@query("op2_exact_dedup", r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
    g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""")
def exact_dedup_query(documents: DataFrame) -> DataFrame:
    return exact_dedup.exact_dedup(documents)


@query("op3_line_dedup", r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    s AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(s.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE s.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN s ON s.key = k.key GROUP BY doc_id""")
def line_dedup_query(documents: DataFrame) -> DataFrame:
    return line_dedup.line_dedup(documents, documents=10, digest=True)


@query("op5_simhash")
def simhash_query(documents: DataFrame) -> DataFrame:
    return simhash.near_duplicates(documents)


@query("op1_language_id")
def language_id_query(documents: DataFrame) -> DataFrame:
    return language_id.language_id(documents)


@query("op9_url_filter", table="pages")
def url_filter_query(pages: DataFrame) -> DataFrame:
    return url_filter.judge_urls(pages)


@query("op10_top_k", """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM x a JOIN x b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""", table="embeddings")
def top_k_query(embeddings: DataFrame) -> DataFrame:
    return top_k.top_k(embeddings)


@query("op4_pii")
def pii_query(documents: DataFrame) -> DataFrame:
    return pii.pii_report(documents)


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text), where one in ten by the id's checksum repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit("[^ \\t-\\r]+"), F.lit(0))))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def periodic_runs_query(documents: DataFrame) -> DataFrame:
    runs = periodic.periodic_runs(with_planted_runs(documents), length=24, exponent=3)
    # Runs come by start, then period, so the first of those with the greatest exact exponent is the one.
    better = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query("op12_embedding_whitening", table="embeddings")
def whitening_query(embeddings: DataFrame) -> DataFrame:
    return whitening.whiten(embeddings, k=8).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op13_mix_sources")
def mixing_query(documents: DataFrame) -> DataFrame:
    return mixing.mix_sources(documents).drop("source")
