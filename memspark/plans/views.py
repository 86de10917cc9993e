"""The supplied tables seen as memories, documents, requests and feeds. ``oracle_views`` says the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.functions import vectors as vec
from memspark.functions.time import ntz
from memspark.session import spread

AS_OF = "2024-01-31 00:00:00"
DIM = 1024


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir
        self.seen: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self.seen:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            # The text tables feed regular expressions and vectors: worth all cores.
            self.seen[name] = spread(df) if name in ("documents", "pages") else df
        return self.seen[name]

    @cached_property
    def n_documents(self) -> int:
        return self.spark.read.parquet(f"{self.dir}/documents.parquet").count()

    # -- memories ---------------------------------------------------------------------------------------

    def memories_base(self) -> DataFrame:
        """Memory rows from documents, without reinforcement counts and vectors."""
        n = F.col("doc_id")
        kind = n % 10
        d = self.raw("documents")
        first = F.substring(F.split("text", "\n", 2)[0], 1, 100)
        tags = F.array(F.col("source"), F.concat(F.lit("k"), (n * n) % 53))
        return d.select(
            n.alias("n"),
            n.cast("string").alias("id"),
            F.concat(F.lit("u"), n % 7).alias("user_id"),
            F.col("lang").alias("agent_id"),
            (n % 5 == 0).alias("shared"),
            F.when(kind == 0, "tool_result").when(kind == 1, "knowledge").when(kind == 2, "project")
            .when(kind == 3, "preference").otherwise("general").alias("type"),
            F.col("text").alias("content"),
            F.when(n % 3 == 0, F.lit("")).otherwise(first).alias("summary"),
            ((n * 37 % 101) / F.lit(100.0)).alias("importance"),
            F.when(n % 2 == 0, F.concat(tags, F.array(F.concat(F.lit("m"), F.col("n_chars") % 17))))
            .otherwise(tags).alias("tags"),
            F.col("source"),
            F.when(n % 13 == 0, "archived").when(n % 17 == 0, "discarded").otherwise("active").alias("status"),
            (ntz(AS_OF) - F.make_dt_interval(mins=(n * 61 % 60000).cast("int"))).alias("created_at"),
        )

    def touches(self) -> DataFrame:
        """Which memory each event of the feed recalled: (n, ts, user_id, request_id)."""
        e = self.raw("events")
        n = (F.col("user_id") * 31 + F.col("event_id") * F.col("event_id")) % self.n_documents
        return e.select(n.alias("n"), "ts", "user_id", F.col("event_id").alias("request_id"), "event_type")

    def memories(self) -> DataFrame:
        """Memory rows with access_count and last_access."""
        counts = self.touches().groupBy("n").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_access"))
        joined = self.memories_base().join(counts, "n", "left")
        return joined.withColumn("access_count", F.coalesce("access_count", F.lit(0)).cast("long")).withColumn(
            "updated_at", F.coalesce("last_access", "created_at")
        )

    def with_tokens(self, df: DataFrame) -> DataFrame:
        blob = F.concat_ws("\n", "content", F.nullif("summary", F.lit("")), F.concat_ws(" ", "tags"))
        return df.withColumn("tokens", tx.tokens(blob))

    def with_embedding(self, df: DataFrame) -> DataFrame:
        body = F.concat_ws("\n", "content", "summary")
        return df.withColumn("embedding", vec.embed_text(body))

    def signals(self) -> DataFrame:
        """Consolidation signals: one per memory, phase and day of the feed."""
        light = F.col("event_type").isin("view", "click")
        deep = F.col("event_type") == "purchase"
        phase = F.when(light, "light").when(deep, "rem")
        e = self.touches().withColumn("phase", phase).filter("phase is not null")
        once = e.groupBy("n", "phase", F.to_date("ts").alias("day")).agg(F.min("ts").alias("created_at"))
        return once.join(self.raw("documents").select(F.col("doc_id").alias("n"), "source"), "n").select(
            F.col("n").cast("string").alias("memory_id"), "phase",
            F.when(F.col("phase") == "light", 0.05).otherwise(0.08).alias("boost"),
            F.when(F.col("phase") == "rem", F.col("source")).alias("cluster_tag"), "created_at",
        )

    def runs(self) -> DataFrame:
        """Run log: each error event opens a run, finished when its value is above 5."""
        e = self.raw("events").filter("event_type in ('error', 'signup')")
        phase = F.when(F.col("user_id") % 3 == 0, "light").when(F.col("user_id") % 3 == 1, "rem").otherwise("deep")
        return e.select(
            F.col("event_id").alias("run_id"), phase.alias("phase"), F.col("ts").alias("started_at"),
            F.when(F.col("value") > 5, F.col("ts") + F.expr("interval 30 seconds")).alias("finished_at"),
            F.col("value").alias("scanned"),
        )

    # -- requests ---------------------------------------------------------------------------------------

    def queries(self) -> DataFrame:
        """Search requests: words 3 and 9 of the benchmark texts, with the user asking."""
        w = tx.words(F.col("text"))
        pair = F.filter(F.array_distinct(F.array(F.get(w, F.lit(2)), F.get(w, F.lit(8)))), lambda x: x.isNotNull())
        return self.raw("benchmark").select(
            F.col("item_id").alias("query_id"), F.concat_ws(" ", pair).alias("text"),
            F.concat(F.lit("u"), F.col("item_id") % 7).alias("user_id"),
        )

    def aliases(self) -> DataFrame:
        """Identity groups: every user of the memories with the next user and, for u2, itself again."""
        u = self.memories_base().select("user_id").distinct()
        number = F.substring("user_id", 2, 9).cast("int")
        near = F.concat(F.lit("u"), (number + 1) % 7)
        return u.filter(number <= 2).select("user_id", F.array(F.col("user_id"), near, F.col("user_id")).alias("aliases"))

    # -- documents --------------------------------------------------------------------------------------

    def doc_collection(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("source").alias("collection"), F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md")).alias("path"),
            F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("content"),
            F.sha2("text", 256).alias("content_hash"), F.col("doc_id"),
        )

    def doc_collection_old(self) -> DataFrame:
        """What was indexed before: the labelled documents; those of low quality had another text."""
        old = self.doc_collection().join(self.raw("labels"), "doc_id")
        content = F.when(F.col("quality") == 0, F.concat(F.col("content"), F.lit(" (old)"))).otherwise(F.col("content"))
        return old.withColumn("content", content).withColumn("content_hash", F.sha2("content", 256)).withColumn(
            "last_status", F.when(F.col("toxic") == 1, "error").otherwise("stored")
        )

    def knowledge_docs(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(F.col("doc_id").cast("string").alias("id"), F.split("text", "\n", 2)[0].alias("heading"),
                        F.col("text").alias("content"))

    def markdown_files(self) -> DataFrame:
        """Markdown files made from the raw pages: front matter, the page heading, one section, the plain text."""
        p = self.raw("pages")
        host = F.regexp_extract("url", "^https?://([^/]*)", 1)
        folder = F.regexp_extract("url", "^https?://[^/]*/([^/?]*)", 1)
        heading = F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))
        body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "\\s+", " "))
        front = F.concat(
            F.lit("---\ntags: web, "), host, F.when(F.col("page_id") % 2 == 0, F.lit("\nimportance: 1.7\ntype: page")).otherwise(""),
            F.lit("\n---\n"),
        )
        text = F.concat(front, F.lit("# "), heading, F.lit("\n\n## Web\n\n"), body, F.lit("\n"))
        return p.select("page_id", folder.alias("folder"), F.concat(folder, F.lit("/p"), "page_id", F.lit(".md")).alias("path"), text.alias("text"))

    def workspace(self) -> DataFrame:
        """Documents as files of a workspace: the language decides the top folder."""
        top = F.when(F.col("lang") == "en", "projects").when(F.col("lang") == "fr", "rules").when(F.col("lang") == "de", "memory").otherwise("other")
        name = F.when(F.col("n_chars") % 10 == 0, "README.md").otherwise(F.concat(F.lit("d-"), "doc_id", F.lit(".md")))
        content = F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("# Note "), "doc_id", F.lit(" #tag-a #tag_b\n\n"), "text")).otherwise(F.col("text"))
        return self.raw("documents").select("doc_id", F.concat_ws("/", top, "source", name).alias("path"), content.alias("content"))

    def chunks(self) -> DataFrame:
        """Outside text chunks: every document under two roots, the second copy later."""
        d = self.raw("documents")
        both = d.withColumn("root", F.explode(F.array(F.lit("a"), F.lit("b"))))
        return both.select(
            F.concat("root", F.lit("-"), "doc_id").alias("chunk_id"), F.concat_ws("/", "root", "source", F.col("doc_id").cast("string")).alias("path"),
            "text", (F.col("doc_id") + F.when(F.col("root") == "b", 1_000_000).otherwise(0)).alias("updated_at"),
        )

    def patches(self) -> DataFrame:
        """Partial updates from the labels: quality sets importance, a toxic text is discarded, then summarised anew."""
        l = self.raw("labels")
        one = l.select(F.col("doc_id").cast("string").alias("id"), F.lit(1).alias("at"), (F.col("quality") * 0.5 + 0.25).alias("importance"),
                       F.when(F.col("toxic") == 1, "discarded").alias("status"), F.lit(None).cast("string").alias("summary"))
        two = l.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"), F.lit(2).alias("at"), F.lit(None).cast("double").alias("importance"),
                                           F.lit(None).cast("string").alias("status"), F.lit("reviewed").alias("summary"))
        return one.unionByName(two)

    # -- knowledge graph ---------------------------------------------------------------------------------

    def entities(self) -> DataFrame:
        """Regions, nations, suppliers and customers as entities."""
        n = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        parts = (
            ("region", "r", "r_regionkey", "r_name", F.lit(0.9)),
            ("nation", "n", "n_nationkey", "n_name", F.lit(0.8)),
            ("supplier", "s", "s_suppkey", "s_name", F.round(F.col("s_acctbal") / 20000, 4)),
            ("customer", "c", "c_custkey", "c_name", F.round(F.col("c_acctbal") / 20000, 4)),
        )
        out = None
        for table, prefix, key, name, weight in parts:
            e = self.raw(table).select(
                n(prefix, key).alias("id"), F.col(name).alias("name"), F.lit(table).alias("type"), weight.alias("importance")
            )
            out = e if out is None else out.unionByName(e)
        return out

    def relations(self) -> DataFrame:
        """part_of, located_in, and orders as ordered_by edges whose order end is not an entity."""
        c = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        nation = self.raw("nation").select(c("n", "n_nationkey").alias("source_id"), c("r", "n_regionkey").alias("target_id"), F.lit("part_of").alias("relation_type"))
        supplier = self.raw("supplier").select(c("s", "s_suppkey").alias("source_id"), c("n", "s_nationkey").alias("target_id"), F.lit("located_in").alias("relation_type"))
        customer = self.raw("customer").select(c("c", "c_custkey").alias("source_id"), c("n", "c_nationkey").alias("target_id"), F.lit("located_in").alias("relation_type"))
        order = self.raw("orders").select(c("o", "o_orderkey").alias("source_id"), c("c", "o_custkey").alias("target_id"), F.lit("ordered_by").alias("relation_type"))
        every = nation.unionByName(supplier).unionByName(customer).unionByName(order)
        return every.withColumn("relation_id", F.concat_ws(">", "source_id", "target_id")).withColumn("weight", F.lit(1.0))

    # -- feeds ------------------------------------------------------------------------------------------

    def chat(self) -> DataFrame:
        return self.raw("conversations")

    def feed(self) -> DataFrame:
        return self.raw("events")
