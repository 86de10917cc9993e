"""Queries: mood, preferences and the two graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.time import micros
from memspark.operators import affect as af
from memspark.operators import filters as fl
from memspark.operators import graph as gr
from memspark.operators import profile as pr
from memspark.plans.registry import query
from memspark.plans.views import Tables

# The supplied texts hold almost none of the built-in keywords, so the queries bring their own lists.
WORDS = (
    {
        "tion": {"curiosity": 0.10, "fatigue": 0.03},
        "ment": {"focus": 0.08},
        "eau": {"closeness": 0.12, "worry": -0.04},
        "haha": {"happiness": 0.15},
    },
    {"ess": {"worry": 0.05}, "tion": {"excitement": 0.20}},
)
NOT = ("un ", "the ")
KINDS = {
    "error": {"worry": 0.15, "happiness": -0.10},
    "purchase": {"happiness": 0.15},
    "signup": {"closeness": 0.10},
    "click": {"curiosity": 0.03},
    "view": {"fatigue": 0.02},
}
PREFS = {
    "ing": {"category": "topic", "keywords": ("ing", "und")},
    "ment": {"category": "work_style", "keywords": ("ment",)},
    "eau": {"category": "interest", "keywords": ("eau", "oup")},
    "never": {"category": "value", "keywords": ("zzzzzz",)},
}

LEX = """lexicon(ord, keyword, dim, shift) AS (VALUES (1, 'tion', 'curiosity', 0.10e0), (2, 'tion', 'fatigue', 0.03e0), (3, 'ment', 'focus', 0.08e0),
      (4, 'eau', 'closeness', 0.12e0), (5, 'eau', 'worry', -0.04e0), (6, 'haha', 'happiness', 0.15e0), (7, 'ess', 'worry', 0.05e0), (8, 'tion', 'excitement', 0.20e0)),
    hits AS (SELECT t.key, l.* FROM texts t JOIN lexicon l ON instr(lower(t.body), l.keyword) > 0
      WHERE NOT contains(substr(lower(t.body), greatest(1, instr(lower(t.body), l.keyword) - 24), instr(lower(t.body), l.keyword) - greatest(1, instr(lower(t.body), l.keyword) - 24)), 'un ')
        AND NOT contains(substr(lower(t.body), greatest(1, instr(lower(t.body), l.keyword) - 24), instr(lower(t.body), l.keyword) - greatest(1, instr(lower(t.body), l.keyword) - 24)), 'the '))"""


def six(c: Column | str) -> Column:
    """Six digits, halves up on the binary value: the same arithmetic as in the SQL."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * 1e6 + 0.5) / 1e6


def hits(c: Column) -> Column:
    return af.trigger_hits(c, WORDS, NOT)


@query("e01_trigger_match", f"""WITH texts AS (SELECT doc_id AS key, text AS body FROM documents), {LEX}
    SELECT key AS doc_id, keyword, dim, shift FROM hits""")
def triggers(t: Tables) -> DataFrame:
    found = t.raw("documents").select("doc_id", F.explode(hits(F.col("text"))).alias("h"))
    return found.select("doc_id", "h.keyword", F.explode("h.shifts").alias("s")).select("doc_id", "keyword", "s.dim", "s.shift")


AFFECT_SQL = f"""texts AS (SELECT id AS key, content || chr(10) || summary AS body FROM memories_base), {LEX},
    sums AS (SELECT key, dim, sum(shift ORDER BY ord) AS v, min(ord) AS first FROM hits GROUP BY ALL),
    dom AS (SELECT key, arg_max(dim, (round(abs(v), 9), -first)) AS dominant,
      coalesce(sum(v) FILTER (dim IN ('happiness', 'closeness', 'curiosity', 'excitement')), 0) - coalesce(sum(v) FILTER (dim IN ('worry', 'fatigue')), 0) AS val FROM sums GROUP BY key),
    feel AS (SELECT t.key, coalesce(d.dominant, '') AS dominant, round(greatest(-1, least(1, coalesce(d.val, 0))), 3) AS valence,
      CASE d.dominant WHEN 'happiness' THEN '#F5C542' WHEN 'closeness' THEN '#F2789F' WHEN 'curiosity' THEN '#4FB8AF' WHEN 'excitement' THEN '#F2884B'
        WHEN 'worry' THEN '#E0A64E' WHEN 'fatigue' THEN '#8B8B8B' WHEN 'focus' THEN '#4C6FD4' ELSE '#7C7C88' END AS color FROM texts t LEFT JOIN dom d ON d.key = t.key)"""


@query("e02_affect", f"WITH {AFFECT_SQL} SELECT key AS id, dominant, valence, color FROM feel")
def affect(t: Tables) -> DataFrame:
    m = t.memories_base().withColumn("a", af.affect(F.concat("content", F.lit("\n"), "summary"), WORDS, NOT))
    return m.select("id", F.coalesce("a.dominant", F.lit("")).alias("dominant"), "a.valence", "a.color")


# --- State over time ------------------------------------------------------------------------------------

DIMS = ("happiness", "curiosity", "fatigue", "worry", "closeness", "focus", "excitement")
BASE = "(VALUES ('happiness', 0.6e0), ('curiosity', 0.7e0), ('fatigue', 0.2e0), ('worry', 0.1e0), ('closeness', 0.5e0), ('focus', 0.6e0), ('excitement', 0e0)) b(dim, base)"


def FOLD(events: str, source: str = "ev") -> str:
    """Sequential fold in SQL: ``ev(key, eid, us, ops)`` with ops a list of (dim, shift)."""
    return f"""{events},
    num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, eid) AS rn FROM {source}),
    fold AS (
      SELECT k.key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS last, b.dim, b.base, b.base AS x, CAST(0 AS BIGINT) AS eid FROM (SELECT DISTINCT key FROM num) k CROSS JOIN {BASE}
      UNION ALL
      SELECT f.key, n.rn, CASE WHEN f.last IS NULL OR n.us - f.last >= 3600000 THEN n.us ELSE f.last END, f.dim, f.base,
        list_reduce(list_concat([CASE WHEN f.last IS NULL OR n.us - f.last < 3600000 THEN f.x ELSE f.x + (f.base - f.x) * least(0.5e0 * (n.us - f.last) / 3600e6, 0.5e0) END],
            list_transform(list_filter(n.ops, lambda o: o.dim = f.dim), lambda o: CAST(o.shift AS DOUBLE))), lambda a, s: least(1e0, greatest(0e0, a + s))),
        n.eid
      FROM fold f JOIN num n ON n.key = f.key AND n.rn = f.rn + 1)"""


FEED = """ev AS (SELECT user_id AS key, event_id AS eid, epoch_us(ts) AS us,
      CASE event_type WHEN 'error' THEN [{dim: 'worry', shift: 0.15}, {dim: 'happiness', shift: -0.10}] WHEN 'purchase' THEN [{dim: 'happiness', shift: 0.15}]
        WHEN 'signup' THEN [{dim: 'closeness', shift: 0.10}] WHEN 'click' THEN [{dim: 'curiosity', shift: 0.03}] ELSE [{dim: 'fatigue', shift: 0.02}] END AS ops FROM events)"""


def feed_states(t: Tables) -> DataFrame:
    """Mood of each user of the feed after every event."""
    e = t.feed().select("user_id", "event_id", micros(F.col("ts")).alias("us"), af.steps(af.structural_hits(F.col("event_type"), KINDS)).alias("steps"))
    return af.fold_states(e, ["user_id"], "event_id", "us")


@query("e05_structural_events", f"""WITH RECURSIVE {FOLD(FEED)} SELECT key AS user_id, eid AS event_id, dim, floor(x * 1e6 + 0.5) / 1e6 AS value FROM fold WHERE rn > 0""")
def structural(t: Tables) -> DataFrame:
    s = feed_states(t)
    long = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), six(d).alias("value")) for d in DIMS]))
    return s.select("user_id", "event_id", long.alias("d")).select("user_id", "event_id", "d.dim", "d.value")


CHAT = f"""texts AS (SELECT conv_id * 1000 + turn AS key, text AS body FROM conversations), {LEX},
    ev AS (SELECT CASE WHEN c.conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS key, c.conv_id * 1000 + c.turn AS eid, (c.conv_id * 1000 + c.turn) * 1500000 AS us,
      coalesce((SELECT list({{dim: h.dim, shift: h.shift * (0.5 + least(1, length(c.text) / 1000e0))}} ORDER BY h.ord) FROM hits h WHERE h.key = c.conv_id * 1000 + c.turn), []) AS ops FROM conversations c)"""


def chat_states(t: Tables) -> DataFrame:
    """Mood over two long threads of texts; each text counts by its length."""
    c = t.chat().withColumn("eid", F.col("conv_id") * 1000 + F.col("turn"))
    weight = F.least(F.lit(1.0), F.length("text") / 1000.0)
    e = c.select(
        F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd").alias("key"), "eid", (F.col("eid") * 1_500_000).alias("us"),
        af.steps(hits(F.col("text")), weight).alias("steps"),
    )
    return af.fold_states(e, ["key"], "eid", "us")


@query("e03_state_fold", f"""WITH RECURSIVE {FOLD(CHAT)} SELECT key, eid, dim, floor(x * 1e6 + 0.5) / 1e6 AS value FROM fold WHERE rn > 0""")
def state_fold(t: Tables) -> DataFrame:
    s = chat_states(t)
    long = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), six(d).alias("value")) for d in DIMS]))
    return s.select("key", "eid", long.alias("d")).select("key", "eid", "d.dim", "d.value")


LAST = f"""{FOLD(FEED)}, ends AS (SELECT key, dim, arg_max(x, rn) AS x, max(rn) AS rn FROM fold GROUP BY key, dim),
    wide AS (SELECT key, max(x) FILTER (dim = 'happiness') AS happiness, max(x) FILTER (dim = 'curiosity') AS curiosity, max(x) FILTER (dim = 'fatigue') AS fatigue,
      max(x) FILTER (dim = 'worry') AS worry, max(x) FILTER (dim = 'closeness') AS closeness, max(x) FILTER (dim = 'focus') AS focus FROM ends GROUP BY key)"""
CASCADE = """CASE WHEN closeness > 0.75 AND happiness > 0.6 THEN '依恋' WHEN happiness > 0.75 AND curiosity > 0.6 AND fatigue < 0.3 THEN '雀跃'
      WHEN focus > 0.75 AND fatigue < 0.5 THEN '专注' WHEN fatigue > 0.7 THEN '疲惫' WHEN happiness < 0.35 AND worry > 0.4 THEN '低落' WHEN worry > 0.6 THEN '担忧'
      WHEN curiosity > 0.7 AND worry < 0.3 THEN '好奇' ELSE '平静' END"""


@query("e04_decay_step", f"""WITH RECURSIVE {LAST}, ends_at AS (SELECT key, max(us) AS us FROM num GROUP BY key)
    SELECT w.key AS user_id, floor((worry + (0.1e0 - worry) * least(0.5e0 * (1706659200000000 - us) / 3600e6, 0.5e0)) * 1e6 + 0.5) / 1e6 AS worry,
      floor((happiness + (0.6e0 - happiness) * least(0.5e0 * (1706659200000000 - us) / 3600e6, 0.5e0)) * 1e6 + 0.5) / 1e6 AS happiness FROM wide w JOIN ends_at ON ends_at.key = w.key""")
def decay(t: Tables) -> DataFrame:
    """States as they look at the end of the feed."""
    last = af.last_states(feed_states(t), ["user_id"], "event_id", "us")
    d = af.decayed(last, "us", F.lit(1_706_659_200_000_000))
    return d.select("user_id", six("worry").alias("worry"), six("happiness").alias("happiness"))


@query("e06_named_state", f"WITH RECURSIVE {LAST} SELECT key AS user_id, {CASCADE} AS named_state FROM wide")
def named(t: Tables) -> DataFrame:
    return af.summary(af.last_states(feed_states(t), ["user_id"], "event_id", "us")).select("user_id", "named_state")


SPREAD = "(abs(happiness - 0.6) + abs(curiosity - 0.7) + abs(fatigue - 0.2) + abs(worry - 0.1) + abs(closeness - 0.5) + abs(focus - 0.6)) / 17"


@query("e07_intensity", f"""WITH RECURSIVE {LAST}, n AS (SELECT *, {CASCADE} AS named FROM wide)
    SELECT key AS user_id, floor(1e6 * CASE named WHEN '依恋' THEN closeness WHEN '雀跃' THEN happiness WHEN '专注' THEN focus WHEN '疲惫' THEN fatigue WHEN '低落' THEN worry WHEN '担忧' THEN worry
      WHEN '好奇' THEN curiosity ELSE greatest(0, 1 - {SPREAD} * 2) END + 0.5) / 1e6 AS intensity FROM n""")
def intensity(t: Tables) -> DataFrame:
    s = af.last_states(feed_states(t), ["user_id"], "event_id", "us").withColumn("named_state", af.named_state())
    return s.select("user_id", six(af.intensity(F.col("named_state"), 15)).alias("intensity"))


@query("e09_state_summary", f"""WITH RECURSIVE {LAST}, n AS (SELECT *, {CASCADE} AS named FROM wide)
    SELECT key AS user_id, CASE greatest(happiness, curiosity, fatigue, worry, closeness, focus) WHEN happiness THEN 'happiness' WHEN curiosity THEN 'curiosity' WHEN fatigue THEN 'fatigue'
        WHEN worry THEN 'worry' WHEN closeness THEN 'closeness' ELSE 'focus' END AS primary_emotion,
      CASE named WHEN '依恋' THEN 'attachment' WHEN '雀跃' THEN 'elated' WHEN '专注' THEN 'focused' WHEN '疲惫' THEN 'tired' WHEN '低落' THEN 'low' WHEN '担忧' THEN 'worried' WHEN '好奇' THEN 'curious' ELSE 'calm' END AS named_state_en,
      CASE named WHEN '依恋' THEN '#FF6FA5' WHEN '雀跃' THEN '#FFD166' WHEN '专注' THEN '#4D96FF' WHEN '疲惫' THEN '#8D8D8D' WHEN '低落' THEN '#6C7A89' WHEN '担忧' THEN '#F4A261' WHEN '好奇' THEN '#7EC8E3' ELSE '#8FBF9F' END AS color FROM n""")
def state_summary(t: Tables) -> DataFrame:
    s = af.summary(af.last_states(feed_states(t), ["user_id"], "event_id", "us"))
    return s.select("user_id", "primary_emotion", "named_state_en", "color")


@query("a11_daily_snapshots", f"""WITH RECURSIVE {FOLD(FEED)}, d AS (SELECT f.dim, f.x, CAST(make_timestamp(n.us) AS DATE) AS day, n.us, n.eid FROM fold f JOIN num n ON n.key = f.key AND n.rn = f.rn)
    SELECT CAST(day AS VARCHAR) AS day, floor(arg_max(x, (us, eid)) FILTER (dim = 'worry') * 1e6 + 0.5) / 1e6 AS worry, floor(arg_max(x, (us, eid)) FILTER (dim = 'happiness') * 1e6 + 0.5) / 1e6 AS happiness FROM d GROUP BY day""")
def snapshots(t: Tables) -> DataFrame:
    s = af.daily_snapshots(feed_states(t), "us", "event_id")
    return s.select(F.col("snapshot_date").cast("string").alias("day"), six("worry").alias("worry"), six("happiness").alias("happiness"))


@query("e10_history", f"""WITH RECURSIVE {FOLD(FEED)}, c AS (SELECT key, max(rn) AS n FROM fold GROUP BY key)
    SELECT f.key AS user_id, f.eid AS event_id, CASE WHEN n <= 60 THEN n ELSE 30 + (n - 61) % 31 END AS history_count, floor(max(x) FILTER (dim = 'worry') * 1e6 + 0.5) / 1e6 AS worry
    FROM fold f JOIN c ON c.key = f.key WHERE f.rn > n - 10 AND f.rn > 0 GROUP BY ALL""")
def history(t: Tables) -> DataFrame:
    h = af.history(feed_states(t), ["user_id"], "event_id", "us", shown=10, keep=30, cap=60)
    return h.select("user_id", "event_id", "history_count", six("worry").alias("worry"))


@query("a10_dominant_triggers", f"""WITH texts AS (SELECT doc_id AS key, text AS body FROM documents), {LEX}
    SELECT keyword, c AS count, row_number() OVER (ORDER BY c DESC, keyword) AS rank FROM (SELECT keyword, count(*) AS c FROM (SELECT DISTINCT key, keyword FROM hits WHERE ord < 7) GROUP BY keyword) ORDER BY rank LIMIT 3""")
def dominant(t: Tables) -> DataFrame:
    return af.dominant_triggers(t.raw("documents"), af.trigger_hits(F.col("text"), WORDS[:1], NOT))


@query("e08_baseline_adjustment", f"""WITH texts AS (SELECT id AS key, summary || ' ' || content AS body FROM memories_base WHERE status = 'active'), {LEX},
    d AS (SELECT dim, sum(shift * (0.5 + importance)) / (SELECT count(*) FROM texts) AS delta FROM hits h JOIN memories_base m ON m.id = h.key WHERE ord < 7 GROUP BY dim)
    SELECT dim, round(delta, 4) AS delta, round(greatest(0, least(1, base + delta * 0.3)), 6) AS baseline FROM d JOIN {BASE} USING (dim)""")
def baseline(t: Tables) -> DataFrame:
    m = fl.active(t.memories_base()).withColumn("body", F.concat("summary", F.lit(" "), "content"))
    b = af.baseline_adjustment(m, af.trigger_hits(F.col("body"), WORDS[:1], NOT), F.col("importance"))
    return b.select("dim", "delta", F.round("baseline", 6).alias("baseline"))


OFFSETS = """texts AS (SELECT conv_id * 1000 + turn AS key, text AS body FROM conversations), {0},
    ev AS (SELECT 'all' AS key, c.conv_id * 1000 + c.turn AS eid, (c.conv_id * 1000 + c.turn) * 1500000 AS us,
      CASE WHEN role = 'assistant' THEN [{{dim: 'focus', shift: 0.3e0}}, {{dim: 'worry', shift: -0.02e0}}]
        ELSE coalesce((SELECT list({{dim: h.dim, shift: h.shift}} ORDER BY h.ord) FROM hits h WHERE h.key = c.conv_id * 1000 + c.turn), []) END AS ops FROM conversations c)""".format(LEX)


@query("e11_outside_offsets", f"WITH RECURSIVE {FOLD(OFFSETS)} SELECT eid, dim, floor(x * 1e6 + 0.5) / 1e6 AS value FROM fold WHERE rn > 0")
def offsets(t: Tables) -> DataFrame:
    """Estimates from outside for the assistant's texts, keywords for all others; one thread for the whole table."""
    given = F.when(F.col("role") == "assistant", F.create_map(F.lit("focus"), F.lit(0.3), F.lit("worry"), F.lit(-0.02), F.lit("unknown"), F.lit(1.0)))
    c = t.chat().withColumn("eid", F.col("conv_id") * 1000 + F.col("turn"))
    e = c.select(F.lit("all").alias("key"), "eid", (F.col("eid") * 1_500_000).alias("us"), af.steps(af.offset_hits(given, hits(F.col("text")))).alias("steps"))
    s = af.fold_states(e, ["key"], "eid", "us")
    long = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), six(d).alias("value")) for d in DIMS]))
    return s.select("eid", long.alias("d")).select("eid", "d.dim", "d.value")


@query("u05_mood_provider", f"""WITH RECURSIVE {LAST}, n AS (SELECT 'u' || key AS user_id, {CASCADE} AS named FROM wide) SELECT q.query_id, coalesce(n.named, '') AS mood FROM queries q LEFT JOIN n USING (user_id)""")
def mood_provider(t: Tables) -> DataFrame:
    """The mood that goes with each request: a state table joined by user."""
    s = af.summary(af.last_states(feed_states(t), ["user_id"], "event_id", "us")).select(F.concat(F.lit("u"), "user_id").alias("user_id"), "named_state")
    return t.queries().join(s, "user_id", "left").select("query_id", F.coalesce("named_state", F.lit("")).alias("mood"))


# --- Preferences ----------------------------------------------------------------------------------------

MENTIONS = """prefs(name, category, kw) AS (VALUES ('ing', 'topic', ['ing', 'und']), ('ment', 'work_style', ['ment']), ('eau', 'interest', ['eau', 'oup']), ('never', 'value', ['zzzzzz'])),
    men AS (SELECT p.name, c.conv_id, c.turn, left(c.text, 20) AS ex FROM conversations c JOIN prefs p ON len(list_filter(p.kw, lambda k: contains(lower(c.text), k))) > 0),
    sc AS (SELECT p.name, p.category, count(m.name) AS mention_count, greatest(0e0, least(0.99e0, 0.3e0 + 0.08e0 * count(m.name)) - 0.01e0 * 30) AS score, max((m.conv_id, m.turn)) AS last FROM prefs p LEFT JOIN men m ON m.name = p.name GROUP BY ALL)"""


@query("a13_preference_scores", f"WITH {MENTIONS} SELECT name, category, mention_count, round(score, 6) AS score, CASE WHEN mention_count > 0 THEN CAST(last[1] AS VARCHAR) || ':' || CAST(last[2] AS VARCHAR) ELSE '' END AS last_seen FROM sc")
def preferences(t: Tables) -> DataFrame:
    p = pr.preferences(t.chat(), "text", ["conv_id", "turn"], PREFS, days=30)
    seen = F.concat_ws(":", F.col("last_seen.conv_id").cast("string"), F.col("last_seen.turn").cast("string"))
    return p.select("name", "category", "mention_count", F.round("score", 6).alias("score"), seen.alias("last_seen"))


@query("a13_preference_examples", f"""WITH {MENTIONS.replace('left(c.text, 20)', 'left(c.text, 120)')}, ch AS (SELECT *, lag(ex) OVER (PARTITION BY name ORDER BY conv_id, turn) AS before FROM men),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY conv_id DESC, turn DESC) AS back FROM ch WHERE ex <> '' AND (before IS NULL OR before <> ex))
    SELECT name, string_agg(ex, ' | ' ORDER BY back DESC) AS examples FROM k WHERE back <= 5 GROUP BY name""")
def examples(t: Tables) -> DataFrame:
    p = pr.preferences(t.chat(), "text", ["conv_id", "turn"], PREFS).filter("examples is not null")
    return p.select("name", F.array_join("examples", " | ").alias("examples"))


@query("a14_preference_summary", f"""WITH {MENTIONS.replace(' - 0.01e0 * 30', '')}
    SELECT category, name, round(score, 2) AS score, mention_count, row_number() OVER (PARTITION BY category ORDER BY score DESC, name) AS place, row_number() OVER (ORDER BY score DESC, name) <= 3 AS is_top FROM sc WHERE score >= 0.3""")
def preference_summary(t: Tables) -> DataFrame:
    return pr.preference_summary(pr.preferences(t.chat(), "text", ["conv_id", "turn"], PREFS))


# --- Graphs ---------------------------------------------------------------------------------------------

SEM = """nd AS (SELECT * FROM memories_base WHERE status = 'active'),
    live AS MATERIALIZED (SELECT CAST(id AS INTEGER) AS n, dim, w FROM memory_vectors WHERE id IN (SELECT id FROM nd)),
    half AS MATERIALIZED (SELECT a.n AS x, b.n AS y, round(sum(a.w * b.w), 9) AS sim FROM live a JOIN live b ON a.dim = b.dim AND a.n < b.n GROUP BY ALL),
    sims AS (SELECT CAST(x AS VARCHAR) AS s, CAST(y AS VARCHAR) AS d, sim FROM half UNION ALL SELECT CAST(y AS VARCHAR), CAST(x AS VARCHAR), sim FROM half),
    rk AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sim DESC, d) AS rank FROM sims),
    sem AS (SELECT least(s, d) AS source, greatest(s, d) AS target, round(max(sim), 4) AS weight FROM rk WHERE rank <= 5 AND sim >= 0.5 GROUP BY 1, 2),
    tmp AS (SELECT older AS source, id AS target FROM (SELECT id, created_at, lag(id) OVER w AS older, lag(created_at) OVER w AS older_at FROM nd WINDOW w AS (PARTITION BY type ORDER BY created_at, id))
      WHERE older IS NOT NULL AND created_at - older_at <= INTERVAL 6 HOUR),
    edges AS (SELECT source, target, weight, 'semantic' AS type FROM sem UNION ALL
      SELECT t.source, t.target, 1e0, 'temporal' FROM tmp t WHERE NOT EXISTS (SELECT 1 FROM sem s WHERE s.source = least(t.source, t.target) AND s.target = greatest(t.source, t.target)))"""


@query("g03_memory_graph", f"WITH {SEM} SELECT * FROM edges")
def memory_graph(t: Tables) -> DataFrame:
    """Edges over all active memories (no cap on the node set)."""
    _, edges, _ = gr.memory_graph(t.with_embedding(t.memories_base()), lexicon=WORDS)
    return edges.select("source", "target", "weight", "type")


@query("a12_graph_counts", f"""WITH {SEM} SELECT count(*) AS edge_count, count(*) FILTER (type = 'semantic') AS semantic_edge_count, count(*) FILTER (type = 'temporal') AS temporal_edge_count, (SELECT count(*) FROM nd) AS node_count FROM edges""")
def graph_counts(t: Tables) -> DataFrame:
    return gr.memory_graph(t.with_embedding(t.memories_base()), lexicon=WORDS)[2]


@query("g03_graph_nodes", f"""WITH {AFFECT_SQL}, p AS (SELECT m.*, replace(trim(CASE WHEN summary <> '' THEN summary ELSE content END, ' ' || chr(10) || chr(9)), chr(10), ' ') AS pv FROM memories_base m WHERE status = 'active')
    SELECT p.id, left(pv, 60) || CASE WHEN length(pv) > 60 THEN '…' ELSE '' END AS label, length(left(pv, 200) || CASE WHEN length(pv) > 200 THEN '…' ELSE '' END) AS preview_length, dominant, valence FROM p JOIN feel f ON f.key = p.id""")
def graph_nodes(t: Tables) -> DataFrame:
    n = gr.node_columns(fl.active(t.memories_base()), WORDS, NOT)
    return n.select("id", "label", F.length("preview").alias("preview_length"), F.coalesce("dominant", F.lit("")).alias("dominant"), "valence")


NAMES = "SELECT query_id, CASE query_id % 4 WHEN 0 THEN 'NATION_' || query_id % 25 WHEN 1 THEN '000' || query_id WHEN 2 THEN 'ASIA' ELSE 'nobody' END AS text FROM queries"


def names(t: Tables) -> DataFrame:
    n = F.col("query_id")
    text = F.when(n % 4 == 0, F.concat(F.lit("NATION_"), n % 25)).when(n % 4 == 1, F.concat(F.lit("000"), n)).when(n % 4 == 2, "asia").otherwise("nobody")
    return t.queries().select("query_id", text.alias("text"))


@query("g01_find_entities", f"""WITH q AS ({NAMES}) SELECT q.query_id, e.id, row_number() OVER (PARTITION BY q.query_id ORDER BY e.importance DESC, e.id) AS rank FROM q JOIN entities e ON e.name ILIKE '%' || q.text || '%'""")
def find(t: Tables) -> DataFrame:
    return gr.find_entities(t.entities(), names(t)).select("query_id", "id", "rank")


@query("g02_best_match_neighbours", f"""WITH q AS ({NAMES}), best AS (SELECT query_id, arg_max(e.id, (e.importance, -CAST(substr(e.id, 2) AS BIGINT))) AS id FROM q JOIN entities e ON e.name ILIKE '%' || q.text || '%' GROUP BY 1),
    nb AS (SELECT source_id AS id, target_id AS neighbour_id, relation_type FROM relations UNION ALL SELECT target_id, source_id, relation_type FROM relations)
    SELECT b.query_id, b.id, count(n.neighbour_id) AS relation_count, min(n.neighbour_id) AS first FROM best b JOIN nb n ON n.id = b.id GROUP BY ALL""")
def best_match(t: Tables) -> DataFrame:
    n = gr.best_match_neighbours(t.entities(), t.relations(), names(t))
    return n.groupBy("query_id", "id").agg(F.count("*").alias("relation_count"), F.min("neighbour_id").alias("first"))


@query("g02_neighbours_by_depth", f"""WITH RECURSIVE q AS ({NAMES}), best AS (SELECT query_id, arg_max(e.id, (e.importance, -CAST(substr(e.id, 2) AS BIGINT))) AS id FROM q JOIN entities e ON e.name ILIKE '%' || q.text || '%' GROUP BY 1),
    nb AS (SELECT source_id AS id, target_id AS next FROM relations UNION SELECT target_id, source_id FROM relations),
    walk AS (SELECT query_id, id, 0 AS depth FROM best UNION SELECT w.query_id, nb.next, w.depth + 1 FROM walk w JOIN nb ON nb.id = w.id WHERE w.depth < 3)
    SELECT query_id, depth, count(*) AS reached, min(id) AS first FROM (SELECT query_id, id, min(depth) AS depth FROM walk GROUP BY ALL) GROUP BY ALL""")
def by_depth(t: Tables) -> DataFrame:
    """How many entities each query's best match reaches in one, two and three steps."""
    best = gr.find_entities(t.entities(), names(t), 1).select("query_id", "id")
    n = gr.neighbours_by_depth(t.entities(), t.relations(), best, 3)
    return n.groupBy("query_id", "depth").agg(F.count("*").alias("reached"), F.min("id").alias("first"))


@query("g04_entity_append", "SELECT id, name, 'concept' AS type, '' AS summary, 0.5e0 AS importance FROM entities UNION ALL SELECT 'p' || p_partkey, p_name, p_type, '', 0.5e0 FROM part")
def append(t: Tables) -> DataFrame:
    part = t.raw("part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))
    plain = t.entities().select("id", "name")
    return gr.new_entities(plain).select("id", "name", "type", "summary", "importance").unionByName(
        gr.new_entities(part).select("id", "name", "type", "summary", "importance")
    )


@query("i25_graph_text", """SELECT 'graph LR' AS line UNION ALL SELECT '    n' || replace(id, '-', '') || '["' || name || '"]' FROM entities
    UNION ALL SELECT '    n' || source_id || ' -->|' || relation_type || '| n' || target_id FROM relations WHERE source_id IN (SELECT id FROM entities) AND target_id IN (SELECT id FROM entities)""")
def graph_text(t: Tables) -> DataFrame:
    return gr.mermaid_lines(t.entities(), t.relations()).select("line")

