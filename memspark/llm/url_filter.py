"""URL filtering by rules and, where none fits, by a tree of path templates with smoothed purity. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.rows import attach, kept

#: (host, path, verdict) of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Levels of a template; what lies deeper is one tail of the template.
LEVELS = 4
#: Children of a node from which it can be variable, and the share of a variable node's pages that keeps a child literal.
MANY, LITERAL_SHARE = 20, 0.05
#: Pages by which a parent's rate counts when a child's is smoothed; deviations within which branches are alike.
PRIOR, ALIKE = 8.0, 1.96
#: What is taken for the share of blocked pages before any label is seen; below the bar, so that no single label blocks all.
USUAL = 0.25
#: Smoothed share of blocked pages from which a template is rejected.
IMPURE = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple[Column, Column]:
    """(host, path) of a URL column: the host in lower case, from the first :// to /, ?, # or the end; the path to ? or #."""
    text = F.col(url).cast("string")
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does. Of equally long ones the first in order."""
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def fits(r: tuple[str, str, str]) -> Column:
        return ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])

    made = [F.when(fits(r), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))) for r in longest]
    return F.coalesce(*made) if made else F.lit(None).cast("struct<rule:string,verdict:string>")


def shape(segment: Column) -> Column:
    """A segment with its variable part as a wildcard: numbers, dates, identifiers, long slugs. The suffix stays."""
    suffix = F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(suffix))
    variable = (
        stem.rlike(r"^[0-9][0-9_.,:-]*$")
        | stem.rlike(r"^[0-9A-Fa-f-]{8,}$") & stem.rlike("[0-9]")
        | stem.rlike(r"^[A-Za-z_-]{1,4}[0-9]{2,}$")
        | stem.rlike(r"[0-9]{4,}")
        | (F.length(stem) > 30)
    )
    return F.when(variable, F.concat(F.lit("*"), suffix)).otherwise(segment)


def _levels(path: Column) -> list[Column]:
    """The first segments' shapes (null past the end) and whether there are more: no path makes a longer template."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    each = [shape(F.get(segments, F.lit(i))) for i in range(LEVELS)]
    return [*each, F.when(F.size(segments) > LEVELS, "**")]


def template_tree(rows: DataFrame) -> DataFrame:
    """Templates of pages (host, s0..s3, tail, blocked, allowed) with their purity.

    Pages are counted by lexical template first, so the tree is built on templates only, however many pages a host has.
    Level by level, a node with many children, most of which are rare, is variable: its rare children become one
    wildcard. Rates of blocked pages are smoothed from the whole to the host and down the levels, each by its parent's
    rate. Siblings whose rates lie on one side of their parent's are pooled, and a branch that does not differ significantly
    from its pool is merged with it: it takes the pool's rate where that differs from the parent's, else the parent's.
    """
    lexical = ["host", *[f"s{i}" for i in range(LEVELS)], "tail"]
    counted = [F.count("*").alias("pages"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed")]
    tree = kept(rows.groupBy(*lexical).agg(*counted))
    total = tree.count()
    level_keys = ["host"]
    for i in range(LEVELS):
        child = tree.groupBy(*level_keys, f"s{i}").agg(F.sum("pages").alias("own"), F.count("*").alias("rows"))
        node = child.filter(F.col(f"s{i}").isNotNull()).groupBy(*level_keys).agg(F.count("*").alias("kids"), F.sum("own").alias("all"), F.sum("rows").alias("node_rows"))
        variable = F.col("kids") >= MANY
        node = node.filter(variable).select(*level_keys, "all", "node_rows")
        tree = tree.withColumn(f"g{i}", F.col(f"s{i}"))
        if not node.isEmpty():  # else nothing is variable at this level
            facts = child.join(node, level_keys).filter(F.col(f"s{i}").isNotNull() & (F.col("own") < F.col("all") * LITERAL_SHARE))
            rare = attach(tree, kept(facts.select(*level_keys, f"s{i}", "rows")), [*level_keys, f"s{i}"], "rows", total)
            rare = kept(rare.withColumn(f"g{i}", F.lit("*")).drop("rows"))
            plain = kept(facts.select(*level_keys, f"s{i}"))
            tree = kept(_without(tree, plain, [*level_keys, f"s{i}"]).unionByName(rare))
        level_keys = [*level_keys, f"g{i}"]
    return _purity(tree, total)


def _without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    other = keys.select(*[F.col(k).alias(f"__{k}") for k in on])
    return rows.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in on]), "left_anti")


def _far(blocked: Column, n: Column, rate: Column) -> Column:
    """Whether so many blocked of ``n`` pages differ significantly from a rate."""
    return F.abs(blocked - n * rate) / F.sqrt(F.greatest(n * rate * (1 - rate), F.lit(1e-9))) > ALIKE


def _purity(tree: DataFrame, total: int) -> DataFrame:
    """``tree`` with rate, the smoothed share of blocked pages of each row's template."""
    whole = tree.agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).first()
    b, a = whole["b"] or 0, whole["a"] or 0
    tree = tree.withColumn("rate", F.lit((b + PRIOR / 2 * USUAL) / (a + b + PRIOR / 2)))
    keys: list[str] = []
    for key in ["host", *[f"g{i}" for i in range(LEVELS)], "tail"]:
        keys = [*keys, key]
        node = tree.groupBy(*keys).agg(F.sum("blocked").alias("nb"), F.sum("allowed").alias("na"), F.max("rate").alias("above"), F.count("*").alias("node_rows"))
        n, p = F.col("nb") + F.col("na"), F.col("above")
        side = F.when(n == 0, 0).when(F.col("nb") > n * p, 1).otherwise(-1)
        node = kept(node.withColumn("side", side).withColumn("top", F.lit(0)))
        pool_keys = ["top", *keys[:-1], "side"]
        pool = kept(node.groupBy(*pool_keys).agg(F.sum("nb").alias("pb"), F.sum(n).alias("pn"), F.count("*").alias("kids"), F.max("above").alias("pa")))
        pooled = F.when(_far(F.col("pb"), F.col("pn"), F.col("pa")), (F.col("pb") + PRIOR * F.col("pa")) / (F.col("pn") + PRIOR)).otherwise(F.col("pa"))
        node = attach(node, kept(pool.select(*pool_keys, "kids", pooled.alias("pooled"))), pool_keys, "kids", total)
        smoothed = (F.col("nb") + PRIOR * p) / (n + PRIOR)
        rate = F.when(n == 0, p).when(_far(F.col("nb"), n, F.col("pooled")), smoothed).otherwise(F.col("pooled"))
        facts = kept(node.select(*keys, "node_rows", rate.alias("own_rate")))
        tree = kept(attach(tree, facts, keys, "node_rows", total).withColumn("rate", F.col("own_rate")).drop("own_rate", "node_rows"))
    return tree


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per row: ``key``, host, path, rule, verdict, template and purity.

    The longest rule that fits decides; pages that rules decide are the labels of the template tree, and every other page
    is blocked if its template's smoothed share of blocked pages reaches ``IMPURE``. Without any label all are allowed.

    A null URL or one without :// has an empty host and path, no rule, and the verdict of the template without a host.
    Null keys and repeated rows give a row each; an empty table gives an empty one; other columns are not looked at.
    """
    host, path = url_parts(url)
    named = pages.select(F.col(key).alias("__key"), host.alias("host"), path.alias("path"))
    named = named.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    each = _levels(F.col("path"))
    flag = lambda v: F.coalesce((F.col("found.verdict") == v).cast("int"), F.lit(0))
    rows = named.select("*", *[c.alias(f"s{i}") for i, c in enumerate(each[:-1])], each[-1].alias("tail"), flag("block").alias("blocked"), flag("allow").alias("allowed"))
    lexical = ["host", *[f"s{i}" for i in range(LEVELS)], "tail"]
    tree = template_tree(rows)
    template = F.concat(F.col("host"), *[F.coalesce(F.concat(F.lit("/"), F.col(f"g{i}")), F.lit("")) for i in range(LEVELS)], F.coalesce(F.concat(F.lit("/"), F.col("tail")), F.lit("")))
    facts = kept(tree.select(*lexical, "pages", "rate", template.alias("template")))
    out = attach(rows, facts, lexical, "pages", pages.count())
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("rate") >= IMPURE, "block").otherwise("allow"))
    return out.select(F.col("__key").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", F.col("rate").alias("purity"))
