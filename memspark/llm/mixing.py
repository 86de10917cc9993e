"""Mixing of sources to target weights by pivotal rounding of copies. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.rows import attach, kept, same
from memspark.operators.ordered import row_numbers
from memspark.session import small_enough

#: Rows that meet in one node of the reduction tree.
FAN = 64
#: A row with a larger share of its source's words is heavy: a source has fewer of them than one over this. They are rounded
#: first, and what that adds or leaves is shared by the others.
HEAVY = 1 / 1536
#: Sources up to this many have their facts broadcast (a few MB); beyond it only large ones do, see ``rows.attach``.
FEW_SOURCES = 50_000
#: Words are parted by ASCII white space.
WORD = "[^ \\t-\\r]+"


def target_words(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``sizes`` (source, source_size, docs) with target: all words shared by weight, none above ``most`` times its source's words.

    Sources are numbered by code point, null last, and weigh ``weights`` in turn. What a bounded source can't take is shared
    by the others, by weight, in rounds of one aggregate until no further one is above its bound.
    """
    number = row_numbers(sizes.withColumn("last", F.col("source").isNull()), [], ["last", "source"], "number")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = kept(number.select(*sizes.columns, weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("bound")))
    total, share, last = rows.agg(F.sum("source_size")).first()[0], 0.0, -1.0
    while share > last:
        above = F.col("bound") < F.col("weight") * share
        got = rows.agg(F.sum(F.when(above, F.col("bound"))).alias("bound"), F.sum(F.when(~above, F.col("weight"))).alias("weight")).first()
        last, share = share, (total - (got["bound"] or 0.0)) / got["weight"] if got["weight"] else share
    return rows.select(*sizes.columns, F.least("bound", F.col("weight") * share).alias("target"))


def _facts(rows: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """``rows`` with the ``facts`` of their source, which has ``docs`` rows."""
    made = same(rows, facts, ["source"], broadcast=True) if small_enough(facts, FEW_SOURCES) else attach(rows, facts, ["source"], "docs", total)
    return made.drop("docs")


def _random(*of: Column) -> Column:
    """A number from 0 up to 1 that depends on the given columns only."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _pivot(seed: str, level: int, held: Column, x: Column, source: Column) -> Column:
    """One step: mass moves between ``held`` and ``x`` until one of them has no fraction. (row that is settled, its copy, row that is held).

    ``mass`` is the words of a row's fraction of a copy. It moves either way, as far as both allow, with the probabilities
    that leave each row's expected copies as they are; the words of both together stay the same.
    """
    room, have = held["size"] - held["mass"], held["mass"]
    x_room, x_have = x["size"] - x["mass"], x["mass"]
    gain, loss = F.least(room, x_have), F.least(have, x_room)
    to_held = _random(F.lit(seed), F.lit(level), source, x["number"]) * (gain + loss) < loss
    full, bare = to_held & (room <= x_have), ~to_held & (have <= x_room)

    def out(settled: Column, copy: int, stays: Column, mass: Column) -> Column:
        return F.struct(settled.withField("copy", F.lit(copy)).alias("settled"), stays.withField("mass", mass).alias("held"))

    return (
        F.when(full, out(held, 1, x, x_have - room))
        .when(bare, out(held, 0, x, x_have + have))
        .when(to_held, out(x, 0, held, have + x_have))
        .otherwise(out(x, 1, held, have - x_room))
    )


def pivotal_rounding(rows: DataFrame, groups: Sequence[str], seed: str) -> DataFrame:
    """``rows`` (``groups``, number, size, mass, key, low) with copy, 0 or 1: fractions rounded so that a group's words stay.

    ``number`` counts the rows of a group. ``FAN`` consecutive ones make a node of a tree: each leaves one row with a
    fraction, and those of ``FAN`` nodes meet on the next level. Only the last row of a group is rounded by itself.
    """
    level, settled = 0, []
    rows = rows.withColumn("copy", F.lit(0))
    own = [c for c in rows.columns if c not in groups]
    first = ["number", *[c for c in own if c != "number"]]
    rows = rows.withColumn("node", F.floor((F.col("number") - 1) / FAN).cast("long"))
    while True:
        node = rows.groupBy(*groups, "node").agg(F.sort_array(F.collect_list(F.struct(*first))).alias("all"))
        kind = node.schema["all"].dataType.simpleString()
        start = F.struct(F.array().cast(kind).alias("settled"), F.col("all")[0].alias("held"))

        def step(acc: Column, x: Column) -> Column:
            made = _pivot(seed, level, acc["held"], x, F.col("of"))  # noqa: B023
            # At most FAN rows are put together here.
            return F.transform(F.array(made), lambda m: F.struct(F.concat(acc["settled"], F.array(m["settled"])).alias("settled"), m["held"].alias("held")))[0]

        folded = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), start, step)
        made = kept(node.withColumn("of", F.struct(*groups)).select(*groups, "node", folded.alias("made")).select(*groups, "node", "made.settled", "made.held"))
        settled.append(made.select(*groups, F.explode("settled").alias("row")).select(*groups, "row.*"))
        left = made.select(*groups, "node", "held.*")
        if made.agg(F.max("node")).first()[0] in (None, 0):
            chance = _random(F.lit(seed), F.lit(-1), F.struct(*groups), F.col("number")) * F.col("size") < F.col("mass")
            settled.append(left.withColumn("copy", chance.cast("int")).drop("node"))
            return reduce(DataFrame.unionByName, settled)
        rows = left.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        level += 1


def heavy_rounding(rows: DataFrame, groups: Sequence[str], most: int, seed: str) -> DataFrame:
    """Per group: ``rows`` (an array of key, size, copies), and what is ``open`` of the target and ``left`` of the words.

    A group's heavy rows, largest first. Each is paired with all that comes after it: the row becomes integral, up or down at
    random by its fraction, and the rest of the source takes the difference, so expected copies stay. Where the rest could
    not make up for one of the two, the other is taken. ``rows`` has source_size, target, key, size and place.
    """
    each = F.struct((-F.col("size")).alias("order"), F.xxhash64("key").alias("hash"), "key", "place", "size")
    node = rows.groupBy(*groups).agg(F.sort_array(F.collect_list(each)).alias("all")).withColumn("of", F.struct(*groups))
    start = F.struct(F.col("target").alias("open"), F.col("source_size").alias("left"), F.array().cast("array<long>").alias("copies"))

    def step(acc: Column, x: Column) -> Column:
        rate = F.least(F.greatest(acc["open"] / acc["left"], F.lit(0.0)), F.lit(float(most)))
        rest = (acc["left"] - x["size"]).cast("double")

        def miss(copies: Column) -> Column:
            """Words by which the rest can't make up for so many copies."""
            after = acc["open"] - copies * x["size"]
            return F.greatest(-after, after - rest * most, F.lit(1e-6))

        low = F.floor(rate).cast("long")
        down, up = miss(low), miss(low + 1)
        lucky = _random(F.lit(seed), F.lit("heavy"), F.col("of"), F.size(acc["copies"])) < rate - low
        copies = F.when(rate <= low, low).when(down < up, low).when(up < down, low + 1).when(lucky, low + 1).otherwise(low)
        settled = F.transform(F.array(copies), lambda c: F.struct((acc["open"] - c * x["size"]).alias("open"), (acc["left"] - x["size"]).alias("left"), F.concat(acc["copies"], F.array(c)).alias("copies")))
        return settled[0]

    folded = node.withColumn("made", F.aggregate("all", start, step))
    pairs = F.zip_with("all", "made.copies", lambda r, c: F.struct(r["key"].alias("key"), r["size"].alias("size"), c.alias("copies")))
    return folded.select(*groups, pairs.alias("rows"), "made.open", "made.left")


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """Per row: ``key``, ``source``, size (words), source_size, target (its source's words), copies and taken (words).

    Every source is to give its ``target_words``; its rows are taken as often as the target is its size, rounded down or
    up, by pivotal rounding. Heavy rows are rounded first, each against the rest of its source. The light ones share what
    is left and are paired in a reduction tree, where words stay and one row of a source is rounded by itself. So a
    source's words miss the target by a part of a light row, or, where a source is of few rows, of one of its smallest. No
    row is taken more than ``most`` times.

    Text is read once and never shuffled. Light rows are numbered by a hash of the key (rows that agree in key and size can
    stand for each other), so runs agree, whatever the partitions. A tree node holds 64 rows, however large a source is; a
    source has fewer than 1536 heavy rows.

    A null, empty or blank text has size 0 and is never taken, nor is one of a source without words. Null sources are the
    last source; null keys and repeated rows are rows of their own; an empty table gives an empty one; other columns are not
    looked at.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = kept(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")).withColumn("place", F.monotonically_increasing_id()))
    sizes = kept(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    total = sizes.agg(F.sum("docs")).first()[0]
    out = [F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")]
    if not total:
        none = rows.withColumn("source_size", F.col("size")).withColumn("target", F.lit(0.0)).withColumn("copies", F.col("size"))
        return none.select(*out)
    facts = kept(target_words(sizes, weights, most))
    groups = ["source", "source_size", "target"]
    rows = _facts(rows, facts, total)
    share = F.col("size") / F.col("source_size")
    heavy = (F.col("size") > 0) & (share > HEAVY)
    made = kept(heavy_rounding(rows.filter(heavy), groups, most, seed))
    first = made.select(*groups, F.explode("rows").alias("row")).select(*groups, "row.*")
    blank = rows.filter("size = 0").select(*groups, "key", "size", F.lit(0).cast("long").alias("copies"))
    state = same(facts, made.select("source", "open", "left"), ["source"], "left")
    open_, left = F.coalesce("open", "target"), F.coalesce("left", "source_size")
    rate = F.when(left > 0, F.least(F.greatest(open_ / left, F.lit(0.0)), F.lit(float(most)))).otherwise(F.lit(0.0))
    light = _facts(rows.filter((F.col("size") > 0) & ~heavy), kept(state.select("source", "docs", rate.alias("rate"))), total)
    low = F.floor("rate").cast("long")
    light = light.select(*groups, "key", "size", "place", low.alias("low"), ((F.col("rate") - low) * F.col("size")).alias("mass"))
    light = kept(row_numbers(light, groups, [F.xxhash64("key"), "key", "size", "place"], "number").drop("place"))
    whole = light.filter("mass <= 0").withColumn("copy", F.lit(0))
    rest = whole.unionByName(pivotal_rounding(light.filter("mass > 0"), groups, seed))
    rest = rest.select(*groups, "key", "size", (F.col("low") + F.col("copy")).alias("copies"))
    return first.unionByName(blank).unionByName(rest).select(*out)
