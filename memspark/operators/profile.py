"""Preferences learned from texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import lexicons as lx
from memspark.operators import filters as fl
from memspark.operators.ordered import with_previous


def mentions(texts: DataFrame, text: str, preferences: Mapping[str, Mapping] = lx.PREFERENCES) -> DataFrame:
    """One row per text and preference with a keyword in it."""
    low = F.lower(F.col(text))
    table = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.lit(p["category"]).alias("category"),
                     F.array(*[F.lit(k) for k in p["keywords"]]).alias("keywords"))
            for n, p in preferences.items()
        ]
    )
    found = F.filter(table, lambda p: F.exists(p["keywords"], lambda k: F.contains(low, k)))
    return texts.withColumn("_p", F.explode(found)).withColumns(
        {"name": F.col("_p.name"), "category": F.col("_p.category")}
    ).drop("_p")


def preferences(
    texts: DataFrame, text: str, order: Sequence[str], table: Mapping[str, Mapping] = lx.PREFERENCES, days: int = 0, examples: int = 5
) -> DataFrame:
    """Score, mention count, last mention and last examples per preference; unmentioned ones keep the start score.

    ``order`` gives the time order of the texts. ``days`` is how many daily decays follow.
    """
    m = mentions(texts, text, table).withColumn("_example", F.substring(text, 1, 120))
    stats = m.groupBy("name").agg(F.count("*").alias("mention_count"), F.max(F.struct(*order)).alias("last_seen"))
    changed = with_previous(m.select("name", *order, "_example"), ["name"], list(order), {"_before": "_example"})
    changed = changed.filter((F.col("_example") != "") & ~F.col("_example").eqNullSafe(F.col("_before")))
    newest = fl.top_per_group(changed, ["name"], [F.col(o).desc() for o in order], examples, "_back")
    shown = newest.groupBy("name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(-F.col("_back"), "_example"))), lambda x: x["_example"]).alias("examples")
    )
    known = texts.sparkSession.createDataFrame([(n, p["category"]) for n, p in table.items()], "name string, category string")
    j = known.join(stats, "name", "left").join(shown, "name", "left")
    count = F.coalesce("mention_count", F.lit(0))
    score = F.least(F.lit(lx.MAX_SCORE), F.lit(lx.INITIAL_SCORE) + lx.BOOST_PER_MENTION * count)
    return j.withColumn("mention_count", count).withColumn(
        "score", F.greatest(F.lit(0.0), score - lx.DECAY_PER_DAY * days)
    )


def preference_summary(prefs: DataFrame, min_score: float = 0.3, top: int = 3) -> DataFrame:
    """Active preferences with their place overall and inside their category; ``is_top`` marks the strongest."""
    from pyspark.sql.window import Window

    # One row per known preference.
    act = prefs.filter(F.col("score") >= min_score)
    order = [F.col("score").desc(), F.col("name")]
    return act.select(
        "category", "name", F.round("score", 2).alias("score"), "mention_count",
        F.row_number().over(Window.partitionBy("category").orderBy(*order)).alias("place"),
        (F.row_number().over(Window.orderBy(*order)) <= top).alias("is_top"),
    )



