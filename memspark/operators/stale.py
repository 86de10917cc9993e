"""Older rows that a newer, very similar row of the same scope has overtaken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as tx
from memspark.functions.time import micros
from memspark.operators import filters as fl
from memspark.operators.similarity import knn_within
from memspark.session import materialize

STALE_DISTANCE = 0.25
STALE_TAG = "stale"


def flag_stale(memories: DataFrame, k: int = 5, max_distance: float = STALE_DISTANCE) -> tuple[DataFrame, DataFrame]:
    """(memories with the tag, conflicts). Each active row is compared with the ``k - 1`` nearest earlier rows of its
    user, agent and type; the first newer row to overtake an old one is recorded. Equal texts do not count."""
    m = fl.active(memories).withColumn("_t", micros(F.col("created_at")))
    # The best of those near enough are the best, as far as they are near enough; the last digit is settled below.
    near = knn_within(m, k - 1, scope=["user_id", "agent_id", "type"], earlier_by="_t", min_similarity=1 - max_distance - 1e-8)
    close = near.withColumn("distance", 1 - F.col("similarity")).filter(F.round("distance", 9) <= max_distance)
    new = m.select("id", "user_id", "agent_id", "type", "_t", F.sha2(tx.strip(F.col("content")), 256).alias("_new"))
    old = m.select(F.col("id").alias("neighbour"), F.sha2(tx.strip(F.col("content")), 256).alias("_old"),
                   F.array_contains("tags", STALE_TAG).alias("_done"))
    pairs = close.join(new, "id").join(old, "neighbour").filter((F.col("_new") != F.col("_old")) & ~F.col("_done"))
    first = pairs.groupBy("neighbour").agg(
        F.min_by(F.struct("id", "distance", "user_id", "agent_id", "type", "_t"), F.struct("_t", "id")).alias("c")
    )
    conflicts = materialize(
        first.select(
            F.col("neighbour").alias("old_memory_id"), F.col("c.id").alias("new_memory_id"), "c.distance", "c.user_id", "c.agent_id",
            "c.type", F.timestamp_micros("c._t").cast("timestamp_ntz").alias("created_at"),
        )
    )
    marked = memories.join(conflicts.select(F.col("old_memory_id").alias("id"), F.lit(True).alias("_stale")), "id", "left")
    tags = F.when(F.col("_stale"), F.concat("tags", F.array(F.lit(STALE_TAG)))).otherwise(F.col("tags"))
    return marked.withColumn("tags", tags).drop("_stale"), conflicts
