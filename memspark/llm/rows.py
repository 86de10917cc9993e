"""Helpers shared by the operators of this package: Arrow maps that keep a key, and joins with keys that may be hot."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm.vocab import slices
from memspark.session import _ensure_checkpoint_dir, materialize

#: Bytes of an Arrow batch that goes to Python; texts are taken up a few MB at a time anyway (``vocab.slices``).
BATCH_BYTES = 8 << 20
#: Bytes of a Parquet row group of a written table.
ROW_GROUP_BYTES = 32 << 20
#: A key with at least this many rows may be hot; see ``attach``.
HOT_ROWS = 2_000
#: Rows of keys or links, as many as a part of a small table should hold; it has a part for each of these, or two for each core.
PART_ROWS = 20_000
#: Rows of keys or links up to which they are broadcast, not dealt out to parts that would hold a few each.
FEW_ROWS = 100_000
#: At most so many keys can each hold more than one part in this many of all rows.
HOT_PARTS = 10_000


def map_text(df: DataFrame, key: str, text: str, fields: str, work: Callable[[], Callable[[pa.Array], dict]]) -> DataFrame:
    """``key`` and what ``work`` makes of ``text`` (null: the empty text), without a shuffle.

    ``work()`` runs once in each task and returns a function from an Arrow array of texts to a dictionary of equally
    long lists or arrays, one for each of ``fields`` (a DDL string). It gets a few MB at a time, or one longer text, so
    memory follows the longest text, not the partition.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *T._parse_datatype_string(fields).fields])
    names = [f.name for f in schema.fields[1:]]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = work()
        for batch in batches:
            done = 0
            for part in slices(batch.column(1)):
                made = fn(part)
                columns = [x if isinstance(x := made[n], pa.Array) else pa.array(x, t) for n, t in zip(names, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), *columns], names=[key, *names])
                done += len(part)
        fn = batch = part = made = columns = None  # noqa: F841
        tidy()

    return light(df.select(F.col(key), whole(text).alias(text))).mapInArrow(run, schema)


def tidy() -> None:
    """Give memory that finished work has freed back to the system; a worker that waits for its next task keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def light(df: DataFrame) -> DataFrame:
    """``df``, its session set to send Python batches of about ``BATCH_BYTES``, so that few bytes of text wait on either side."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def attach(rows: DataFrame, facts: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner-joined with ``facts`` (one row for each ``key``, ``size`` being its number of rows) without a hot task.

    A key is hot if it has more than one in ``HOT_PARTS`` of the ``total`` rows, and ``HOT_ROWS`` at least. So
    there are at most ``HOT_PARTS`` hot keys, whatever the input: those facts are broadcast. The other keys,
    each with a small share of the rows, meet their facts by a shuffle. Keys compare null-safe.
    """
    bound = max(HOT_ROWS, total // HOT_PARTS)
    hot = facts.filter(F.col(size) >= bound)
    cold = facts.filter(F.col(size) < bound)
    return same(rows, hot, key, broadcast=True).unionByName(same(rows, cold, key))


def same(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """An equality join on ``key`` where nulls are equal; the key columns of the left side stay."""
    other = right.select(*[F.col(k).alias(f"__{k}") if k in key else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    return left.join(F.broadcast(other) if broadcast else other, on, how).drop(*[f"__{k}" for k in key])


def whole(text: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder that the session names in ``spark.checkpoint.dir``, and read again."""
    _ensure_checkpoint_dir(df.sparkSession)
    place = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    # Small row groups: a writer holds one in memory.
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(place)
    return df.sparkSession.read.parquet(place)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut."""
    return materialize(df)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` short rows (keys, prints, links), in no more parts than those fill.

    Each part of a table costs a task, its files and its lines in the event log, however small; a loop over small tables pays
    that in each round. Parts are put together without a shuffle, and never fewer than keep all cores busy.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // PART_ROWS)))


def lookup(df: DataFrame, rows: int) -> DataFrame:
    """``df``, the right side of a join, of at most ``rows`` short rows: broadcast if they are few."""
    return F.broadcast(df) if rows <= FEW_ROWS else df
