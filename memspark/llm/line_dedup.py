"""Removal of lines that many documents share."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.llm.rows import kept, map_text, same, whole
from memspark.llm.vocab import slices
from memspark.session import small_enough

SPACE = b" \t\n\x0b\x0c\r"
#: Hashes of shared lines that are broadcast (16 MB); more of them reach their documents by joins.
BROADCAST_LINES = 2_000_000


def line_hash(line: bytes) -> int | None:
    """The hash of a line's key: ASCII white space stripped, A-Z lower-cased. None for an empty key, which is never shared."""
    key = line.strip(SPACE).lower()
    return xxhash.xxh64_intdigest(key) - (1 << 63) if key else None


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _without(lines: list[bytes], drop: np.ndarray) -> list[bytes]:
    """The lines, by position, whose hash is not among the sorted ``drop``."""
    hashes = [line_hash(x) for x in lines]
    found = np.array([0 if h is None else h for h in hashes], dtype=np.int64)
    at = np.searchsorted(drop, found)
    gone = (at < len(drop)) & (drop[np.minimum(at, max(0, len(drop) - 1))] == found) if len(drop) else np.zeros(len(lines), dtype=bool)
    return [x for x, h, g in zip(lines, hashes, gone.tolist(), strict=True) if h is None or not g]


def shared_lines(docs: DataFrame, key: str, text: str, documents: int) -> DataFrame:
    """(line) hashes of the lines found in at least ``documents`` rows.

    A row's lines are made distinct before they are exploded, and counted by a sum that combines in each task first, so
    neither a long row nor a line that every row has weighs on one task.
    """

    def work():
        return lambda texts: {"lines": [list({h for x in t.split(b"\n") if (h := line_hash(x)) is not None}) for t in _bytes(texts)]}

    lines = map_text(docs, key, text, "lines array<long>", work).select(F.explode("lines").alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("found")).filter(F.col("found") >= documents).select("line")


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = 10, digest: bool = False, keep: tuple[str, ...] = (), broadcast: int = BROADCAST_LINES) -> DataFrame:
    """Per row: ``key``, the ``keep`` columns, n_lines, n_dropped, and kept_text, or with ``digest`` kept_sha256 of it.

    Lines (split at \\n) whose key is found in at least ``documents`` rows go from every row, the others stay in their
    order, joined by \\n. Keys are compared by a 64-bit hash: among n different lines two agree by chance with n * n / 2 ** 65. A row counts as one document, repeated rows as several.

    The text is read twice and never shuffled while at most ``broadcast`` lines are shared: their sorted hashes go to
    every task. Beyond that each row's shared hashes are joined to it by ``key``.

    A null or empty text is one empty line, which stays. A text whose lines all go becomes empty. Null keys give a row
    like any other; an empty table gives an empty one; other columns are not looked at.
    """
    shared = kept(shared_lines(docs, key, text, documents))
    rows = docs.select(F.col(key).alias("__key"), whole(text).alias("__text"), *keep)
    if small_enough(shared, broadcast):
        found = np.sort(np.array(shared.toArrow()["line"].to_numpy(), dtype=np.int64))
        common = docs.sparkSession.sparkContext.broadcast(found)
        rows = rows.withColumn("__shared", F.lit(None).cast("array<long>"))
    else:
        common = None
        own = map_text(rows, "__key", "__text", "lines array<long>", lambda: lambda texts: {"lines": [list({h for x in t.split(b"\n") if (h := line_hash(x)) is not None}) for t in _bytes(texts)]})
        hits = own.select("__key", F.explode("lines").alias("line")).join(shared, "line").groupBy("__key").agg(F.collect_set("line").alias("__shared"))
        rows = same(rows, hits, ["__key"], "left")
    last = "kept_sha256" if digest else "kept_text"
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in (key, *keep)), *T._parse_datatype_string(f"n_lines long, n_dropped long, {last} string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = common.value if common is not None else None
        for batch in batches:
            done = 0
            for part in slices(batch.column(1)):
                n_lines, n_dropped, out = [], [], []
                for t, mine in zip(_bytes(part), batch.column(2).slice(done, len(part)).to_pylist(), strict=True):
                    drop = everywhere if everywhere is not None else np.sort(np.array(mine or (), dtype=np.int64))
                    lines = t.split(b"\n")
                    stay = _without(lines, drop)
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    left = t if len(stay) == len(lines) else b"\n".join(stay)
                    out.append(hashlib.sha256(left).hexdigest() if digest else left.decode())
                own = [batch.column(i).slice(done, len(part)) for i in (0, *range(3, 3 + len(keep)))]
                columns = [*own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(out, pa.string())]
                done += len(part)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select("__key", "__text", "__shared", *keep).mapInArrow(run, schema)
