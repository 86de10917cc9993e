"""Order-dependent grouping without sequential loops: tag clusters and near-duplicate removal.

Both keep the rows that a first-come walk would keep. That set is unique, so it can be found in rounds. A round settles
all rows that no earlier undecided row can affect, or, where that is few of them (long chains), the earliest undecided rows
are walked in one task, as many as a task may hold; what their seeds reach leaves, and the next prefix follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.operators import similarity as si
from memspark.operators.ordered import join_hot
from memspark.operators.similarity import DIGITS
from memspark.session import materialize, small_enough

BROADCAST_ROWS = 200_000
#: Rows with tags, and their tags, that one task walks at most (some 100 MB); vectors of a prefix, at first and at most.
WALK_TAGS = 1_000_000
SWEEP, MOST_SWEEP = 2048, 8192


def _by_tag(rows: DataFrame, per_tag: DataFrame, small: bool) -> DataFrame:
    """Join tag rows with one row per tag; a tag may be on a large share of the rows."""
    if small:
        return rows.join(F.broadcast(per_tag), "tag")
    return join_hot(rows, per_tag, ["tag"], F.col("ord"))


def star_clusters(rows: DataFrame, id_col: str = "id", tags_col: str = "tags", order_col: str = "ord") -> DataFrame:
    """(id, ord, seed): every row joins the first earlier seed it shares a tag with, else it becomes a seed.

    ``order_col`` is a unique integer; ``seed`` is the order value of the cluster's first row. Membership is by
    shared tag with the seed only. Per round and tag one minimum is taken, so a tag on many rows costs no pairs.
    """
    base = materialize(rows.select(F.col(id_col).alias("id"), F.col(order_col).cast("bigint").alias("ord"),
                                   F.array_distinct(F.coalesce(tags_col, F.array().cast("array<string>"))).alias("tags")))
    tagged = materialize(base.filter(F.size("tags") > 0).select("id", "ord", F.explode("tags").alias("tag")))
    todo, seeds = tagged, None
    few_tags = small_enough(tagged.select("tag").distinct(), BROADCAST_ROWS)
    left = todo.select("ord").distinct().count()
    walks, size = False, WALK_TAGS // 64
    while left:
        if walks:
            heads = _walk(todo, size)
            size = min(2 * size, WALK_TAGS)
        else:
            first = todo.groupBy("tag").agg(F.min("ord").alias("first"))
            # A row that comes first under each of its tags has no earlier undecided neighbour.
            heads = _by_tag(todo, first, few_tags).groupBy("ord").agg(F.max(F.col("first") < F.col("ord")).alias("blocked"))
            heads = heads.filter(~F.col("blocked")).select(F.col("ord").alias("seed"))
        # Seeds never share a tag, so this has one row per tag.
        seed_tags = materialize(todo.join(heads, todo["ord"] == heads["seed"]).select("tag", "seed"))
        seeds = seed_tags if seeds is None else seeds.unionByName(seed_tags)
        near = _by_tag(todo, seed_tags, few_tags).select("ord").distinct()
        todo = materialize(todo.join(near, "ord", "left_anti"))
        before, left = left, todo.select("ord").distinct().count()
        # Whichever settles more is used: a round, or a prefix that doubles.
        walks = left > before * 0.75
    done = base.filter(F.size("tags") == 0).select("id", "ord", F.col("ord").alias("seed"))
    if seeds is None:
        return done
    return done.unionByName(_by_tag(tagged, seeds, few_tags).groupBy("id", "ord").agg(F.min("seed").alias("seed")))


def _walk(tagged: DataFrame, size: int) -> DataFrame:
    """(seed) of the plain walk over the earliest rows that have about ``size`` tags in all; one task, bounded by ``size``."""
    head = tagged.orderBy("ord", "tag").limit(size + 1)
    # The last row of the prefix may be cut: it waits, unless it is the only one.
    edge = head.agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n")).first()
    cut = edge["n"] > size and edge["low"] < edge["high"]
    rows = (tagged.filter(F.col("ord") < edge["high"]) if cut else tagged.filter(F.col("ord") <= edge["high"])).groupBy("ord").agg(F.collect_list("tag").alias("tags"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[str] = set()
        for pdf in batches:
            found = []
            for order, tags in zip(pdf["ord"], pdf["tags"], strict=True):
                if taken.isdisjoint(tags):
                    taken.update(tags)
                    found.append(order)
            yield pd.DataFrame({"seed": pd.Series(found, dtype="int64")})

    return rows.repartition(1).sortWithinPartitions("ord").mapInPandas(walk, "seed long")


def dedupe_vectors(rows: DataFrame, order_col: str = "ord", threshold: float = 0.9, sweep: int = SWEEP) -> DataFrame:
    """Ids kept when a row is dropped if it lies within ``threshold`` of an earlier kept row.

    Rows need id, embedding and a unique integer order. Rows without a vector, or with a zero one, are always kept.
    Equal vectors collapse to the first. The earliest ``sweep`` rows are walked in one task, everything near the rows they
    leave is removed, and the next ones follow: twice as many, up to ``MOST_SWEEP``, where little was removed. So each pair
    of a kept row and a later row is multiplied once, whatever chains there are, and the number of rounds follows the rows
    that are kept. Vectors are written once, packed into blocks in their order. The driver holds one bit a row, which says
    what is still open, and of a round the packed vectors of the rows that are kept, at most ``MOST_SWEEP``.
    """
    r = rows.select("id", F.col(order_col).cast("bigint").alias("ord"), "embedding")
    coded = materialize(si._coded(r))
    kept = r.select("id", "ord").join(coded.select("ord"), "ord", "left_anti").select("id")
    first = coded.groupBy(F.sha2("_vector", 256).alias("_print")).agg(F.min("ord").alias("ord"))
    blocks = _in_order(coded.join(first.select("ord"), "ord", "left_semi"))
    sizes = sorted(tuple(x) for x in blocks.select("first", F.size("ids")).collect())
    open_ = {at: np.ones(n, dtype=bool) for at, n in sizes}
    stays = {at: np.zeros(n, dtype=bool) for at, n in sizes}
    left = sum(n for _, n in sizes)
    while left:
        head, wanted = {}, sweep
        for at, _ in sizes:
            some = np.flatnonzero(open_[at])[:wanted]
            if len(some):
                head[at], wanted = some, wanted - len(some)
            if not wanted:
                break
        last = max(head)
        found = _leaders(blocks.filter(F.col("first").between(min(head), last)), head, threshold)
        for at, some in head.items():
            open_[at][some] = False
        for at, i in zip(found["at"], found["place"], strict=True):
            stays[at][i] = True
        rest = {at: np.packbits(flags) for at, flags in open_.items() if flags.any()}
        if rest:
            for at, gone in _near(blocks.filter(F.col("first") >= min(rest)), rest, found, threshold):
                open_[at] &= ~np.unpackbits(np.frombuffer(gone, np.uint8), count=len(open_[at])).astype(bool)
        before, left = left, sum(int(x.sum()) for x in open_.values())
        if left > before / 2:
            sweep = min(2 * sweep, max(sweep, MOST_SWEEP))
    flags = rows.sparkSession.sparkContext.broadcast({at: np.packbits(x) for at, x in stays.items()})
    schema = T.StructType([rows.schema["id"]])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = batch.column("ids")[i].values
                stay = np.unpackbits(flags.value[batch.column("first")[i].as_py()], count=len(ids)).astype(bool)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(stay))], names=["id"])

    return kept.unionByName(blocks.select("first", "ids").mapInArrow(chosen, schema))


def _in_order(coded: DataFrame) -> DataFrame:
    """(first, ids, width, vectors): coded rows as blocks of ``BLOCK_ROWS`` or fewer, each a stretch of the order that begins at ``first``."""
    size, n = si.BLOCK_ROWS, coded.count()
    names = ["first", "ids", "width", "vectors"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            m = si._joined(table)
            row = [table.column("ord").slice(0, 1).combine_chunks(), pa.array([table.column("id").to_pylist()], pa.list_(table.schema.field("id").type)),
                   pa.array([m.shape[1]], pa.int32()), pa.array([pa.compress(np.ascontiguousarray(m), codec="zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=names)

        waiting = None
        for batch in batches:
            waiting = pa.Table.from_batches([batch] if waiting is None else [*waiting.to_batches(), batch])
            while len(waiting) >= size:
                yield block(waiting.slice(0, size))
                waiting = waiting.slice(size)
        if waiting is not None and len(waiting):
            yield block(waiting)

    parts = max(1, -(-n // size))
    rows = coded.select("ord", "id", "_width", "_vector").repartitionByRange(parts, "ord").sortWithinPartitions("ord")
    kind = coded.schema["id"].dataType.simpleString()
    # Dealt anew, so that the blocks of a late round are spread over the tasks too.
    return materialize(rows.mapInArrow(pack, f"first long, ids array<{kind}>, width int, vectors binary").repartition(min(parts, 4 * coded.sparkSession.sparkContext.defaultParallelism)))


def _unpacked(batch: pa.RecordBatch, i: int) -> np.ndarray:
    n, width = len(batch.column("ids")[i]), batch.column("width")[i].as_py()
    return np.frombuffer(pa.decompress(batch.column("vectors")[i].as_py(), n * width * 8, codec="zstd")).reshape(n, width)


def _hits(a: np.ndarray, b: np.ndarray, threshold: float, rough: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which rows of ``a`` and ``b`` are within the threshold: by single precision (``rough``), in double where that doesn't settle it."""
    slack = 2.0**-23 * (a.shape[1] + 8) + 10.0**-DIGITS
    sims = rough[0] @ rough[1].T
    hit = sims >= np.float32(threshold + slack)
    i, j = np.nonzero((sims >= np.float32(threshold - slack)) & ~hit)
    for c in range(0, len(i), 4096):
        x, y = i[c : c + 4096], j[c : c + 4096]
        hit[x, y] = np.round(np.einsum("ij,ij->i", a[x], b[y]), DIGITS) >= threshold
    return hit


def _leaders(blocks: DataFrame, head: dict, threshold: float) -> dict:
    """Of the rows of a prefix of bounded size (``head``: places by block) those that the plain walk keeps: at, place, width, vectors (packed)."""
    shared = blocks.sparkSession.sparkContext.broadcast(head)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = {}
        for batch in batches:
            for i in range(batch.num_rows):
                if (at := batch.column("first")[i].as_py()) in shared.value:
                    parts[at] = _unpacked(batch, i)[shared.value[at]]
        order = sorted(parts)
        m = np.concatenate([parts[at] for at in order])
        at, place = np.concatenate([np.full(len(parts[x]), x) for x in order]), np.concatenate([shared.value[x] for x in order])
        parts = None
        f = m.astype(np.float32)
        stays = np.zeros(len(m), dtype=bool)
        for start in range(0, len(m), 512):
            own, part = m[start : start + 512], f[start : start + 512]
            free = np.ones(len(own), dtype=bool)
            for low in range(0, start, 2048):
                some = low + np.flatnonzero(stays[low : min(start, low + 2048)])
                look = np.flatnonzero(free)
                free[look] = ~_hits(own[look], m[some], threshold, (part[look], f[some])).any(axis=1)
            inside = _hits(own, own, threshold, (part, part))
            for i in np.flatnonzero(free).tolist():
                if not (inside[i, :i] & stays[start : start + i]).any():
                    stays[start + i] = True
        packed = pa.compress(np.ascontiguousarray(m[stays]), codec="zstd", asbytes=True)
        columns = [pa.array([at[stays].tolist()], pa.list_(pa.int64())), pa.array([place[stays].tolist()], pa.list_(pa.int64())),
                   pa.array([m.shape[1]], pa.int32()), pa.array([packed], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "place", "width", "vectors"])

    out = blocks.repartition(1).mapInArrow(walk, "at array<long>, place array<long>, width int, vectors binary").first().asDict()
    shared.unpersist()
    return out


def _near(blocks: DataFrame, open_: dict, leaders: dict, threshold: float) -> list[tuple[int, bytes]]:
    """(first, gone): by block the bits of the open rows that are within the threshold of a leader, all of which come before them."""
    shared = blocks.sparkSession.sparkContext.broadcast((open_, len(leaders["at"]), leaders["width"], bytes(leaders["vectors"])))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, n, width, packed = shared.value
        b = f = None
        for batch in batches:
            for i in range(batch.num_rows):
                at, rows = batch.column("first")[i].as_py(), len(batch.column("ids")[i])
                if at not in flags:
                    continue
                if b is None:
                    b = np.frombuffer(pa.decompress(packed, n * width * 8, codec="zstd")).reshape(n, width)
                    f = b.astype(np.float32)
                todo = np.flatnonzero(np.unpackbits(flags[at], count=rows))
                m = _unpacked(batch, i)
                gone = np.zeros(rows, dtype=np.uint8)
                for low in range(0, len(todo), si.STRIPE):
                    mine = todo[low : low + si.STRIPE]
                    for c in range(0, n, 2048):
                        a = m[mine]
                        hit = _hits(a, b[c : c + 2048], threshold, (a.astype(np.float32), f[c : c + 2048])).any(axis=1)
                        gone[mine[hit]], mine = 1, mine[~hit]
                        if not len(mine):
                            break
                if gone.any():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(gone).tobytes()], pa.binary())], names=["first", "gone"])

    out = [(x["first"], bytes(x["gone"])) for x in blocks.mapInArrow(look, "first long, gone binary").collect()]
    shared.unpersist()
    return out
