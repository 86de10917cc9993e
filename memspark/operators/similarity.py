"""Exact nearest neighbours and threshold searches over vectors.

Spark moves blocks of vectors; each task multiplies two blocks and keeps only what the caller asked for
(the best k per row, the earliest match per row, ...). Full pair lists are never written.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.operators.filters import top_per_group
from memspark.operators.ordered import meet
from memspark.operators.pruning import LEAVES, SLACK, Space, fit, sampled
from memspark.session import materialize

# Queries up to this many are sent to every task as one matrix (at 1024 dimensions: 16 MB).
BROADCAST_QUERIES = 2048
# Rows of the corpus that a task holds as a matrix at a time, whatever the batches it is given.
SEARCH_ROWS = 512
# Rows per block when both sides are shuffled.
BLOCK_ROWS = 4096
# Rows beyond which blocks are pruned (64 blocks); with fewer blocks the bounds cost more than they save.
PRUNE_ROWS = 64 * BLOCK_ROWS
DIGITS = 9


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as one matrix of unit vectors; a zero vector stays zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return _unit(m)


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


class _Best:
    """The k smallest (distance, id) per query over the blocks seen so far."""

    def __init__(self, k: int, n_queries: int):
        self.k = k
        self.kept: list[tuple[np.ndarray, np.ndarray]] = [
            (np.zeros(0), np.zeros(0, dtype=object)) for _ in range(n_queries)
        ]
        #: The largest distance kept of each query that has ``k``; nothing beyond it is one of its best.
        self.edges = np.full(n_queries, np.inf)

    def add(self, q: int, dist: np.ndarray, ids: np.ndarray) -> None:
        d0, i0 = self.kept[q]
        if len(dist) > self.k:
            edge = np.partition(dist, self.k - 1)[self.k - 1]
            near = dist <= edge
            dist, ids = dist[near], ids[near]
        d, i = np.concatenate([d0, dist]), np.concatenate([i0, ids])
        order = np.lexsort((i, d))[: self.k]
        self.kept[q] = (d[order], i[order])
        if len(order) == self.k:
            self.edges[q] = d[order[-1]]


def _search_block(best: _Best, qs: pd.DataFrame, qm: np.ndarray, rows: dict[str, np.ndarray], m: np.ndarray) -> None:
    if len(m) == 0:
        return
    dist = np.round(1.0 - m @ qm.T, DIGITS)
    noise = (rows["type"] == "tool_result") & ~(rows["importance"] >= 0.5)
    zero = ~m.any(axis=1)
    asked = list(qs.itertuples(index=False))
    for j in np.flatnonzero((dist <= best.edges).any(axis=0)).tolist():
        q, ok = asked[j], ~zero
        for name in ("user_id", "agent_id", "type"):
            wanted = getattr(q, name)
            if wanted is not None and wanted == wanted:
                ok &= rows[name] == wanted
        if q.exclude_noise and q.type != "tool_result":
            ok &= ~noise
        best.add(j, dist[ok, j], rows["id"][ok])


def _emit(best: _Best, query_ids: list) -> pd.DataFrame:
    counts = [len(d) for d, _ in best.kept]
    ids = np.concatenate([i for _, i in best.kept]) if best.kept else np.zeros(0, dtype=object)
    return pd.DataFrame(
        {
            "query_id": pd.Series(np.repeat(np.asarray(query_ids, dtype=object), counts), dtype=object),
            "id": pd.Series(ids, dtype=object),
            "distance": np.concatenate([d for d, _ in best.kept]) if best.kept else np.zeros(0),
        }
    )


_FILTERS = ("user_id", "agent_id", "type")


def vector_topk(
    corpus: DataFrame, queries: DataFrame, k: int, exclude_noise: bool = True, max_broadcast: int = BROADCAST_QUERIES
) -> DataFrame:
    """The ``k`` rows of ``corpus`` nearest to each query by cosine distance (0..2), exactly.

    ``corpus`` has id, embedding and optionally user_id, agent_id, type, importance. ``queries`` has query_id,
    embedding and optional filters of the same names. Null vectors are skipped on both sides and a zero vector has no
    direction, so it matches nothing. A modest query table travels to the corpus; a larger one is packed into blocks, as
    is the corpus, and these meet in a cartesian product that copies nothing for a pair of blocks.
    """
    # Null vectors are dropped inside the tasks: a filter on a vector that is still to be made would make it twice.
    c = corpus
    for name, kind in (("user_id", "string"), ("agent_id", "string"), ("type", "string"), ("importance", "double")):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    c = c.select("id", "user_id", "agent_id", "type", F.col("importance").cast("double"), "embedding")
    q = queries
    for name in _FILTERS:
        if name not in q.columns:
            q = q.withColumn(name, F.lit(None).cast("string"))
    if "exclude_noise" not in q.columns:
        q = q.withColumn("exclude_noise", F.lit(exclude_noise))
    q = q.select("query_id", *_FILTERS, "exclude_noise", "embedding")
    id_type = q.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, id string, distance double"

    few = q.limit(max_broadcast + 1).toPandas()  # never more than the bound
    if len(few) <= max_broadcast:
        partial = _topk_broadcast(c, few[few["embedding"].notna()], k, schema)
    else:
        partial = _topk_blocks(c, q, k, schema)
    return top_per_group(partial, ["query_id"], [F.col("distance"), F.col("id")], k)


def _rows_of(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    cols = {n: batch.column(n).to_pandas().to_numpy(dtype=object) for n in ("id", *_FILTERS)}
    cols["importance"] = batch.column("importance").to_pandas().to_numpy(dtype=float)
    return cols


def _topk_broadcast(c: DataFrame, pdf: pd.DataFrame, k: int, schema: str) -> DataFrame:
    if pdf.empty:
        return c.sparkSession.createDataFrame([], schema)
    qm = _unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
    meta = pdf.drop(columns="embedding").astype({n: object for n in _FILTERS})
    keep = qm.any(axis=1)
    shared = c.sparkSession.sparkContext.broadcast((meta[keep].reset_index(drop=True), qm[keep]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, m = shared.value
        best = _Best(k, len(qs))
        for batch in batches:
            # A batch may hold many rows, and each stage of the work a copy of its vectors.
            for start in range(0, batch.num_rows, SEARCH_ROWS):
                b = batch.slice(start, SEARCH_ROWS)
                b = b.filter(pc.is_valid(b.column("embedding")))
                _search_block(best, qs, m, _rows_of(b), _matrix(b.column("embedding")))
        out = _emit(best, qs["query_id"].tolist())
        if len(out):
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    return c.mapInArrow(search, schema)


def _topk_blocks(c: DataFrame, q: DataFrame, k: int, schema: str) -> DataFrame:
    left = _bundled(q, "query_id")
    right = _bundled(c, "id")
    asked, count = max(1, left.count()), max(1, right.count())
    # A task gives ``k`` rows a query: no more parts of the corpus than memory or idle cores ask for.
    parts = max(-(-count // RIGHT_BLOCKS), min(count, -(-2 * c.sparkSession.sparkContext.defaultParallelism // asked)))
    left = left.select(*[F.col(n).alias(f"a_{n}") for n in left.columns]).repartition(asked)
    right = right.select(*[F.col(n).alias(f"b_{n}") for n in right.columns]).repartition(parts)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best, meta, qm = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if at != (here := batch.column("a__block")[i].as_py()):
                    if at is not None:
                        yield pa.RecordBatch.from_pandas(_emit(best, meta["query_id"].tolist()), preserve_index=False)
                    at, qm = here, _vectors(batch, i, "a_")
                    meta = pd.DataFrame({n: pd.Series(batch.column(f"a_{n}")[i].as_py(), dtype=object) for n in ("query_id", *_FILTERS, "exclude_noise")})
                    best = _Best(k, len(meta))
                m = _vectors(batch, i, "b_")
                rows = {n: np.array(batch.column(f"b_{n}")[i].as_py(), dtype=object) for n in ("id", *_FILTERS)}
                rows["importance"] = np.array(batch.column("b_importance")[i].as_py(), dtype=float)
                for start in range(0, len(m), SEARCH_ROWS):
                    part = slice(start, start + SEARCH_ROWS)
                    _search_block(best, meta, qm, {n: x[part] for n, x in rows.items()}, m[part])
        if at is not None:
            yield pa.RecordBatch.from_pandas(_emit(best, meta["query_id"].tolist()), preserve_index=False)

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(search, schema)


def _bundled(df: DataFrame, key: str) -> DataFrame:
    """Rows as blocks of some ``BLOCK_ROWS``, one row each: lists of the columns, and the unit vectors compressed."""
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    names = [n for n in df.columns if n != "embedding"]
    shape = ", ".join(["_block long", *[f"{n} array<{df.schema[n].dataType.simpleString()}>" for n in names], "width int, vectors binary"])

    def pack(table: pa.Table) -> pa.Table:
        m = _joined(table)
        row = {"_block": table.column("_block").slice(0, 1), **{n: pa.array([table.column(n).to_pylist()], pa.list_(table.schema.field(n).type)) for n in names}}
        packed = pa.compress(np.ascontiguousarray(m), codec="zstd", asbytes=True)
        return pa.table(row | {"width": pa.array([m.shape[1]], pa.int32()), "vectors": pa.array([packed], pa.binary())})

    rows = _coded(df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")))
    rows = rows.repartition(min(MOST_PARTS, 3 * blocks + 8), "_block").groupBy("_block").applyInArrow(pack, shape)
    return materialize(rows)


def _joined(table: pa.Table) -> np.ndarray:
    """The vectors of coded rows as a matrix."""
    widths = table.column("_width").to_pylist()
    m = np.frombuffer(b"".join([pa.decompress(v.as_buffer(), w * 8, codec="zstd", asbytes=True) for v, w in zip(table.column("_vector"), widths, strict=True)]))
    return m.reshape(len(widths), -1) if widths else np.zeros((0, 0))


def _vectors(batch: pa.RecordBatch, i: int, side: str) -> np.ndarray:
    """The vectors of a bundle; ``side`` is the prefix of its columns."""
    n, width = len(batch.column(f"{side}importance" if side == "b_" else f"{side}query_id")[i]), batch.column(f"{side}width")[i].as_py()
    return np.frombuffer(pa.decompress(batch.column(f"{side}vectors")[i].as_py(), n * width * 8, codec="zstd")).reshape(n, width)


# --- Self-joins on one set of vectors -----------------------------------------------------------------


def knn_within(
    rows: DataFrame,
    k: int,
    scope: list[str] | None = None,
    earlier_by: str | None = None,
    min_similarity: float | None = None,
    block_rows: int = BLOCK_ROWS,
    prune_rows: int = PRUNE_ROWS,
) -> DataFrame:
    """The ``k`` most similar other rows of every row, exactly: (id, neighbour, similarity, rank).

    ``scope`` columns must be equal on both sides. With ``earlier_by`` (an integer column) only rows that come
    before, by (that column, id), are neighbours. Vectors are packed into blocks of ``block_rows`` once; blocks, not
    rows, meet in a cartesian product that reads them where they were written, so nothing is copied for each pair of
    blocks. A task returns only rows that may displace one of the ``k`` found inside the row's own block. Beyond
    ``prune_rows`` rows, blocks hold rows that lie together, and a row is compared with a block only if the block's box
    may hold something better. The result is the same.
    """
    scope = list(scope or [])
    when = (F.col(earlier_by) if earlier_by else F.lit(0)).cast("bigint").alias("_t")
    r = rows
    for c in scope:  # a null is equal to nothing
        r = r.filter(F.col(c).isNotNull())
    key = F.to_json(F.struct(*scope)) if scope else F.lit("")
    # The vectors may be made on the fly: they are not read to count, made once, and never written or dealt out as plain arrays.
    r = r.select(F.col("id").cast("string").alias("id"), when, key.alias("_scope"), "embedding")
    total = r.count()
    sizes = r.groupBy("_scope").agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))
    if total > prune_rows:
        r = _lying_together(r, sizes, total, block_rows)
    else:
        r = meet(r, sizes, ["_scope"], F.col("id")).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")))
        r = _coded(r.select("_scope", F.col("_block").cast("long").alias("_block"), "id", "_t", "embedding"))
    r = r.select("_scope", "_block", "id", "_t", "_x", "_width", "_vector")

    def pack(table: pa.Table) -> pa.Table:
        return _packed(table, k, bool(earlier_by), min_similarity)

    # A stated number of parts: left alone, adaptive execution puts many blocks, small as bytes, into one task.
    r = r.repartition(min(MOST_PARTS, 3 * -(-total // block_rows) + 8), "_scope", "_block")
    blocks = materialize(r.groupBy("_scope", "_block").applyInArrow(pack, _BLOCK_SHAPE))
    near = F.explode(F.arrays_zip(F.col("own_id").alias("id"), F.col("own_neighbour").alias("neighbour"), F.col("own_similarity").alias("similarity")))
    found = blocks.select(near.alias("_n")).select("_n.*")
    many = blocks.groupBy("_scope").count().filter("count > 1").select("_scope")
    shared = meet(blocks.select("_scope", "_block"), many, ["_scope"], F.col("_block")).count()
    if shared:
        found = found.unionByName(_other_blocks(blocks, many, shared, k, bool(earlier_by), min_similarity))
    return top_per_group(found, ["id"], [F.col("similarity").desc(), F.col("neighbour")], k)


def _coded(r: DataFrame, space: Space | None = None) -> DataFrame:
    """``r`` with _width and _vector, the unit vector compressed by itself, for embedding; null and zero vectors leave.

    _x is what the axes of ``space`` show of it, _leaf where its tree puts it; without one they are empty and 0.
    """
    own = [f for f in r.schema.fields if f.name != "embedding"]
    made = T._parse_datatype_string("_x array<float>, _leaf long, _width int, _vector binary").fields
    names = [f.name for f in (*own, *made)]
    shared = r.sparkSession.sparkContext.broadcast(space)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SEARCH_ROWS):
                b = batch.slice(start, SEARCH_ROWS)
                b = b.filter(pc.is_valid(b.column("embedding")))
                m = _matrix(b.column("embedding"))
                live = m.any(axis=1)
                if not live.any():
                    continue
                b, m = b.filter(pa.array(live)), m[live]
                n = len(m)
                x, leaf = shared.value.place(m) if shared.value is not None else (np.zeros((n, 0), np.float32), np.zeros(n, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                vectors = pa.array([pa.compress(v, codec="zstd", asbytes=True) for v in m], pa.binary())
                columns = [*[b.column(f.name) for f in own], lists, pa.array(leaf), pa.array(np.full(n, m.shape[1], np.int32)), vectors]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return r.mapInArrow(code, T.StructType([*own, *made]))


def _lying_together(r: DataFrame, sizes: DataFrame, total: int, block_rows: int) -> DataFrame:
    """Rows, coded, with the block they lie in (_block) and what the principal axes show of them (_x).

    A scope of several blocks is cut where the tree over the axes is cut, only as deep as it has blocks, and what is still
    larger than a block by hash: a small scope gives few blocks, not one for each leaf.
    """
    space = fit(sampled(r.withColumnRenamed("id", "_row"), total), min(LEAVES, -(-total // block_rows)))
    depth = int(np.log2(len(space.axis) + 1))
    seen = meet(materialize(_coded(r, space)), sizes, ["_scope"], F.col("id"))
    down = F.least(F.lit(depth), F.ceil(F.log2("_blocks")))
    seen = seen.withColumn("_node", F.floor(F.col("_leaf") / F.pow(F.lit(2.0), F.lit(depth) - down)))
    parts = seen.groupBy("_scope", "_node").agg(F.ceil(F.count("*") / block_rows).alias("_parts"))
    seen = meet(seen, parts, ["_scope", "_node"], F.col("id"))
    return seen.withColumn("_block", F.col("_node") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("_parts")))


#: Blocks a task of the product holds of the right side (at some 500 bytes a row and 4,096 rows: 64 MB), parts of the left.
RIGHT_BLOCKS, LEFT_PARTS = 32, 128
#: Parts in which rows are packed into blocks, at most.
MOST_PARTS = 2000
#: Rows of a block multiplied at a time.
STRIPE = 1024
_BLOCK_SHAPE = (
    "_scope string, _block long, ids array<string>, times array<long>, first long, last long, width int, vectors binary, seen binary, "
    "floors binary, own_id array<string>, own_neighbour array<string>, own_similarity array<double>"
)


def _packed(table: pa.Table, k: int, earlier: bool, min_similarity: float | None) -> pa.Table:
    """One row for a block: its unit vectors compressed, and the neighbours its rows have inside it."""
    m = _joined(table)
    ids = table.column("id").to_pandas().to_numpy(dtype=object)
    t = table.column("_t").to_numpy()
    x = table.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    floors = np.full(len(ids), -2.0 if min_similarity is None else min_similarity)
    best = _Best(k, len(ids))
    _exact(best, 0, m, t, ids, m, t, ids, floors, earlier)
    kept = best.kept
    for i, (d, _) in enumerate(kept):
        if len(d) == k:
            floors[i] = max(floors[i], -d[-1])
    row = {
        "_scope": table.column("_scope").to_pylist()[:1], "_block": table.column("_block").to_pylist()[:1], "ids": [ids.tolist()],
        "times": [t.tolist()], "first": [int(t.min(initial=np.iinfo(np.int64).max))], "last": [int(t.max(initial=np.iinfo(np.int64).min))],
        "width": [m.shape[1]], "vectors": [pa.compress(np.ascontiguousarray(m), codec="zstd", asbytes=True)], "seen": [x.tobytes()], "floors": [floors.tobytes()],
        "own_id": [np.repeat(ids, [len(d) for d, _ in kept]).tolist()], "own_neighbour": [[n for _, i in kept for n in i]],
        "own_similarity": [[-float(s) for d, _ in kept for s in d]],
    }
    types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(),
             pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64())]
    if not len(ids):
        row = dict.fromkeys(row, [])
    return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(row.items(), types, strict=True)})


def _exact(best: _Best, start: int, am, at, ai, bm, bt, bi, floors: np.ndarray, earlier: bool) -> None:
    """Rows of ``b`` added to the best of the rows ``start``... of ``a``: all products in double precision."""
    code = np.unique(np.concatenate([ai, bi]), return_inverse=True)[1]  # numbers in the order of the ids compare faster
    ac, bc = code[: len(ai)], code[len(ai) :]
    for low in range(0, len(am), STRIPE):
        sims = np.round(am[low : low + STRIPE] @ bm.T, DIGITS)
        for j in range(len(sims)):
            i = low + j
            ok = (sims[j] >= floors[i]) & (bc != ac[i])
            if earlier:
                ok &= (bt < at[i]) | ((bt == at[i]) & (bc < ac[i]))
            if ok.any():
                best.add(start + i, -sims[j][ok], bi[ok])


class _Block:
    """A block as it comes from the product; ``side`` is the prefix of its columns. Vectors are unpacked when asked for."""

    def __init__(self, batch: pa.RecordBatch, i: int, side: str):
        row = {n: batch.column(f"{side}{n}")[i] for n in ("ids", "times", "width", "vectors", "seen")}
        self.ids = row["ids"].values.to_pandas().to_numpy(dtype=object)
        self.t = row["times"].values.to_numpy(zero_copy_only=False)
        self.width, self.packed = row["width"].as_py(), row["vectors"].as_py()
        self.x = np.frombuffer(row["seen"].as_py(), dtype=np.float32).reshape(len(self.ids), -1)

    @cached_property
    def m(self) -> np.ndarray:
        n = len(self.ids)
        return np.frombuffer(pa.decompress(self.packed, n * self.width * 8, codec="zstd"), dtype=np.float64).reshape(n, self.width)

    @cached_property
    def rough(self) -> np.ndarray:
        return self.m.astype(np.float32)


def _search_other(a: _Block, b: _Block, best: _Best, floors: np.ndarray, k: int, earlier: bool) -> None:
    """What ``b`` holds for the rows of ``a`` at or above their floors, which rise with it.

    Products are first taken in single precision; those not surely below the floor are taken again in double.
    """
    look = np.arange(len(a.ids))
    if a.x.shape[1]:
        v, lo, hi = a.x.astype(np.float64), b.x.min(axis=0), b.x.max(axis=0)
        apart = (np.maximum(0, np.maximum(lo - v, v - hi)) ** 2).sum(axis=1)
        look = look[apart <= 2 - 2 * floors + SLACK]
    if not len(look):
        return
    # Rounding of a sum of products of unit vectors, term by term, and that of the digits kept.
    slack = 2.0 ** -23 * (b.width + 8) + 10.0**-DIGITS
    for low in range(0, len(look), STRIPE):
        part = look[low : low + STRIPE]
        rough = a.rough[part] @ b.rough.T
        near = rough >= (floors[part] - slack).astype(np.float32)[:, None]
        if not earlier and len(b.ids) > k and np.count_nonzero(near) > 4 * k * len(part):
            # The k best of the block by these products are at least so near; what is surely farther is none of the k.
            near &= rough >= (np.partition(rough, -k, axis=1)[:, -k].astype(np.float64) - 2 * slack).astype(np.float32)[:, None]
        if np.count_nonzero(near) > 32 * len(part):
            own = _Best(k, len(part))
            _exact(own, 0, a.m[part], a.t[part], a.ids[part], b.m, b.t, b.ids, floors[part], earlier)
            for j, (d, names) in enumerate(own.kept):
                if len(d):
                    best.add(int(part[j]), d, names)
        else:
            i, j = np.nonzero(near)
            i = part[i]
            if earlier:
                ok = b.t[j] < a.t[i]
                same = np.flatnonzero(b.t[j] == a.t[i])
                ok[same] = b.ids[j[same]] < a.ids[i[same]]
                i, j = i[ok], j[ok]
            sims = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", a.m[i[c : c + STRIPE]], b.m[j[c : c + STRIPE]]) for c in range(0, len(i), STRIPE)]])
            sims = np.round(sims, DIGITS)
            ok = sims >= floors[i]
            i, j, sims = i[ok], j[ok], sims[ok]
            cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1)) if len(i) else np.zeros(0, np.int64)
            for c, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                best.add(int(i[c]), -sims[c:e], b.ids[j[c:e]])
        for i in part.tolist():
            d = best.kept[i][0]
            if len(d) == k:
                floors[i] = max(floors[i], -d[-1])


def _other_blocks(blocks: DataFrame, many: DataFrame, count: int, k: int, earlier: bool, min_similarity: float | None) -> DataFrame:
    """(id, neighbour, similarity) between different blocks of a scope (of those in ``many``): at most ``k`` of a row from each part of the right side."""
    cols = ["_scope", "_block", "ids", "times", "first", "last", "width", "vectors", "seen", "floors"]
    blocks = meet(blocks, many, ["_scope"], F.col("_block"))
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in cols]).repartition(min(count, LEFT_PARTS))
    right = blocks.select(*[F.col(c).alias(f"b_{c}") for c in cols if c not in ("last", "floors")]).repartition(-(-count // RIGHT_BLOCKS))
    # Not written as an equality: a join by key would send all blocks of one large scope to one task.
    on = (F.col("a__scope") <= F.col("b__scope")) & (F.col("a__scope") >= F.col("b__scope")) & (F.col("a__block") != F.col("b__block"))
    if earlier:
        on &= F.col("b_first") <= F.col("a_last")
    pairs = left.join(right.hint("shuffle_replicate_nl"), on)

    def emit(a: _Block, best: _Best) -> pa.RecordBatch:
        out = _emit(best, a.ids.tolist()).set_axis(["id", "neighbour", "similarity"], axis=1)
        out["similarity"] = -out["similarity"]
        shape = pa.schema([("id", pa.string()), ("neighbour", pa.string()), ("similarity", pa.float64())])
        return pa.RecordBatch.from_pandas(out, schema=shape, preserve_index=False)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, a, best, floors = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch.column("a__scope")[i].as_py(), batch.column("a__block")[i].as_py())
                if at != here:
                    if a is not None:
                        yield emit(a, best)
                    at, a = here, _Block(batch, i, "a_")
                    best, floors = _Best(k, len(a.ids)), np.frombuffer(batch.column("a_floors")[i].as_py()).copy()
                _search_other(a, _Block(batch, i, "b_"), best, floors, k, earlier)
        if a is not None:
            yield emit(a, best)

    return pairs.mapInArrow(search, "id string, neighbour string, similarity double")


def earliest_match(
    rows: DataFrame, targets: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, before_only: bool = True
) -> DataFrame:
    """For each row the smallest ``ord`` among the targets within ``threshold``: (id, match).

    With ``before_only`` a target counts only if its ``ord`` is smaller than the row's. One row at most per
    (row, block) leaves a task. Both frames need id, ord (integer) and embedding without null or zero vectors.
    """
    t_blocks = max(1, -(-targets.count() // block_rows))
    r_blocks = max(1, -(-rows.count() // block_rows))
    left = rows.select("id", "ord", "embedding").withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(r_blocks)).cast("int"))
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))))
    right = targets.select(*[F.col(c).alias(c) for c in ("id", "ord", "embedding")]).withColumn(
        "_b", F.pmod(F.xxhash64("id"), F.lit(t_blocks)).cast("int")
    )
    right = right.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": pd.Series([], dtype=object), "match": np.zeros(0, dtype=np.int64)})
        am = _unit(np.stack(a["embedding"].to_numpy()).astype(np.float64))
        bm = _unit(np.stack(b["embedding"].to_numpy()).astype(np.float64))
        hit = np.round(am @ bm.T, DIGITS) >= threshold
        ao, bo = a["ord"].to_numpy(), b["ord"].to_numpy()
        if before_only:
            hit &= bo[None, :] < ao[:, None]
        none = np.iinfo(np.int64).max
        first = np.where(hit, bo[None, :], none).min(axis=1)
        found = first < none
        ids = pd.Series(a["id"].to_numpy(dtype=object)[found], dtype=object)
        return pd.DataFrame({"id": ids, "match": first[found]})

    partial = (
        left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInPandas(search, "id string, match bigint")
    )
    return partial.groupBy("id").agg(F.min("match").alias("match"))
