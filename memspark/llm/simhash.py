"""Near-duplicates by SimHash: fingerprints of word shingles, joined by walking pairs of nodes of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.components import components
from memspark.llm.rows import attach, few, kept, map_text, same
from memspark.session import small_enough

#: Fingerprints wanted under one top node of the trie; the depth at which the trie is cut follows from it.
NODE_ROWS = 500_000
#: Least and largest depth of the cut.
CUT = (5, 20)
#: Pairs of nodes with at most so many pairs of fingerprints are compared outright.
LEAF_PAIRS = 512
#: Keys of rows that go that are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Pairs of nodes taken up at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text: bit i is set if it is in over half of the shingles' hashes; 0 without words."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    n, ones = 0, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter(map(digest, grams), dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 16):
        some = hashes[i : i + (1 << 16)]
        n += len(some)
        ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """Per row: ``key`` and print, the 64 bits as a signed long."""

    def work():
        def batch(texts: pa.Array) -> dict:
            raw = texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            return {"print": pa.array(np.array([fingerprint(t, words) for t in raw], dtype=np.uint64).view(np.int64))}

        return batch

    return map_text(docs, key, text, "print long", work)


def _split(sorted_bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Where the right child begins in nodes [lo, hi) of the trie over sorted fingerprints, ``depth`` bits down."""
    bit = np.uint64(1) << (np.uint64(63) - depth.astype(np.uint64))
    first = (sorted_bits[lo] & ~(bit - np.uint64(1))) | bit
    return np.clip(np.searchsorted(sorted_bits, first), lo, hi)


def close_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints at most ``budget`` bits apart; ``right`` None joins ``left`` with itself.

    Both are sorted and distinct, and each shares its first ``depth`` bits. Pairs of nodes are walked downward together;
    a pair whose nodes differ in more bits than the budget is dropped with all that is below. Blocks of pairs are taken
    from a stack, the deepest first, so that few wait at a time.
    """
    own = right is None
    right = left if own else right
    if not len(left) or not len(right):
        return
    top = np.uint64(0) if depth == 0 else (left[0] ^ right[0]) >> np.uint64(64 - depth)
    start = np.array([[0, len(left), 0, len(right), int(np.bitwise_count(top)), depth]], dtype=np.int64)
    stack = [start[start[:, 4] <= budget]]
    while stack:
        block = stack.pop()
        if len(block) > BLOCK:
            stack.append(block[BLOCK:])
            block = block[:BLOCK]
        a, b, c, d, err, at = block.T
        sizes = (b - a) * (d - c)
        leaf = (sizes <= LEAF_PAIRS) | (at >= 64)
        if leaf.any():
            yield from _compare(left, right, block[leaf], budget, own)
        a, b, c, d, err, at = block[~leaf].T
        if not len(a):
            continue
        m, n = _split(left, a, b, at), _split(right, c, d, at)
        same = (a == c) & (b == d) if own else np.zeros(len(a), dtype=bool)
        down = [np.stack(x, axis=1)[keep] for x, keep in (
            ((a, m, c, n, err, at + 1), slice(None)),
            ((m, b, n, d, err, at + 1), slice(None)),
            ((a, m, n, d, err + 1, at + 1), slice(None)),
            ((m, b, c, n, err + 1, at + 1), ~same),  # of a node with itself, the mirror of the line above
        )]
        nodes = np.concatenate(down)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (nodes[:, 4] <= budget)]
        if len(nodes):
            stack.append(nodes)


def _compare(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, budget: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of fingerprints under pairs of nodes, at most about a million pairs at a time."""
    a, b, c, d = nodes[:, :4].T
    sizes = (b - a) * (d - c)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(nodes):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), side="right")))
        some = slice(begin, stop)
        which = np.repeat(np.arange(begin, stop), sizes[some])
        nth = np.arange(len(which)) - np.repeat(ends[some] - sizes[some] - (ends[begin - 1] if begin else 0), sizes[some])
        wide = (d - c)[which]
        i, j = a[which] + nth // wide, c[which] + nth % wide
        near = np.bitwise_count(left[i] ^ right[j]) <= budget
        if own:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        begin = stop


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Put the ends of each link (i, j) under one label; a label is its group's smallest index."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def near_links(prints: DataFrame, budget: int = 3, column: str = "print") -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all pairs at most ``budget`` bits apart.

    The trie is cut where its nodes hold about ``NODE_ROWS`` fingerprints; bits that split the set most evenly come
    first. Each pair of top nodes within the budget is one group, walked on in one task by ``close_pairs``. A group
    gives a spanning forest of its links, so a dense cluster costs one row for each fingerprint and not one for each pair.
    """
    distinct = kept(prints.select(F.col(column).alias("print")).distinct())
    bits = [F.sum(F.shiftright("print", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(64)]
    ones = distinct.agg(F.count("*").alias("n"), *bits).first()
    n = ones["n"]
    order = sorted(range(64), key=lambda i: (abs(2 * (ones[f"b{i}"] or 0) - n), i))
    cut = min(CUT[1], max(CUT[0], int(np.ceil(np.log2(max(1, n) / NODE_ROWS)))))

    def node(depth: int):
        out = F.lit(0).cast("long")
        for i in order[:depth]:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright("print", i).bitwiseAND(F.lit(1).cast("long")))
        return out

    # A set that the most even bits leave lopsided is cut deeper.
    while cut < CUT[1] and n > NODE_ROWS and distinct.groupBy(node(cut)).count().agg(F.max("count")).first()[0] > 8 * NODE_ROWS:
        cut += 1
    flips = [m for m in range(1 << cut) if m.bit_count() <= budget]
    rows = distinct.select("print", node(cut).alias("node")).withColumn("flip", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])))
    other = F.col("node").bitwiseXOR(F.col("flip"))
    pairs = rows.select("print", F.least("node", other).alias("x"), F.greatest("node", other).alias("y"), (F.col("node") > other).alias("second"))

    def permuted(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.uint64)
        for i in order:
            out = (out << np.uint64(1)) | ((values >> np.uint64(i)) & np.uint64(1))
        return out

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        raw, second = pdf["print"].to_numpy().view(np.uint64), pdf["second"].to_numpy(dtype=bool)
        turned = permuted(raw)
        sides = []
        for mine in (~second, second):
            by = np.argsort(turned[mine])
            sides.append((turned[mine][by], raw[mine][by]))
        (left, left_raw), (right, right_raw) = sides
        own = pdf["x"].iat[0] == pdf["y"].iat[0]
        every = left_raw if own else np.concatenate([left_raw, right_raw])
        label = np.arange(len(every))
        for i, j in close_pairs(left, None if own else right, cut, budget):
            join_labels(label, i, j if own else j + len(left))
        child = np.flatnonzero(label != np.arange(len(every)))
        return pd.DataFrame({"a": every[label[child]].view(np.int64), "b": every[child].view(np.int64)})

    return pairs.groupBy("x", "y").applyInPandas(walk, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 3) -> DataFrame:
    """Per row: ``key``, fingerprint (16 lowercase hex digits) and component_id, the smallest ``key`` reachable over links.

    Whole texts are cut at ASCII white space, A-Z lower-cased, and every run of ``words`` words hashed (fewer words: all
    of them once). Fingerprints at most ``budget`` bits apart link; equal ones are one node, whatever their number.

    Null texts count as empty and have fingerprint 0, linked like any other. Null keys are never a component's id unless
    it has no other; repeated rows give a row each; an empty table gives an empty one; other columns are not looked at.
    """
    rows = kept(fingerprints(docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), "__key", "__text", words))
    prints = rows.groupBy("print").agg(F.count("*").alias("size"), F.min("__key").alias("least"))
    roots = components(near_links(prints, budget)).withColumnRenamed("node", "print")
    grouped = kept(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints"))
    of_print = attach(grouped, ids, ["root"], "prints", grouped.count()).select("print", "size", "component_id")
    out = attach(rows, kept(of_print), ["print"], "size", rows.count())
    return out.select(F.col("__key").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, budget: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row whose ``key`` is the smallest, with all columns.

    Components are those of ``groups`` (``key``, component_id), or else of fingerprints at most ``budget`` bits apart. The
    text isn't shuffled while the keys that go can be broadcast. Of several rows of the key that stays, one does.
    """
    found = kept(near_duplicates(docs, key, text, words, budget) if groups is None else groups)
    stays = F.col(key).eqNullSafe(F.col("component_id"))
    n = found.count()
    found = few(found, n)
    gone = kept(few(found.filter(~stays).select(key).distinct(), n))
    out = same(docs, gone, [key], "left_anti", broadcast=small_enough(gone, BROADCAST_KEYS))
    repeated = few(found.filter(stays).groupBy(key).count().filter("count > 1"), n)
    return out if repeated.isEmpty() else out.dropDuplicates([key])
