"""Near-duplicates by the similarity of their shingles: tries of wide SimHashes, walked table by table, every link settled exactly.

A similarity of 0.8 is about ten differing bits of 64, a budget with which one trie walk prunes next to nothing. So a
text has a SimHash of 1024 bits here, and as many tries as the wanted recall takes, each over other bits of it. In each
trie only texts under the same top node meet; below it pairs of nodes are walked with a budget of differing bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.components import components
from memspark.llm.rows import attach, few, kept, lookup, map_text, same, tidy
from memspark.llm.simhash import close_pairs, join_labels
from memspark.session import small_enough

#: 64-bit words of a SimHash.
WIDTH = 16
#: Different texts wanted under one top node; the depth of the cut follows from it.
NODE_TEXTS = 256
#: A top node with more texts is split into parts of this size, and each pair of parts is one group.
PART_TEXTS = 20_000
#: Share of the pairs at the very threshold that meet under some top node; more similar pairs meet more surely.
RECALL = 0.98
#: Standard deviations of the estimate within which a pair may be on either side of the threshold.
DEVIATIONS = 3.0
#: Spanning forests of border links that a group gives at first, no link twice; where one fails, all pairs are compared.
FORESTS = 4
#: Border links held in a task before they are cut to spanning forests.
HELD_LINKS = 1 << 20
#: Shingles up to which a set is compared without its sketch, which is too coarse for few shingles.
SHORT = 80
#: Shingles of a part of a group whose sets are compared outright; each pair of parts is one task's work.
GROUP_SHINGLES = 1 << 20
#: Short rows that a set of shingles counts as where small tables are put into few parts.
SET_ROWS = 8
#: Pairs of texts, and meetings of a shingle in two texts, counted at once when sets are compared.
BLOCK_PAIRS = 1 << 20
#: Texts of a group after whose work a worker gives its freed memory back.
TIDY_TEXTS = 1_000
#: Keys that are broadcast; more of them are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

_SEEDS = np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's runs of ``words`` words, sorted; fewer words are one run, none are no run."""
    w = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), dtype=np.uint64))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """``WIDTH`` independent hashes of each hash, as rows of bits."""
    x = hashes[:, None] + _SEEDS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little")


def sketch(hashes: np.ndarray) -> bytes:
    """The wide SimHash of a set of shingles; where a bit is in exactly half of them, the smallest shingle decides."""
    if not len(hashes):
        return bytes(8 * WIDTH)
    ones = np.zeros(64 * WIDTH, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        ones += _mixed(hashes[i : i + 4096]).sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones + _mixed(hashes[:1])[0] > len(hashes), bitorder="little").tobytes()


def _print(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed=42) if len(hashes) else 0


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Per row: ``key``, print (equal for equal sets of shingles), sketch and number of shingles."""

    def work():
        def batch(texts: pa.Array) -> dict:
            sets = [shingles(t, words) for t in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            prints = np.array([_print(s) for s in sets], dtype=np.uint64).view(np.int64)
            return {"print": pa.array(prints), "sketch": pa.array([sketch(s) for s in sets], pa.binary()), "shingles": [len(s) for s in sets]}

        return batch

    return map_text(docs, key, text, "print long, sketch binary, shingles long", work)


def differing(similarity: float) -> float:
    """The share of bits in which SimHashes of two sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def turned(words: np.ndarray, table: int, cut: int) -> np.ndarray:
    """The word of each wide SimHash that a table's trie is over, turned so that tables on one word begin with other bits."""
    word, by = words[:, table % WIDTH], np.uint64(table // WIDTH * cut % 64)
    return (word << by) | (word >> (np.uint64(64) - by)) if by else word


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _forests(label: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, forests: int) -> np.ndarray:
    """Places of the links of ``forests`` spanning forests over the labels, without common links, the closest pairs first."""
    ends = list(zip(label[i].tolist(), label[j].tolist(), strict=True))
    left, taken = np.argsort(d, kind="stable").tolist(), []
    for _ in range(forests):
        up, over = {}, []

        def root(x: int, up: dict = up) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for k in left:
            a, b = map(root, ends[k])
            if a != b:
                up[max(a, b)] = min(a, b)
                taken.append(k)
            else:
                over.append(k)
        left = over
    return np.array(taken, dtype=np.int64)


@dataclass(frozen=True)
class Tries:
    """How many tries there are, how deep they are cut, and which numbers of differing bits are near the threshold."""

    cut: int
    tables: int
    sure: int
    border: int
    budget: int


def tries(n: int, similarity: float) -> Tries:
    """The tries for ``n`` prints and a Jaccard similarity of ``similarity``."""
    cut = min(40, max(0, math.ceil(math.log2(max(1, n) / NODE_TEXTS))))
    p = differing(similarity)
    tables = 1 if not cut else math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - p) ** cut))
    bits = 64 * WIDTH
    margin = DEVIATIONS * math.sqrt(p * (1 - p) * bits)
    border = math.floor(p * bits + margin)
    share, rest = border / bits, 64 - cut
    budget = math.ceil(share * rest + 3.5 * math.sqrt(share * (1 - share) * rest))
    return Tries(cut, tables, math.floor(p * bits - margin), border, budget)


def dealt(prints: DataFrame, by: Tries) -> DataFrame:
    """(t, node, x, y, second, print, sketch): the texts under each top node of each trie, a wide node as pairs (x, y) of parts."""
    cut, tables = by.cut, by.tables

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, WIDTH)
            for t in range(tables):
                node = turned(words, t, cut) >> np.uint64(64 - cut) if cut else np.zeros(len(words), np.uint64)
                columns = [pa.array(np.full(len(words), t, np.int32)), pa.array(node.view(np.int64)), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "node", "print", "sketch"])

    # Rows of no word have no shingle to share; their one print is linked to none.
    under = prints.filter("print <> 0").select("print", "sketch").mapInArrow(deal, "t int, node long, print long, sketch binary")
    wide = kept(few(under.groupBy("t", "node").count().filter(F.col("count") > PART_TEXTS), tables << cut))
    return paired(under, ["t", "node"], wide.select("t", "node", F.ceil(F.col("count") / PART_TEXTS).cast("long").alias("parts")))


def paired(rows: DataFrame, group: list[str], parts: DataFrame) -> DataFrame:
    """``rows`` with ``x``, ``y`` and ``second``: groups that ``parts`` (``group``, parts) names are cut into pairs (x, y) of parts."""
    rows = rows.join(F.broadcast(parts) if small_enough(parts, BROADCAST_KEYS) else parts, group, "left")
    mine = F.pmod(F.xxhash64("print"), F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    rows = rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    return rows.withColumn("second", F.col("mine") > F.col("other")).drop("parts", "mine", "other")


def _walked(pdf: pd.DataFrame, by: Tries) -> tuple:
    """Of a group: prints, sketches as words and places, in the order of the trie, and its close pairs (i, j), some at a time."""
    words = np.frombuffer(b"".join(pdf["sketch"]), dtype="<u8").reshape(-1, WIDTH)
    second = pdf["second"].to_numpy(dtype=bool)
    bits_of = turned(words, int(pdf["t"].iat[0]), by.cut)
    order = np.lexsort((bits_of, second))
    words, bits_of, m = words[order], bits_of[order], int((~second).sum())
    own = pdf["x"].iat[0] == pdf["y"].iat[0]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in close_pairs(bits_of[:m], None if own else bits_of[m:], by.cut, by.budget):
            j = j if own else j + m
            for k in range(0, len(i), 1 << 15):
                yield i[k : k + (1 << 15)], j[k : k + (1 << 15)]

    return pdf["print"].to_numpy()[order], words, order, pairs()


def similar_links(rows: DataFrame, by: Tries) -> DataFrame:
    """(t, node, x, y, a, b, more): in each group pairs of prints whose sketches say that they may be similar enough.

    All have to be settled by their shingles. Pairs beyond the error of the estimate give one spanning forest, the others
    ``FORESTS`` between its trees, closest pairs first, so that a dense group costs rows for each text and not for each
    pair. ``more`` says that the group may have other pairs; they matter only where one of those given fails.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, words, _, pairs = _walked(pdf, by)
        label, more = np.arange(len(ids)), False
        trees, held = [np.zeros((2, 0), dtype=np.int64)], [np.zeros((3, 0), dtype=np.int64)]
        if len(ids) > 64:
            # What seems surely like the text nearest to the middle is one piece; its pairs needn't be looked at.
            share = sum(np.unpackbits(words[i : i + 4096].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(ids), 4096))
            middle = np.packbits(2 * share > len(ids)).view("<u8")
            nearest = int(np.argmin(_apart(words, middle[None, :])))
            like = np.flatnonzero(_apart(words, words[nearest][None, :]) <= by.sure)
            join_labels(label, np.full(len(like), nearest), like)
            like = like[like != nearest]
            trees.append(np.stack([np.full(len(like), nearest), like]))
            more = len(like) > 0
        for a, b in pairs:
            open_ = label[a] != label[b]
            more |= not open_.all()
            a, b = a[open_], b[open_]
            d = _apart(words[a], words[b])
            near = d <= by.sure
            if near.any():
                i, j = a[near], b[near]
                tree = _forests(label, i, j, d[near], 1)
                more |= len(tree) < len(i)
                trees.append(np.stack([i[tree], j[tree]]))
                join_labels(label, i, j)
            between = ~near & (d <= by.border)
            held.append(np.stack([a[between], b[between], d[between]]))
            if sum(h.shape[1] for h in held) > HELD_LINKS:
                some = np.concatenate(held, axis=1)
                held, more = [some[:, _forests(label, *some, FORESTS)]], True
        some = np.concatenate(held, axis=1)
        taken = _forests(label, *some, FORESTS)
        more |= len(taken) < some.shape[1]
        i, j = np.concatenate([*trees, some[:2, taken]], axis=1)
        at = {c: np.repeat(pdf[c].iat[0], len(i)) for c in ("t", "node", "x", "y")}
        held = some = words = pairs = None
        if len(ids) > TIDY_TEXTS:
            tidy()
        return pd.DataFrame({**at, "a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "more": np.full(len(i), more)})

    return rows.groupBy("t", "node", "x", "y").applyInPandas(walk, "t int, node long, x long, y long, a long, b long, more boolean")


def open_texts(rows: DataFrame, by: Tries, groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(t, node, x, y, print, part): of the named groups the texts that may be similar enough to one of another component.

    ``roots`` (print, root) are the components so far; a print without is one of its own, and part is its component.
    """
    key = ["t", "node", "x", "y"]
    some = rows.join(F.broadcast(groups) if small_enough(groups, BROADCAST_KEYS) else groups, key, "left_semi")
    some = some.join(roots, "print", "left").withColumn("part", F.coalesce("root", "print")).drop("root")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, words, order, pairs = _walked(pdf, by)
        part, found = pdf["part"].to_numpy()[order], np.zeros(len(ids), dtype=bool)
        for a, b in pairs:
            apart = part[a] != part[b]
            a, b = a[apart], b[apart]
            near = _apart(words[a], words[b]) <= by.border
            found[a[near]] = found[b[near]] = True
        at = {c: np.repeat(pdf[c].iat[0], int(found.sum())) for c in key}
        words = pairs = None
        if len(ids) > TIDY_TEXTS:
            tidy()
        return pd.DataFrame({**at, "print": ids[found], "part": part[found]})

    return some.groupBy(*key).applyInPandas(walk, "t int, node long, x long, y long, print long, part long")


def alike(sets: list[np.ndarray], part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sets whose Jaccard similarity is ``similarity`` or more: a spanning forest of all such pairs over the parts.

    All pairs are counted: shingles of many sets by a product of matrices, the others by the sets that hold them.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    holders = np.bincount(shingle)
    wide = holders > max(16, m // 4)
    dense = np.zeros((m, int(wide.sum())), dtype=np.float32)
    often = wide[shingle]
    dense[owner[often], (np.cumsum(wide) - 1)[shingle[often]]] = 1
    owner, shingle = owner[~often], shingle[~often]
    lists = owner[np.argsort(shingle, kind="stable")]  # the holders of shingle s are at begin[s] up to begin[s] + count[s]
    count = np.where(wide, 0, holders)
    begin = np.cumsum(count) - count
    row_at = np.searchsorted(owner, np.arange(m + 1))
    work = np.concatenate([[0], np.cumsum(count[shingle])])[row_at]
    label = np.unique(part, return_inverse=True)[1]
    label = np.unique(label, return_index=True)[1][label]  # a part's first place, as join_labels wants it
    out, lo = [np.zeros((2, 0), dtype=np.int64)], 0
    while lo < m and label.any():
        hi = max(lo + 1, min(lo + BLOCK_PAIRS // m, int(np.searchsorted(work, work[lo] + BLOCK_PAIRS, side="right")) - 1, m))
        s = shingle[row_at[lo] : row_at[hi]]
        which = np.repeat(np.arange(len(s)), count[s])
        nth = np.arange(len(which)) - (np.cumsum(count[s]) - count[s])[which]
        meet = (owner[row_at[lo] : row_at[hi]] - lo)[which] * m + lists[begin[s[which]] + nth]
        shared = np.bincount(meet, minlength=(hi - lo) * m).reshape(hi - lo, m) + np.rint(dense[lo:hi] @ dense.T).astype(np.int64)
        enough = shared >= similarity * (sizes[lo:hi, None] + sizes[None, :] - shared) - 1e-9
        i, j = np.nonzero(enough & (label[lo:hi, None] != label[None, :]))
        i += lo
        tree = _forests(label, i, j, np.zeros(len(i)), 1)
        out.append(np.stack([i[tree], j[tree]]))
        join_labels(label, i[tree], j[tree])
        lo = hi
    i, j = np.concatenate(out, axis=1)
    return i, j


def exact_links(texts: DataFrame, group: list[str], sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs that join parts, of all pairs in each group of ``texts`` (``group``, print, part) that are ``similarity`` alike or more.

    ``sets`` is (print, set). A group with over ``GROUP_SHINGLES`` shingles is cut into parts, each pair of them one task's work.
    """
    n = texts.count()
    full = few(kept(few(texts, n).join(sets.select("print", "set"), "print")), SET_ROWS * n)
    total = full.groupBy(*group).agg(F.sum(F.size("set")).alias("n")).filter(F.col("n") > GROUP_SHINGLES)
    parts = kept(few(total.select(*group, F.ceil(F.col("n") / GROUP_SHINGLES).cast("long").alias("parts")), n))
    rows = paired(full.select(*[F.col(c).alias(f"__{c}") for c in group], "print", "part", "set"), [f"__{c}" for c in group],
                  parts.select(*[F.col(c).alias(f"__{c}") for c in group], "parts"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["print"].to_numpy()
        i, j = alike([np.asarray(s, dtype=np.int64) for s in pdf["set"]], pdf["part"].to_numpy(), similarity)
        if len(ids) > TIDY_TEXTS:
            tidy()
        return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j])})

    return rows.groupBy(*[f"__{c}" for c in group], "x", "y").applyInPandas(compare, "a long, b long").distinct()


def sets_of(wanted: DataFrame, docs: DataFrame, prints: DataFrame, words: int) -> DataFrame:
    """(print, set): the distinct shingles of the texts of ``wanted`` (print), which are read again. Its other columns are kept.

    ``docs`` is (__key, __text). Only the hashes of these texts are moved.
    """
    wanted = kept(prints.select("print", F.col("least").alias("__key")).join(wanted.distinct(), "print"))
    n = wanted.count()
    wanted = few(wanted, n)
    texts = same(docs, wanted.select("__key"), ["__key"], "left_semi", broadcast=n <= BROADCAST_KEYS)

    def work():
        def batch(texts: pa.Array) -> dict:
            sets = [shingles(t, words) for t in texts.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            return {"print": [int(np.uint64(_print(s)).view(np.int64)) for s in sets], "set": [s.view(np.int64) for s in sets]}

        return batch

    made = map_text(texts, "__key", "__text", "print long, set array<long>", work)
    sets = kept(made.join(lookup(wanted.drop("__key"), n), "print").dropDuplicates(["print"]))
    return few(sets, SET_ROWS * n)


def settled(links: DataFrame, docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """The links (a, b) of ``links`` whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    A text with very many links is broadcast (see ``attach``).
    """
    total = links.count()
    both = links = few(links, total)
    ends = kept(few(links.select(F.explode(F.array("a", "b")).alias("print")).groupBy("print").agg(F.count("*").alias("links")), 2 * total))
    sets = sets_of(ends, docs, prints, words)
    for end in ("a", "b"):
        facts = sets.select(F.col("print").alias(end), F.col("set").alias(f"set_{end}"), "links")
        both = attach(both, facts, [end], "links", total).drop("links")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared >= similarity * (F.size("set_a") + F.size("set_b") - shared) - 1e-9).select("a", "b")


def short_links(docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of all similar pairs in which a set has at most ``SHORT`` shingles; none is missed.

    Two sets that are similar enough share one of the first ``size - ceil(similarity * size) + 1`` shingles of each, in any
    order common to all; the rarest come first here. Sets that share such a shingle are compared outright.
    """
    short = prints.filter((F.col("print") != 0) & (F.col("shingles") <= math.floor(SHORT / similarity + 1e-9)))
    sets = sets_of(short.select("print"), docs, prints, words)
    each = kept(sets.select("print", F.size("set").alias("size"), F.explode("set").alias("shingle")))
    held = kept(each.groupBy("shingle").agg(F.count("*").alias("texts")))
    counted = attach(each, held, ["shingle"], "texts", each.count())
    order = F.array_sort(F.collect_list(F.struct("texts", "shingle")))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1
    begins = counted.groupBy("print", "size").agg(order.alias("order")).select("print", F.explode(F.slice("order", F.lit(1), first)).alias("s"))
    texts = begins.filter("s.texts > 1").select("print", F.col("s.shingle").alias("shingle"), F.col("print").alias("part"))
    return exact_links(kept(texts), ["shingle"], sets, similarity)


def verified_links(docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of all similar pairs that meet under some top node, each compared by its shingles.

    First each group's forests are settled. A group in which one of these links fails and that has other pairs is walked again
    over the components so far, and the texts that still have an open pair are compared with one another outright.
    """
    n = prints.count()
    by = tries(n, similarity)
    rows = dealt(prints, by)
    prints = few(prints, n)
    found = kept(similar_links(rows, by))
    total = found.count()
    found = few(found, total)
    links = kept(few(found.select("a", "b").distinct(), total))
    good = few(kept(settled(links, docs, prints, words, similarity)), total)
    failed = found.filter("more").join(lookup(good, total), ["a", "b"], "left_anti").select("t", "node", "x", "y").distinct()
    failed = kept(few(failed, total))
    if failed.isEmpty():
        return good
    roots = components(good).withColumnRenamed("node", "print")
    texts = kept(open_texts(rows, by, failed, lookup(roots, 2 * total)))
    if texts.isEmpty():
        return good
    sets = sets_of(texts.select("print"), docs, prints, words)
    return good.unionByName(exact_links(texts, ["t", "node", "x", "y"], sets, similarity))


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row: ``key`` and component_id, the smallest ``key`` reachable over pairs of texts that are ``similarity`` alike or more.

    Alike is the Jaccard similarity of the sets of runs of ``words`` words, A-Z lower-cased, cut at ASCII white space
    (fewer words: one run). All pairs with a text of at most ``SHORT`` runs are met; of other pairs at the very threshold
    ``RECALL`` are, of closer ones more. Every link is settled by its shingles.

    Null and empty texts are one group. Null keys are never a component's id unless it has no other; repeated rows give a
    row each; an empty table gives an empty one; other columns are not looked at.
    """
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = kept(sketches(docs, "__key", "__text", words))
    prints = kept(rows.groupBy("print").agg(F.count("*").alias("size"), F.min("__key").alias("least"), F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles")))
    links = verified_links(docs, prints, words, similarity)
    n = prints.count()
    prints = few(prints, n)
    roots = components(links.unionByName(short_links(docs, prints, words, similarity))).withColumnRenamed("node", "print")
    grouped = kept(few(prints.select("print", "size", "least").join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), n))
    ids = few(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), n)
    of_print = kept(few(attach(grouped, ids, ["root"], "prints", n).select("print", "size", "component_id"), n))
    out = attach(rows.select("__key", "print"), of_print, ["print"], "size", rows.count())
    return out.select(F.col("__key").alias(key), "component_id")
