"""Runs of repeated words: suffix classes are united by falling LCP, and positions that become neighbours seed the runs."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memspark.llm.rows import map_text

#: Words of texts whose suffixes are sorted together (or one longer text): bounds the rank tables.
SORT_WORDS = 200_000


def least_lcp(length: int, exponent: int) -> int:
    """The smallest LCP with which the start of a run and the place one period further on can agree.

    A run of period q has max(``length``, ``exponent`` q) words at least, so those places agree in q words less.
    """
    return min(max(length, exponent * q) - q for q in range(1, length + 1))


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(Word numbers of all texts in a row, place of each text's first word). Texts share no number; a number of its own ends each."""
    out, at, starts = [], 0, []
    base = 0
    for words in texts:
        local: dict[bytes, int] = {}
        ids = [local.setdefault(w, len(local)) for w in words]
        ids.append(len(local))
        out.append(np.array(ids, dtype=np.int64) + base)
        base += len(local) + 1
        starts.append(at)
        at += len(ids)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.int64)), np.array(starts, dtype=np.int64)


def _repeats(ids: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """Whether each text may hold the same ``words`` words twice: equal stretches have equal hashes, so none is missed."""
    found = np.zeros(len(starts), dtype=bool)
    if len(ids) <= words:
        return found
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while 2 * width <= words:
        h = h ^ (h >> np.uint64(29))
        h = h[: len(h) - width] * np.uint64(0xBF58476D1CE4E5B9) + h[width:] * np.uint64(0x94D049BB133111EB)
        width *= 2
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    at = order[1:][same]
    found[np.searchsorted(starts, at, side="right") - 1] = True
    return found


def suffix_neighbours(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, lcp) of suffixes that follow each other in sorted order and agree in at least ``least`` words.

    Ranks of stretches of 1, 2, 4, ... words are made until all suffixes differ; the same tables give the LCP bit by bit.
    """
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int32)]
    width = 1
    while int(ranks[-1].max(initial=0)) < n - 1:
        high = ranks[-1].astype(np.int64) * (n + 1)
        high[: n - width] += ranks[-1][width:] + 1
        ranks.append(np.unique(high, return_inverse=True)[1].astype(np.int32))
        width *= 2
    order = np.empty(n, dtype=np.int64)
    order[ranks[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1 if n else 0, dtype=np.int64)
    for level in range(len(ranks) - 2, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < n) & (y < n)
        rank = ranks[level]
        same = inside & (rank[np.where(inside, x, 0)] == rank[np.where(inside, y, 0)])
        lcp += same.astype(np.int64) << level
    keep = lcp >= least
    return a[keep], b[keep], lcp[keep]


def kruskal_runs(ids: np.ndarray, length: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least ``length`` words and ``exponent`` (2 or more) periods.

    Neighbours in suffix order are united by falling LCP l. A class holds its positions in order; the smaller one is dealt
    into the larger. Two positions that come to follow each other then agree in exactly l words; at a distance d <= l they
    seed a run of period d: d + l words, which no word after them extends. It is kept where no word before extends it.
    A smaller period would have put a position between them earlier, so d is the smallest.
    """
    a, b, lcp = suffix_neighbours(ids, least_lcp(length, exponent))
    order = np.argsort(-lcp, kind="stable")
    text = ids.tolist()
    home: dict[int, list[int]] = {}
    runs = []
    for x, y, l in zip(a[order].tolist(), b[order].tolist(), lcp[order].tolist(), strict=True):
        large, small = home.get(x), home.get(y)
        if large is None:
            large = home[x] = [x]
        if small is None:
            small = home[y] = [y]
        if len(large) < len(small):
            large, small = small, large
        for i, p in enumerate(small):
            at = bisect_left(large, p)
            if at and (i == 0 or large[at - 1] != small[i - 1]):
                u = large[at - 1]
                if p - u <= l and (u == 0 or text[u - 1] != text[p - 1]):
                    runs.append((u, p - u + l, p - u))
            if at < len(large) and (i + 1 == len(small) or small[i + 1] > large[at]):
                v = large[at]
                if v - p <= l and (p == 0 or text[p - 1] != text[v - 1]):
                    runs.append((p, v - p + l, v - p))
            large.insert(at, p)
            home[p] = large
    return sorted(r for r in runs if r[1] >= max(length, exponent * r[2]))


def text_runs(texts: list[list[bytes]], length: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, starts = _numbered(texts)
    hits = np.flatnonzero(_repeats(ids, starts, least_lcp(length, exponent))).tolist()
    while hits:
        group = [hits.pop()]
        words = len(texts[group[0]])
        while hits and words + len(texts[hits[-1]]) <= SORT_WORDS:
            words += len(texts[hits[-1]])
            group.append(hits.pop())
        own, begin = _numbered([texts[t] for t in group])
        for start, n, period in kruskal_runs(own, length, exponent):
            which = int(np.searchsorted(begin, start, side="right")) - 1
            found[group[which]].append((start - int(begin[which]), n, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    deep = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, period in runs:
        deep[start + period] += 1
        deep[start + n] -= 1
    stay = np.cumsum(deep)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 24, exponent: int = 3) -> DataFrame:
    """Per row: ``key``, n_words, runs (start, length and period in words; by start, then period) and kept_text.

    A run is a stretch of words with smallest period q, as many as ``length`` and ``exponent`` q, that no neighbouring
    word extends. kept_text has each run's first period only, its words joined by one space. Words are parted by ASCII
    white space.

    Rows are worked on alone, without a shuffle. Texts that hold no stretch of words twice (found by hash, none missed)
    have no run and are not sorted; a text of n words takes n log n steps and log n rank tables of 4 n bytes.

    A null, empty or blank text has no words, no runs and an empty kept_text. Null keys and repeated rows give a row each;
    an empty table gives an empty one; other columns are not looked at.
    """

    def work():
        def one(part: pa.Array) -> dict:
            texts = [t.split() for t in part.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            runs = text_runs(texts, length, exponent)
            return {
                "n_words": [len(t) for t in texts],
                "runs": [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                "kept_text": [collapsed(t, r).decode() for t, r in zip(texts, runs, strict=True)],
            }

        return one

    return map_text(docs, key, text, "n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string", work)
