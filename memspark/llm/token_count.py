"""Token counts by byte-pair merging with a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm import vocab
from memspark.llm.rows import map_text

#: How byte-level vocabularies cut text, for the characters of ``vocab.PLAIN``.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


def merged_length(symbols: Sequence[int], pairs: dict[int, int]) -> int:
    """How many tokens byte-pair merging leaves of ``symbols``: their number less the merges made.

    ``pairs`` gives the merged symbol of each pair (a << 20 | b); merged symbols rise with the rank. The heap holds
    the merged symbol and the position of adjacent pairs as one integer; the linked list, the living symbols. The pair
    of the lowest rank, leftmost first, is merged; entries whose pair has changed since are passed over. O(n log n).
    """
    sym = list(symbols)
    n = len(sym)
    if n < 2:
        return n
    get = pairs.get
    heap = [m << 32 | i for i in range(n - 1) if (m := get(sym[i] << 20 | sym[i + 1]))]
    if not heap:
        return n
    heapq.heapify(heap)
    after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i, made = top & 0xFFFFFFFF, top >> 32
        j = after[i]
        if j >= n or sym[i] < 0 or get(sym[i] << 20 | sym[j]) != made:
            continue
        sym[i], sym[j] = made, -1
        done += 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if m := get(made << 20 | sym[k]):
                push(heap, m << 32 | i)
        p = before[i]
        if p >= 0 and (m := get(sym[p] << 20 | made)):
            push(heap, m << 32 | p)
    return n - done


class Counter:
    """Counts the tokens of texts for a byte-level vocabulary file."""

    def __init__(self, file: str):
        from tokenizers.pre_tokenizers import ByteLevel

        spec = vocab.settings(file)
        cutting = spec["pre_tokenizer"]
        if spec["normalizer"] or cutting["type"] != "ByteLevel" or not cutting["use_regex"] or cutting["add_prefix_space"]:
            raise ValueError(f"{file}: only byte-level vocabularies without a normaliser are counted")
        self.pairs = vocab.symbols(file)[0]
        self.cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str  # the library's, for cutting only
        self.byte = {c: b for b, c in enumerate(vocab.byte_characters())}
        self.special, self.strings = vocab.special_pattern(file), [*vocab.specials(file)]
        self.words, self.seen = vocab.Cache(vocab.CACHE_WORDS), vocab.Cache(vocab.CACHE_UNITS)

    def piece(self, piece: str) -> int:
        """Tokens of a piece of plain text that no token reaches out of."""
        if (n := self.words.get(piece)) is None:
            n = self.words.keep(piece, merged_length(piece.encode(), self.pairs))
        return n

    def part(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if vocab.PLAIN.fullmatch(text):
            return sum(map(self.piece, PIECES.findall(text)))
        return sum(merged_length([self.byte[c] for c in piece], self.pairs) for piece, _ in self.cut(text))

    def text(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]  # texts and special strings in turn
        return len(parts) // 2 + sum(self.part(p) for p in parts[::2] if p)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Texts are cut before white space and equal units counted once."""
        odd = pc.match_substring_regex(texts, vocab.OTHER_SPACE)
        for s in self.strings:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        distinct, index, first = vocab.units(texts)
        seen, part, keep = self.seen, self.part, self.seen.keep
        each = np.fromiter((n if (n := seen.get(u)) is not None else keep(u, part(u)) for u in distinct), np.int64, len(distinct))
        out = vocab.sums(each, index, first)
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            out[i] = self.text(texts[int(i)].as_py())
        return out


@lru_cache(maxsize=2)
def counter(file: str) -> Counter:
    return Counter(file)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """Per row: ``key``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    One pass without a shuffle. A text is cut before each run of white space; the units are counted alone, since no
    token reaches over such a place, and equal ones once. The merging itself is ``merged_length``.

    Null texts count as empty (0 tokens, not over). Repeated rows and null keys give one row each. A special string
    inside a text counts as one token. Very long words take O(n log n) and are not remembered. An empty table gives
    an empty one; other columns are not looked at.
    """
    file = vocab.path(tokenizer)

    def work():
        count = counter(file)
        return lambda texts: {"n_bytes": pc.binary_length(texts).cast(pa.int64()), "n_tokens": pa.array(count.texts(texts))}

    made = map_text(docs, key, text, "n_bytes long, n_tokens long", work)
    return made.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
