"""What token counting, encoding and packing share: vocabulary files, and the cutting of texts into independent units."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa

#: Units and words at least this long are not remembered, so that a cache entry is small.
LONG_UNIT = 64
#: A cache is cut beyond so many entries: memory is bounded, results are the same.
CACHE_UNITS = 300_000
CACHE_WORDS = 600_000

#: White space that cuts a text; a subset of what the tokenizers take as white space.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: A unit for vocabularies whose tokens may begin with a blank: the white space before a word, and the word.
LED_WORDS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
WORDS = re.compile(r"[^ \t-\r]+")
#: White space that doesn't cut here. A text with such characters is one unit where white space is part of tokens.
OTHER_SPACE = "[\u0085   -     　]"
#: Text for which the cutting patterns are written out here; any other goes through the library's.
PLAIN = re.compile("[ -~\t-\rÀ-ÖØ-öø-ÿ]*")


def path(name: str) -> str:
    """The place of a vocabulary file of the public tokenizers; any other path is kept."""
    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def settings(file: str) -> dict:
    """The parsed vocabulary file."""
    with open(file, encoding="utf-8") as f:
        return json.load(f)


@lru_cache(maxsize=4)
def merges(file: str) -> list[tuple[str, str]]:
    """The merge list, lowest rank first."""
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in settings(file)["model"]["merges"]]


def forget() -> None:
    """Drop the parsed files, once what is needed of them has been built."""
    settings.cache_clear()
    merges.cache_clear()


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def symbols(file: str) -> tuple[dict[int, int], list[str]]:
    """(merged symbol of each pair, the string of each symbol).

    Symbols 0 to 255 are the bytes, 256 to 511 the bytes that end a word, then one for each merge by rank; so a lower
    symbol is a merge of a lower rank. A pair (a, b) is the integer a << 20 | b.
    """
    suffix = settings(file)["model"].get("end_of_word_suffix") or ""
    chars = byte_characters()
    strings = [*chars, *([c + suffix for c in chars] if suffix else [""] * 256)]
    number = {s: i for i, s in reversed(list(enumerate(strings)))}
    pairs = {}
    for a, b in merges(file):
        if a + b in number:
            raise ValueError(f"{file}: two merges make {a + b!r}")
        pairs[number[a] << 20 | number[b]] = number[a + b] = len(strings)
        strings.append(a + b)
    return pairs, strings


@lru_cache(maxsize=4)
def specials(file: str) -> dict[str, int]:
    """Strings that are tokens of their own wherever a text holds them."""
    return {t["content"]: t["id"] for t in settings(file).get("added_tokens", [])}


def special_pattern(file: str) -> re.Pattern | None:
    """Matches one special string; None if there are none. Longer strings go first."""
    found = sorted(specials(file), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Cut texts before each run of white space: (distinct units, index of each unit, where each text's units begin).

    The last array has one entry more than there are texts. Units are made as offsets into the texts' own buffer and
    told apart by a dictionary, so Python looks at each distinct unit once.
    """
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(at[-1] - at[0]) if len(texts) else 0
    if not size:
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    data = buffers[2].slice(int(at[0]), size)
    space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
    begins = np.zeros(size + 1, dtype=bool)
    begins[1:size] = space[1:] & ~space[:-1]
    rows = at - at[0]
    begins[rows[:-1][rows[:-1] < rows[1:]]] = True
    begins[size] = False
    begin = np.flatnonzero(begins)
    offsets = np.append(begin, size)
    cut = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), data).dictionary_encode()
    return cut.dictionary.to_pylist(), cut.indices.to_numpy(), np.searchsorted(begin, rows)


def slices(texts: pa.Array, most: int = 6_000_000) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``most`` bytes, or one row where that is longer."""
    at = np.frombuffer((texts := texts.cast(pa.large_string())).buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def sums(values: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text, the sum of its units' ``values`` (one row of values for each distinct unit)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values[index], axis=0)])
    return total[first[1:]] - total[first[:-1]]


class Cache(dict):
    """Remembers short keys. Beyond ``most`` entries the newer half goes: frequent keys were seen first."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def keep(self, key: str, value):
        if len(key) < LONG_UNIT:
            if len(self) >= self.most:
                for _ in range(self.most // 2):
                    self.popitem()
            self[key] = value
        return value
