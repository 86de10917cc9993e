"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from memspark.llm import vocab
from memspark.llm.rows import map_text
from memspark.llm.token_count import PIECES

#: How the vocabulary that drops white space cuts text, for the characters of ``vocab.PLAIN`` in lower case.
LOWER_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def sufficient_lookahead(rules: list[tuple[int, int, int]], size: list[int]) -> int:
    """How many symbols right of a token's end can matter for whether a merge crosses that end.

    ``rules`` are (left, right, merged) by rank. A rule (u, v) crosses the end of u if v comes to stand there. That takes
    |v| symbols, and v stands unless one of its own right ends is crossed before by a rule of a lower rank, and so
    on: ranks fall along such a chain, so it ends. One pass over the rules by rank: ``reach[u]``, the farthest look of
    the rules so far that begin with u; ``inner[t]``, the same for the right ends inside t at the ranks at which they vanish.
    """
    reach, inner = [0] * len(size), [0] * len(size)
    for u, v, made in rules:
        far = max(inner[v], reach[v])
        inner[made] = max(inner[made], far)
        reach[u] = max(reach[u], size[v] + far)
    return max(reach, default=0)


def merge(sym: list[int], pairs: dict[int, int]) -> list[int]:
    """Byte-pair merging of a short list: the pair of the lowest rank first, the leftmost of equal ones."""
    get, none = pairs.get, 1 << 40
    made = [get(a << 20 | b, none) for a, b in zip(sym, sym[1:], strict=False)]
    while made:
        best = min(made)
        if best == none:
            break
        i = made.index(best)
        sym[i : i + 2] = [best]
        del made[i]
        if i < len(made):
            made[i] = get(best << 20 | sym[i + 1], none)
        if i:
            made[i - 1] = get(sym[i - 1] << 20 | best, none)
    return sym


#: Words up to so many bytes are merged many at a time, in matrices of widths that are multiples of ``WIDTH_STEP``.
MATRIX_BYTES, WIDTH_STEP = 24, 4
#: Stands for no symbol, and for no merged symbol: above all symbols.
NONE = (1 << 20) - 1


class Merger:
    """Byte-pair merging of many short words at once: in each round every word that has a pair merges the one it would merge next."""

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int32, len(pairs))
        order = np.argsort(keys)
        # The last key is above all pairs, so that every search ends inside.
        self.keys, self.made = np.append(keys[order], 1 << 62), np.append(made[order], np.int32(NONE))

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair; its order is the rank."""
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], NONE).astype(np.int32)

    def merge(self, sym: np.ndarray) -> np.ndarray:
        """``sym``: a row of symbols for each word, ``NONE`` at its end. As ``merge`` for each row."""
        out, rows = np.full_like(sym, NONE), np.arange(len(sym))
        made = self._pair(sym[:, :-1], sym[:, 1:])
        while len(rows) and made.shape[1]:
            i = made.argmin(axis=1)
            best = made[np.arange(len(rows)), i]
            alive = best < NONE
            if not alive.all():
                out[rows[~alive], : sym.shape[1]] = sym[~alive]
                rows, sym, made, i, best = rows[alive], sym[alive], made[alive], i[alive], best[alive]
            all_, after = np.arange(len(rows)), np.arange(sym.shape[1] - 1) > i[:, None]
            sym = np.where(after, sym[:, 1:], sym[:, :-1])
            sym[all_, i] = best
            made = np.where(after[:, :-1], made[:, 1:], made[:, :-1])
            right = np.flatnonzero(i < made.shape[1])
            made[right, i[right]] = self._pair(best[right], sym[right, i[right] + 1])
            left = np.flatnonzero(i > 0)
            made[left, i[left] - 1] = self._pair(sym[left, i[left] - 1], best[left])
        out[rows, : sym.shape[1]] = sym
        return out


class Transducer:
    """Symbols of a word in, tokens out as soon as they are stable; what it holds doesn't grow with the word.

    Inside a window of ``ahead`` plus ``window`` symbols, a token that ends ``ahead`` symbols or more before the
    window's end is final: no symbol to come can change whether a merge crosses its end, and none does, so the rest is
    encoded on its own. ``finish`` ends the word: its last symbol becomes the one that carries the end of a word.
    """

    def __init__(self, pairs: dict[int, int], ahead: int, size: list[int], ending: int = 0, window: int = 256):
        self.pairs, self.ahead, self.size, self.ending, self.window = pairs, ahead, size, ending, window
        self.held: list[int] = []

    def push(self, symbols: Iterable[int]) -> Iterator[int]:
        for s in symbols:
            self.held.append(s)
            if len(self.held) > self.ahead + self.window + 1:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        # The newest symbol waits: it may be the word's last, which is another symbol.
        end, at = len(self.held) - 1, 0
        for token in merge(self.held[:end], self.pairs):
            if at + self.size[token] + self.ahead > end:
                break
            yield token
            at += self.size[token]
        if at == 0:  # a token longer than the window
            self.window *= 2
        del self.held[:at]

    def finish(self) -> Iterator[int]:
        if self.held:
            self.held[-1] += self.ending
            yield from merge(self.held, self.pairs)
            self.held = []


class Decoder:
    """Identifiers in, text out, one at a time. The state is the bytes of one unfinished character.

    With a byte-level decoder a token's characters stand for bytes, which pass through an incremental UTF-8 machine
    (an invalid sequence gives U+FFFD); special tokens are text. Without a decoder the vocabulary's strings follow
    each other with a blank between, as the library joins them. Unknown identifiers give nothing.
    """

    def __init__(self, file: str):
        spec = vocab.settings(file)
        self.words = {i: s for s, i in (spec["model"]["vocab"] | vocab.specials(file)).items()}
        byte = {c: b for b, c in enumerate(vocab.byte_characters())}
        self.bytes = byte if (spec["decoder"] or {}).get("type") == "ByteLevel" else None
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def push(self, token: int) -> str:
        word = self.words.get(token)
        if word is None:
            return ""
        if self.bytes is None:
            lead, self.first = "" if self.first else " ", False
            return lead + word
        if all(c in self.bytes for c in word):
            return self.utf8.decode(bytes(self.bytes[c] for c in word))
        return self.utf8.decode(word.encode())

    def finish(self) -> str:
        out = "" if self.bytes is None else self.utf8.decode(b"", True)
        self.utf8.reset()
        self.first = True
        return out


class Codec:
    """Encoder and decoder for one vocabulary file; equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(file)  # for its normaliser and its cutting into words only
        spec = vocab.settings(file)
        self.special, self.special_ids = vocab.special_pattern(file), vocab.specials(file)
        self.normal = library.normalizer.normalize_str if library.normalizer else (lambda s: s)
        self.cut = library.pre_tokenizer.pre_tokenize_str
        self.pairs, strings = vocab.symbols(file)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ending = 256 if suffix else 0
        self.size = [len(s.removesuffix(suffix)) if i >= 512 else 1 for i, s in enumerate(strings)]
        self.ids = [spec["model"]["vocab"].get(s, -1) for s in strings]
        self.ahead = sufficient_lookahead([(p >> 20, p & 0xFFFFF, m) for p, m in self.pairs.items()], self.size)
        self.byte = {c: b for b, c in enumerate(vocab.byte_characters())}
        #: Whether white space is dropped; if not, a text with white space that doesn't cut here is one unit.
        self.loose = '"behavior": "Removed"' in str(spec["pre_tokenizer"]).replace("'", '"')
        self.lower = '"Lowercase"' in str(spec["normalizer"]).replace("'", '"')
        self.pieces = LOWER_PIECES if self.loose and self.lower else None if self.loose or spec["normalizer"] else PIECES
        self.decoder = Decoder(file)
        self.joint = "" if self.decoder.bytes else " "
        self.merger, self.id_array = Merger(self.pairs), np.array(self.ids, dtype=np.int64)
        self.words, self.seen = vocab.Cache(vocab.CACHE_WORDS), vocab.Cache(vocab.CACHE_UNITS)

    def word(self, symbols: bytes | list[int]) -> Iterator[int]:
        """The identifiers of one word, streamed. A word within the first window is final as soon as it ends."""
        machine = Transducer(self.pairs, self.ahead, self.size, self.ending)
        if len(symbols) <= machine.window:
            machine.held = [*symbols]
            yield from map(self.ids.__getitem__, machine.finish())
            return
        for token in machine.push(symbols):
            yield self.ids[token]
        for token in machine.finish():
            yield self.ids[token]

    def part(self, text: str) -> list[int]:
        """The identifiers of a text without special strings."""
        out: list[int] = []
        if self.pieces and vocab.PLAIN.fullmatch(text):
            for piece in self.pieces.findall(text.lower() if self.lower else text):
                got = self.words.get(piece)
                out += got if got is not None else self.words.keep(piece, tuple(self.word(piece.encode())))
        else:
            for piece, _ in self.cut(self.normal(text)):
                out += self.word([self.byte[c] for c in piece])
        return out

    def stream(self, text: str) -> Iterator[int]:
        """The identifiers of a whole text, special strings included."""
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                yield self.special_ids[part]
            elif self.loose:
                for unit in vocab.WORDS.finditer(part):
                    yield from self.part(unit[0])
            else:
                yield from self.part(part)

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(map(self.decoder.push, ids)) + self.decoder.finish()

    def unit(self, text: str) -> bytes:
        """The identifiers of a unit as little-endian unsigned 32-bit integers."""
        if (got := self.seen.get(text)) is None:
            got = self.seen.keep(text, pack(f"<{len(ids := self.part(text))}I", *ids))
        return got

    def texts(self, texts: pa.Array, decoding: bool = True) -> Iterator[tuple[memoryview | bytes, memoryview | bytes | None]]:
        """For each text (its identifiers as bytes, with ``decoding`` the decoded text in UTF-8).

        Texts are cut before white space, equal units encoded once, and the units' bytes put together by an Arrow ``take``.
        """
        odd = self._odd(texts)
        distinct, index, first = vocab.units(texts)
        made = [self.unit(u) for u in distinct]
        ids = _joined(pa.array(made, pa.large_binary()), index, first)
        if decoding:
            back = [self.joint + self.decode(m) if (m := np.frombuffer(b, "<u4").tolist()) else "" for b in made]
            decoded = _joined(pa.array(back, pa.large_string()), index, first)
        skip = len(self.joint)
        for i, rare in enumerate(odd):
            if rare:
                whole = [*self.stream(texts[i].as_py())]
                yield np.array(whole, dtype="<u4").tobytes(), self.decode(whole).encode() if decoding else None
            else:
                yield ids(i), decoded(i)[skip:] if decoding else None


    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be read as a whole: with special strings, or white space that doesn't cut here."""
        odd = pc.match_substring_regex(texts, vocab.OTHER_SPACE) if not self.loose else pa.array(np.zeros(len(texts), bool))
        for s in self.special_ids:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        return odd.to_numpy(zero_copy_only=False)

    def encoded(self, texts: pa.Array) -> Iterator[memoryview | bytes]:
        """The identifiers of each text, as ``texts`` gives them. From call to call only odd or long words are remembered.

        Texts are cut into words by the kinds of their bytes, and the different words merged many at a time.
        """
        if self.pieces is not LOWER_PIECES:
            yield from (b for b, _ in self.texts(texts, decoding=False))
            return
        odd = self._odd(texts)
        words, first = _lower_words(texts)
        words = words.dictionary_encode()
        values, place = self._merged(words.dictionary)
        ids = _joined(values, place[words.indices.to_numpy()], first)
        for i, rare in enumerate(odd):
            yield np.array([*self.stream(texts[i].as_py())], dtype="<u4").tobytes() if rare else ids(i)

    def _merged(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the identifiers of different words as bytes, in some order, and each word's place in it)."""
        begin, text = _bytes(words)
        size = np.diff(begin)
        odd = np.zeros(len(words), bool)
        odd[np.searchsorted(begin, np.flatnonzero(_odd_bytes(text)), side="right") - 1] = True
        wide = np.where(odd | (size > MATRIX_BYTES), 0, -(-size // WIDTH_STEP) * WIDTH_STEP)
        place, parts, done = np.zeros(len(words), np.int64), [], 0
        for width in range(WIDTH_STEP, MATRIX_BYTES + 1, WIDTH_STEP):
            own = np.flatnonzero(wide == width)
            at = np.minimum(begin[own, None] + np.arange(width), len(text) - 1)
            sym = np.where(np.arange(width) < size[own, None], text[at].astype(np.int32), np.int32(NONE))
            sym[np.arange(len(own)), size[own] - 1] += self.ending
            sym = self.merger.merge(sym)
            there = sym != NONE
            ids = self.id_array[sym[there]].astype("<u4")
            offsets = np.append(0, np.cumsum(there.sum(axis=1))) * 4
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
            place[own] = done + np.arange(len(own))
            done += len(own)
        rest = np.flatnonzero(wide == 0)
        place[rest] = done + np.arange(len(rest))
        parts.append(pa.array([self.unit(w) for w in words.take(pa.array(rest)).to_pylist()], pa.large_binary()))
        return pa.concat_arrays(parts), place


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(where each text begins and the last one ends, the bytes of all) of an Arrow array of large strings."""
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], data


def _odd_bytes(b: np.ndarray) -> np.ndarray:
    """Which bytes belong to no character of ``vocab.PLAIN``, or are apostrophes, which may begin a word of their own."""
    after, before = np.append(b[1:], 0), np.append(0, b[:-1])
    latin = ((b == 0xC3) & (after != 0x97) & (after != 0xB7)) | ((b >= 0x80) & (b < 0xC0) & (before == 0xC3) & (b != 0x97) & (b != 0xB7))
    return ~(((b >= 32) & (b < 127) & (b != 39)) | ((b >= 9) & (b <= 13)) | latin)


def _lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, in lower case; where each text's words begin), cut as ``LOWER_PIECES`` does.

    What stands between white space and has an odd byte is one word here and keeps its case; see ``_odd_bytes``. The last
    array has one entry more than there are texts.
    """
    rows, b = _bytes(texts.cast(pa.large_string()))
    if not len(b):
        return pa.array([], pa.large_string()), np.zeros(len(rows), np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    starts = rows[:-1][rows[:-1] < rows[1:]]
    begins[starts] = ~space[starts]
    number = np.cumsum(begins, dtype=np.int32)
    odd = np.zeros(int(number[-1]) + 1, bool)
    # White space has the number of the word before it, but is never odd.
    odd[number[_odd_bytes(b)]] = True
    odd = odd[number]
    upper = ((b >= 65) & (b <= 90)) | ((b >= 0x80) & (b <= 0x9E))
    low = np.where(upper & ~odd, b + 32, b).astype(np.uint8)
    digit = (b >= 48) & (b <= 57)
    letter = ((low >= 97) & (low <= 122)) | (b >= 0x80)
    kind = np.where(digit, 1, np.where(letter, 2, 3)).astype(np.uint8)
    begins[1:] |= ~space[1:] & ~odd[1:] & ((kind[1:] != kind[:-1]) | digit[1:])
    kept = np.flatnonzero(~space)
    offsets = np.append(np.flatnonzero(begins[kept]), len(kept))
    words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(low[kept]))
    return words, np.append(0, np.cumsum(begins, dtype=np.int64))[rows]


def _joined(values: pa.Array, index: np.ndarray, first: np.ndarray):
    """A function from a text's number to the bytes of its units' ``values``, one after the other."""
    taken = values.take(pa.array(index))
    at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset :] if len(taken) else np.zeros(1, np.int64)
    data = memoryview(taken.buffers()[2] or b"")
    return lambda i: data[at[first[i]] : at[first[i + 1]]]


@lru_cache(maxsize=2)
def codec(file: str) -> Codec:
    return Codec(file)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Per row: ``key``, ids (array of int) and decoded, the text that decoding them gives. No shuffle.

    Null texts count as empty: no identifiers, empty text. Repeated rows and null keys give a row each. Special strings
    inside a text are their own tokens. Words of any length are streamed through ``Transducer``; only short ones are
    remembered. An empty table gives an empty one; other columns are not looked at.
    """
    file = vocab.path(tokenizer)

    def work():
        def batch(texts: pa.Array) -> dict:
            got = [*codec(file).texts(texts)]
            return {"ids": [np.frombuffer(b, dtype="<u4").astype(np.int32) for b, _ in got], "decoded": [bytes(d).decode() for _, d in got]}

        return batch

    return map_text(docs, key, text, "ids array<int>, decoded string", work)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Per row: ``key``, n_tokens, ids_sha256 (of the identifiers as little-endian unsigned 32-bit integers) and decoded_sha256.

    As ``encode``, with digests made where the texts are, so that only these leave a task.
    """
    file = vocab.path(tokenizer)

    def work():
        def batch(texts: pa.Array) -> dict:
            n, ids, decoded = [], [], []
            for b, d in codec(file).texts(texts):
                n.append(len(b) // 4)
                ids.append(hashlib.sha256(b).hexdigest())
                decoded.append(hashlib.sha256(d).hexdigest())
            return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

        return batch

    return map_text(docs, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
