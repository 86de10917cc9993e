"""Counting, encoding and packing against the tokenizers library and by their own rules."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from memspark.llm import codec, packing, token_count, vocab

SPECIAL = "<|endoftext|>"


def texts() -> list[str]:
    r = random.Random(5)
    odd = [*"ab cde thing\n\t'sΣσİéßÀ　漢字😀²Ⅷ1234  ", "\x1c", "\x85", "\xa0", "́", SPECIAL]
    out = ["".join(r.choice(odd) for _ in range(r.randint(0, 60))) for _ in range(400)]
    out += ["".join(r.choice("ab cde'll'VE thing\n\t'séßÀÿ1234 ,.-  ") for _ in range(r.randint(0, 60))) for _ in range(400)]
    out += ["".join(r.choice(["a", "aa", "in", "the", "thin", "er", "z"]) for _ in range(r.randint(300, 2000))) for _ in range(15)]
    return [*out, "a" * 3000, "", " ", "\n", "İ" * 100, f"x{SPECIAL} <|startoftext|>y", "<|ENDOFTEXT|>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_codec_equals_the_library(name):
    file = vocab.path(name)
    library, own = Tokenizer.from_file(file), codec.codec(file)
    some = texts()
    for text, (ids, decoded) in zip(some, own.texts(pa.array(some)), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert bytes(decoded).decode() == library.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_many_texts_at_once_are_encoded_as_by_the_library(name):
    file = vocab.path(name)
    library, own = Tokenizer.from_file(file), codec.codec(file)
    some = [*texts(), "naïve CAFÉ, O'Neil×3÷2 rock'n'roll", "abcdefghijklmnopqrstuvwxyz" * 2, "\x0bab\x00c d\x7fe"]
    for part in (pa.array(some), pa.array(["skipped", *some]).slice(1), pa.array(["", ""]), pa.array([], pa.string())):
        got = [np.frombuffer(ids, "<u4").tolist() for ids in own.encoded(part)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in part.to_pylist()]


def test_packing_remembers_no_common_words():
    own = codec.Codec(vocab.path("word_bpe_49k.json"))
    list(own.encoded(pa.array([" ".join(f"Word{c}x {c}thing," for c in "abcdefgh")])))
    assert not own.seen and not own.words


def test_counts_equal_the_library():
    file = vocab.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(file), token_count.counter(file)
    some = texts()
    assert own.texts(pa.array(some)).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in some]


def test_transducer_holds_a_bounded_window_and_equals_merging_all_at_once():
    own = codec.codec(vocab.path("word_bpe_49k.json"))
    r = random.Random(2)
    word = [ord(c) for c in "".join(r.choice(["in", "the", "thin", "er", "a", "tion"]) for _ in range(3000))]
    machine = codec.Transducer(own.pairs, own.ahead, own.size, own.ending, window=16)
    out, most = [], 0
    for s in word:
        out += machine.push([s])
        most = max(most, len(machine.held))
    out += machine.finish()
    assert out == codec.merge([*word[:-1], word[-1] + own.ending], own.pairs)
    assert most <= own.ahead + 16 + 2


def test_merged_length_is_symbols_less_merges():
    pairs = {1 << 20 | 2: 100, 100 << 20 | 100: 101, 2 << 20 | 1: 102}
    assert token_count.merged_length([1, 2, 1, 2], pairs) == 1
    assert token_count.merged_length([2, 1, 2], pairs) == 2
    assert token_count.merged_length([], pairs) == 0


@pytest.fixture
def odd_docs(spark):
    rows = [(1, "The cat sat."), (2, None), (3, ""), (1, "The cat sat."), (None, "no id"), (4, "word " * 3000), (5, "Straße\n" * 40)]
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, ids string, length int")


def test_queries_on_odd_rows(spark, odd_docs):
    counts = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in token_count.count_tokens(odd_docs).collect()}
    assert counts[2, 0] == counts[3, 0] == (0, False) and counts[4, 15000][1] and counts[1, 12] == (4, False)
    assert codec.round_trip(odd_docs).count() == 7
    back = {r.doc_id: r for r in codec.encode(odd_docs).collect()}
    assert back[2].ids == [] and back[2].decoded == "" and back[1].decoded == "the</w> cat</w> sat</w> .</w>"
    empty = odd_docs.limit(0)
    assert token_count.count_tokens(empty).count() == codec.round_trip(empty).count() == packing.pack_documents(empty).count() == 0


def unpacked(rows, capacity):
    """Check the rules of a packing; return the pieces of each document."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= pieces[0].padded
        assert at <= capacity
    return by_doc, by_sequence


def test_packing_covers_each_document_without_padding(spark):
    r = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["the", "cat", "on", "mat"]) for _ in range(r.choice([0, 3, 40, 900, 5000])))) for i in range(60)] + [(60, None)], "doc_id long, text string").repartition(3, "doc_id")
    rows = packing.pack_documents(docs, capacity=512, with_ids=True).collect()
    by_doc, by_sequence = unpacked(rows, 512)
    library = Tokenizer.from_file(vocab.path("word_bpe_49k.json"))
    for d in docs.collect():
        want = [*library.encode(d.text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[d.doc_id], key=lambda p: p.start)
        assert [i for p in pieces for i in p.ids] == want and pieces[0].doc_tokens == len(want)
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
        assert [p.start for p in pieces] == np.cumsum([0, *[p.length for p in pieces]])[:-1].tolist()
    for pieces in by_sequence.values():
        used = sum(p.length for p in pieces)
        assert used == pieces[0].padded and (used == 512 or used & (used - 1) == 0)


def test_packing_keeps_all_limits_and_whole_documents(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["cat"] * n), r.randint(0, n)) for i, n in enumerate(r.choices(range(1, 90), k=80))]
    docs = spark.createDataFrame([*rows, (80, "cat " * 300, None)], "doc_id long, text string, prompt long").coalesce(1)
    out = packing.pack_documents(docs, capacity=128, segments=3, loss_tokens=60, silent="prompt", cut=False).collect()
    assert len(out) == 81 and all(p.length == p.doc_tokens for p in out)
    silent = {d: p for d, _, p in rows} | {80: 0}
    by_sequence = {}
    for p in out:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for pieces in by_sequence.values():
        loss = sum(p.length - silent[p.doc_id] for p in pieces)
        assert len(pieces) == 1 or sum(p.length for p in pieces) <= 128 and len(pieces) <= 3 and loss <= 60
    assert len(by_sequence) < 60
