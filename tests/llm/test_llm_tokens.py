"""Tokenization automaton and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tonearm.llm import bpe_automaton, packing, spans
from tonearm.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

HARD = [
    "", " ", "a b  c", "   ", "x \n\n y\t ", "Σας ΟΔΟΣ", "<|endoftext|>x <|endoftext|>  <|startoftext|>", " 'll don't 123a", "é x   y",
    "ǅ \x1c y\x85z", "😀 日本語 テスト12", "a" * 70, "　a   b", "            indent", "=======--------____", "İstanbul ẞ ß", "it's I'LL we've",
    "foo  bar", "tab\there\r\n  end  ", "﻿bom", "<|endoftext", "word.Word,word;;x",
]


def twins(steps=10):
    """Two words that a polynomial hash modulo 2^64 can't tell apart, whatever its odd base."""
    a, b = "a", "b"
    for _ in range(steps):
        a, b = a + b, b + a
    return a, b


def random_texts(n):
    pick = random.Random(6)
    signs = "abcdeehhtt  in\n.,'<|>é0"
    return ["".join(pick.choice(signs) for _ in range(pick.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_bpe():
    return vocabulary(BYTE_BPE)


@pytest.fixture(scope="module")
def word_bpe():
    return vocabulary(WORD_BPE)


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_ids_of_texts_equal_the_library(kind, byte_bpe, word_bpe, documents):
    definition = byte_bpe if kind == "byte" else word_bpe
    encoder = bpe_automaton.Encoder(definition) if kind == "byte" else packing.Words(definition)
    texts = HARD + random_texts(800) + [r.text for r in documents.limit(60).collect()]
    ids, at = encoder.texts(*spans.utf8(pa.array(texts)))
    for i, want in enumerate(Tokenizer.from_str(definition).encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == want.ids, texts[i]


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_words_with_one_hash_keep_their_own_ids(kind, byte_bpe, word_bpe):
    a, b = twins()
    definition = byte_bpe if kind == "byte" else word_bpe
    encoder = (bpe_automaton.Encoder if kind == "byte" else packing.Words)(definition)
    library = Tokenizer.from_str(definition)
    for texts in ([f"{a} {b} x {a}", b], [a], [f"plain {b}", f" {a}"], [f"{b} {a}"] * 3):
        data, offsets = spans.utf8(pa.array(texts))
        ids, at = encoder.texts(data, offsets)
        got = [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
        assert got == [library.encode(text, add_special_tokens=False).ids for text in texts]


def test_small_automaton_accepts_what_merging_makes():
    """All words over three letters up to eight long, against merging step by step; merges overlap themselves."""
    merges = [("a", "a"), ("b", "a"), ("aa", "a"), ("a", "b"), ("ab", "ba"), ("aa", "aa"), ("c", "c"), ("ba", "ba")]
    names = ["a", "b", "c", *dict.fromkeys(x + y for x, y in merges)]
    number = {x: i for i, x in enumerate(names)}
    automaton = bpe_automaton.Automaton([x.encode() for x in names], [(number[x], number[y], number[x + y]) for x, y in merges])

    def merged(word):
        parts = list(word)
        for x, y in merges:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (x, y):
                    parts[i : i + 2] = [x + y]
                i += 1
        return parts

    words = [""]
    for _ in range(8):
        words = [w + x for w in words for x in "abc"]
        for word in words:
            assert [names[t] for t in automaton.encode(word.encode())] == merged(word)


def test_round_trip_query(spark, byte_bpe, odd_documents, no_documents):
    tokenizer = Tokenizer.from_str(byte_bpe)
    rows = bpe_automaton.round_trip(odd_documents, byte_bpe).collect()
    texts = [r.text or "" for r in odd_documents.select("text").collect()]
    want = sorted((e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)), key=str)
    digests = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(i, skip_special_tokens=False).encode()).hexdigest()) for i in want)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == digests
    assert bpe_automaton.round_trip(no_documents, byte_bpe).count() == 0
    coded = bpe_automaton.encode(odd_documents, byte_bpe)
    back = bpe_automaton.decode(coded, byte_bpe)
    assert sorted(r.text for r in back.collect()) == sorted(texts)


def test_pieces(spark, word_bpe, odd_documents, documents, no_documents):
    tokenizer = Tokenizer.from_str(word_bpe)
    for docs in (odd_documents, documents):
        texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = sorted(((i, tuple([*e.ids, 2])) for (i, _), e in zip(texts, tokenizer.encode_batch([t for _, t in texts], add_special_tokens=False))), key=str)
        pieces = packing.pack(docs, word_bpe).collect()
        # Every id is in exactly one piece (ids repeat among rows, so rows are told apart by their length).
        rest, by_doc = [], {}
        for p in sorted(pieces, key=lambda p: (str(p.doc_id), p.doc_tokens, p.start)):
            by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
            assert len(p.ids) == 4 * p.length
        assert sum(p.length for p in pieces) == sum(len(ids) for _, ids in want)
        for (doc_id, n), own in by_doc.items():
            copies = [ids for i, ids in want if i == doc_id and len(ids) == n]
            for ids in set(copies):
                if len(set(copies)) == 1:
                    for p in own:
                        assert np.frombuffer(p.ids, "<u4").tolist() == list(ids[p.start : p.start + p.length])
                    assert sum(p.length for p in own) == n * len(copies)
        # Sequences have no gap, and are full or a power of two.
        sequences = {}
        for p in pieces:
            sequences.setdefault(p.sequence_id, []).append(p)
        for own in sequences.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= packing.LIMIT and at & (at - 1) == 0
    assert packing.pack(no_documents, word_bpe).count() == 0


def test_checksum(spark, documents, word_bpe):
    from pyspark.sql import functions as F

    for r in packing.pack(documents.limit(3), word_bpe).select("ids", F.crc32("ids").alias("crc")).collect():
        assert r.crc == zlib.crc32(r.ids)


def test_costs_are_balanced():
    lengths = np.random.default_rng(1).integers(1, 3000, 400)
    pieces = packing.assign(lengths, 4096)
    cost = {}
    for _, _, n, seq, _ in pieces:
        cost[seq] = cost.get(seq, 0) + n + n * n / 4096
    full = [c for s, c in cost.items() if sum(p[2] for p in pieces if p[3] == s) == 4096]
    assert max(full) < 1.6 * min(full)
