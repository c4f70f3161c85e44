"""Encoding, files and counts against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from agentguard.llm import bpe, token_counts, token_files
from agentguard.llm.flat import Spans, codes

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["'s", "'", "re", "'ll", " ", "\n", "é", "é", "Σ", "ς", "İ", "1", "½", "<|endoftext|>", "<|startoftext|>", "<|", "AB", "!!",
         "\x1c", "Ᲊ", "\U0001F600", "漢字", "\x00", "''s", "aaaa", "x" * 60, "ﬁ", "한글", "▁", "</s>", "<unk>", "\r\n", "    ", "def", "the"]


def texts(seed, n=400):
    rng = random.Random(seed)
    return ["", "ab" * 3000, *["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(n)]]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_encoding_equals_the_library(library):
    given = texts(1)
    n, ids, decoded, flat = bpe._digests(given, WORD)
    at = 0
    for k, text in enumerate(given):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n[k], flat[at:at + n[k]].tolist()) == (len(want), want)
        assert ids[k] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        plain = library.decode(want, skip_special_tokens=False)
        assert decoded[k] == hashlib.sha256(plain.encode()).hexdigest() and bpe.decode_ids(want, WORD) == plain
        at += n[k]


def test_merges_one_at_a_time_agree():
    words = ["aaaaaaaaa", "banana", "thethethe", "ab" * 200]
    one = bpe.WordBpe(WORD)
    both = one.encode_words(words)
    one.at_once = False
    assert all((a == b).all() for a, b in zip(both, one.encode_words(words), strict=True))


def test_long_spans_are_told_apart_by_text():
    flat = codes("a" * 60 + " " + "a" * 61 + " " + "a" * 60)
    spans = Spans(flat, np.array([0, 61, 123]), np.array([60, 122, 183]))
    assert spans.which[0] == spans.which[2] != spans.which[1]


def test_round_trip_on_odd_rows(odd, none, library):
    got = sorted([(str(r.doc_id), r.n_tokens, r.ids_sha256) for r in bpe.round_trip(odd, WORD).collect()])
    ids = [(str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in odd.collect()]
    assert got == sorted((i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids)
    assert sorted((str(r.doc_id), list(r.ids)) for r in bpe.encode(odd, WORD).collect()) == sorted(ids)
    assert bpe.round_trip(none, WORD).count() == 0


def test_coder_round_trip_and_checkpoints():
    rng = np.random.default_rng(3)
    counts = np.zeros(5000, dtype=np.int64)
    ids = np.minimum(rng.zipf(1.3, 200_000), 4999)
    np.add.at(counts, ids, 1)
    coder = token_files.Coder(token_files.scaled(counts))
    for n in (0, 1, 63, 64, 65, 5000, 200_000):
        block = token_files.Block(token_files.pack_block(coder, [7], np.array([n]), ids[:n]))
        assert (block.ids(coder) == ids[:n]).all() and block.doc_ids == [7]
        if n:
            assert (np.concatenate([block.section(coder, k) for k in range(len(block.marks))]) == ids[:n]).all()
    data = bytearray(token_files.pack_block(coder, [7], np.array([5000]), ids[:5000]))
    data[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.Block(bytes(data)).ids(coder)
    assert len(token_files.pack_block(coder, [7], np.array([len(ids)]), ids)) < 2 * len(ids)


def test_files_on_odd_rows(odd, none, library):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect()),
                  key=lambda x: (x[0], x[1]))
    got = sorted(token_files.write_and_read(odd, WORD).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i if known else None for known, i, _ in rows]
    at = 0
    for r, (_, _, ids) in zip(got, rows, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_files.write_and_read(none, WORD).count() == 0


def test_pieces_equal_the_library():
    processor, given = token_counts.processor(PIECE), texts(2)
    spans, per_text = token_counts.pre_tokens(given, token_counts.splits_at_line(PIECE))
    counts = token_counts.count_pieces([spans.text(k) for k in range(len(spans.first))], PIECE)[spans.which]
    ends = np.cumsum(per_text)
    assert [int(counts[e - n:e].sum()) for e, n in zip(ends, per_text, strict=True)] == [len(processor.encode(t)) for t in given]


@pytest.mark.parametrize("hot", [0, 5, 1_000_000])
def test_counts_on_odd_rows(odd, none, hot):
    processor = token_counts.processor(PIECE)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, PIECE, limit=20, hot=hot).collect())
    want = [(str(r.doc_id), len((r.text or "").encode()), len(processor.encode(r.text or ""))) for r in odd.collect()]
    assert got == sorted((*w, w[2] > 20) for w in want)
    assert token_counts.count_tokens(none, PIECE).count() == 0
