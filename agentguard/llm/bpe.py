"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every word finds its lowest-ranked
adjacent pair, by binary search of its pairs among the sorted pair keys of the vocabulary, and all
words merge at once; words without a known pair leave the array. Each distinct word is encoded once
per worker; ids of texts are gathered from those.

The vocabulary file is a parameter: a path that exists on every executor. Texts are processed
whole, in Arrow batches cut to a few megabytes.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from agentguard.llm.flat import Spans, byte_batches
from agentguard.llm.shared import bounded_batches
from agentguard.llm.words import IdCache, gather, splitter

_NONE = np.int64(1 << 40)


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself where it is printable, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    signs, extra = [], 256
    for b in range(256):
        signs.append(chr(b if b in printable else extra))
        extra += b not in printable
    return signs


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = max(max(vocab.values()), *(x["id"] for x in spec["added_tokens"]), 0) + 1
        self.tokens = [""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {}
        for x in spec["added_tokens"]:
            self.tokens[x["id"]] = x["content"]
            self.special[x["content"]] = x["id"]
        signs = byte_signs()
        self.inner = np.array([vocab[c] for c in signs], dtype=np.int64)
        self.last = np.array([vocab[c + suffix] for c in signs], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        #: With one merge per token no merge of a round can come before another of the same pair.
        self.at_once = len(np.unique(made)) == len(made)
        self.cache = IdCache()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and ids per word."""
        raw = [b"" if w in self.special else w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(raw)), lengths)
        ends = np.cumsum(lengths)[lengths > 0] - 1
        sym[ends] = self.last[data[ends]]
        done_sym, done_word = [], []
        while len(sym):
            head = np.empty(len(sym), dtype=bool)
            head[0] = True
            np.not_equal(word[1:], word[:-1], out=head[1:])
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), _NONE)
            rank[:-1] = np.where((self.keys[at] == key) & ~head[1:], self.rank[at], _NONE)
            first = np.flatnonzero(head)
            best = np.minimum.reduceat(rank, first)
            run = np.cumsum(head) - 1
            over = (best == _NONE)[run]
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                live = ~over
                if not live.any():
                    break
                at = np.append(at, 0)[live]
                sym, word, rank, run = sym[live], word[live], rank[live], run[live]
            else:
                at = np.append(at, 0)
            hit = np.flatnonzero(rank == best[run])
            hit = hit[rank[hit] < _NONE]
            hit = self._apart(hit, word)
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        extra = [(k, self.special[w]) for k, w in enumerate(words) if w in self.special]
        if extra:
            done_word.append(np.array([k for k, _ in extra]))
            done_sym.append(np.array([i for _, i in extra], dtype=np.int64))
        if not done_sym:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        owner = np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_sym)[order], np.bincount(owner, minlength=len(words))

    def _apart(self, hit: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of the places of the best pair: the leftmost, and those that do not overlap one taken before."""
        if not self.at_once:
            return hit[np.append(True, word[hit[1:]] != word[hit[:-1]])]
        fresh = np.append(True, np.diff(hit) != 1)
        start = hit[fresh][np.cumsum(fresh) - 1]
        return hit[(hit - start) % 2 == 0]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


class _Words(Spans):
    """Distinct words; a special token's place holder reads as its string."""

    names: list[str] = []

    def text(self, k: int) -> str:
        at = int(self.flat[self.starts[self.first[k]]])
        return self.names[at - 0x110000] if at >= 0x110000 else super().text(k)


def distinct_words(texts: list[str], path: str) -> tuple[_Words, np.ndarray]:
    """The words of the texts as spans, and words per text."""
    split = splitter(path)
    flat, starts, stops, per_text = split.split(texts)
    spans = _Words(flat, starts, stops)
    spans.names = [x for x, _ in split.special]
    return spans, per_text


def encode_texts(texts: list[str], path: str, encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and ids per text. `encoder` has `cache` and `encode_words`."""
    spans, per_text = distinct_words(texts, path)
    ids, start, count = encoder.cache.resolve(spans, encoder.encode_words)
    words = gather(ids, start[spans.which], count[spans.which])
    return words, _per_text(count[spans.which], per_text)


def _per_text(counts: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(counts)])
    stops = np.cumsum(per_text)
    return total[stops] - total[stops - per_text]


def decode_ids(ids, path: str) -> str:
    """Text of ids, special tokens included: the token strings joined by a space, as the file has no decoder."""
    tokens = word_bpe(path).tokens
    return " ".join(tokens[i] for i in ids if tokens[i])


def _digests(texts: list[str], path: str) -> tuple[list[int], list[str], list[str], np.ndarray]:
    """Per text: number of ids, digest of the ids, digest of the decoded text; and all ids in turn."""
    bpe = word_bpe(path)
    spans, per_text = distinct_words(texts, path)
    ids, start, count = bpe.cache.resolve(spans, bpe.encode_words)
    own = gather(ids, start, count).tolist()
    ends = np.cumsum(count).tolist()
    tokens, numbers = bpe.tokens, [str(i) for i in range(bpe.size)]
    as_ids, as_text, at = [], [], 0
    for end in ends:
        part = own[at:end]
        as_ids.append(" ".join([numbers[i] for i in part]))
        as_text.append(" ".join([tokens[i] for i in part]))
        at = end
    n = _per_text(count[spans.which], per_text).tolist()
    id_digests, text_digests, at = [], [], 0
    for words in per_text.tolist():
        which = spans.which[at:at + words].tolist()
        at += words
        id_digests.append(hashlib.sha256(" ".join([as_ids[k] for k in which]).encode()).hexdigest())
        text_digests.append(hashlib.sha256(" ".join([as_text[k] for k in which]).encode("utf-8", "surrogatepass")).hexdigest())
    return n, id_digests, text_digests, gather(ids, start[spans.which], count[spans.which])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and `ids` (array of int). Null and empty texts have no ids.

    Ids equal those of the tokenizers library for the file, without added special tokens; strings of
    special tokens inside a text give their ids. Repeated rows stay. Other columns are not read.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        import pyarrow as pa

        bpe = word_bpe(path)
        for batch in byte_batches(batches, text_col):
            ids, n = encode_texts([x or "" for x in batch.column(text_col).to_pylist()], path, bpe)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))],
                names=[id_col, "ids"])

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256 and decoded_sha256, as `encode` and `decode_ids` give them.

    Digests are of the decimal ids joined by a space and of the decoded text in UTF-8; a null or
    empty text has no ids and decodes to an empty text. `with_ids` adds the ids. Repeated rows stay.
    """
    fields = [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType(fields)

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, text_col):
            n, digests, decoded, ids = _digests([x or "" for x in batch.column(text_col).to_pylist()], path)
            columns = [batch.column(id_col), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return bounded_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
