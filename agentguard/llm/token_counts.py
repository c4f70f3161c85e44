"""Token counts of a SentencePiece BPE vocabulary, without ids.

No piece of the vocabulary has a space mark after another sign, nor a line feed beside another
sign, so no merge crosses those places: the text between two of them is a pre-token, and
the number of pieces of a text is the sum over its pre-tokens. Each distinct pre-token of the whole
table is counted once by the library. Documents bring pre-token frequencies: the most widespread
pre-tokens, up to HOT of them, are looked up in a broadcast table of that fixed size, all others are
joined by key and summed per document.

The vocabulary file is a parameter: a path that exists on every executor.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.flat import Spans, byte_batches, codes
from agentguard.llm.shared import bounded_batches, stage

#: Entries of the broadcast table: 9 bytes each.
HOT = 1_000_000
_MARK, _BLANK, _LINE = 0x2581, 0x20, 0x0A


@functools.lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=2)
def splits_at_line(path: str) -> bool:
    """Whether line feeds are safe to split at; raises where the model does not fit this method."""
    from sentencepiece import sentencepiece_model_pb2 as model

    spec = model.ModelProto()
    spec.ParseFromString(processor(path).serialized_model_proto())
    rules = spec.normalizer_spec
    pieces = [p.piece for p in spec.pieces if p.type in (1, 4)]
    if (not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces
            or rules.precompiled_charsmap or spec.trainer_spec.model_type != 2
            or any("▁" in p.lstrip("▁") for p in pieces)):
        raise ValueError("the model's pieces cross spaces or its text is normalised; pre-tokens can't be counted alone")
    return not any("\n" in p for p in pieces)


def pre_tokens(texts: list[str], lines: bool) -> tuple[Spans, np.ndarray]:
    """Pre-tokens of the texts as spans, each text with the leading space it gets, and their number per text."""
    parts, ends, at = [], np.zeros(len(texts), dtype=np.int64), 0
    lead = np.array([_BLANK], dtype=np.uint32)
    for k, text in enumerate(texts):
        if text:
            own = codes(text)
            parts += [lead, own]
            at += 1 + len(own)
        ends[k] = at
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
    if not len(flat):
        return Spans(flat, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), np.zeros(len(texts), dtype=np.int64)
    flat[flat == _MARK] = _BLANK
    blank = flat == _BLANK
    begin = np.empty(len(flat), dtype=bool)
    begin[0] = True
    np.greater(blank[1:], blank[:-1], out=begin[1:])
    begin[ends[:-1][ends[:-1] < len(flat)]] = True
    if lines:
        line = flat == _LINE
        begin |= line
        begin[1:] |= line[:-1]
    starts = np.flatnonzero(begin)
    stops = np.append(starts[1:], len(flat))
    return Spans(flat, starts, stops), np.diff(np.searchsorted(starts, ends, side="left"), prepend=0)


def span_keys(spans: Spans) -> np.ndarray:
    """A 64-bit key of each distinct span, as signed numbers."""
    keys = spans.unique.copy()
    for k in np.flatnonzero(keys == 0):
        keys[k] = int.from_bytes(hashlib.blake2b(spans.text(k).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return keys.view(np.int64)


def count_pieces(tokens: list[str], path: str) -> np.ndarray:
    """Pieces of each pre-token, as it stands inside a text."""
    encode = processor(path).encode
    # The library puts a space before what it is given: a pre-token with a leading space comes without
    # it, another one behind a line feed whose two pieces (the space, the line feed) are taken off.
    behind = np.array([not t.startswith(" ") for t in tokens])
    given = ["\n" + t if b else t[1:] for t, b in zip(tokens, behind, strict=True)]
    counts = np.fromiter(map(len, encode(given, num_threads=1)), dtype=np.int64, count=len(given))
    lone = np.array([t == " " for t in tokens])
    counts[lone] = 1  # the library gives nothing for an empty text
    return counts - behind * len(encode("\n"))


def _distinct(docs: DataFrame, path: str) -> DataFrame:
    """(key, token, batches): every distinct pre-token, with the number of batches that have it."""

    def run(batches):
        import pyarrow as pa

        lines = splits_at_line(path)
        for batch in byte_batches(batches, "text"):
            spans, _ = pre_tokens([x or "" for x in batch.column(0).to_pylist()], lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array(span_keys(spans), pa.int64()), pa.array([spans.text(k) for k in range(len(spans.first))], pa.string())],
                names=["key", "token"])

    rows = bounded_batches(docs).select("text").mapInArrow(run, "key long, token string")
    return rows.groupBy("key", "token").agg(F.count(F.lit(1)).alias("batches"))


def piece_table(docs: DataFrame, path: str) -> DataFrame:
    """(key, n, batches): pieces of every distinct pre-token of all texts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = count_pieces(batch.column("token").to_pylist(), path)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), batch.column("batches")], names=["key", "n", "batches"])

    return stage(_distinct(docs, path).mapInArrow(run, "key long, n long, batches long"), "piece-counts")


def _most_widespread(pieces: DataFrame, hot: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Least number of batches, keys and counts of at most `hot` pre-tokens that the most batches have."""
    sizes = sorted(((r["batches"], r["count"]) for r in pieces.groupBy("batches").count().collect()), reverse=True)
    least, held = 1 << 62, 0
    for batches, count in sizes:
        if held + count > hot:
            break
        held, least = held + count, batches
    found = pieces.where(F.col("batches") >= least).select("key", "n").toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    return least, keys[order], n[order]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, hot: int = HOT) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal the number of pieces that the sentencepiece library gives, without begin and end
    marks. Null and empty texts count 0. Repeated rows and ids stay as they are. An empty table gives
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = piece_table(slim, path)
    _, keys, n = _most_widespread(pieces, hot)
    shared = spark.sparkContext.broadcast((keys, n.astype(np.int32)))
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("known", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType(), False)), T.StructField("counts", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        lines = splits_at_line(path)
        hot_keys, hot_n = shared.value
        for batch in byte_batches(batches, "text"):
            texts = batch.column("text")
            spans, per_text = pre_tokens([x or "" for x in texts.to_pylist()], lines)
            own = span_keys(spans)
            at = np.minimum(np.searchsorted(hot_keys, own), max(0, len(hot_keys) - 1))
            hit = hot_keys[at] == own if len(hot_keys) else np.zeros(len(own), dtype=bool)
            cost = np.where(hit, hot_n[at], 0) if len(hot_keys) else np.zeros(len(own), dtype=np.int64)
            total = np.concatenate([[0], np.cumsum(cost[spans.which])])
            stops = np.cumsum(per_text)
            row = np.repeat(np.arange(len(per_text)), per_text)
            cold = ~hit[spans.which]
            pairs, times = np.unique(row[cold] * np.int64(len(own) + 1) + spans.which[cold], return_counts=True)
            offsets = np.searchsorted(pairs // (len(own) + 1), np.arange(len(per_text) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                pa.array(total[stops] - total[stops - per_text], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(own[pairs % (len(own) + 1)], pa.int64())),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(times, pa.int32()))], names=schema.names)

    counted = stage(slim.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "token-frequencies")
    rare = counted.where(F.size("keys") > 0).select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x"))
    summed = (
        rare.select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("times"))
        .join(pieces.select("key", "n"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more")))
    tokens = F.col("known") + F.coalesce("more", F.lit(0))
    return counted.select("row", "id", "n_bytes", "known").join(summed, "row", "left").select(
        F.col("id").alias(id_col), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
