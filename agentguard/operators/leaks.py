"""Issued tokens in later texts, whatever their shape: a join on rolling hashes of windows.

Each text is hashed once; from the prefix sums follow the hashes of all its windows of every length that was issued.
Windows and tokens meet by an equi-join on (length, hash), and the text itself decides. Both sides are counted per token before they
are paired, so a token issued and leaked very often costs a row per pair of tools.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentguard.session import staged

#: The base of the polynomial and the multiplier of the finaliser are odd 64-bit numbers without further meaning.
_BASE, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _window_hashes(text: str, lengths):
    """(length, hashes of all windows of that length) of a text."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    power = np.full(len(codes) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(_SPREAD)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mixed * power[:-1], out=sums[1:])
    for n in lengths:
        if 0 < n <= len(codes):
            # Scaled to one power, so that equal windows have equal hashes wherever they stand.
            window = (sums[n:] - sums[:-n]) * power[len(codes) - np.arange(len(codes) - n + 1)]
            yield n, window, np.uint64(pow(_BASE, -len(codes), 2**64))


def _hashes(rows: DataFrame, key: str, text: str, lengths) -> DataFrame:
    """(key, length, hash, at) of the first of each distinct window of the given lengths."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, window, scale in _window_hashes(value or "", lengths):
                    found, at = np.unique(window * scale, return_index=True)
                    size = len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * size, pa.int64()), pa.array(np.full(size, n, dtype=np.int32)), pa.array(found.view(np.int64)), pa.array(at.astype(np.int32))],
                        names=["key", "length", "hash", "at"])

    return rows.select(F.col(key).cast("bigint"), text).mapInArrow(run, "key bigint, length int, hash bigint, at int")


def canary_leaks(issued: DataFrame, responses: DataFrame, body: str = "body") -> DataFrame:
    """(leaked_by, issued_to, leaks): pairs of an issue and a response of another tool that holds its token.

    `issued` has token and tool, `responses` has tool and `body`. A response that holds a token several times counts once, an issue as
    often as it was made. Tokens of any length and shape are found, also inside other words; null and empty ones are nowhere. The
    lengths that occur are read before the join.
    """
    made = staged(issued.where("length(token) > 0").groupBy("token", F.col("tool").alias("issued_to")).agg(F.count("*").alias("n")), "tokens")
    tokens = made.select("token").distinct().withColumn("no", F.monotonically_increasing_id())
    tokens = staged(tokens, "token-numbers")
    lengths = sorted(r[0] for r in tokens.select(F.length("token")).distinct().collect())
    # A text that many responses share is read once.
    texts = staged(responses.where(F.col(body).isNotNull()).groupBy(F.col(body).alias("body")).agg(F.lit(1).alias("one")).withColumn(
        "text_no", F.monotonically_increasing_id()).drop("one"), "leak-texts")
    windows = _hashes(texts, "text_no", "body", lengths)
    keys = _token_hashes(tokens)
    met = windows.join(keys, ["length", "hash"]).select(F.col("key").alias("text_no"), "at", "no", "length")
    held = met.join(texts, "text_no").join(tokens, "no").where(F.substring("body", F.col("at") + 1, F.col("length")) == F.col("token")).select("body", "token").distinct()
    leaked = responses.select(F.col(body).alias("body"), F.col("tool").alias("leaked_by")).groupBy("body", "leaked_by").agg(F.count("*").alias("k"))
    by_token = leaked.join(held, "body").groupBy("token", "leaked_by").agg(F.sum("k").alias("m"))
    pairs = by_token.join(made, "token").where("leaked_by <> issued_to")
    return pairs.groupBy("leaked_by", "issued_to").agg(F.sum(F.col("m") * F.col("n")).alias("leaks"))


def _token_hashes(tokens: DataFrame) -> DataFrame:
    """(no, length, hash) of whole tokens."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for no, token in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, window, scale in _window_hashes(token, [len(token)]):
                    out.append((no, n, int((window * scale).view("i8")[0])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["no", "length", "hash"])

    return tokens.select("no", "token").mapInArrow(run, "no bigint, length int, hash bigint")
