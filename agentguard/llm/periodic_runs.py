"""Runs of repeating words, found by recompression.

The words of many documents are numbered and set one after the other, a number of its own between any two documents,
and compressed into one run-length grammar (`grammar.py`). A run of period q that is at least 2q long covers two
neighbours of the grid 0, q, 2q, ...; so the candidates are the neighbours on the grids of all periods that hold the same
word, n log n places in all, of which few are left when a word beside them must agree too. Longest
common extensions by the grammar, to the right and to the left, give each candidate's whole stretch exactly. A stretch found
with several periods has the smallest of them.

Each document is judged by itself, inside the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.flat import byte_batches
from agentguard.llm.grammar import both_ways
from agentguard.llm.shared import bounded_batches

LEAST_LENGTH = 12
GRID_AT_ONCE = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words, with a number that occurs once before, between and after documents; starts and lengths of the documents."""
    known = {word: k for k, word in enumerate(dict.fromkeys(itertools.chain.from_iterable(documents)))}
    parts = [np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)) for words in documents]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    out = np.empty(int(lengths.sum()) + len(parts) + 1, dtype=np.int64)
    border = np.ones(len(out), dtype=bool)
    for start, part in zip(starts.tolist(), parts, strict=True):
        out[start:start + len(part)] = part
        border[start:start + len(part)] = False
    out[border] = len(known) + np.arange(int(border.sum()))
    return out, starts, lengths


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts a, b, ..: which of them, and the number within it, of each of their sum."""
    ends = np.cumsum(counts)
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(int(ends[-1]) if len(ends) else 0) - (ends - counts)[which]


def candidates(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Pairs of places on the grids of all periods, in portions: (document, place, period) with a word, and one beside it, in common."""
    doc, period = _spread(lengths // 2)
    period = period + 1
    places = (lengths[doc] - 1) // np.maximum(period, 1)
    total = np.cumsum(places)
    low = 0
    while low < len(doc):
        base = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, base + GRID_AT_ONCE, side="right")))
        which, k = _spread(places[low:high])
        q = period[low:high][which]
        at = starts[doc[low:high]][which] + q * k
        same = symbols[at] == symbols[at + q]
        at, q, which = at[same], q[same], which[same]
        beside = (q == 1) | (symbols[at + 1] == symbols[at + q + 1]) | (symbols[at - 1] == symbols[at + q - 1])
        if beside.any():
            yield doc[low:high][which[beside]], at[beside], q[beside]
        low = high


def runs_of(documents: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each document, by start, then period."""
    none = np.zeros((0, 3), dtype=np.int64)
    out = [none] * len(documents)
    long = [k for k, words in enumerate(documents) if len(words) >= max(2, least)]
    if not long:
        return out
    symbols, starts, lengths = numbered([documents[k] for k in long])
    right, left = both_ways(symbols)
    found = []
    last = len(symbols) - 1
    for doc, at, q in candidates(symbols, starts, lengths):
        after = right.right(at, at + q)
        before = left.right(last - (at - 1), last - (at + q - 1))
        length = before + q + after
        run = length >= np.maximum(least, 2 * q)
        found.append(np.stack([doc[run], (at - before)[run] - starts[doc[run]], length[run], q[run]], axis=1))
    if not found:
        return out
    rows = np.unique(np.concatenate(found), axis=0)
    # Of equal stretches, sorted by period last, the first has the smallest.
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(long) + 1))
    for k, a, b in zip(long, cuts[:-1], cuts[1:], strict=True):
        out[k] = rows[a:b, 1:]
    return out


def kept_words(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run repeats, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """One row per document: id, runs (start, length, period; by start, then period), collapsed (text without what runs repeat).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of words with smallest period q, at least
    `least` and 2q words long, that no neighbouring word extends keeping q. `collapsed` leaves out every word that some run
    contains after its first q words, and joins the others by one space. Case counts. A long text is
    worked on whole, with memory in proportion to its words. Null and empty texts, and those
    without words, have no runs and an empty `collapsed`. Ids are passed on, null or repeated; every row is judged by itself. An
    empty table gives an empty result. Other columns are not read.
    """
    fields = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("collapsed", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, text_col):
            documents = [(x or "").encode("utf-8", "surrogatepass").split() for x in batch.column(text_col).to_pylist()]
            found = runs_of(documents, least)
            collapsed = [kept_words(words, runs).decode("utf-8", "surrogatepass") for words, runs in zip(documents, found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array([r.tolist() for r in found], pa.list_(pa.list_(pa.int64()))), pa.array(collapsed, pa.string())],
                names=fields.names)

    out = bounded_batches(docs.select(id_col, text_col)).mapInArrow(run, fields)
    as_struct = lambda r: F.struct(r[0].alias("start"), r[1].alias("length"), r[2].alias("period"))
    return out.select(id_col, F.transform("runs", as_struct).cast(RUNS).alias("runs"), "collapsed")


def run_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, n_runs, the longest run (ties: smallest start, then period) and digests of all runs and of the collapsed text."""
    key = lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("s"), r["period"].alias("q"))
    best = F.array_min(F.transform("runs", key))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(F.transform("runs", line), "\n"), F.lit("\n"))).otherwise("")
    length, period = -best["less"], best["q"]
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best["s"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_repeated_ends(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which about one in ten ends in a repetition, told by h = crc32 of the decimal id.

    Where h % 10 is 0, each word from a on becomes word a + (i - a) % p; a = g % n, p = 1 + floor((n - a) / (3 + g % 8)),
    g = floor(h / 10). Other rows, those without words or id included, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words")
    chosen = docs.select(id_col, text_col, F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    placed = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    return placed.select(id_col, F.when(F.col("a").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform("words", word), " ")).alias(text_col))
