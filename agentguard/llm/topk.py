"""Exact top-k inner products by an impact-ordered score-at-a-time index.

Each task cuts its vectors into blocks and orders a block's postings (vector, dimension, value) by
quantised impact, the size of the value, into segments. All queries of a batch process the segments
by descending impact and add up scores. After each segment a bound on what is left, from the norms
of the query and of the vector's unprocessed part, says which vectors may still reach a query's k-th best
score, counted over distinct ids; processing stops early only when few are possible, and those are scored exactly from their whole
vectors. A vector leaves only on that proof, so the result is exact.

Queries are broadcast in chunks of fixed size; every chunk meets all vectors, block by block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentguard.llm.shared import bounded_batches

SEGMENTS = 6
BLOCK = 4096
QUERY_CHUNK = 8192
QUERY_BATCH = 512
_EXACT = float(1 << 52)


def quantise(rows: list[np.ndarray], width: int, scale: int = 1024) -> np.ndarray:
    """floor(scale * x) of vectors as whole numbers in double precision, short ones filled up with zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, : len(r)] = np.floor(np.asarray(r, dtype=np.float64) * scale)
    return out


class ImpactIndex:
    """Postings of a block in segments of falling impact, and the norm of what each vector has left after each.

    Where ids repeat, the rows of an id lie together and `starts` has the first of each; else it is None.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0)) if len(ids) else np.zeros(0, dtype=int)
        self.starts = starts if len(starts) < len(ids) else None
        if self.starts is not None:
            ids, x = ids[order], x[order]
        self.ids, self.x = ids, x
        size = np.abs(x)
        cuts = np.quantile(size, np.linspace(1, 0, SEGMENTS + 1)[1:-1]) if x.size else np.zeros(SEGMENTS - 1)
        level = np.searchsorted(-cuts, -size, side="left") if x.size else np.zeros(x.shape, dtype=int)
        self.segments = []
        left = (x * x).sum(axis=1)
        for k in range(SEGMENTS):
            part = np.where(level == k, x, 0.0)
            left = np.maximum(0, left - (part * part).sum(axis=1))
            self.segments.append((part, np.sqrt(left)))


class TopK:
    """The k best of each query so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.rows = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)
        self.scores = np.zeros(0, dtype=np.float64)
        self.least = np.full(len(queries), -np.inf)

    def search(self, index: ImpactIndex) -> None:
        q, n = self.queries, len(index.ids) if index.starts is None else len(index.starts)
        own = np.searchsorted(self.query_ids, index.ids)
        own[own == len(self.query_ids)] = 0
        same = np.flatnonzero(self.query_ids[own] == index.ids)
        partial = np.zeros((len(q), len(index.ids)))
        least = self.least
        for step, (part, left) in enumerate(index.segments):
            partial += q @ part.T
            partial[own[same], same] = -np.inf
            last = step == SEGMENTS - 1
            if not last and step < SEGMENTS // 2:
                continue
            slack = 0.0 if last else 1.0 + self.norms[:, None] * left[None, :]
            if n > self.k:
                low = partial - slack
                if index.starts is not None:
                    low = np.maximum.reduceat(low, index.starts, axis=1)
                least = np.maximum(least, np.partition(low, n - self.k, axis=1)[:, n - self.k])
            possible = partial + slack >= least[:, None]
            if last or possible.sum() <= 4 * self.k * len(q):
                break
        possible &= partial > -np.inf
        rows, cols = np.nonzero(possible)
        scores = np.empty(len(rows))
        for at in range(0, len(rows), 1 << 16):
            r, c = rows[at:at + (1 << 16)], cols[at:at + (1 << 16)]
            scores[at:at + (1 << 16)] = (q[r] * index.x[c]).sum(axis=1)
        self.add(rows, index.ids[cols], scores)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, ids, scores = np.concatenate([self.rows, rows]), np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((-scores, ids, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        once = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])) if len(rows) else np.zeros(0, dtype=bool)
        rows, ids, scores = rows[once], ids[once], scores[once]
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - first < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]
        counts = np.bincount(self.rows, minlength=len(self.queries))
        full = np.flatnonzero(counts == self.k)
        ends = np.cumsum(counts) - 1
        self.least[full] = self.scores[ends[full]]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id whose vector has no null and only finite components."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~bad).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of every vector whose id is divisible by `every`.

    Components become floor(scale * x); the score is their inner product; ties go to the smaller id.
    All rows but the query's own id are candidates; fewer than k give fewer rows. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id. A shorter vector counts as filled up with zeros. Rows that
    repeat an id count as one candidate by their best score; of a repeated query id the greatest vector is the
    query. Raises ValueError where scores would exceed 2**52, beyond which doubles are not exact. Empty
    tables give empty results.
    """
    spark = vectors.sparkSession
    rows = bounded_batches(usable(vectors, id_col, vec_col))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.max("vec").alias("vec"))
    chunks = max(1, -(-asked.count() // QUERY_CHUNK))
    schema = "query_id long, vec_id long, score long"
    found = None
    for c in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).toArrow()
        ids = mine.column("id").to_numpy()
        order = np.argsort(ids)
        values = mine.column("vec").to_pylist()
        shared = spark.sparkContext.broadcast((ids[order], [np.array(values[i], dtype=np.float64) for i in order]))
        part = rows.mapInArrow(_searcher(shared, k, scale), schema)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searcher(shared, k: int, scale: int):
    def run(batches):
        import pyarrow as pa

        query_ids, raw = shared.value
        if not len(query_ids):
            return
        tops: list[TopK] = []
        width = 0

        def process(ids, vectors):
            nonlocal tops, width
            need = max(max(map(len, vectors), default=0), max(map(len, raw)))
            if need > width:  # also the first time
                q = quantise(raw, need, scale)
                old, width = tops, need
                tops = [TopK(query_ids[a:a + QUERY_BATCH], q[a:a + QUERY_BATCH], k) for a in range(0, len(q), QUERY_BATCH)]
                for new, was in zip(tops, old, strict=False):
                    new.add(was.rows, was.ids, was.scores)
            x = quantise(vectors, width, scale)
            most = max((float(np.abs(t.queries).max(initial=0)) for t in tops), default=0.0)
            if most * float(np.abs(x).max(initial=0)) * max(1, width) >= _EXACT:
                raise ValueError("scores would exceed what doubles hold exactly")
            index = ImpactIndex(ids, x)
            for t in tops:
                t.search(index)

        held_ids, held = [], []
        for batch in batches:
            own = batch.column("vec")
            ends, flat = own.offsets.to_numpy(), own.values.to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy()
            for i in range(len(ids)):
                held_ids.append(ids[i])
                held.append(flat[ends[i]:ends[i + 1]])
                if len(held) >= BLOCK:
                    process(np.array(held_ids), held)
                    held_ids, held = [], []
        if held:
            process(np.array(held_ids), held)
        for t in tops:
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.query_ids[t.rows], pa.int64()), pa.array(t.ids, pa.int64()), pa.array(t.scores.astype(np.int64), pa.int64())],
                names=["query_id", "vec_id", "score"])

    return run
