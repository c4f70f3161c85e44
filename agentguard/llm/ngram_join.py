"""Near duplicates by the Jaccard similarity of word n-grams, with count-vector R-trees.

The shingles of a document are hashed to groups, and the counts per group are a point. The overlap of
two documents is at most the sum of the smaller coordinates, so a pair that is similar enough has points that
differ by no more than R in all, where R follows from the sizes.

Routing. Groups are gathered into R + 1 blocks per size class. Points that differ by at most R agree
on at least one whole block, so similar documents meet at the key of a block; a document is also sent to the
next size class if a partner may be there. Where a block holds fewer than RICH shingles its key says little:
its documents bring their count vectors, and an R-tree per key tells who may be similar. Where poor blocks
are many, up to ROUNDS groupings with hashes of their own take their place if a similar pair then agrees on a
richer block but for a chance below 1e-12, which compares to that of equal 64-bit hashes. Meeting links
documents into clusters; only clusters are looked at again.

Verification. The documents of a cluster form an R-tree, its nodes bounded by the largest counts
below them. A document visits the nodes whose bound reaches the overlap it needs, and the pairs that
remain are compared by their sets of shingles. Pairs that are linked already through others are passed
over. Larger clusters are cut into tiles, and every two tiles meet in one task; tiles grow with the root of
the cluster, so that neither one task nor the number of times a document is sent grows in proportion to it.

Documents with the same set of shingles form a class and take part once. Shingles are told apart by
64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.components import components
from agentguard.llm.flat import SHORT, byte_batches, mix, short_hashes
from agentguard.llm.shared import bounded_batches, discard, rows_that_stay, stage, with_order

RICH = 3
SURE = 28.0  # expected rich blocks that a similar pair shares, at which poor ones are left out: exp(-28) < 1e-12
ROUNDS = 8
FULL = 5.0  # shingles per block from which poor blocks are rare
LEAST_TILE, MOST_TILE = 128, 2048
TILE_SHINGLES = 4_000_000
SEEN_CLASSES = 200_000
LEAF = 8
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_K1, _K2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


# --- shingles -------------------------------------------------------------------------------


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts, and words per text."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", dtype=np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    hashes = np.zeros(len(starts), dtype=np.uint64)
    short = stops - starts <= SHORT
    hashes[short] = short_hashes(data, starts[short], stops[short])
    for k in np.flatnonzero(~short):
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:stops[k]].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than n words give one shingle, none give none."""
    words, per_text = word_hashes(texts)
    stops = np.cumsum(per_text)
    rolled = words[: max(0, len(words) - n + 1)]
    for k in range(1, n):
        rolled = mix(rolled * _K1 + words[k:len(words) - n + 1 + k])
    out = []
    for stop, count in zip(stops.tolist(), per_text.tolist(), strict=True):
        start = stop - count
        if count >= n:
            out.append(np.unique(rolled[start:stop - n + 1]))
        elif count:
            whole = words[start:start + 1]
            for k in range(1, count):
                whole = mix(whole * _K1 + words[start + k:start + k + 1])
            out.append(mix(whole + np.array([count], dtype=np.uint64) * _K2))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def class_id(shingles: np.ndarray) -> int | None:
    """A number for the set; None for the empty set."""
    if not len(shingles):
        return None
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


# --- routing --------------------------------------------------------------------------------


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b that links them."""
    return -(-percent * (a + b) // (100 + percent))


class Routing:
    """Size classes with their number of blocks, and the keys at which documents meet."""

    def __init__(self, percent: int):
        self.percent = percent
        ratio = max(1.5, 100 / percent)
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, math.floor(bounds[-1] * ratio)))
        self.bounds = np.array(bounds)
        most = 2 * (self.bounds[1:] - 1)
        self.differ = most * (100 - percent) // (100 + percent)
        found = [self._expected(k) for k in range(len(self.differ))]
        rounds = np.array([math.ceil(SURE / e) if e else ROUNDS + 1 for e, _ in found])
        full = np.array([mean >= FULL for _, mean in found])
        #: Groupings per size class, and whether poor blocks are left out.
        self.sure = (rounds == 1) | (rounds <= ROUNDS) & ~full
        self.rounds = np.where(self.sure, rounds, 1)

    def _expected(self, k: int) -> tuple[float, float]:
        """Rich blocks that the least similar pair of a class is expected to share, and shared shingles per block."""
        blocks = float(self.differ[k] + 1)
        if blocks < 2:
            return 0.0, 0.0
        low, thin = math.inf, math.inf
        for b in (int(self.bounds[k]), int(self.bounds[k + 1]) - 1):
            a = -(-self.percent * b // 100)
            shared = needed(a, b, self.percent)
            mean = shared / blocks
            poor = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(RICH))
            low = min(low, blocks * (1 - 1 / blocks) ** (a + b - 2 * shared) * (1 - poor))
            thin = min(thin, mean)
        return low, thin

    def classes(self, n: int) -> list[int]:
        """Size classes in which a set of n shingles may meet another that is not the same."""
        k = int(np.searchsorted(self.bounds, n, side="right")) - 1
        own = [k, k + 1] if 100 * n >= self.percent * int(self.bounds[k + 1]) else [k]
        return [c for c in own if self.differ[c] > 0]

    def keys(self, sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per set: keys of its rich blocks, keys of its poor ones."""
        plan = [(i, c, t) for i, s in enumerate(sets) if len(s) for c in self.classes(len(s)) for t in range(self.rounds[c])]
        rich: list[list[np.ndarray]] = [[] for _ in sets]
        poor: list[list[np.ndarray]] = [[] for _ in sets]
        if plan:
            blocks = np.array([self.differ[c] + 1 for _, c, _ in plan])
            base = np.cumsum(blocks) - blocks
            sizes = np.array([len(sets[i]) for i, _, _ in plan])
            flat = np.concatenate([sets[i] for i, _, _ in plan])
            grouping = mix(np.array([c * (ROUNDS + 1) + t for _, c, t in plan], dtype=np.uint64) * _K2)
            spread = mix(flat ^ np.repeat(grouping, sizes))
            at = np.repeat(base, sizes) + (spread % np.repeat(blocks, sizes).astype(np.uint64)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            total, count = np.zeros(int(blocks.sum()), dtype=np.uint64), np.bincount(at, minlength=int(blocks.sum()))
            firsts = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
            total[at[order][firsts]] = np.add.reduceat(mix(spread * _K1 + np.uint64(7))[order], firsts)
            number = (np.arange(len(total)) - np.repeat(base, blocks)).astype(np.uint64)
            keys = mix(mix(total + number * _K1) + np.repeat(grouping, blocks)).view(np.int64)
            for (i, c, _), b, m in zip(plan, base.tolist(), blocks.tolist(), strict=True):
                own, full = keys[b:b + m], count[b:b + m] >= RICH
                rich[i].append(own[full])
                if not self.sure[c]:
                    poor[i].append(own[~full])
        none = np.zeros(0, dtype=np.int64)
        return [np.concatenate(r) if r else none for r in rich], [np.concatenate(p) if p else none for p in poor]


@functools.lru_cache(maxsize=4)
def routing(percent: int) -> Routing:
    return Routing(percent)


def width(n: int) -> int:
    """Groups of the count vector for sets of about n shingles."""
    return 1 << min(11, max(4, math.ceil(math.log2(max(1, n / 6)))))


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups).astype(np.int32)


# --- the tree -------------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors, packed in order of size and counts; a node knows the largest counts and the sizes below it."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        first = vectors[:, : min(4, vectors.shape[1])].T
        self.order = np.lexsort((*first[::-1], sizes))
        self.vectors, self.sizes = vectors[self.order], sizes[self.order]
        self.levels = []
        top, low, high = self.vectors, self.sizes, self.sizes
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def near(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places (in tree order) of points that may overlap enough."""
        nodes = None
        for top, low, high in self.levels[::-1]:
            nodes = np.arange(len(top)) if nodes is None else self._below(nodes, len(top))
            least = np.maximum(low[nodes], -(-percent * size // 100))
            fits = (100 * high[nodes] >= percent * size) & (100 * size >= percent * low[nodes])
            fits &= np.minimum(top[nodes], vector).sum(axis=1) >= needed(least, size, percent)
            nodes = nodes[fits]
            if not len(nodes):
                return nodes
        points = np.arange(len(self.sizes)) if nodes is None else self._below(nodes, len(self.sizes))
        small, large = np.minimum(self.sizes[points], size), np.maximum(self.sizes[points], size)
        points = points[100 * small >= percent * large]
        bound = np.minimum(self.vectors[points], vector).sum(axis=1)
        may = bound >= needed(self.sizes[points], size, percent)
        return points[may][np.argsort(-bound[may], kind="stable")]

    @staticmethod
    def _below(nodes: np.ndarray, count: int) -> np.ndarray:
        out = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return out[out < count]


def spanning_links(vectors: np.ndarray, sizes: np.ndarray, percent: int, tiles: np.ndarray, similar=None) -> list[tuple[int, int]]:
    """Links that connect what is similar: pairs that pass the bound and `similar`, unless linked already.

    `tiles`: where they differ, only pairs of two tiles count.
    """
    tree = CountTree(vectors, sizes)
    root = np.arange(len(sizes))
    cross = len(np.unique(tiles)) > 1
    links = []
    for i in range(len(sizes)):
        found = tree.order[tree.near(vectors[i], int(sizes[i]), percent)]
        found = found[found != i]
        if cross:
            found = found[tiles[found] != tiles[i]]
        found = found[root[found] != root[i]]
        while len(found):
            j = int(found[0])
            found = found[1:]
            if similar is None or similar(i, j):
                links.append((i, j))
                root[root == root[j]] = root[i]
                found = found[root[found] != root[i]]
    return links


def groups_of(batches, keys: int):
    """Consecutive rows with equal leading columns, of batches sorted by them: lists of columns."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.zeros(batch.num_rows, dtype=bool)
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        own[0] = last is None or tuple(v[0] for v in values) != last
        for v in values:
            own[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(own).tolist(), batch.num_rows]
        if cuts[0] != 0:
            held.append(batch.slice(0, cuts[0]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held = [batch.slice(a, b - a)]
        last = tuple(v[-1] for v in values)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


# --- the join -------------------------------------------------------------------------------


def _describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, cls, rich, poor, vector); keys only with the first document of a class that a task sees."""
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()),
        T.StructField("rich", T.ArrayType(T.LongType(), False)), T.StructField("poor", T.ArrayType(T.LongType(), False)),
        T.StructField("vector", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        route = routing(percent)
        seen: set[int | None] = set()
        for batch in byte_batches(batches, "text"):
            sets = shingle_sets([(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()], words)
            ids = [class_id(s) for s in sets]
            fresh = []
            for s, c in zip(sets, ids, strict=True):
                new = c is not None and c not in seen
                fresh.append(s if new else s[:0])
                if new:
                    if len(seen) >= SEEN_CLASSES:
                        seen.clear()
                    seen.add(c)
            rich, poor = route.keys(fresh)
            vectors = [count_vector(s, 1 << 8).astype("<u2").tobytes() if len(p) else None for s, p in zip(fresh, poor, strict=True)]

            def lists(parts):
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))

            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.int64()),
                lists(rich), lists(poor), pa.array(vectors, pa.binary())], names=schema.names)

    return bounded_batches(docs).mapInArrow(run, schema)


def _possible_links(described: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that meet: at a rich key all with its smallest class, at a poor key what its R-tree lets pass."""
    rich = described.where(F.size("rich") > 0).select("cls", F.explode("rich").alias("key"))
    shared = rich.groupBy("key").agg(F.min("cls").alias("lead"), F.max("cls").alias("top")).where("lead < top").drop("top")
    met = rich.join(shared, "key").where("cls > lead").select(F.col("cls").alias("a"), F.col("lead").alias("b")).distinct()

    def run(batches):
        import pyarrow as pa

        for group in groups_of(batches, 3):
            cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)
            if len(cls) < 2:
                continue
            cross = group.column("low")[0].as_py() != group.column("high")[0].as_py()
            tile = group.column("tile").to_numpy()[first] if cross else np.zeros(len(cls), dtype=int)
            sizes = group.column("n").to_numpy()[first]
            raw = group.column("vector").to_pylist()
            full = np.stack([np.frombuffer(raw[k], dtype="<u2") for k in first]).astype(np.int32)
            groups = min(full.shape[1], width(int(sizes.max())))
            vectors = full.reshape(len(full), -1, groups).sum(axis=1)
            links = spanning_links(vectors, sizes, percent, tile)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cls[i]) for i, _ in links], pa.int64()), pa.array([int(cls[j]) for _, j in links], pa.int64())], names=["a", "b"])

    poor = described.where(F.size("poor") > 0).select(F.explode("poor").alias("key"), "cls", "n", "vector")
    sized = stage(poor.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", _tiles(F.col("m"), F.lit(0)).alias("tiles")), "join-poor-keys")
    placed = poor.join(sized, "key").withColumn("tile", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int"))
    near = _every_two_tiles(placed, "key", "n", "vector").mapInArrow(run, "a long, b long").distinct()
    return met.unionByName(near)


def _tiles(members: Column, shingles: Column) -> Column:
    """Number of tiles of a group with so many members and shingles in all."""
    tile = F.greatest(F.lit(LEAST_TILE), F.least(F.lit(MOST_TILE), 3 * F.sqrt(members)))
    return F.greatest(F.ceil(members / tile), F.ceil(shingles / TILE_SHINGLES)).cast("int")


def _every_two_tiles(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """Rows (group, cls, tile, tiles) at each pair of tiles (low, high) of their group, sorted by pair."""
    both = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        group, F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "cls", "tile", *columns)
    return both.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def _verified_links(docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of classes with similar sets, as a forest of each cluster. `members`: cluster, cls, id, n."""
    sized = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    sized = stage(sized.select("cluster", _tiles(F.col("m"), F.col("w")).alias("tiles")), "join-tiles")
    wanted = members.join(sized, "cluster").select("cluster", "cls", "id", "tiles", F.pmod(F.xxhash64("cls"), F.col("tiles")).cast("int").alias("tile"))
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id"))).select(
        "w.cluster", "w.cls", "w.tiles", "w.tile", "d.text")
    schema = "cluster long, cls long, tiles int, tile int, shingles binary"

    def sets(batches):
        import pyarrow as pa

        for batch in byte_batches(batches, "text"):
            found = shingle_sets([(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()], words)
            # An id may stand for several texts: keep the one of the class.
            own = [k for k, (s, c) in enumerate(zip(found, batch.column("cls").to_pylist(), strict=True)) if class_id(s) == c]
            slim = batch.take(pa.array(own, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*slim.columns[:4], pa.array([found[k].tobytes() for k in own], pa.binary())],
                names=["cluster", "cls", "tiles", "tile", "shingles"])

    def verify(batches):
        import pyarrow as pa

        for group in groups_of(batches, 3):
            cls, first = np.unique(group.column("cls").to_numpy(), return_index=True)
            raw, tile = group.column("shingles"), group.column("tile").to_numpy()[first]
            own = [np.frombuffer(raw[int(k)].as_py(), dtype=np.uint64) for k in first]
            sizes = np.array([len(s) for s in own])
            groups = width(int(sizes.max()))
            vectors = np.stack([count_vector(s, groups) for s in own])
            low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()

            def similar(i, j):
                shared = len(np.intersect1d(own[i], own[j], assume_unique=True))
                return 100 * shared >= percent * (len(own[i]) + len(own[j]) - shared)

            links = spanning_links(vectors, sizes, percent, tile if low != high else np.zeros(len(sizes), dtype=int), similar)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(cls[i]) for i, _ in links], pa.int64()), pa.array([int(cls[j]) for _, j in links], pa.int64())], names=["a", "b"])

    met = _every_two_tiles(texts.mapInArrow(sets, schema), "cluster", "shingles")
    return stage(met.mapInArrow(verify, "a long, b long"), "join-links")


def similar_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles (size of its set) and component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of `words`-word
    shingles; letters A to Z count as lower case, words are runs of anything but ASCII white space.
    component_id is the smallest id reachable by links, the document itself included. A text with fewer
    words is one shingle; a null text, or one without words, has an empty set and stays alone. Null ids
    count as greater than others; a component of null ids only has a null component_id. Rows that repeat an id or a text
    stay; an empty table gives an empty result. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    described = stage(_describe(slim, words, percent), "join-sets")
    clusters = components(_possible_links(described, percent))
    in_cluster = stage(clusters.select(F.col("node").alias("cls"), F.col("root").alias("cluster")), "join-clusters")
    classes = stage(described.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.max("n").alias("n")), "join-classes")
    members = stage(classes.join(in_cluster, "cls"), "join-members")
    roots = components(_verified_links(slim, members, words, percent))
    roots = stage(roots.select(F.col("node").alias("cls"), "root"), "join-roots")
    discard(in_cluster, classes, members)
    labelled = stage(described.select("id", "n", "cls").join(roots, "cls", "left").select(
        "id", "n", F.coalesce("root", "cls").alias("root")), "join-labelled")
    least = stage(labelled.where("root is not null").groupBy("root").agg(F.min("id").alias("least")), "join-least")
    return labelled.join(least, "root", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the smallest id, null ids last; of rows that repeat it any one.

    Rows without words are alike to none, so each stays.
    """
    rows, order = with_order(docs, id_col, "join-documents")
    found = similar_components(rows, words, percent, order, text_col)
    return rows_that_stay(rows, order, found.where(F.col(order) == F.col("component_id")).select(order))
