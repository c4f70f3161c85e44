"""The trie of conversation prefixes, from ternary search trees over range shards.

Turns are dictionary-encoded: each distinct (role, text) has a number, in their order. Conversations are arrays of such
numbers and are sorted by range into shards of about SHARD_TURNS turns, equal ones by their id, so that neither a common
first turn nor a conversation repeated very often makes a shard larger than others. A task builds a ternary search tree over the
distinct sequences of its shard, the median inserted first and then the medians of both sides, and walks it with
a stack: members and smallest ids are counted on the way down, children, leaves and savings on the way back.

Only the prefixes of a shard's first and last sequence can go on in a neighbour. These boundary nodes are merged by key, a few
per shard. The boundary paths are in order, and a node lies on consecutive ones, from the path that owns it on. All
that hangs below it is therefore what its owner holds from its depth on, plus all that the other paths own: two
running sums give the totals without a step per level.

Sequences that agree have equal keys (128 bits of a hash of their turns' numbers, and the depth); unequal ones are taken to
have different keys.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentguard.llm.flat import mix
from agentguard.llm.shared import bounded_batches, discard, stage

SHARD_TURNS = 100_000
ENDS_AT_ONCE = 4096
_INNER, _BOUNDARY, _ENDS = 0, 1, 2
_P1, _P2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def encode_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv, codes (numbers of its turns, in order of turn, null first, then role and text) and sizes (UTF-8 bytes of their texts).

    Null roles and texts are empty. All rows without a conversation id are one conversation, with a null id.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = rows.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = stage(words.withColumn("code", F.monotonically_increasing_id()), "trie-words")
    coded = rows.join(words, ["role", "text"]).select(
        "conv", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "code", F.octet_length("text").cast("long").alias("bytes")).alias("t"))
    return stage(coded.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("t")).select(
        "conv", F.col("t.code").alias("codes"), F.col("t.bytes").alias("sizes")), "trie-conversations")


def with_common_starts(sequences: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """Conversations that begin like the first of their family: its first h turns, then their own after the first h.

    The first of c's family is c - c % `family`; h is crc32 of the decimal c modulo `most` + 1. An absent one gives no turns. A
    conversation without an id stays as it is.
    """
    first = sequences.select(F.col("conv").alias("base"), F.col("codes").alias("base_codes"), F.col("sizes").alias("base_sizes"))
    h = F.coalesce(F.crc32(F.col("conv").cast("string")) % (most + 1), F.lit(0)).cast("int")
    none = F.array().cast("array<bigint>")
    both = sequences.withColumn("h", h).join(first, F.col("conv") - F.col("conv") % family == F.col("base"), "left")
    joined = lambda base, own: F.concat(
        F.slice(F.coalesce(base, none), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))
    return both.select("conv", joined("base_codes", "codes").alias("codes"), joined("base_sizes", "sizes").alias("sizes"))


# --- one shard --------------------------------------------------------------------------------


def _before(a, b) -> bool:
    """Whether a is smaller than b; None is greater than all."""
    return a is not None and (b is None or a < b)


class TernaryTree:
    """Ternary search tree over sequences of numbers. Node 0 is the empty prefix; every other node is a prefix one longer than its parent."""

    def __init__(self):
        self.code, self.lower, self.higher, self.below = [-1], [-1], [-1], [-1]
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        self.members, self.first, self.keys = [0], [None], [(0, 0)]

    def _add(self, parent: int, code: int, size: int, key: tuple[int, int]) -> int:
        for column, value in ((self.code, code), (self.lower, -1), (self.higher, -1), (self.below, -1), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.bytes, size), (self.members, 0), (self.first, None), (self.keys, key)):
            column.append(value)
        return len(self.code) - 1

    def _child(self, node: int, code: int, size: int, key: tuple[int, int]) -> int:
        links, at = self.below, node
        while links[at] >= 0:
            at = links[at]
            if self.code[at] == code:
                return at
            links = self.lower if code < self.code[at] else self.higher
        links[at] = new = self._add(node, code, size, key)
        return new

    def insert(self, codes: list[int], sizes: list[int], keys: list[tuple[int, int]], members: int, first) -> None:
        node = 0
        self.members[0] += members
        if _before(first, self.first[0]):
            self.first[0] = first
        for code, size, key in zip(codes, sizes, keys, strict=True):
            node = self._child(node, code, size, key)
            self.members[node] += members
            if _before(first, self.first[node]):
                self.first[node] = first

    def path(self, codes: list[int]) -> list[int]:
        out = [0]
        for code in codes:
            at = self.below[out[-1]]
            while self.code[at] != code:
                at = self.lower[at] if code < self.code[at] else self.higher[at]
            out.append(at)
        return out

    def in_order(self) -> list[int]:
        """All nodes, parents first and siblings by code."""
        out, stack = [], [~0]
        while stack:
            at = stack.pop()
            if at < 0:
                out.append(~at)
                if self.below[~at] >= 0:
                    stack.append(self.below[~at])
                continue
            if self.higher[at] >= 0:
                stack.append(self.higher[at])
            stack.append(~at)
            if self.lower[at] >= 0:
                stack.append(self.lower[at])
        return out


def prefix_keys(codes: np.ndarray) -> list[tuple[int, int]]:
    """Keys of the prefixes of lengths 1, 2, ... of a sequence."""
    spread = mix(codes.astype(np.uint64) + np.uint64(1))
    halves = []
    for p in (_P1, _P2):
        powers = np.full(len(codes), p, dtype=np.uint64)
        halves.append(mix(np.cumsum(mix(spread + p) * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64)).view(np.int64).tolist())
    return list(zip(*halves, strict=True))


def build_tree(sequences: list[tuple[np.ndarray, np.ndarray, int, object]]) -> TernaryTree:
    """The tree of sorted distinct sequences (codes, sizes, members, smallest id), medians first."""
    tree = TernaryTree()
    stack = [(0, len(sequences))]
    while stack:
        low, high = stack.pop()
        if low < high:
            middle = (low + high) // 2
            codes, sizes, members, first = sequences[middle]
            tree.insert(codes.tolist(), sizes.tolist(), prefix_keys(codes), members, first)
            stack += [(middle + 1, high), (low, middle)]
    return tree


def shard_rows(shard: int, tree: TernaryTree, low: list[int], high: list[int]):
    """Rows of a shard: inner nodes with their totals, boundary nodes with what hangs below them inside the shard. `low`, `high`: first and last sequence."""
    paths = {}
    for number, codes in ((2 * shard, low), (2 * shard + 1, high)):
        for node in tree.path(codes):
            paths[node] = (paths.get(node, (number,))[0], number)
    count = len(tree.code)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    order = tree.in_order()
    for node in reversed(order):
        if node in paths:
            continue
        up = tree.parent[node]
        leaves[node] += not children[node]
        saved[node] += (tree.members[node] - 1) * tree.bytes[node]
        children[up] += 1
        leaves[up] += leaves[node]
        saved[up] += saved[node]
    for node in order:
        up = tree.parent[node]
        inner = node not in paths
        yield (_INNER if inner else _BOUNDARY, tree.depth[node], *tree.keys[node], *(tree.keys[up] if up >= 0 else (None, None)), tree.first[node],
               tree.first[up] if inner and up not in paths else None, inner and up not in paths, tree.members[node], tree.bytes[node],
               children[node], leaves[node], saved[node], *paths.get(node, (None, None)))


def prefix_trie(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of the trie of sequences (conv, codes, sizes).

    nodes: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes in
    its subtree), saved (sum over its subtree of (members - 1) times bytes of the last turn's text), key. The root has depth 0 and no parent.
    ends: key, place, ids: the ids of the conversations that end at a node, ascending by place and inside the arrays.

    A conversation without turns is a member of the root only. A null id counts as a member, is greater than all others and is not
    listed in ends. Equal ids are members each. An empty table gives no nodes, not even a root. A conversation is one array: its turns
    are the only thing that is never divided.
    """
    total = sequences.agg(F.sum(F.size("codes") + 1).alias("n")).first()["n"] or 0
    shards = max(1, -(-total // SHARD_TURNS))
    id_type = sequences.schema["conv"].dataType
    long = T.LongType()
    names = ["kind", "depth", "k1", "k2", "up1", "up2", "first", "up_first", "up_known", "members", "bytes", "children", "leaves", "saved", "path", "path_end"]
    kinds = dict.fromkeys(names, long) | {"first": id_type, "up_first": id_type, "up_known": T.BooleanType()}
    schema = T.StructType([*(T.StructField(n, kinds[n]) for n in names), T.StructField("place", long), T.StructField("ids", T.ArrayType(id_type))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def as_batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

        found, ends, held, shard, place = [], [], [], None, 0

        def end(codes):
            nonlocal held, place
            key = prefix_keys(codes)[-1] if len(codes) else (0, 0)
            ends.append((_ENDS, len(codes), *key, *[None] * 12, (shard << 32) + place, held))
            held, place = [], place + 1

        for batch in batches:
            lengths = np.diff(batch.column("codes").offsets.to_numpy())
            stops = np.cumsum(lengths).tolist()
            codes, sizes = batch.column("codes").flatten().to_numpy(), batch.column("sizes").flatten().to_numpy()
            start = 0
            for k, (stop, conv) in enumerate(zip(stops, batch.column("conv").to_pylist(), strict=True)):
                own = codes[start:stop]
                shard = batch.column("shard")[k].as_py() if shard is None else shard
                if not found or len(own) != len(found[-1][0]) or (own != found[-1][0]).any():
                    if held:
                        end(found[-1][0])
                    found.append([own.copy(), sizes[start:stop].copy(), 0, None])
                found[-1][2] += 1
                if conv is not None:
                    if _before(conv, found[-1][3]):
                        found[-1][3] = conv
                    held.append(conv)
                    if len(held) >= ENDS_AT_ONCE:
                        end(own)
                start = stop
            if ends:
                yield as_batch(ends)
                ends = []
        if not found:
            return
        if held:
            end(found[-1][0])
            yield as_batch(ends)
        tree = build_tree(found)
        rows = []
        for row in shard_rows(shard, tree, found[0][0].tolist(), found[-1][0].tolist()):
            rows.append((*row, None, None))
            if len(rows) >= 10_000:
                yield as_batch(rows)
                rows = []
        if rows:
            yield as_batch(rows)

    dealt = sequences.repartitionByRange(shards, "codes", "conv").sortWithinPartitions("codes", "conv")
    all_rows = stage(bounded_batches(dealt.withColumn("shard", F.spark_partition_id())).mapInArrow(run, schema), "trie-shards")
    boundary, paths = _merge_boundary(all_rows.where(F.col("kind") == _BOUNDARY))
    key = F.struct("depth", "k1", "k2").alias("key")
    merged = stage(_boundary_totals(boundary, paths), "trie-boundary")
    parents = merged.select(F.col("depth").alias("up_depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("first").alias("found_first"))
    inner = all_rows.where(F.col("kind") == _INNER).withColumn("up_depth", F.col("depth") - 1)
    known = inner.where("up_known")
    hung = inner.where("NOT up_known").join(parents, ["up_depth", "up1", "up2"]).withColumn("up_first", F.col("found_first")).drop("found_first")
    top = merged.withColumn("up_depth", F.col("depth") - 1).drop("up_first").join(parents, ["up_depth", "up1", "up2"], "left").withColumnRenamed("found_first", "up_first")
    columns = [F.col("first").alias("conv_id"), "depth", F.col("up_first").alias("parent_conv_id"), F.col("members").alias("n_convs"),
               F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved", key]
    nodes = known.select(*columns).unionByName(hung.select(*columns)).unionByName(top.select(*columns))
    return nodes, all_rows.where(F.col("kind") == _ENDS).select(key, "place", "ids")


def _merge_boundary(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundary nodes, one row each, with all their children; and a row for each boundary path."""
    merged = stage(rows.groupBy("depth", "k1", "k2").agg(
        F.min("first").alias("first"), F.sum("members").alias("members"), F.first("bytes").alias("bytes"), F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("up1").alias("up1"), F.first("up2").alias("up2"),
        F.min("path").alias("path"), F.max("path_end").alias("path_end")), "trie-merged")
    kids = merged.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count(F.lit(1)).alias("more"))
    whole = merged.join(kids, ["depth", "k1", "k2"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0))).drop("more")
    own = whole.withColumns({
        "leaves": F.col("leaves") + (F.col("children") == 0).cast("long"),
        "saved": F.col("saved") + (F.col("members") - 1) * F.col("bytes")})
    return own, rows.select(F.explode(F.array("path", "path_end")).alias("path")).distinct()


def _boundary_totals(own: DataFrame, paths: DataFrame) -> DataFrame:
    """Boundary nodes with leaves and savings of their whole subtrees. The running sum over the paths, two per shard, is one small task."""
    up = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    along = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    per_path = own.groupBy("path").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    zero = F.lit(0)
    upto = paths.join(per_path, "path", "left").select(
        "path", F.sum(F.coalesce("l", zero)).over(along).alias("l"), F.sum(F.coalesce("s", zero)).over(along).alias("s"))
    low, high = upto.select("path", F.col("l").alias("l0"), F.col("s").alias("s0")), upto.select(F.col("path").alias("path_end"), F.col("l").alias("l1"), F.col("s").alias("s1"))
    suffix = own.withColumns({"leaves": F.sum("leaves").over(up), "saved": F.sum("saved").over(up)})
    return suffix.join(low, "path").join(high, "path_end").withColumns({
        "leaves": F.col("leaves") + F.col("l1") - F.col("l0"), "saved": F.col("saved") + F.col("s1") - F.col("s0")}).drop("l0", "s0", "l1", "s1")


def digest_of_ends(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the decimal ids, ascending, joined by commas.

    One task reads all ids of a node, piece by piece, since a digest is a chain; what it holds at a time is one piece.
    """
    schema = T.StructType([ends.schema["key"], T.StructField("ends_sha256", T.StringType())])

    def run(batches):
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            keys, done = [], []
            raw = batch.column("key").to_pylist()
            for key, text in zip(raw, batch.column("text").to_pylist(), strict=True):
                if key != last:
                    if state is not None:
                        keys.append(last)
                        done.append(state.hexdigest())
                    last, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("key").type), pa.array(done)], names=schema.names)
            kind = batch.column("key").type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], kind), pa.array([state.hexdigest()])], names=schema.names)

    text = ends.select("key", "place", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    return text.repartition("key").sortWithinPartitions("key", "place").drop("place").mapInArrow(run, schema)


def trie_digest(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie with a digest of the ids that end there, as columns."""
    nodes, ends = prefix_trie(sequences)
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.join(digest_of_ends(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
