"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

The documents of a source are permuted by a hash of their id and cut into blocks, ranges of that
hash. Its target says how often the source is read whole and how many more words are to be taken; these
come from the first blocks of the permutation, the last of them filled document by document. A
(block, reading) pair is a unit. The tree then deals the units out: a node with a known number of
units of each source splits its room in two and draws, from the multivariate hypergeometric
distribution, how many units of each source go left, down to single output shards. Every shard
thus owns a range of the units of each source, ranges of a source do not overlap, and every unit
has one shard. A shard orders its documents by a hash of its own.

One row per source, and one per source and shard it draws from, pass through the driver: figures,
never documents. All draws come from `seed`, so a run can be repeated.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentguard.llm.shared import free_name, stage, with_address

BLOCK_DOCS = 64
CUTS = 4096
FILL_DOCS = 4096
UNITS_PER_SHARD = 256
MOST_REPEATS = 3
_WS = r"[\x20\x09-\x0D]"
_NOT_WS = r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but ASCII white space; null has none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{_WS}++", "")
    return F.when(trimmed == "", 0).otherwise(
        F.length(F.regexp_replace(F.concat(trimmed, F.lit(" ")), f"{_NOT_WS}++{_WS}++", "x"))).cast("long")


def cyclic_weights(sources: list[str | None], weights: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """Weights in turn over the sources by code point, null last."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: float(weights[k % len(weights)]) for k, s in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Shares of `total` by weight; none above `most` times its size, the excess shared again by weight."""
    out: dict[str | None, float] = {}
    open_, left = {s for s in sizes if weights[s] > 0}, float(total)
    out.update({s: 0.0 for s in sizes if s not in open_})
    while open_:
        whole = math.fsum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / whole for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
        open_ -= set(over)
        left = total - math.fsum(out.values())
    return out


def split_tree(units: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Units of each source (columns) for each shard (rows); rows differ by at most one unit in all."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = int(units.sum())
    room = np.full(shards, total // shards)
    room[: total % shards] += 1
    out = np.zeros((shards, len(units)), dtype=np.int64)
    nodes = [(0, shards, units.astype(np.int64))]
    while nodes:
        low, high, have = nodes.pop()
        if high - low == 1:
            out[low] = have
            continue
        middle = (low + high) // 2
        left = rng.multivariate_hypergeometric(have, int(room[low:middle].sum()), method="marginals")
        nodes += [(middle, high, have - left), (low, middle, left)]
    return out


def _small_boundary(last: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The part of each source's last block in which its words run out, small enough for one task, and the rows before it.

    A block of many documents is cut again by the hash of its ids, and where these are equal, as for null ids, by that of the row
    numbers. Its first cuts are taken whole, until the next would be too much: so a block may grow with the data, and only
    sums per cut meet in one task.
    """
    whole: list[DataFrame] = []
    depth = 0
    last = stage(last, "mix-boundary")
    while (last.groupBy("source").count().agg(F.max("count")).first()[0] or 0) > FILL_DOCS:
        by = F.xxhash64("place", F.lit(depth)) if depth % 2 == 0 else F.xxhash64("row", F.lit(depth))
        cut = last.withColumn("cut", F.pmod(by, F.lit(CUTS)))
        order = Window.partitionBy("source").orderBy("cut")
        sums = cut.groupBy("source", "cut").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = stage(sums.withColumn("before", before).where(F.col("before") < F.col("left")).select(
            "source", "cut", (F.col("before") + F.col("words") <= F.col("left")).alias("fits"), (F.col("left") - F.col("before")).alias("rest")), "mix-cuts")
        met = stage(cut.join(sums, [cut["source"].eqNullSafe(sums["source"]), cut["cut"] == sums["cut"]]).select(
            cut["source"], "row", "place", "size", F.col("rest").alias("left"), "fits"), "mix-boundary")
        whole.append(met.where("fits").select("row"))
        last, depth = met.where("NOT fits").drop("fits"), depth + 1
    return last, whole


def _fill(left_col: str):
    """Documents of a source's last block: in the order of the permutation, each that still fits."""

    def run(pdf):
        pdf = pdf.sort_values(["place", "size", "row"], kind="stable")
        left = float(pdf[left_col].iloc[0])
        extra = np.zeros(len(pdf), dtype=np.int32)
        sizes = pdf["size"].to_numpy()
        for k, size in enumerate(sizes):
            if 0 < size <= left:
                extra[k], left = 1, left - size
        rest = np.flatnonzero((extra == 0) & (sizes > 0) & (sizes < 2 * left))
        if len(rest):
            extra[rest[np.argmin(np.abs(sizes[rest] - left))]] = 1
        return pdf.assign(extra=extra)[["row", "extra"]]

    return run


def plan_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, seed: int = 20,
                 row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sizes, mixture) of the documents.

    sizes: a row per document with row, id, size (words), source, source_size, target. mixture: a row per
    reading of a document with row, copy (from 0), shard, position (in the shard, from 1), size.
    `row`, a number of its own, tells apart rows that repeat an id; where `row_col` is given, its value comes with every reading
    as `address`. `share` is the part of all words that the mixture holds.

    Null texts have size 0 and are taken as often as their block; a null source is a source of its own, the last. A
    null id is a value like others. Empty tables give empty results. A document is taken at most
    MOST_REPEATS times. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = stage(
        docs.select(F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"), F.col(source_col).alias("source"),
                    F.monotonically_increasing_id().alias("row"), *([F.col(row_col).alias("address")] if row_col else []))
        .withColumn("place", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 52))),
        "mix-sizes")
    stats = {r["source"]: (r["size"], r["n"]) for r in slim.groupBy("source").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = {s: int(v[0] or 0) for s, v in stats.items()}
    goal = targets(sizes, cyclic_weights(list(sizes), weights), share * sum(sizes.values()))
    rows = []
    for s, (size, n) in stats.items():
        whole = min(MOST_REPEATS, int(math.floor(goal[s] / size + 1e-12))) if size else 1
        rest = max(0.0, goal[s] - whole * size) if size and whole < MOST_REPEATS else 0.0
        rows.append((s, int(size or 0), float(goal[s]), whole, rest, int(min(CUTS, max(1, n // BLOCK_DOCS)))))
    plan = stage(spark.createDataFrame(
        rows, "source string, source_size long, target double, whole int, rest double, blocks int").coalesce(1), "mix-plan")
    same = slim["source"].eqNullSafe(plan["source"])
    placed = slim.join(F.broadcast(plan) if len(rows) <= 10_000 else plan, same).drop(plan["source"]).withColumn(
        "block", F.floor(F.col("place") / float(1 << 52) * F.col("blocks")).cast("int"))  # as fractions: the product of both numbers is no long
    order = Window.partitionBy("source").orderBy("block")
    runs = placed.groupBy("source", "block").agg(
        F.sum("size").alias("words"), F.first("whole").alias("whole"), F.first("rest").alias("rest"), F.first("blocks").alias("blocks"))
    upto = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    blocks = stage(
        runs.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        .withColumn("extra", F.when(F.col("rest") <= 0, 0).when(F.col("upto") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 2).otherwise(0))
        .withColumn("left", F.col("rest") - F.col("before"))
        .select("source", "block", "whole", "blocks", "extra", "left"), "mix-blocks")
    key = [placed["source"].eqNullSafe(blocks["source"]), placed["block"] == blocks["block"]]
    last = placed.join(blocks.where("extra = 2"), key).select(placed["source"], "row", "place", "size", "left")
    last, whole_cuts = _small_boundary(last)
    last = last.groupBy("source").applyInPandas(_fill("left"), "row long, extra int").where("extra = 1").select("row")
    filled = stage(functools.reduce(DataFrame.unionByName, whole_cuts, last), "mix-filled")
    copies = (
        placed.join(blocks.select("source", "block", "extra"), key).select(
            "row", "place", "size", *(["address"] if row_col else []), placed["source"], placed["block"], "blocks", "whole", F.col("extra").alias("mode"))
        .join(filled.select("row", F.lit(1).alias("chosen")), "row", "left")
        .withColumn("copies", F.col("whole") + F.when(F.col("mode") == 1, 1).when(F.col("mode") == 2, F.coalesce("chosen", F.lit(0))).otherwise(0)))
    mixture = _deal(copies, blocks, seed)
    return placed.select("row", F.col("id").alias(id_col), "size", "source", "source_size", "target"), mixture


def _deal(copies: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """The readings of all documents with the shard that the tree gives to their unit."""
    spark = copies.sparkSession
    own = blocks.groupBy("source").agg(F.max("blocks").alias("blocks"), F.max("whole").alias("whole"), F.sum((F.col("extra") > 0).cast("int")).alias("more"),
                                       F.max(F.when(F.col("extra") > 0, F.col("block"))).alias("last")).collect()
    own.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    # Units are numbered by reading, then by block; blocks without documents keep their number.
    units = np.array([r["whole"] * r["blocks"] + (r["last"] + 1 if r["last"] is not None else 0) for r in own], dtype=np.int64)
    shards = max(1, -(-int(units.sum()) // UNITS_PER_SHARD)) if len(units) else 1
    dealt = split_tree(units, shards, seed) if len(units) else np.zeros((1, 0), dtype=np.int64)
    ends = np.cumsum(dealt, axis=0)
    ranges = [
        (own[c]["source"], int(s), int(ends[s, c] - dealt[s, c]), int(ends[s, c]))
        for s, c in zip(*np.nonzero(dealt), strict=True)]
    table = stage(spark.createDataFrame(ranges, "source string, shard int, low long, high long").select(
        "source", "shard", F.explode(F.sequence("low", F.col("high") - 1)).alias("unit")), "mix-units")
    readings = copies.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn(
        "unit", F.col("copy").cast("long") * F.col("blocks") + F.col("block"))
    joined = readings.join(table, [readings["source"].eqNullSafe(table["source"]), readings["unit"] == table["unit"]])
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("place", "copy", F.lit(seed + 1)), "row", "copy")
    return joined.select("row", "copy", "shard", F.row_number().over(shuffled).alias("position"), "size", *(["address"] if "address" in copies.columns else []))


def taken_words(sizes: DataFrame, mixture: DataFrame) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words the mixture takes, repeats counted), copies, shards of its readings."""
    per_row = mixture.groupBy("row").agg(
        F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies"), F.array_sort(F.collect_list("shard")).alias("shards"))
    return sizes.join(per_row, "row", "left").drop("row").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).withColumn(
        "copies", F.coalesce("copies", F.lit(0).cast("long"))).withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mixture, each as often as it is taken, with their columns: by shard, and in its order within a shard."""
    placed, name = with_address(docs, "mix-documents")
    _, mixture = plan_mixture(placed, row_col=name, **how)
    shard, position = free_name(placed, "_mix_shard"), free_name(placed, "_mix_position")
    chosen = mixture.select(F.col("address").alias(name + "_taken"), F.col("shard").alias(shard), F.col("position").alias(position))
    taken = placed.join(chosen, placed[name] == chosen[name + "_taken"]).drop(name, name + "_taken")
    return taken.repartitionByRange(shard, position).sortWithinPartitions(shard, position).drop(shard, position)
