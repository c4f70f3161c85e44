"""Exact duplicates through an extendible-hash index on shared files.

The pseudokey of a text is the leading bits of its SHA-256. A directory of `2**global_depth`
cells points to buckets; a bucket with more than `bucket_entries` distinct pseudokeys splits on
its next bit, and the directory doubles when the split bucket was as deep as the directory.
All splits follow from the counts per prefix, so the directory is derived in one aggregate over
keys instead of one insert at a time.

Rows meet in the chain of their pseudokey. A chain is the set of different texts, compared byte
by byte, under one pseudokey; copies fall together in each map task before anything is shuffled,
so a text that holds a third of all rows reaches its owner as one entry per map task. The slim
entries (pseudokey, digest, row that stays, size) are then dealt by key range to owner tasks that
write the index files, ordered by bucket and pseudokey. Chains with more than one text
are split by the text itself. The documents look up their entry in those files.

Everything is DataFrame work: no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.llm.shared import rows_that_stay, stage, with_order

KEY_BITS = 60
MAX_DEPTH = 40


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def pseudokey(sha: Column, key_bits: int = KEY_BITS) -> Column:
    """The leading bits of a binary digest as a non-negative long."""
    head = F.conv(F.hex(F.substring(sha, 1, 8)), 16, 2)
    return F.conv(F.substring(F.lpad(head, 64, "0"), 1, key_bits), 2, 10).cast("long")


def build_directory(keys: DataFrame, rows: int, bucket_entries: int, key_bits: int = KEY_BITS) -> tuple[DataFrame, int]:
    """Directory of (cell, bucket, local_depth) and its global depth.

    `keys` has a column `key`; `rows` bounds their number and with it the depth that is counted.
    Cells without keys are left out. Buckets that stay overfull at the deepest level counted are
    kept as they are: their chains are handled all the same.
    """
    deepest = min(MAX_DEPTH, key_bits, 4 + max(0, math.ceil(math.log2(max(1, rows / bucket_entries)))))
    cells = stage(
        keys.select("key").distinct()
        .groupBy(F.shiftright("key", key_bits - deepest).alias("fine")).agg(F.count(F.lit(1)).alias("n")),
        "dedup-cells",
    )
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(deepest - 1)))) if deepest else None
    if levels is None:
        return cells.select(F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("bucket"),
                            F.lit(0).alias("local_depth")).distinct(), 0
    prefix = F.call_function("shiftright", F.col("fine"), F.lit(deepest) - F.col("depth"))
    overfull = (
        levels.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("n"))
        .where(F.col("n") > bucket_entries).select("depth", "prefix")
    )
    split = (
        levels.select("fine", "depth", prefix.alias("prefix")).join(overfull, ["depth", "prefix"])
        .groupBy("fine").agg((F.max("depth") + 1).alias("local_depth"))
    )
    depths = stage(
        cells.join(split, "fine", "left").select("fine", F.coalesce("local_depth", F.lit(0)).alias("local_depth")),
        "dedup-depths",
    )
    depth = depths.agg(F.max("local_depth")).first()[0] or 0
    bucket = F.call_function("shiftright", F.col("fine"), F.lit(deepest) - F.col("local_depth"))
    start = F.call_function("shiftleft", bucket, F.lit(depth) - F.col("local_depth"))
    directory = depths.select(
        F.shiftright("fine", deepest - depth).alias("cell"), start.alias("bucket"), "local_depth"
    ).distinct()
    return stage(directory, "dedup-directory"), depth


def build_index(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, bucket_entries: int, key_bits: int) -> DataFrame:
    """Index entries: key, sha, keep_id, group_size, chain (texts under the key), bucket, local_depth."""
    spark = docs.sparkSession
    rows = keys.count()
    directory, depth = build_directory(keys, rows, bucket_entries, key_bits)
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    keyed = texts.withColumn("key", pseudokey(F.unhex(F.sha2("body", 256)), key_bits))
    chains = keyed.groupBy("key").agg(
        F.collect_set("body").alias("texts"), F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    heads = chains.select(
        "key", "keep_id", "group_size", F.size("texts").alias("chain"),
        F.unhex(F.sha2(F.col("texts")[0], 256)).alias("sha"),
        F.shiftright("key", key_bits - depth).alias("cell"))
    owners = max(1, min(2**depth, max(64, rows >> 20)))
    placed = heads.join(directory, "cell").withColumn("owner", F.floor(F.col("cell") * owners / 2**depth))
    index = stage(
        placed.repartition(owners, "owner").sortWithinPartitions("bucket", "key").drop("owner", "cell"), "dedup-index")
    crowded = index.where("chain > 1").select("key", "chain", "bucket", "local_depth")
    if crowded.isEmpty():
        return index
    links = (
        keyed.join(crowded.select("key"), "key", "left_semi").groupBy("key", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("key", "keep_id", "group_size", F.unhex(F.sha2("body", 256)).alias("sha"))
        .join(crowded, "key")
    )
    return index.where("chain = 1").unionByName(stage(links, "dedup-links"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bucket_entries: int = 1024, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256, chain_length, bucket.

    Texts are equal when identical after white space runs become one space. The smallest id of a
    group stays. Null and empty texts are equal to each other; a text of white space only is one
    space. A null id never counts as the smallest; where a group has only null ids, keep_id is null
    and all its rows are kept. Rows that repeat an id share its verdict. An empty table gives an
    empty result. Other columns are not read.
    """
    keys = stage(
        docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"))
        .withColumn("key", pseudokey(F.col("sha"), key_bits)),
        "dedup-keys",
    )
    index = build_index(docs, keys, id_col, text_col, bucket_entries, key_bits)
    return keys.join(index, ["key", "sha"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("chain").cast("long").alias("chain_length"), "bucket")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: the smallest id, null ids last; of rows that repeat it any one."""
    rows, order = with_order(docs, id_col, "dedup-documents")
    return rows_that_stay(rows, order, exact_dedup(rows, order, text_col).where("kept").select(order))
