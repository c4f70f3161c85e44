"""Two tables under one commit, hash trees, and counters from tiles."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from agentguard.operators import hashtree, tiles
from agentguard.sources import commits


def audit_rows(spark, n, parts=4):
    return spark.range(n, numPartitions=parts).select(F.col("id").alias("decision_id"), (F.col("id") * 2).alias("v"), F.concat(F.lit("d"), F.col("id")).alias("kind"))


def calls_of(decisions):
    return decisions.select("decision_id", F.lit("{}").alias("request"))


def read(spark, folder, decisions):
    calls = calls_of(decisions)
    return tuple(sorted(r.decision_id for r in commits.read_kind(spark, folder, k, s).collect())
                 for k, s in (("decisions", decisions.schema), ("tool_calls", calls.schema), ("refused", decisions.schema)))


def test_a_batch_is_there_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = audit_rows(spark, 100)
    assert read(spark, folder, rows) == ([], [], [])
    fails = F.udf(lambda i: 1 // (0 if i == 77 else 1), "int")
    with pytest.raises(PySparkException):
        commits.write_batch(rows.withColumn("v", F.col("v") + fails("decision_id")), calls_of(rows), folder, "one")
    assert read(spark, folder, rows) == ([], [], [])
    with pytest.raises(PySparkException):
        commits.write_batch(rows, calls_of(rows).withColumn("request", fails("decision_id").cast("string")), folder, "one")
    assert read(spark, folder, rows) == ([], [], [])
    commits.write_batch(rows, calls_of(rows), folder, "one", valid=F.when(F.col("decision_id") % 10 != 3, True).when(F.col("decision_id") == 3, F.lit(None)))
    want = ([k for k in range(100) if k % 10 != 3], list(range(100)), [k for k in range(100) if k % 10 == 3])
    assert read(spark, folder, rows) == want
    commits.write_batch(audit_rows(spark, 7), None, folder, "one")
    assert read(spark, folder, rows) == want
    commits.write_batch(audit_rows(spark, 2), None, folder, "two")
    assert read(spark, folder, rows) == (sorted([*want[0], 0, 1]), want[1], want[2])
    assert [(m["batch"], m["rows"]["decisions"]) for m in commits.manifests(spark, folder)] == [("one", 90), ("two", 2)]
    named = {f for m in commits.manifests(spark, folder) for fs in m["files"].values() for f in fs}
    assert named <= {f"files/{f}" for f in os.listdir(f"{folder}/files")}
    with pytest.raises(ValueError):
        commits.write_batch(rows, None, folder, "../two")


def test_tree_names_the_ranges_and_looks_at_few_nodes(spark):
    rows = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 97).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("t"))
    extra = spark.createDataFrame([(None, 1, "n"), (-5, 1, "neg")], "k long, v long, t string")
    old = hashtree.digest_tree(rows.unionByName(extra), "k", ["k", "v", "t"], 8, "s")
    same, looked = hashtree.digest_tree(rows.unionByName(extra).repartition(5), "k", ["k", "v", "t"], 8, "s"), []
    assert hashtree.digest_locate(old, same, 8, looked).count() == 0 and sum(looked[1:]) == 0
    changed = rows.where("k <> 20000").withColumn("v", F.when(F.col("k") == 7, 0).otherwise(F.col("v"))).unionByName(
        spark.createDataFrame([(None, 2, "n"), (-5, 1, "neg"), (40_001, 1, None)], "k long, v long, t string"))
    new, looked = hashtree.digest_tree(changed, "k", ["k", "v", "t"], 8, "s"), []
    got = sorted(map(tuple, hashtree.digest_locate(old, new, 8, looked).collect()), key=str)
    assert got == sorted([(0, 8, 8, 8), (20_000, 20_008, 8, 7), (40_000, 40_008, 0, 1), (None, None, 1, 1)], key=str)
    assert len(old) >= 4 and sum(looked) < 4 * 2 * 16 * len(old) < old[0].count() / 3


@pytest.mark.parametrize("window", [(0, 0), (10, 20), (3_600_000_000, 7_200_000_000), (1_800_000_000, 20_000_000_000), (3_599_999_999, 3_600_000_001), (0, 10**12)])
def test_tiles_equal_the_full_scan(spark, tmp_path, window):
    rng = random.Random(1)
    rows = [(rng.randrange(30_000_000_000), rng.choice(["allow", "deny"]), rng.choice(["response_clean", "denylist", None]), rng.choice(["timeout", "response redacted: x", "", None]), rng.random() < 0.3) for _ in range(400)]
    rows += [(t, "deny", "denylist", "", True) for t in (0, 3_600_000_000, 3_599_999_999, 7_200_000_000)]
    df = spark.createDataFrame(rows, "us long, decision string, stage string, reason string, upstream_error boolean").withColumns(
        {"timestamp": F.timestamp_micros("us"), "scanner_type": F.lit(""), "tool": F.lit("t")})
    path = str(tmp_path / "tiles")
    for batch in (0, 1, 1, 0):
        tiles.write_tiles(df.where(F.col("us") % 2 == batch), path, batch)
    start, end = window
    got = {r.metric: r.value for r in tiles.summary(tiles.window_counts(tiles.read_tiles(spark, path), df, start, end)).collect()}
    held = [r for r in rows if start <= r[0] < end]
    assert got["requests"] == len(held) and got["denied"] == sum(r[1] == "deny" for r in held) and got["upstream_errors"] == sum(r[4] for r in held)
    assert got["timeouts"] == sum(r[3] == "timeout" for r in held) and got["responses"] == sum(r[2] == "response_clean" for r in held) and got["crosslayer_sent"] == 0
