"""Differences between policies, and expected outcomes of policy cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentguard.operators.policy import Policy

SCALARS = ("default_action", "evaluation_timeout_ms", "max_message_bytes")
LISTS = ("allowlist", "denylist", "domain_allowlist")
TOGGLES = ("vuln_scan", "prompt_injection", "malware_scan", "secrets_scan", "pii_scan")


def policy_rows(policy_id: str, policy: Policy) -> list[tuple]:
    """A policy in long form: (policy_id, kind, field, value)."""
    rows = [(policy_id, "scalar", f, str(getattr(policy, f))) for f in SCALARS]
    rows += [(policy_id, "scalar", f, "enabled" if getattr(policy, f) is not None else "disabled") for f in TOGGLES]
    rows.append((policy_id, "scalar", "siem.enabled", str(policy.siem_enabled).lower()))
    rows += [(policy_id, "list", f, v) for f in LISTS for v in getattr(policy, f)]
    return rows


def rule_tables(spark: SparkSession, policies: dict[str, Policy]) -> DataFrame:
    """Many policies as one table, keyed by policy_id."""
    rows = [row for name, policy in policies.items() for row in policy_rows(name, policy)]
    return spark.createDataFrame(rows, "policy_id string, kind string, field string, value string")


def diff_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """(field, old_value, new_value, change_type) between two policies in long form."""
    o, n = (t.filter("kind = 'scalar'").select("field", "value") for t in (old, new))
    scalars = o.withColumnRenamed("value", "old_value").join(n.withColumnRenamed("value", "new_value"), "field", "full_outer")
    changed = scalars.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).withColumn("change_type", F.lit("changed"))
    ol, nl = (t.filter("kind = 'list'").select("field", "value") for t in (old, new))

    def summary(rows: DataFrame, sign: str) -> DataFrame:
        grouped = rows.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("v"))
        text = F.concat(F.lit(sign), F.size("v").cast("string"), F.lit(" entries: "), F.array_join("v", ", "))
        return grouped.select("field", text.alias("entries"))

    added = summary(nl.subtract(ol), "+").select(
        "field", F.lit(None).cast("string").alias("old_value"), F.col("entries").alias("new_value"), F.lit("added").alias("change_type"))
    removed = summary(ol.subtract(nl), "").select(
        "field", F.col("entries").alias("old_value"), F.lit(None).cast("string").alias("new_value"), F.lit("removed").alias("change_type"))
    return changed.unionByName(added).unionByName(removed)


def diff_policies(spark: SparkSession, old: Policy, new: Policy) -> DataFrame:
    """What changed from one policy to the other."""
    return diff_tables(rule_tables(spark, {"old": old}), rule_tables(spark, {"new": new}))


def check_cases(actual: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """Cases whose decision is not the expected one; a case without a result is a mismatch too."""
    joined = expected.join(actual.select(key, F.col("decision").alias("actual")), key, "left")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("actual")))
