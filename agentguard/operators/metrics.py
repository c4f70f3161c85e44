"""Counters over audit rows, in long form: (metric, labels, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.functions.labels import normalize_reason

# Histogram bounds in milliseconds.
LATENCY_BOUNDS_MS = (1, 5, 10, 25, 50, 100, 500)
PREFIX = "agentguard_"


def totals(decisions: DataFrame) -> DataFrame:
    """One row: requests, allowed, denied, redacted, timeouts and response counters."""
    decision, reason, stage = F.col("decision"), F.col("reason"), F.col("stage")
    return decisions.agg(
        F.count("*").alias("requests"),
        F.count_if(decision == "allow").alias("allowed"),
        F.count_if(decision == "deny").alias("denied"),
        F.count_if(F.startswith(reason, F.lit("response redacted"))).alias("redacted"),
        F.count_if(F.contains(reason, F.lit("timeout"))).alias("timeouts"),
        F.count_if(F.startswith(stage, F.lit("response"))).alias("responses"),
        F.count_if(F.startswith(stage, F.lit("response")) & (decision == "deny")).alias("responses_blocked"),
    )


def detections(decisions: DataFrame) -> DataFrame:
    """(scanner, action, detections) from the findings of every decision."""
    rows = decisions.select("decision", F.explode("scan_results").alias("r"))
    action = F.when(F.col("decision") == "deny", "blocked").otherwise("redacted")
    return rows.groupBy(F.col("r.scanner").alias("scanner"), action.alias("action")).agg(F.count("*").alias("detections"))


def denied_by_tool(decisions: DataFrame) -> DataFrame:
    return decisions.filter("decision = 'deny' AND tool <> ''").groupBy("tool").agg(F.count("*").alias("denied"))


def denied_by_reason(decisions: DataFrame) -> DataFrame:
    denied = decisions.filter("decision = 'deny' AND reason <> ''")
    return denied.groupBy(normalize_reason(F.col("reason")).alias("reason")).agg(F.count("*").alias("denied"))


def latency_histogram(decisions: DataFrame, latency_ms: Column) -> DataFrame:
    """(le, bucket, n, cumulative): one pass with partial counts, a row per bucket."""
    us = F.floor(latency_ms * 1000)
    bounds = [*LATENCY_BOUNDS_MS, None]
    cumulative = [F.count_if(us < b * 1000) if b else F.count("*") for b in bounds]
    one = decisions.agg(*[c.alias(f"c{i}") for i, c in enumerate(cumulative)], F.sum(us).alias("sum_us"))
    rows = [
        F.struct(
            F.lit("+Inf" if b is None else f"{b / 1000:.3f}").alias("le"), F.lit(i).alias("bucket"),
            (F.col(f"c{i}") - (F.col(f"c{i - 1}") if i else F.lit(0))).alias("n"), F.col(f"c{i}").alias("cumulative"),
            F.col("sum_us").alias("sum_us"))
        for i, b in enumerate(bounds)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def top_rules(decisions: DataFrame, n: int = 10) -> DataFrame:
    """The n rules with most findings; ties by name."""
    rows = decisions.select(F.explode("scan_results").alias("r")).groupBy("r.scanner", "r.rule_id").agg(F.count("*").alias("count"))
    return rows.orderBy(F.col("count").desc(), "scanner", "rule_id").limit(n)


def rule_rollup(decisions: DataFrame) -> DataFrame:
    """Findings per rule, per scanner and in all."""
    rows = decisions.select(F.explode("scan_results").alias("r")).select("r.scanner", "r.rule_id")
    return rows.rollup("scanner", "rule_id").agg(F.count("*").alias("findings"))


def collect_metrics(decisions: DataFrame, latency_ms: Column) -> DataFrame:
    """Every counter as (metric, labels, value), ready for exposition or storage.

    One scan: rows are counted per kind of decision first, then each kind gives its share of every counter.
    """
    reason, stage, denied = F.col("reason"), F.col("stage"), F.col("decision") == "deny"
    us = F.floor(latency_ms * 1000)
    scanners = F.transform("scan_results", lambda r: r["scanner"])
    kinds = decisions.groupBy(
        "decision", F.coalesce("tool", F.lit("")).alias("tool"), F.when(denied & (reason != ""), normalize_reason(reason)).alias("label"),
        F.array_sort(F.coalesce(scanners, F.array().cast("array<string>"))).alias("scanners"),
    ).agg(
        F.count("*").alias("n"), F.count_if(F.startswith(reason, F.lit("response redacted"))).alias("redacted"),
        F.count_if(F.contains(reason, F.lit("timeout"))).alias("timeouts"), F.count_if(F.startswith(stage, F.lit("response"))).alias("responses"),
        *[F.count_if(us < b * 1000).alias(f"c{k}") for k, b in enumerate(LATENCY_BOUNDS_MS)])

    def part(metric: str, value, *pairs) -> Column:
        labels = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs]) if pairs else F.array().cast("array<struct<k:string,v:string>>")
        return F.struct(F.lit(metric).alias("metric"), labels.alias("pairs"), F.coalesce(value, F.lit(0)).cast("bigint").alias("value"))

    n, zero = F.col("n"), F.lit(0)
    fixed = [
        part("requests_total", n), part("decisions_allowed_total", F.when(F.col("decision") == "allow", n)),
        part("decisions_denied_total", F.when(denied, n)), part("decisions_redacted_total", F.col("redacted")),
        part("evaluation_timeouts_total", F.col("timeouts")), part("responses_scanned_total", F.col("responses")),
        part("responses_blocked_total", F.when(denied, F.col("responses")).otherwise(zero)),
        *[part("evaluation_duration_seconds_bucket", F.col(f"c{k}"), ("le", F.lit(f"{b / 1000:.3f}"))) for k, b in enumerate(LATENCY_BOUNDS_MS)],
        part("evaluation_duration_seconds_bucket", n, ("le", F.lit("+Inf"))),
        F.when(denied & (F.col("tool") != ""), part("denied_by_tool_total", n, ("tool", F.col("tool")))),
        F.when(F.col("label").isNotNull(), part("denied_by_reason_total", n, ("reason", F.col("label")))),
    ]
    action = F.when(denied, F.lit("blocked")).otherwise(F.lit("redacted"))
    found = F.transform("scanners", lambda x: part("scanner_detections_total", n, ("scanner", x), ("action", action)))
    rows = kinds.select(F.explode(F.concat(F.array_compact(F.array(*fixed)), found)).alias("r")).select("r.*")
    summed = rows.groupBy("metric", "pairs").agg(F.sum("value").alias("value"))
    return summed.select("metric", F.map_from_entries("pairs").alias("labels"), F.col("value").cast("double").alias("value"))


def to_prometheus(metrics: DataFrame) -> DataFrame:
    """Exposition lines: name{labels} value, labels sorted by name."""
    escaped = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(
        e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    body = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(escaped, ","), F.lit("}"))).otherwise(F.lit(""))
    number = F.format_string("%.0f", F.col("value"))
    return metrics.select(F.concat(F.lit(PREFIX), F.col("metric"), body, F.lit(" "), number).alias("line"))
