"""Sinks: audit tables, quarantine, exports, rotation, SIEM and metrics text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("decision_id", "timestamp", "session_id", "tool", "arguments_hash", "decision", "reason", "policy_version")
CALL_COLUMNS = ("request_json", "response_json")
RFC3339 = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def write_audit(decisions: DataFrame, tool_calls: DataFrame | None, path: str, batch: str) -> None:
    """Decisions and their calls as Parquet in folders `decisions` and `tool_calls`, by batch and date.

    A batch that is written again under its name replaces itself.
    """
    for rows, time, name in ((decisions, "timestamp", "decisions"), (tool_calls, "created_at", "tool_calls")):
        if rows is not None:
            rows.withColumn("date", F.to_date(time)).write.mode("overwrite").partitionBy("date").parquet(f"{path}/{name}/batch={batch}")


def audit_batch_writer(path: str, split=None):
    """`foreachBatch` function in the same layout. `split(frame)` gives (decisions, tool calls or None) of a batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        decisions, calls = split(batch) if split else (batch, None)
        write_audit(decisions, calls, path, str(batch_id))

    return write


def quarantine(df: DataFrame, valid: Column, path: str) -> DataFrame:
    """Write rows that fail the condition (or leave it unknown) as JSON lines; return the others.

    The frame is read twice, once for each side: give one that is a table, not a long computation.
    """
    ok = F.coalesce(valid, F.lit(False))
    df.filter(~ok).write.mode("append").json(path)
    return df.filter(ok)


def export_frame(logs: DataFrame, with_calls: bool = False) -> DataFrame:
    """The exported columns as text; binary payloads are decoded."""
    cols = [F.date_format(c, RFC3339).alias(c) if c == "timestamp" else F.col(c).cast("string").alias(c) for c in CSV_COLUMNS]
    if with_calls:
        cols += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CALL_COLUMNS]
    return logs.select(*cols)


def export_csv(logs: DataFrame, path: str, with_calls: bool = False) -> None:
    export_frame(logs, with_calls).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_json(logs: DataFrame, path: str) -> None:
    logs.write.mode("overwrite").json(path)


def human_text(with_calls: bool = False) -> Column:
    """One text block per decision, for people."""
    def line(label, column):
        return F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) != "", F.concat(F.lit(label), F.col(column).cast("string"), F.lit("\n"))).otherwise(F.lit(""))

    parts = [
        F.concat(F.lit("=== Decision #"), F.col("decision_id").cast("string"), F.lit(" ===\n")),
        F.concat(F.lit("Time: "), F.date_format("timestamp", RFC3339), F.lit("\n")),
        F.concat(F.lit("Session: "), F.coalesce("session_id", F.lit("")), F.lit("\n")),
        F.concat(F.lit("Tool: "), F.coalesce("tool", F.lit("")), F.lit("\n")),
        F.concat(F.lit("Args Hash: "), F.coalesce("arguments_hash", F.lit("")), F.lit("\n")),
        F.concat(F.lit("Decision: "), F.col("decision"), F.lit("\n")),
        line("Reason: ", "reason"),
        line("Policy: v", "policy_version"),
    ]
    if with_calls:
        parts += [line("Request: ", "request_json"), line("Response: ", "response_json")]
    return F.concat(*parts)


def export_text(logs: DataFrame, path: str, with_calls: bool = False) -> None:
    logs.select(human_text(with_calls).alias("value")).write.mode("overwrite").text(path)


def rotate_audit(decisions: DataFrame, export_path: str, now: Column, retention_days: int = 90) -> DataFrame:
    """Rows of days past retention go to compressed JSON lines, one folder a day; gives those days (date, rows).

    Nothing that stays is written anew: the table is partitioned by date, so the caller drops the
    partitions of the days given once the export is verified.
    """
    day = F.to_date("timestamp")
    old = decisions.filter(day < F.date_sub(F.to_date(now), retention_days)).withColumn("date", day)
    old.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("date").json(export_path)
    return old.groupBy("date").agg(F.count("*").alias("rows"))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """Syslog or metrics lines as text files."""
    lines.select(F.col(column).alias("value")).write.mode("append").text(path)


def siem_batch_writer(send, min_severity: int = 4):
    """`foreachBatch` function: `send(frame, batch_id)` receives the OCSF events above the threshold."""
    from agentguard.operators.siem import forward

    def write(batch: DataFrame, batch_id: int) -> None:
        events, _ = forward(batch, min_severity)
        send(events, batch_id)

    return write
