"""Readers: message logs, chat bodies, event logs, check-ins, kernel telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentguard.functions.net import long_le_to_ipv4

SECURITY_EVENT = (
    "event_type string, severity string, source string, timestamp string, session_id string, pid int, "
    "tool string, reason string, details map<string,string>, reaction string"
)
CHECKIN = (
    "checkin_id bigint, agent_id string, timestamp timestamp, health_status string, "
    "metrics_summary string, audit_db_size_bytes bigint"
)
METRICS = "struct<decisions_total:bigint,decisions_denied:bigint,scanner_detections:map<string,bigint>,period_seconds:bigint>"
CHAT_REQUEST = "struct<model:string,user:string,messages:array<struct<role:string,content:string>>>"
CHAT_RESPONSE = "struct<choices:array<struct<message:struct<role:string,content:string>>>>"
KERNEL = {
    "exec": "ts timestamp, pid int, ppid int, uid int, comm string, filename string",
    "conn": "ts timestamp, pid int, uid int, daddr bigint, dport int, comm string",
    "file": "ts timestamp, pid int, uid int, flags int, comm string, filename string",
    "setuid": "ts timestamp, pid int, old_uid int, new_uid int, comm string",
}


def local_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A table from the driver's own rows, as a local relation: the optimiser knows its size and broadcasts it if small."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(schema)
    rows = [tuple(r) for r in rows]
    columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(to_arrow_schema(fields))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=to_arrow_schema(fields)), fields)


def read_table(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Parquet table, in the partitions of its files or dealt into a given number of them.

    Pattern matching is bound by CPU: a table that is one row group is worth dealing out, which
    only the caller can know.
    """
    df = spark.read.parquet(path)
    return df.repartition(partitions) if partitions else df


def read_messages(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON-RPC messages, one per line, as `raw`; parsing is left to the decision step."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "raw").filter(F.trim("raw") != "")


def over_size(raw: Column, max_bytes: int) -> Column:
    """Message longer than the policy allows, in bytes."""
    return F.octet_length(raw) > max_bytes


def chat_request(body: Column) -> Column:
    """Chat body as a struct; NULL fields where it is not JSON."""
    return F.from_json(body, CHAT_REQUEST)


def user_text(messages: Column) -> Column:
    """All user turns of a chat, each followed by a space."""
    turns = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit("")))
    return F.when(F.size(turns) > 0, F.concat(F.array_join(turns, " "), F.lit(" "))).otherwise(F.lit(""))


def response_content(body: Column) -> Column:
    """Content of the first choice of a chat response; empty when there is none."""
    return F.coalesce(F.get(F.from_json(body, CHAT_RESPONSE)["choices"], F.lit(0))["message"]["content"], F.lit(""))


def conversation_user_text(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """User text per conversation from one row per turn."""
    grouped = turns.filter("role = 'user'").groupBy(conv).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("text").alias("x")))).alias("t"))
    return grouped.select(conv, F.concat(F.array_join(F.transform("t", lambda s: s["x"]), " "), F.lit(" ")).alias("user_text"))


def event_problem(line: Column, event_type: Column, max_bytes: int | None = None) -> Column:
    """Why a line is no security event: `too_long`, `no_event_type`, or NULL."""
    long = F.octet_length(line) > max_bytes if max_bytes else F.lit(False)
    return F.when(long, "too_long").when(event_type.isNull(), "no_event_type")


def read_security_event_lines(spark: SparkSession, path: str, streaming: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Every NDJSON line with its fields and `problem`, which is NULL for a security event."""
    reader = spark.readStream if streaming else spark.read
    parsed = reader.text(path).select(F.col("value").alias("line"), F.from_json("value", SECURITY_EVENT).alias("e")).select("line", "e.*")
    ts = F.coalesce(F.try_to_timestamp("timestamp"), F.current_timestamp())
    return parsed.withColumns({"ts": ts, "problem": event_problem(F.col("line"), F.col("event_type"), max_bytes)}).drop("timestamp")


def read_security_events(spark: SparkSession, path: str, streaming: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Security events; a missing time becomes now.

    Lines that are none, or longer than `max_bytes` if that is given, are those that
    `rejected_events` counts and `read_security_event_lines` holds for a quarantine.
    """
    return read_security_event_lines(spark, path, streaming, max_bytes).filter("problem IS NULL").drop("problem", "line")


def rejected_events(lines: DataFrame) -> DataFrame:
    """(problem, lines) over the lines that are no security events."""
    return lines.filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("lines"))


def read_checkins(spark: SparkSession, path: str) -> DataFrame:
    """Fleet check-ins with their metrics parsed; rows with malformed metrics keep NULL there."""
    df = spark.read.schema(CHECKIN).json(path)
    return df.withColumn("metrics", F.from_json(F.coalesce("metrics_summary", F.lit("{}")), METRICS))


def read_kernel_events(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Kernel telemetry of one kind; connection targets become dotted addresses."""
    df = spark.read.schema(KERNEL[kind]).json(path)
    return df.withColumn("dest_ip", long_le_to_ipv4(F.col("daddr"))) if kind == "conn" else df
