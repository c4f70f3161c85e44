"""SIEM export: OCSF detection findings, severity filter, syslog lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# OCSF identifiers and severities.
OCSF_VERSION = "1.1.0"
CLASS_UID, CATEGORY_UID, ACTIVITY_CREATE = 2004, 2, 1
SEVERITIES = {0: "Unknown", 1: "Informational", 3: "Medium", 4: "High", 5: "Critical"}
PRODUCT = "agentguard"
SYSLOG_PRIORITY = 134


def ocsf_severity(decision: Column, first_scanner: Column, scanner_type: Column) -> Column:
    """Severity number: by the first finding's scanner, else by the audit row's."""
    def by_scanner(c: Column, medium) -> Column:
        return F.when(c.isin("injection", "malware"), 5).when(c.isin("vuln", "secrets"), 4).when(c.isin(*medium), 3)

    return (
        F.when(decision == "allow", 1).when(decision == "redacted", 3)
        .otherwise(F.coalesce(
            by_scanner(first_scanner, ("pii",)), by_scanner(scanner_type, ("pii", "redaction")),
            F.when(decision == "deny", 4), F.lit(0)))
    )


def severity_name(severity: Column) -> Column:
    out = F.lit("Unknown")
    for number, name in SEVERITIES.items():
        out = F.when(severity == number, name).otherwise(out)
    return out


def ocsf_status(decision: Column) -> Column:
    """Struct (id, name): denied 3, redacted 99, else 1."""
    def status(number, name):
        return F.struct(F.lit(number).alias("id"), F.lit(name).alias("name"))

    return F.when(decision == "deny", status(3, "Blocked")).when(decision == "redacted", status(99, "Redacted")).otherwise(status(1, "Success"))


def _pair(name, value) -> Column:
    return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), value.alias("value"))


def to_ocsf(decisions: DataFrame) -> DataFrame:
    """Add severity_id and the finding as nested `ocsf`; absent parts are NULL and left out of the JSON."""
    first = F.get("decision_details.scan_results", F.lit(0))
    severity = ocsf_severity(F.col("decision"), first["scanner"], F.col("scanner_type"))
    df = decisions.withColumn("severity_id", severity)
    sev_name, stage = severity_name(F.col("severity_id")), F.coalesce("decision_details.pipeline_stage", F.lit(""))
    has_finding = F.size("decision_details.scan_results") > 0
    nothing = F.lit(None).cast("string")
    finding = F.when(has_finding, F.struct(
        first["description"].alias("title"), first["rule_id"].alias("uid"), F.array(first["scanner"], first["rule_id"]).alias("types"),
        F.col("reason").alias("desc"), first["confidence"].alias("confidence"), sev_name.alias("severity"),
    )).when(F.col("decision") == "deny", F.struct(
        F.col("reason").alias("title"), stage.alias("uid"), F.array(F.lit("policy"), stage).alias("types"),
        F.col("reason").alias("desc"), nothing.alias("confidence"), nothing.alias("severity"),
    ))
    evidence = F.flatten(F.transform("decision_details.scan_results", lambda r: F.concat(
        F.array(_pair("rule_id", r["rule_id"]), _pair("scanner", r["scanner"]), _pair("confidence", r["confidence"])),
        F.when(F.coalesce(r["match_excerpt"], F.lit("")) != "", F.array(_pair("match_excerpt", r["match_excerpt"]))).otherwise(
            F.array().cast("array<struct<name:string,value:string>>")),
        F.transform(F.array_sort(F.map_entries(r["metadata"])), lambda e: _pair(e["key"], e["value"])),
    )))
    resources = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(kind).alias("type"), F.col(c).alias("name")))
        for kind, c in (("tool", "tool"), ("agent", "agent_name"), ("source", "source"))
    ]))
    overrides = F.col("decision_details.active_overrides")
    unmapped = F.when(has_finding, F.struct(
        stage.alias("pipeline_stage"), F.col("decision_details.eval_duration_ms").alias("eval_duration_ms"),
        F.when(F.size(overrides) > 0, F.array_join(overrides, ", ")).alias("active_overrides")))
    status = ocsf_status(F.col("decision"))
    message = F.concat(F.lit(f"{PRODUCT} "), F.col("decision"), F.lit(": "), F.col("reason"), F.lit(" [tool="), F.col("tool"), F.lit("]"))
    return df.withColumn("ocsf", F.struct(
        F.struct(
            F.lit(OCSF_VERSION).alias("version"),
            F.struct(F.lit(PRODUCT).alias("name"), F.lit(PRODUCT).alias("vendor_name"), F.lit("1.0").alias("version")).alias("product"),
            F.unix_millis(F.current_timestamp()).alias("logged_time"), F.col("correlation_id").alias("correlation_uid"),
            F.lit("detection_finding").alias("event_code"),
        ).alias("metadata"),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias("time"), F.col("severity_id"), sev_name.alias("severity"),
        F.lit(CLASS_UID).alias("class_uid"), F.lit(CATEGORY_UID).alias("category_uid"),
        F.lit(CLASS_UID * 100 + ACTIVITY_CREATE).alias("type_uid"), F.lit(ACTIVITY_CREATE).alias("activity_id"),
        status["id"].alias("status_id"), status["name"].alias("status"), message.alias("message"),
        finding.alias("finding_info"), F.when(has_finding, evidence).alias("evidences"), resources.alias("resources"), unmapped.alias("unmapped"),
    ))


def forward(decisions: DataFrame, min_severity: int = 4) -> tuple[DataFrame, DataFrame]:
    """(events to send as JSON, one row of forwarded and filtered counts)."""
    events = to_ocsf(decisions)
    keep = F.col("severity_id") >= min_severity
    counts = events.agg(F.count_if(keep).alias("forwarded"), F.count_if(~keep).alias("filtered"))
    return events.filter(keep).select("decision_id", F.to_json("ocsf").alias("event")), counts


def to_syslog(ts: Column, message: Column, host: str = PRODUCT, app: str = PRODUCT) -> Column:
    """RFC 5424 line; line breaks in the message are escaped."""
    clean = F.replace(F.replace(message, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.concat(F.lit(f"<{SYSLOG_PRIORITY}>1 "), stamp, F.lit(f" {host} {app} - - - "), clean)
