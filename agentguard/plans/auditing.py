"""Audit, metrics, SIEM and integrity queries over decisions derived from the event table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from agentguard.functions import jsonfuncs, labels, text as tx
from agentguard.operators import audit, hashtree, leaks, listing, metrics, siem, tiles
from agentguard.operators.ordered import micros
from agentguard.operators.scan import NO_METADATA
from agentguard.plans import inputs
from agentguard.plans.base import q, register, table
from agentguard.session import shared_dir
from agentguard.sources import commits, sinks

# Audit rows as SQL text for both engines; findings are two plain columns here.
DECISIONS = """
SELECT d.*, CASE
    WHEN reason LIKE 'prompt_injection%' THEN 'injection' WHEN reason LIKE 'malware_scan%' THEN 'malware'
    WHEN reason LIKE 'vuln_scan%' THEN 'vuln' WHEN reason LIKE 'secrets_scan%' THEN 'secrets'
    WHEN reason LIKE 'pii_scan%' THEN 'pii' WHEN reason LIKE 'response redacted%' THEN 'redaction' ELSE '' END AS scanner_type
FROM (
  SELECT event_id AS decision_id, ts AS timestamp, user_id, value AS eval_ms,
    concat('s', CAST(user_id AS STRING)) AS session_id,
    CASE event_id % 5 WHEN 0 THEN 'chat.send' WHEN 1 THEN 'tools.invoke' WHEN 2 THEN 'file.read' WHEN 3 THEN 'web.get' ELSE 'search.query' END AS tool,
    concat('{"user":"', CAST(user_id AS STRING), '","api_key":"t', CAST(event_id AS STRING), '","k":', regexp_extract(props, '[0-9]+', 0), '}') AS params,
    CASE WHEN event_type IN ('error', 'signup') THEN 'deny' ELSE 'allow' END AS decision,
    CASE
      WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'prompt_injection: role override attempt detected'
        WHEN 1 THEN 'vuln_scan: SQL injection detected' WHEN 2 THEN 'malware_scan: signature match' WHEN 3 THEN 'secrets_scan: github token detected' ELSE 'pii_scan: Email Address detected' END
      WHEN event_type = 'signup' THEN CASE user_id % 4 WHEN 0 THEN 'tool explicitly denied by denylist' WHEN 1 THEN 'tool not in allowlist'
        WHEN 2 THEN 'evaluation timeout exceeded' ELSE 'sensitive data detected in arguments' END
      WHEN event_type = 'purchase' THEN 'response redacted: PII redacted: [Email Address]'
      WHEN event_type = 'view' THEN 'response clean' ELSE 'default allowed' END AS reason,
    CASE
      WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'injection_scan' WHEN 1 THEN 'vuln_scan' WHEN 2 THEN 'malware_scan' WHEN 3 THEN 'secrets_scan' ELSE 'pii_scan' END
      WHEN event_type = 'signup' THEN CASE user_id % 4 WHEN 0 THEN 'denylist' WHEN 1 THEN 'allowlist' WHEN 2 THEN 'timeout' ELSE 'arg_filter' END
      WHEN event_type = 'purchase' THEN 'response_redaction' WHEN event_type = 'view' THEN 'response_clean' ELSE 'default_action' END AS stage,
    CASE WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'injection' WHEN 1 THEN 'vuln' WHEN 2 THEN 'malware' WHEN 3 THEN 'secrets' ELSE 'pii' END
      WHEN event_type = 'purchase' THEN 'pii' END AS finding_scanner,
    CASE WHEN event_type = 'error' THEN CASE user_id % 5 WHEN 0 THEN 'role_override' WHEN 1 THEN 'sqli' WHEN 2 THEN 'signature_match' WHEN 3 THEN 'github_personal_access_token' ELSE 'email_address' END
      WHEN event_type = 'purchase' THEN 'email_address' END AS finding_rule,
    concat('agent', CAST(user_id % 7 AS STRING)) AS agent_name, 'bridge' AS source, 'ab12cd34' AS policy_version
  FROM @events@
) d
"""
SQL_DECISIONS = "(" + DECISIONS.replace("@events@", "events") + ")"


def decisions(spark, sf):
    """Audit rows with their findings as an array."""
    df = inputs.run_sql(spark, DECISIONS, events=table(spark, sf, "events"))
    finding = F.expr(
        "array_compact(array(CASE WHEN finding_scanner IS NOT NULL THEN named_struct('scanner', finding_scanner, 'rule_id', finding_rule, "
        f"'description', reason, 'match_excerpt', '****', 'confidence', 'high', 'blocked', decision = 'deny', 'metadata', {NO_METADATA}) END))")
    details = F.struct(
        F.col("stage").alias("pipeline_stage"), F.col("eval_ms").alias("eval_duration_ms"), F.col("scan_results"),
        F.array().cast("array<string>").alias("active_overrides"))
    return df.withColumn("scan_results", finding).withColumn("decision_details", details.cast(audit.DETAIL)).withColumn(
        "correlation_id", F.lit(None).cast("string"))


def hashed(spark, sf):
    return decisions(spark, sf).withColumn("arguments_hash", jsonfuncs.hash_arguments(F.col("params")))


_SQL_HASH = "sha256(concat('{\"api_key\":\"[REDACTED]\",\"k\":', regexp_extract(params, '\"k\":([0-9]+)', 1), ',\"user\":\"', user_id::VARCHAR, '\"}'))"


@register("args_hash", f"SELECT decision_id, {_SQL_HASH} AS arguments_hash FROM {SQL_DECISIONS}")
def args_hash(spark, sf):
    return hashed(spark, sf).select("decision_id", "arguments_hash")


@register("args_hash_flat", f"SELECT decision_id, '{{\"api_key\":\"[REDACTED]\",\"k\":\"' || regexp_extract(params, '\"k\":([0-9]+)', 1) || '\",\"user\":\"' || user_id || '\"}}' AS args FROM {SQL_DECISIONS}")
def args_hash_flat(spark, sf):
    return decisions(spark, sf).select("decision_id", jsonfuncs.redact_flat_json(F.col("params")).alias("args"))


@register("audit_query", f"""
    SELECT decision_id, timestamp, session_id, tool, decision, reason FROM {SQL_DECISIONS}
    WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp <= TIMESTAMP '2024-01-20' AND decision = 'deny' AND tool ILIKE '%file%' AND scanner_type = 'vuln'
""")
def audit_query(spark, sf):
    rows = audit.query(decisions(spark, sf), since="2024-01-05", until="2024-01-20", decision="deny", tool="FILE", scanner="vuln", rule_id="sqli", ordered=False)
    return rows.select("decision_id", "timestamp", "session_id", "tool", "decision", "reason")


@register("audit_latest", f"SELECT decision_id, timestamp, tool, decision FROM {SQL_DECISIONS} ORDER BY timestamp DESC, decision_id DESC LIMIT 100")
def audit_latest(spark, sf):
    return audit.query(decisions(spark, sf), limit=100).select("decision_id", "timestamp", "tool", "decision")


@register("audit_recent", f"SELECT decision_id, timestamp, coalesce(NULL, '') AS correlation_id, source FROM {SQL_DECISIONS} WHERE timestamp >= TIMESTAMP '2024-01-10' ORDER BY timestamp DESC, decision_id DESC LIMIT 5000")
def audit_recent(spark, sf):
    return audit.recent(decisions(spark, sf), since="2024-01-10", source="bridge", limit=5000).select("decision_id", "timestamp", "correlation_id", "source")


_CALLS = "SELECT event_id AS decision_id, CAST(ts AS TIMESTAMP) AS created_at, props AS request_json, CASE WHEN event_id % 3 = 0 THEN concat('{\"v\":', CAST(user_id AS STRING), '}') END AS response_json FROM @events@"


@register("decisions_with_calls", f"""
    SELECT d.decision_id, d.decision, c.request_json, c.response_json FROM (SELECT * FROM {SQL_DECISIONS} WHERE decision = 'deny') d
    LEFT JOIN ({_CALLS.replace('@events@', 'events')}) c ON d.decision_id = c.decision_id
""")
def decisions_with_calls(spark, sf):
    calls = inputs.run_sql(spark, _CALLS, events=table(spark, sf, "events"))
    return audit.query(decisions(spark, sf), calls, decision="deny", ordered=False).select("decision_id", "decision", "request_json", "response_json")


@register("audit_sessions", f"""
    SELECT session_id, min(timestamp) AS first_at, max(timestamp) AS last_at, count(*) AS decisions, count_if(decision = 'deny') AS denied
    FROM {SQL_DECISIONS} WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20' GROUP BY session_id
""")
def audit_sessions(spark, sf):
    return listing.sessions(decisions(spark, sf), "2024-01-05", "2024-01-20")


@register("audit_search", f"SELECT decision_id, tool, reason FROM {SQL_DECISIONS} WHERE (tool ILIKE '%SQL%' OR reason ILIKE '%SQL%') AND decision = 'deny'")
def audit_search(spark, sf):
    return audit.text_search(decisions(spark, sf), "sql", decision="deny").select("decision_id", "tool", "reason")


@register("export_rows", f"""
    SELECT decision_id::VARCHAR AS decision_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, session_id, tool, {_SQL_HASH} AS arguments_hash, decision, reason, policy_version FROM {SQL_DECISIONS}
""")
def export_rows(spark, sf):
    return sinks.export_frame(hashed(spark, sf))


@register("export_text", f"""
    SELECT decision_id, '=== Decision #' || decision_id || ' ===' || chr(10) || 'Time: ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') || chr(10) || 'Session: ' || session_id || chr(10)
      || 'Tool: ' || tool || chr(10) || 'Args Hash: ' || {_SQL_HASH} || chr(10) || 'Decision: ' || decision || chr(10) || 'Reason: ' || reason || chr(10) || 'Policy: v' || policy_version || chr(10) AS block
    FROM {SQL_DECISIONS}
""")
def export_text(spark, sf):
    return hashed(spark, sf).select("decision_id", sinks.human_text().alias("block"))


@register("encrypt_roundtrip", f"SELECT count(*) AS rows, count(*) AS restored, count(*) AS plain_kept, count(*) AS marked FROM {SQL_DECISIONS}")
def encrypt_roundtrip(spark, sf):
    key = F.unhex(F.sha2(F.lit("demonstration key"), 256))
    rows = decisions(spark, sf).withColumn("box", audit.encrypt(F.col("params"), key))
    back = audit.decrypt(F.col("box"), key).cast("string")
    plain = audit.decrypt(F.col("params").cast("binary"), key).cast("string")
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(back == F.col("params")).alias("restored"),
        F.count_if(plain == F.col("params")).alias("plain_kept"), F.count_if(F.startswith(F.hex("box"), F.lit("01"))).alias("marked"))


@register("decision_totals", f"""
    SELECT count(*) AS requests, count_if(decision = 'allow') AS allowed, count_if(decision = 'deny') AS denied,
      count_if(reason LIKE 'response redacted%') AS redacted, count_if(reason LIKE '%timeout%') AS timeouts,
      count_if(stage LIKE 'response%') AS responses, count_if(stage LIKE 'response%' AND decision = 'deny') AS responses_blocked FROM {SQL_DECISIONS}
""")
def decision_totals(spark, sf):
    return metrics.totals(decisions(spark, sf))


@register("scanner_detections", f"SELECT finding_scanner AS scanner, CASE decision WHEN 'deny' THEN 'blocked' ELSE 'redacted' END AS action, count(*) AS detections FROM {SQL_DECISIONS} WHERE finding_scanner IS NOT NULL GROUP BY ALL")
def scanner_detections(spark, sf):
    return metrics.detections(decisions(spark, sf))


@register("denied_by_tool", f"SELECT tool, count(*) AS denied FROM {SQL_DECISIONS} WHERE decision = 'deny' GROUP BY tool")
def denied_by_tool(spark, sf):
    return metrics.denied_by_tool(decisions(spark, sf))


_SQL_LABEL = """CASE WHEN stage = 'injection_scan' THEN 'injection' WHEN stage = 'malware_scan' THEN 'malware' WHEN stage = 'vuln_scan' THEN 'vuln'
    WHEN stage = 'secrets_scan' THEN 'secrets' WHEN stage = 'pii_scan' THEN 'pii' WHEN stage = 'denylist' THEN 'denylist' WHEN stage = 'allowlist' THEN 'not_in_allowlist'
    WHEN stage = 'timeout' THEN 'timeout' WHEN stage = 'arg_filter' THEN 'arg_filter' ELSE 'policy' END"""


@register("denied_by_reason", f"SELECT {_SQL_LABEL} AS reason, count(*) AS denied FROM {SQL_DECISIONS} WHERE decision = 'deny' GROUP BY ALL")
def denied_by_reason(spark, sf):
    return metrics.denied_by_reason(decisions(spark, sf))


@register("latency_histogram", f"""
    WITH b AS (SELECT * FROM (VALUES (0, 1, '0.001'), (1, 5, '0.005'), (2, 10, '0.010'), (3, 25, '0.025'), (4, 50, '0.050'), (5, 100, '0.100'), (6, 500, '0.500'), (7, 1000000000000, '+Inf')) v(bucket, bound, le)),
    us AS (SELECT floor(eval_ms * 1000)::BIGINT AS us FROM {SQL_DECISIONS}),
    c AS (SELECT bucket, le, (SELECT count(*) FROM us WHERE us < bound * 1000) AS cumulative, (SELECT sum(us)::BIGINT FROM us) AS sum_us FROM b)
    SELECT le, bucket, cumulative - coalesce(lag(cumulative) OVER (ORDER BY bucket), 0) AS n, cumulative, sum_us FROM c
""")
def latency_histogram(spark, sf):
    return metrics.latency_histogram(decisions(spark, sf), F.col("eval_ms"))


@register("top_rules", f"SELECT finding_scanner AS scanner, finding_rule AS rule_id, count(*) AS count FROM {SQL_DECISIONS} WHERE finding_rule IS NOT NULL GROUP BY ALL ORDER BY count DESC, 1, 2 LIMIT 3")
def top_rules(spark, sf):
    return metrics.top_rules(decisions(spark, sf), 3)


@register("rule_rollup", f"SELECT finding_scanner AS scanner, finding_rule AS rule_id, count(*) AS findings FROM {SQL_DECISIONS} WHERE finding_rule IS NOT NULL GROUP BY ROLLUP (finding_scanner, finding_rule)")
def rule_rollup(spark, sf):
    return metrics.rule_rollup(decisions(spark, sf))


@register("prometheus_lines", f"""
    WITH d AS (SELECT *, floor(eval_ms * 1000)::BIGINT AS us FROM {SQL_DECISIONS}),
    b AS (SELECT * FROM (VALUES (1, '0.001'), (5, '0.005'), (10, '0.010'), (25, '0.025'), (50, '0.050'), (100, '0.100'), (500, '0.500'), (1000000000000, '+Inf')) v(bound, le)),
    m AS (
      SELECT unnest([{{'m': 'requests_total', 'v': count(*)}}, {{'m': 'decisions_allowed_total', 'v': count_if(decision = 'allow')}}, {{'m': 'decisions_denied_total', 'v': count_if(decision = 'deny')}},
        {{'m': 'decisions_redacted_total', 'v': count_if(reason LIKE 'response redacted%')}}, {{'m': 'evaluation_timeouts_total', 'v': count_if(reason LIKE '%timeout%')}},
        {{'m': 'responses_scanned_total', 'v': count_if(stage LIKE 'response%')}}, {{'m': 'responses_blocked_total', 'v': count_if(stage LIKE 'response%' AND decision = 'deny')}}], recursive := true) FROM d
      UNION ALL SELECT 'evaluation_duration_seconds_bucket{{le="' || le || '"}}', (SELECT count(*) FROM d WHERE us < bound * 1000) FROM b
      UNION ALL SELECT 'scanner_detections_total{{action="' || CASE decision WHEN 'deny' THEN 'blocked' ELSE 'redacted' END || '",scanner="' || finding_scanner || '"}}', count(*) FROM d WHERE finding_scanner IS NOT NULL GROUP BY decision, finding_scanner
      UNION ALL SELECT 'denied_by_tool_total{{tool="' || tool || '"}}', count(*) FROM d WHERE decision = 'deny' GROUP BY tool
      UNION ALL SELECT 'denied_by_reason_total{{reason="' || {_SQL_LABEL} || '"}}', count(*) FROM d WHERE decision = 'deny' GROUP BY ALL)
    SELECT 'agentguard_' || m || ' ' || v AS line FROM m
""")
def prometheus_lines(spark, sf):
    return metrics.to_prometheus(metrics.collect_metrics(decisions(spark, sf), F.col("eval_ms")))


_SQL_SEV = "CASE WHEN decision = 'allow' THEN 1 WHEN finding_scanner IN ('injection', 'malware') THEN 5 WHEN finding_scanner IN ('vuln', 'secrets') THEN 4 WHEN finding_scanner = 'pii' THEN 3 ELSE 4 END"


@register("ocsf_events", f"""
    SELECT decision_id, sev AS severity_id, CASE sev WHEN 1 THEN 'Informational' WHEN 3 THEN 'Medium' WHEN 4 THEN 'High' ELSE 'Critical' END AS severity,
      CASE decision WHEN 'deny' THEN 3 ELSE 1 END AS status_id, epoch_us(timestamp) // 1000 AS time, 200401 AS type_uid,
      'agentguard ' || decision || ': ' || reason || ' [tool=' || tool || ']' AS message,
      CASE WHEN finding_rule IS NOT NULL THEN finding_rule WHEN decision = 'deny' THEN stage END AS finding_uid,
      CASE WHEN finding_rule IS NOT NULL THEN 4 END AS evidences, 3 AS resources
    FROM (SELECT *, {_SQL_SEV} AS sev FROM {SQL_DECISIONS})
""")
def ocsf_events(spark, sf):
    # Through the JSON text that leaves the system, and back.
    events = siem.to_ocsf(decisions(spark, sf)).select("decision_id", F.to_json("ocsf").alias("j"))
    schema = (
        "struct<severity_id:int,severity:string,status_id:int,time:bigint,type_uid:int,message:string,finding_info:struct<uid:string>,"
        "evidences:array<struct<name:string,value:string>>,resources:array<struct<type:string,name:string>>>"
    )
    e = events.withColumn("e", F.from_json("j", schema))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return e.select(
        "decision_id", "e.severity_id", "e.severity", "e.status_id", "e.time", "e.type_uid", "e.message",
        F.col("e.finding_info.uid").alias("finding_uid"), size("e.evidences").alias("evidences"), size("e.resources").alias("resources"))


@register("siem_filter_counts", f"SELECT count_if(sev >= 4) AS forwarded, count_if(sev < 4) AS filtered FROM (SELECT {_SQL_SEV} AS sev FROM {SQL_DECISIONS})")
def siem_filter_counts(spark, sf):
    return siem.forward(decisions(spark, sf), 4)[1]


@register("syslog_lines", f"""
    SELECT msg_id, '<134>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' agentguard agentguard - - - ' || replace(replace(text, chr(10), '\\n'), chr(13), '\\r') AS line FROM {inputs.SQL_MESSAGES}
""")
def syslog_lines(spark, sf):
    return inputs.messages(spark, sf).select("msg_id", siem.to_syslog(F.col("ts"), F.col("text")).alias("line"))


@register("log_values", f"""
    SELECT msg_id, CASE WHEN length(c) > 200 THEN left(c, 200) || '...' ELSE c END AS clean FROM (SELECT msg_id, regexp_replace(text, '[\\x00-\\x1F\\x7F]', '_', 'g') AS c FROM {inputs.SQL_MESSAGES})
""")
def log_values(spark, sf):
    return inputs.messages(spark, sf).select("msg_id", tx.sanitize_for_log(F.col("text")).alias("clean"))


SQL_EVENT_KIND = """CASE stage WHEN 'injection_scan' THEN 'injection_blocked' WHEN 'malware_scan' THEN 'malware_blocked' WHEN 'vuln_scan' THEN 'vuln_blocked'
    WHEN 'arg_filter' THEN 'arg_filter_match' ELSE 'policy_deny' END AS event_type,
  CASE stage WHEN 'injection_scan' THEN 'high' WHEN 'malware_scan' THEN 'critical' WHEN 'vuln_scan' THEN 'high' WHEN 'arg_filter' THEN 'medium' ELSE 'low' END AS severity"""


@register("deny_events", f"SELECT event_type, severity, count(*) AS events FROM (SELECT {SQL_EVENT_KIND} FROM {SQL_DECISIONS} WHERE decision = 'deny') GROUP BY ALL")
def deny_events(spark, sf):
    denied = decisions(spark, sf).filter("decision = 'deny'").select(labels.reason_to_event(F.col("reason")).alias("e"))
    return denied.groupBy("e.event_type", "e.severity").agg(F.count("*").alias("events"))


_DIGEST_COLS = (
    "decision_id", "at_us", "user_id", "session_id", "tool", "params", "decision", "reason", "stage", "finding_scanner", "finding_rule",
    "agent_name", "source", "policy_version", "scanner_type",
)
_DIGEST_KEY = "demonstration key"


def _sql_digest(source: str) -> str:
    cell = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    row_hash = f"sha256({q(_DIGEST_KEY)} || " + " || ".join(cell(c) for c in _DIGEST_COLS) + ")"
    sums = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::HUGEINT AS s{i}" for i in range(8))
    listed = ", ".join(f"s{i}::VARCHAR" for i in range(8))
    return f"""SELECT day, rows, sha256(concat_ws(':', rows::VARCHAR, {listed})) AS digest FROM (
        SELECT timestamp::DATE AS day, count(*) AS rows, {sums} FROM (SELECT *, {row_hash} AS h FROM (SELECT *, epoch_us(timestamp) AS at_us FROM {source})) GROUP BY ALL)"""


def _digest_input(spark, sf):
    return decisions(spark, sf).withColumn("day", F.to_date("timestamp")).withColumn("at_us", micros(F.col("timestamp")))


@register("audit_digest", _sql_digest(SQL_DECISIONS))
def audit_digest(spark, sf):
    return audit.table_digest(_digest_input(spark, sf), ["day"], _DIGEST_COLS, _DIGEST_KEY)


_TAMPERED = f"(SELECT * REPLACE (CASE WHEN decision_id % 1000 = 7 THEN 'allow' ELSE decision END AS decision) FROM {SQL_DECISIONS})"


@register("digest_verify", f"SELECT a.day, 'changed' AS status FROM ({_sql_digest(SQL_DECISIONS)}) a JOIN ({_sql_digest(_TAMPERED)}) b ON a.day = b.day WHERE a.digest <> b.digest")
def digest_verify(spark, sf):
    rows = _digest_input(spark, sf)
    changed = rows.withColumn("decision", F.when(F.col("decision_id") % 1000 == 7, "allow").otherwise(F.col("decision")))
    stored, current = (audit.table_digest(r, ["day"], _DIGEST_COLS, _DIGEST_KEY) for r in (rows, changed))
    return audit.verify_digests(stored, current, ["day"]).select("day", "status")


#: Each constraint is broken in the decisions whose id leaves its number; (constraint, what else breaks it).
_BROKEN = [
    ("missing_timestamp", "false"), ("missing_tool", "false"), ("missing_policy", "false"), ("bad_decision", "false"), ("bad_stage", "stage = 'response_redaction'"),
    ("negative_duration", "eval_ms < 0"), ("bad_scanner", "false"), ("bad_confidence", "false"), ("long_excerpt", "false"),
]
_SQL_BROKEN = ", ".join(f"{{'constraint': {q(name)}, 'violations': count_if(decision_id % 101 = {k} OR {other})}}" for k, (name, other) in enumerate(_BROKEN))


@register("record_checks", f"SELECT unnest([{_SQL_BROKEN}], recursive := true) FROM {SQL_DECISIONS}")
def record_checks(spark, sf):
    rows = decisions(spark, sf)
    broken = lambda k: F.col("decision_id") % 101 == k
    finding = F.struct(*[
        F.when(broken(k), value).otherwise(other).cast("string").alias(name) for k, name, value, other in (
            (6, "scanner", F.lit("nobody"), F.lit(None)), (7, "confidence", F.lit("sure"), F.lit(None)), (8, "match_excerpt", F.repeat(F.lit("x"), F.lit(300)), F.lit("")))])
    kind = rows.schema["decision_details"].dataType["scan_results"].dataType.elementType
    added = F.struct(*[(finding[f.name] if f.name in ("scanner", "confidence", "match_excerpt") else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    results = F.concat(F.col("decision_details.scan_results"), F.array(added))
    details = F.col("decision_details").withField("scan_results", results).withField(
        "pipeline_stage", F.when(broken(4), "nowhere").otherwise(F.col("decision_details.pipeline_stage"))).withField(
        "eval_duration_ms", F.when(broken(5), -1).otherwise(F.col("decision_details.eval_duration_ms")))
    spoiled = rows.withColumns({
        "timestamp": F.when(~broken(0), F.col("timestamp")), "tool": F.when(broken(1), "").otherwise(F.col("tool")),
        "policy_version": F.when(~broken(2), F.col("policy_version")), "decision": F.when(broken(3), "maybe").otherwise(F.col("decision")), "decision_details": details})
    return audit.violation_counts(audit.record_checks(spoiled))


# Tokens of two shapes: a marked one, and digits that stand inside a longer number.
_CANARY = "CASE WHEN user_id % 2 = 0 THEN '__canary_' || left(sha256(user_id::VARCHAR), 16) || '__' ELSE (7919 * user_id + 10000000)::VARCHAR END"


@register("canary_leaks", f"""
    WITH c AS (SELECT decision_id, tool, {_CANARY} AS token FROM {SQL_DECISIONS} WHERE stage = 'default_action'),
    r AS (SELECT decision_id, tool, 'result for 5' || {_CANARY} || '5 and more' AS body FROM {SQL_DECISIONS} WHERE stage = 'response_clean')
    SELECT r.tool AS leaked_by, c.tool AS issued_to, sum(r.k * c.n)::BIGINT AS leaks
    FROM (SELECT tool, body, count(*) AS k FROM r GROUP BY ALL) r JOIN (SELECT tool, token, count(*) AS n FROM c GROUP BY ALL) c ON contains(r.body, c.token) WHERE r.tool <> c.tool GROUP BY ALL
""")
def canary_leaks(spark, sf):
    rows = decisions(spark, sf)
    user = F.col("user_id").cast("string")
    marked = F.concat(F.lit("__canary_"), F.left(F.sha2(user, 256), F.lit(16)), F.lit("__"))
    token = F.when(F.col("user_id") % 2 == 0, marked).otherwise((F.lit(7919) * F.col("user_id") + 10_000_000).cast("string"))
    issued = rows.filter("stage = 'default_action'").select(token.alias("token"), "tool")
    body = F.concat(F.lit("result for 5"), token, F.lit("5 and more"))
    return leaks.canary_leaks(issued, rows.filter("stage = 'response_clean'").select("tool", body.alias("body")))


@register("canary_seeded", f"""
    SELECT decision_id, '{{"_canary":"c' || decision_id || '",' || substr(params, 2) AS params FROM {SQL_DECISIONS}
""")
def canary_seeded(spark, sf):
    return decisions(spark, sf).select(
        "decision_id", audit.inject_canary(F.col("params"), F.concat(F.lit("c"), F.col("decision_id").cast("string"))).alias("params"))


# --- trees, commits and tiles -------------------------------------------------------------------

_WIDTH = 16


@register("digest_locate", f"""
    SELECT decision_id // {_WIDTH} * {_WIDTH} AS low, decision_id // {_WIDTH} * {_WIDTH} + {_WIDTH} AS high, count(*) AS rows_before, count_if(decision_id % 2003 <> 5) AS rows_after
    FROM {SQL_DECISIONS} GROUP BY ALL HAVING bool_or(decision_id % 1000 = 7 OR decision_id % 2003 = 5)
""")
def digest_locate(spark, sf):
    """A copy of the decisions in which some were changed and some are gone."""
    rows = _digest_input(spark, sf)
    changed = rows.where("decision_id % 2003 <> 5").withColumn("decision", F.when(F.col("decision_id") % 1000 == 7, "nobody").otherwise(F.col("decision")))
    trees = [hashtree.digest_tree(r, "decision_id", _DIGEST_COLS, _WIDTH, _DIGEST_KEY) for r in (rows, changed)]
    return hashtree.digest_locate(*trees, _WIDTH)


@register("audit_log_round_trip", f"""
    SELECT 'decisions' AS kind, day, count(*) AS rows, sum(decision_id)::BIGINT AS ids, count_if(decision = 'deny') AS denied FROM (SELECT *, timestamp::DATE AS day FROM {SQL_DECISIONS}) WHERE eval_ms >= 5 GROUP BY ALL
    UNION ALL SELECT 'refused', timestamp::DATE, count(*), sum(decision_id)::BIGINT, count_if(decision = 'deny') FROM {SQL_DECISIONS} WHERE eval_ms < 5 GROUP BY ALL
    UNION ALL SELECT 'tool_calls', created_at::DATE, count(*), sum(decision_id)::BIGINT, count_if(response_json IS NOT NULL) FROM ({_CALLS.replace('@events@', 'events')}) GROUP BY ALL
""")
def audit_log_round_trip(spark, sf):
    """Two batches, one of them written twice, and read back by their manifests."""
    folder = f"{shared_dir(spark)}/audit-log-{os.urandom(6).hex()}"
    kept = decisions(spark, sf).select("decision_id", "timestamp", "tool", "decision", "reason", "eval_ms")
    calls = inputs.run_sql(spark, _CALLS, events=table(spark, sf, "events"))
    for batch in (0, 1, 1):
        part = F.pmod(F.coalesce("decision_id", F.lit(0)), F.lit(2)) == batch
        commits.write_batch(kept.where(part), calls.where(part), folder, f"b{batch}", valid=F.col("eval_ms") >= 5)
    day = lambda c: F.to_date(c).alias("day")
    shown = lambda df, kind, time, flag: df.groupBy(F.lit(kind).alias("kind"), day(time)).agg(
        F.count("*").alias("rows"), F.sum("decision_id").alias("ids"), F.count_if(flag).alias("denied"))
    read = lambda kind, like: commits.read_kind(spark, folder, kind, like.schema)
    denied = F.col("decision") == "deny"
    return shown(read("decisions", kept), "decisions", "timestamp", denied).unionByName(shown(read("refused", kept), "refused", "timestamp", denied)).unionByName(
        shown(read("tool_calls", calls), "tool_calls", "created_at", F.col("response_json").isNotNull()))


_FLAGS = {"upstream_error": "decision_id % 11 = 0", "layer_received": "decision_id % 7 = 0", "layer_sent": "decision_id % 13 = 0", "adaptive_action": "decision_id % 17 = 0"}
_FROM, _TO = "2024-01-04 05:17:31", "2024-01-21 22:41:07"


@register("window_summary", f"""
    WITH w AS (SELECT * FROM {SQL_DECISIONS} WHERE timestamp >= TIMESTAMP '{_FROM}' AND timestamp < TIMESTAMP '{_TO}'),
    c AS (SELECT count(*) AS requests, count_if(decision = 'allow') AS allowed, count_if(decision = 'deny') AS denied, count_if(starts_with(reason, 'response redacted')) AS redacted,
      count_if(contains(reason, 'timeout')) AS timeouts, count_if(starts_with(stage, 'response')) AS responses, count_if(starts_with(stage, 'response') AND decision = 'deny') AS responses_blocked,
      count_if(decision_id % 11 = 0) AS upstream_errors, count_if(decision_id % 7 = 0) AS crosslayer_received, count_if(decision_id % 13 = 0) AS crosslayer_sent, count_if(decision_id % 17 = 0) AS adaptive_actions FROM w)
    UNPIVOT c ON COLUMNS(*) INTO NAME metric VALUE value
""")
def window_summary(spark, sf):
    """A window that begins and ends inside hours, from tiles of two batches; one of them was written twice."""
    folder = f"{shared_dir(spark)}/tiles-{os.urandom(6).hex()}"
    rows = decisions(spark, sf).withColumns({k: F.expr(v) for k, v in _FLAGS.items()})
    for batch in (0, 1, 0):
        tiles.write_tiles(rows.where(F.pmod(F.coalesce("decision_id", F.lit(0)), F.lit(2)) == batch), folder, batch)
    start, end = (int(spark.sql(f"SELECT unix_micros(timestamp '{t}') AS t").first().t) for t in (_FROM, _TO))
    return tiles.summary(tiles.window_counts(tiles.read_tiles(spark, folder), rows, start, end))
