"""Fleet queries over tables derived from customers, orders, nations, regions and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentguard.operators import fleet, listing, policytable
from agentguard.plans import inputs
from agentguard.plans.base import register, table

AGENTS = """
SELECT c_custkey AS agent_id, c_nationkey AS policy_group_id, concat('1.', CAST(c_custkey % 3 AS STRING)) AS version,
  concat('h', CAST((c_custkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END * 3) % 5 AS STRING)) AS policy_hash, c_custkey AS seq,
  CASE WHEN c_acctbal < 0 THEN 'unhealthy' WHEN c_custkey % 10 = 0 THEN 'stale' ELSE 'healthy' END AS status, lower(c_mktsegment) AS tag
FROM @customer@
"""
GROUPS = "SELECT n_nationkey AS group_id, CASE WHEN n_nationkey % 6 = 5 OR n_nationkey = 0 THEN NULL ELSE n_regionkey END AS current_version_id FROM @nation@"
VERSIONS = "SELECT r_regionkey AS version_id, CASE WHEN r_regionkey < 4 THEN concat('h', CAST(r_regionkey AS STRING)) END AS policy_hash FROM @region@"
CHECKINS = """
SELECT o_orderkey AS checkin_id, o_custkey AS agent_id, o_orderdate AS timestamp, CASE o_orderstatus WHEN 'F' THEN 'unhealthy' ELSE 'healthy' END AS health_status,
  CASE WHEN o_orderkey % 17 = 0 THEN '{broken' ELSE concat('{"decisions_total":', CAST(CAST(o_totalprice AS BIGINT) AS STRING), ',"decisions_denied":', CAST(o_orderkey % 50 AS STRING),
    ',"scanner_detections":{"', lower(substr(o_orderpriority, 1, 1)), '":', CAST(o_orderkey % 7 AS STRING), ',"pii":', CAST(o_orderkey % 3 AS STRING), '},"period_seconds":60}') END AS metrics_summary
FROM @orders@
"""
KEY_EVENTS = "SELECT o_orderkey AS event_id, o_custkey AS key_id, o_custkey % 25 AS group_id, o_orderdate AS ts, CASE o_orderkey % 9 WHEN 0 THEN 'rotated' WHEN 1 THEN 'revoked' ELSE 'created' END AS event FROM @orders@"
LIFECYCLE = """SELECT o_orderkey AS event_id, o_custkey AS version_id, o_custkey % 25 AS group_id, o_orderdate AS ts,
  CASE o_orderkey % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' WHEN 2 THEN 'published' WHEN 3 THEN 'superseded' ELSE 'rejected' END AS status FROM @orders@"""
TASKS = """SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS task_id, l_partkey AS agent_id, l_suppkey AS rollout_id,
  concat('2.', CAST(l_suppkey % 4 AS STRING)) AS target_version, CASE l_linenumber % 4 WHEN 0 THEN 'canary' WHEN 1 THEN 'wave1' WHEN 2 THEN 'wave2' ELSE 'full' END AS wave,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'pending' END AS status, l_shipdate AS scheduled_at FROM @lineitem@"""
REPORTS = "SELECT user_id AS host, 1 + event_id % 4 AS layer, ts, CASE event_type WHEN 'error' THEN 'down' WHEN 'click' THEN 'degraded' WHEN 'view' THEN 'unknown' ELSE 'healthy' END AS status, event_id AS report_id FROM @events@"
USES = "SELECT event_id AS use_id, ts, concat('t', CAST(user_id AS STRING)) AS token FROM @events@"


def _sql(text: str) -> str:
    for name in ("customer", "nation", "region", "orders", "lineitem", "events"):
        text = text.replace(f"@{name}@", name)
    return f"({text})"


def _df(spark, sf, text):
    names = [n for n in ("customer", "nation", "region", "orders", "lineitem", "events") if f"@{n}@" in text]
    return inputs.run_sql(spark, text, **{n: table(spark, sf, n) for n in names})


def _policy_tables(spark, sf):
    return _df(spark, sf, AGENTS), _df(spark, sf, GROUPS), _df(spark, sf, VERSIONS)


@register("fleet_overview", f"SELECT count(*) AS total, count_if(status = 'healthy') AS healthy, count_if(status = 'unhealthy') AS unhealthy, count_if(status = 'stale') AS stale FROM {_sql(AGENTS)}")
def fleet_overview(spark, sf):
    return fleet.overview(_df(spark, sf, AGENTS))


@register("version_distribution", f"SELECT version, count(*) AS agents FROM {_sql(AGENTS)} GROUP BY version")
def version_distribution(spark, sf):
    return fleet.version_distribution(_df(spark, sf, AGENTS))


_SQL_STATE = f"""(SELECT a.*, v.policy_hash AS current_hash, g.current_version_id AS version_id, CASE WHEN g.current_version_id IS NULL THEN 'unassigned' WHEN a.policy_hash = v.policy_hash THEN 'compliant' ELSE 'non_compliant' END AS compliance
    FROM {_sql(AGENTS)} a LEFT JOIN {_sql(GROUPS)} g ON a.policy_group_id = g.group_id LEFT JOIN {_sql(VERSIONS)} v ON g.current_version_id = v.version_id)"""


@register("policy_compliance", f"SELECT compliance, count(*) AS agents FROM {_SQL_STATE} GROUP BY compliance")
def policy_compliance(spark, sf):
    return fleet.compliance_counts(*_policy_tables(spark, sf))


@register("pending_policy_updates", f"SELECT agent_id, 'update_policy' AS action, version_id, current_hash AS policy_hash FROM {_SQL_STATE} WHERE current_hash IS NOT NULL AND policy_hash <> current_hash")
def pending_policy_updates(spark, sf):
    return fleet.pending_policy_updates(*_policy_tables(spark, sf))


@register("latest_checkins", f"SELECT agent_id, checkin_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY timestamp DESC, checkin_id DESC)::INT AS rank FROM {_sql(CHECKINS)}) WHERE rank <= 10")
def latest_checkins(spark, sf):
    return fleet.latest_checkins(_df(spark, sf, CHECKINS)).select("agent_id", "checkin_id", "rank")


_SQL_LAST = f"(SELECT agent_id, max(timestamp) AS last_checkin_at, arg_max(health_status, (timestamp, checkin_id)) AS status, arg_max(checkin_id, (timestamp, checkin_id)) AS checkin_id FROM {_sql(CHECKINS)} GROUP BY agent_id)"


@register("agent_state", f"SELECT agent_id, last_checkin_at, status, checkin_id FROM {_SQL_LAST}")
def agent_state(spark, sf):
    return fleet.current_state(_df(spark, sf, CHECKINS))


@register("stale_agents", f"SELECT agent_id, last_checkin_at FROM {_SQL_LAST} WHERE last_checkin_at < TIMESTAMP '2001-01-01' - INTERVAL 90 DAY")
def stale_agents(spark, sf):
    state = fleet.current_state(_df(spark, sf, CHECKINS))
    return fleet.stale_agents(state, F.lit("2001-01-01"), 90 * 86400).select("agent_id", "last_checkin_at")


_NOW = "TIMESTAMP '1999-06-01 00:00:00'"
_SQL_RECENT = f"(SELECT * FROM {_sql(CHECKINS)} WHERE timestamp > {_NOW} - INTERVAL 2400 HOUR)"


@register("security_summary_24h", f"SELECT coalesce(sum(trunc(o_totalprice)::BIGINT), 0)::BIGINT AS total_decisions, coalesce(sum(o_orderkey % 50), 0)::BIGINT AS total_denied FROM orders WHERE o_orderdate > {_NOW} - INTERVAL 2400 HOUR AND o_orderkey % 17 <> 0")
def security_summary_24h(spark, sf):
    return fleet.security_totals(_df(spark, sf, CHECKINS), F.lit("1999-06-01").cast("timestamp"), 2400)


@register("detection_totals_24h", f"""
    SELECT scanner, sum(n)::BIGINT AS detections FROM (
      SELECT lower(left(o_orderpriority, 1)) AS scanner, o_orderkey % 7 AS n FROM orders WHERE o_orderdate > {_NOW} - INTERVAL 2400 HOUR AND o_orderkey % 17 <> 0
      UNION ALL SELECT 'pii', o_orderkey % 3 FROM orders WHERE o_orderdate > {_NOW} - INTERVAL 2400 HOUR AND o_orderkey % 17 <> 0) GROUP BY scanner
""")
def detection_totals_24h(spark, sf):
    return fleet.detection_totals(_df(spark, sf, CHECKINS), F.lit("1999-06-01").cast("timestamp"), 2400)


@register("agents_by_tag", f"SELECT agent_id, status FROM {_sql(AGENTS)} WHERE status = 'healthy' AND tag = 'building'")
def agents_by_tag(spark, sf):
    agents = _df(spark, sf, AGENTS).withColumn("tags", F.array("tag", F.lit("fleet")))
    return fleet.agents_with_tag(agents, "healthy", "building").select("agent_id", "status")


_SQL_KEYS = f"(SELECT key_id, any_value(group_id) AS group_id, min(ts) AS created_at, min(ts) + INTERVAL 365 DAY AS expires_at, CASE arg_max(event, (ts, event_id)) WHEN 'created' THEN 'active' ELSE arg_max(event, (ts, event_id)) END AS status, max(CASE WHEN event = 'rotated' THEN ts END) AS rotated_at FROM {_sql(KEY_EVENTS)} GROUP BY key_id)"


def _keys(spark, sf):
    events = _df(spark, sf, KEY_EVENTS)
    facts = events.groupBy("key_id").agg(F.min("group_id").alias("group_id"), F.min("ts").alias("created_at"))
    return fleet.fold_key_events(events).join(facts, "key_id").withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 365 DAYS"))


@register("key_lifecycle", f"SELECT key_id, status, rotated_at FROM {_SQL_KEYS}")
def key_lifecycle(spark, sf):
    return fleet.fold_key_events(_df(spark, sf, KEY_EVENTS))


@register("active_keys", f"SELECT group_id, arg_max(key_id, (created_at, key_id)) AS key_id FROM {_SQL_KEYS} WHERE status = 'active' GROUP BY group_id")
def active_keys(spark, sf):
    return fleet.active_keys(_keys(spark, sf))


@register("key_status_counts", f"SELECT status, count(*) AS keys, count_if(status = 'active' AND expires_at < TIMESTAMP '1998-01-01') AS overdue FROM {_SQL_KEYS} GROUP BY status")
def key_status_counts(spark, sf):
    return fleet.key_counts(_keys(spark, sf), F.lit("1998-01-01").cast("timestamp"))


@register("token_first_use", f"SELECT use_id, token, row_number() OVER (PARTITION BY token ORDER BY ts, use_id) = 1 AND token IN (SELECT 't' || c_custkey FROM customer WHERE c_custkey % 3 <> 0) AS accepted FROM {_sql(USES)}")
def token_first_use(spark, sf):
    issued = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("token"))
    return fleet.token_uses(_df(spark, sf, USES), issued).select("use_id", "token", "accepted")


@register("waves_by_name", f"""
    SELECT agent_id, position FROM (SELECT c_name AS agent_id, row_number() OVER (ORDER BY c_name) AS position FROM customer)
""")
def waves_by_name(spark, sf):
    agents = table(spark, sf, "customer").select(F.col("c_name").alias("agent_id"))
    return fleet.number_rows(agents, "agent_id").select("agent_id", "position")


@register("version_status_counts", f"""
    SELECT status, count(*) AS versions FROM (
      WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY version_id) AS n FROM {_sql(LIFECYCLE)}),
      walk AS (
        SELECT version_id, rn, n, CASE WHEN 'draft>' || status IN ('draft>approved', 'draft>rejected') THEN status ELSE 'draft' END AS state FROM e WHERE rn = 1
        UNION ALL SELECT e.version_id, e.rn, e.n, CASE WHEN (w.state || '>' || e.status) IN ('draft>approved', 'draft>rejected', 'approved>published', 'approved>rejected', 'published>superseded') THEN e.status ELSE w.state END
        FROM walk w JOIN e ON e.version_id = w.version_id AND e.rn = w.rn + 1)
      SELECT version_id, state AS status FROM walk WHERE rn = n) GROUP BY status
""")
def version_status_counts(spark, sf):
    return fleet.version_states(_df(spark, sf, LIFECYCLE)).groupBy("status").agg(F.count("*").alias("versions"))


@register("policy_changes", f"SELECT event_id, version_id, status, ts FROM {_sql(LIFECYCLE)} WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '1996-01-01' ORDER BY ts DESC, event_id DESC LIMIT 50")
def policy_changes(spark, sf):
    rows = listing.newest(_df(spark, sf, LIFECYCLE), "ts", "event_id", "1995-01-01", "1996-01-01", 50)
    return rows.select("event_id", "version_id", "status", "ts")


@register("group_agents", f"SELECT agent_id, version, status FROM {_sql(AGENTS)} WHERE policy_group_id = 7 AND status = 'healthy'")
def group_agents(spark, sf):
    return listing.of_group(_df(spark, sf, AGENTS), policy_group_id=7, status="healthy").select("agent_id", "version", "status")


@register("group_keys", f"SELECT key_id, status, created_at FROM {_SQL_KEYS} WHERE group_id = 3")
def group_keys(spark, sf):
    return listing.of_group(_keys(spark, sf), group_id=3).select("key_id", "status", "created_at")


_SQL_VALID = "(previous || '>' || status) IN ('draft>approved', 'draft>rejected', 'approved>published', 'approved>rejected', 'published>superseded')"


#: Every change of a version with the status it met, by a fold over its changes.
_SQL_WALK = f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY ts, event_id) AS rn FROM {_sql(LIFECYCLE)}),
    walk AS (
      SELECT version_id, event_id, rn, status, 'draft' AS previous FROM e WHERE rn = 1
      UNION ALL SELECT e.version_id, e.event_id, e.rn, e.status, CASE WHEN {_SQL_VALID.replace("status)", "w.status)").replace("previous ||", "w.previous ||")} THEN w.status ELSE w.previous END
      FROM walk w JOIN e ON e.version_id = w.version_id AND e.rn = w.rn + 1)"""


@register("lifecycle_violations", f"""{_SQL_WALK}
    SELECT version_id, event_id, previous, status FROM walk WHERE NOT ({_SQL_VALID} OR (rn = 1 AND status = 'draft'))
""")
def lifecycle_violations(spark, sf):
    return fleet.lifecycle_violations(_df(spark, sf, LIFECYCLE)).select("version_id", "event_id", "previous", "status")


@register("current_versions", f"""{_SQL_WALK}
    SELECT group_id, arg_max(e.version_id, (ts, e.event_id)) AS current_version_id FROM walk w JOIN e ON e.version_id = w.version_id AND e.rn = w.rn
    WHERE w.status = 'published' AND {_SQL_VALID.replace("status)", "w.status)")} GROUP BY group_id
""")
def current_versions(spark, sf):
    return fleet.current_versions(_df(spark, sf, LIFECYCLE))


@register("rollout_waves", f"""
    SELECT agent_id, position, CASE WHEN position <= c THEN 'canary' WHEN position <= c + n * 25 // 100 THEN 'wave1' WHEN position <= c + n * 75 // 100 THEN 'wave2' ELSE 'full' END AS wave
    FROM (SELECT agent_id, row_number() OVER (ORDER BY agent_id) AS position, count(*) OVER () AS n, greatest(1, count(*) OVER () * 5 // 100) AS c FROM {_sql(AGENTS)})
""")
def rollout_waves(spark, sf):
    return fleet.rollout_waves(_df(spark, sf, AGENTS), "agent_id", 5).select("agent_id", "position", "wave")


@register("pending_tasks", f"SELECT agent_id, arg_min(task_id, (scheduled_at, task_id)) AS task_id FROM {_sql(TASKS)} WHERE status = 'pending' GROUP BY agent_id")
def pending_tasks(spark, sf):
    return fleet.pending_tasks(_df(spark, sf, TASKS)).select("agent_id", "task_id")


@register("rollout_stats", f"SELECT s_suppkey AS rollout_id, count(t.task_id) AS total, count_if(t.status = 'completed') AS completed, count_if(t.status = 'failed') AS failed FROM supplier LEFT JOIN {_sql(TASKS)} t ON s_suppkey = t.rollout_id GROUP BY s_suppkey")
def rollout_stats(spark, sf):
    rollouts = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rollout_id"))
    return fleet.rollout_stats(rollouts, _df(spark, sf, TASKS))


@register("wave_failure_rates", f"""
    SELECT rollout_id, wave, count_if(status IN ('completed', 'failed')) AS finished, count_if(status = 'failed') AS failed,
      round(count_if(status = 'failed') / count_if(status IN ('completed', 'failed')), 6) AS failure_rate, count_if(status = 'failed') / count_if(status IN ('completed', 'failed')) > 0.5 AS halt
    FROM {_sql(TASKS)} GROUP BY ALL
""")
def wave_failure_rates(spark, sf):
    return fleet.wave_failure_rates(_df(spark, sf, TASKS), 0.5).withColumn("failure_rate", F.round("failure_rate", 6))


@register("health_rollup", f"""
    SELECT host, CASE greatest(max(r), CASE WHEN count(l) < 3 THEN 1 ELSE 0 END) WHEN 2 THEN 'down' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall, (3 - count(l))::BIGINT AS missing_layers
    FROM (SELECT c_custkey AS host, layer AS l, CASE status WHEN 'healthy' THEN 0 WHEN 'down' THEN 2 ELSE 1 END AS r
      FROM customer LEFT JOIN (SELECT host, layer, arg_max(status, (ts, report_id)) AS status FROM {_sql(REPORTS)} WHERE layer <= 3 GROUP BY ALL) h ON c_custkey = host) GROUP BY host
""")
def health_rollup(spark, sf):
    hosts = table(spark, sf, "customer").select(F.col("c_custkey").alias("host"))
    return fleet.health_rollup(_df(spark, sf, REPORTS), hosts)


@register("integrity_check", """
    SELECT c_custkey AS host, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 100 = 99 THEN 'binary (hash mismatch)' ELSE '' END || CASE WHEN (c_custkey % 13 = 0 OR c_custkey % 100 = 99) AND (c_custkey % 11 = 0 OR c_custkey % 100 = 99) THEN '|' ELSE '' END
      || CASE WHEN c_custkey % 11 = 0 OR c_custkey % 100 = 99 THEN 'policy (hash mismatch)' ELSE '' END AS tampered FROM customer
""")
def integrity_check(spark, sf):
    hosts = table(spark, sf, "customer").select(F.col("c_custkey").alias("host"))
    expected = hosts.select("host", F.lit("b1").alias("binary_hash"), F.lit("p1").alias("policy_hash"))
    actual = hosts.filter("host % 100 <> 99").select(
        "host", F.when(F.col("host") % 13 == 0, "b2").otherwise("b1").alias("binary_hash"), F.when(F.col("host") % 11 == 0, "p2").otherwise("p1").alias("policy_hash"))
    return fleet.integrity_check(expected, actual).select("host", F.array_join("tampered", "|").alias("tampered"))


@register("health_status_counts", f"SELECT health_status, count(*) AS checkins, count(DISTINCT agent_id) AS agents FROM {_sql(CHECKINS)} GROUP BY health_status")
def health_status_counts(spark, sf):
    rows = _df(spark, sf, CHECKINS).groupBy("health_status", "agent_id").agg(F.count("*").alias("n"))
    return rows.groupBy("health_status").agg(F.sum("n").alias("checkins"), F.count("*").alias("agents"))


# A policy per customer with a version per order: two scalars, and a denylist of its items' ship modes.
POLICY_ROWS = """
SELECT o_custkey AS policy_id, o_orderkey AS version, 'scalar' AS kind, 'default_action' AS field, CASE o_orderstatus WHEN 'F' THEN 'deny' ELSE 'allow' END AS value FROM @orders@
UNION ALL SELECT o_custkey, o_orderkey, 'scalar', 'max_message_bytes', CASE WHEN o_orderkey % 4 = 0 THEN '400' ELSE '1000000' END FROM @orders@
UNION ALL SELECT o_custkey, o_orderkey, 'list', CASE WHEN l_partkey % 5 = 0 THEN 'allowlist' ELSE 'denylist' END,
  CASE l_linenumber % 6 WHEN 0 THEN 'chat.send' WHEN 1 THEN 'shell.exec' WHEN 2 THEN 'web.get' WHEN 3 THEN 'file.read' WHEN 4 THEN 'notes.write' ELSE 'search.query' END
  FROM @orders@ JOIN @lineitem@ ON l_orderkey = o_orderkey
"""


@register("policy_version_changes", f"""
    WITH r AS {_sql(POLICY_ROWS)},
    s AS (SELECT policy_id, version, lag(version) OVER (PARTITION BY policy_id ORDER BY version) AS old FROM (SELECT DISTINCT policy_id, version FROM r)),
    n AS (SELECT s.policy_id, s.version, kind, field, value FROM s JOIN r USING (policy_id, version) WHERE old IS NOT NULL),
    o AS (SELECT s.policy_id, s.version, kind, field, value FROM s JOIN r ON r.policy_id = s.policy_id AND r.version = s.old),
    a AS (SELECT DISTINCT * FROM n EXCEPT SELECT DISTINCT * FROM o), d AS (SELECT DISTINCT * FROM o EXCEPT SELECT DISTINCT * FROM n)
    SELECT policy_id, version, field, 'changed' AS change_type, d.value AS old_value, a.value AS new_value FROM a JOIN d USING (policy_id, version, kind, field) WHERE kind = 'scalar'
    UNION ALL SELECT policy_id, version, field, 'added', NULL, value FROM a WHERE kind = 'list'
    UNION ALL SELECT policy_id, version, field, 'removed', value, NULL FROM d WHERE kind = 'list'
""")
def policy_version_changes(spark, sf):
    return policytable.version_changes(_df(spark, sf, POLICY_ROWS))


_SQL_METHOD = "lower(trim(regexp_replace(sent_method, '\\s+', ' ', 'g')))"


@register("policy_table_decisions", f"""
    WITH r AS (SELECT * FROM {_sql(POLICY_ROWS)} WHERE version IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)),
    p AS (SELECT policy_id, list(value) FILTER (field = 'denylist') AS deny, list(value) FILTER (field = 'allowlist') AS allow,
      max(value) FILTER (field = 'default_action') AS act, max(value) FILTER (field = 'max_message_bytes')::BIGINT AS most FROM r GROUP BY policy_id),
    m AS (SELECT msg_id, conv_id % 200 AS policy_id, raw, {_SQL_METHOD} AS tool FROM {inputs.SQL_MESSAGES})
    SELECT msg_id, CASE WHEN p.policy_id IS NULL OR strlen(raw) > most OR list_contains(deny, tool) THEN 'deny'
        WHEN allow IS NOT NULL THEN CASE WHEN list_contains(allow, tool) THEN 'allow' ELSE 'deny' END ELSE act END AS decision,
      CASE WHEN p.policy_id IS NULL THEN 'unknown policy' WHEN strlen(raw) > most THEN 'message too large' WHEN list_contains(deny, tool) THEN 'tool explicitly denied by denylist'
        WHEN allow IS NOT NULL THEN CASE WHEN list_contains(allow, tool) THEN 'tool in allowlist, scans passed' ELSE 'tool not in allowlist' END
        WHEN act = 'allow' THEN 'default allowed' ELSE 'default denied' END AS reason
    FROM m LEFT JOIN p ON m.policy_id = p.policy_id
""")
def policy_table_decisions(spark, sf):
    rows = _df(spark, sf, POLICY_ROWS)
    current = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("policy_id")).agg(F.max("o_orderkey").alias("version"))
    msgs = inputs.messages(spark, sf).select("msg_id", (F.col("conv_id") % 200).alias("policy_id"), "raw", F.col("sent_method").alias("method"))
    return policytable.evaluate_by_table(msgs, rows.join(current, ["policy_id", "version"])).select("msg_id", "decision", "reason")
