"""Kernel telemetry and egress: fork bombs, port scans, suspicious activity, allowlist reports."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentguard.functions import net
from agentguard.functions.regex import re2
from agentguard.operators.ordered import micros, running_sum, trailing_count
from agentguard.operators.rangetable import range_matches

SECOND = 1_000_000
# Thresholds, allowed process paths, suspicious commands, files and ports.
FORK_BOMB_THRESHOLD = 50
FORK_BOMB_WINDOW = 60
PORT_SCAN_THRESHOLD = 20
ALLOWED_PROCESSES = ("/usr/bin/apt", "/usr/bin/dpkg", "/usr/lib/systemd/systemd", "/usr/bin/node", "/usr/bin/python3")
SUSPICIOUS_COMMANDS = (
    r"curl.*\|.*sh", r"wget.*\|.*sh", r"nc\s+-e", r"bash\s+-i", r"/dev/tcp/", r"base64\s+-d", r"base64.*decode",
    r"chmod.*777", r"rm\s+-rf\s+/", r"python.*-c.*import",
)
SENSITIVE_FILES = ("shadow", "sudoers", "passwd")
SUSPICIOUS_PORTS = (4444, 5555, 31337)
WRITE_FLAG = 1
# Networks that are always reachable.
ALWAYS_ALLOWED = ("127.0.0.0/8", "172.16.0.0/12", "10.255.255.254/32", "140.82.112.0/20", "185.199.108.0/22", "192.30.252.0/22")


def is_allowed_process(filename: Column) -> Column:
    return functools.reduce(operator.or_, [F.startswith(filename, F.lit(p)) for p in ALLOWED_PROCESSES])


def fork_bombs(execs: DataFrame, window_seconds: int = FORK_BOMB_WINDOW, threshold: int = FORK_BOMB_THRESHOLD) -> DataFrame:
    """Executions whose parent started more than `threshold` processes in the window."""
    rows = execs.filter(~is_allowed_process(F.col("filename"))).withColumn("__us", micros(F.col("ts")))
    counted = trailing_count(rows, ["ppid"], "__us", window_seconds * SECOND, "execs")
    return counted.filter(F.col("execs") > threshold).drop("__us")


def port_scans(conns: DataFrame, threshold: int = PORT_SCAN_THRESHOLD) -> DataFrame:
    """Connections of a process that has used more than `threshold` ports so far.

    The first use of each port counts one; a running sum over these and all connections
    gives the number of ports, in pieces so that a busy process is spread out.
    """
    rows = conns.withColumn("__us", micros(F.col("ts")))
    first = rows.groupBy("pid", "dport").agg(F.min(F.struct("__us", "event_id")).alias("f"))
    news = first.select("pid", F.col("f.__us").alias("__us"), F.col("f.event_id").alias("event_id"), F.lit(1).alias("__new"), F.lit(0).alias("__seen"))
    both = rows.select("pid", "__us", "event_id", F.lit(0).alias("__new"), F.lit(1).alias("__seen")).unionByName(news)
    # A first use sorts before the connection that made it.
    summed = running_sum(both, ["pid"], "__us", ["event_id", "__seen"], "__new", "ports")
    hits = summed.filter((F.col("__seen") == 1) & (F.col("ports") > threshold))
    return hits.select("event_id", "pid", F.timestamp_micros("__us").alias("ts"), "ports")


def suspicious_execs(execs: DataFrame) -> DataFrame:
    """Executions with a suspicious command line, allowed programs left out."""
    hit = functools.reduce(operator.or_, [F.col("filename").rlike(re2(p)) for p in SUSPICIOUS_COMMANDS])
    return execs.filter(~is_allowed_process(F.col("filename")) & hit)


def suspicious_ports(conns: DataFrame) -> DataFrame:
    return conns.filter(F.col("dport").isin(*SUSPICIOUS_PORTS))


def sensitive_files(files: DataFrame) -> DataFrame:
    """Access to account files, with READ or WRITE."""
    hit = functools.reduce(operator.or_, [F.contains("filename", F.lit(f)) for f in SENSITIVE_FILES])
    return files.filter(hit).withColumn("mode", F.when(F.col("flags").bitwiseAND(WRITE_FLAG) == WRITE_FLAG, "WRITE").otherwise("READ"))


def privilege_gains(setuid: DataFrame) -> DataFrame:
    return setuid.filter((F.col("new_uid") == 0) & (F.col("old_uid") != 0))


def security_events(execs: DataFrame, conns: DataFrame, files: DataFrame, setuid: DataFrame) -> DataFrame:
    """One stream of security events from the four telemetry tables."""
    def event(df, event_type, severity, reason, details):
        pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
        return df.select(
            "event_id", "ts", F.lit(event_type).alias("event_type"), F.lit(severity).alias("severity"), F.lit("ebpf").alias("source"),
            F.col("pid").cast("bigint").alias("pid"), F.lit(reason).alias("reason"), F.create_map(*pairs).alias("details"))

    dest = F.concat_ws(":", net.long_le_to_ipv4(F.col("daddr")), F.col("dport").cast("string"))
    parts = [
        event(suspicious_execs(execs), "exec_suspicious", "high", "Suspicious Command Execution", {"path": F.col("filename"), "ppid": F.col("ppid")}),
        event(suspicious_ports(conns), "port_scan", "high", "Connection to Suspicious Port", {"destination": dest, "dest_ip": net.long_le_to_ipv4(F.col("daddr"))}),
        event(sensitive_files(files), "file_access", "high", "Sensitive File Access", {"file": F.col("filename"), "mode": F.col("mode")}),
        event(privilege_gains(setuid), "privesc", "critical", "Privilege Escalation to Root", {"from_uid": F.col("old_uid"), "to_uid": F.col("new_uid")}),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def egress_report(conns: DataFrame, allowed_ips=(), allowed_cidrs=(), domain_ips: DataFrame | None = None, resolvers=(),
                  allowed_ranges: DataFrame | None = None) -> DataFrame:
    """(dest_ip, verdict, connections): what a default-drop firewall with these lists would do.

    `domain_ips` has (ip) rows resolved from allowed domains; it is joined after counting, a row
    per destination, and so are `allowed_ranges`, (range) rows of both families in any number. `resolvers` are allowed on port 53 only; such a destination may have both verdicts.
    """
    dns = net.long_le_to_ipv4(F.col("daddr")).isin(*resolvers) & (F.col("dport") == 53) if resolvers else F.lit(False)
    counted = conns.groupBy("daddr", dns.alias("__dns")).agg(F.count("*").alias("connections")).withColumn("dest_ip", net.long_le_to_ipv4(F.col("daddr"))).drop("daddr")
    allowed = F.col("__dns") | net.in_any_cidr(net.ipv4_to_long(F.col("dest_ip")), (*ALWAYS_ALLOWED, *allowed_cidrs))
    if allowed_ips:
        allowed = allowed | F.col("dest_ip").isin(*allowed_ips)
    if domain_ips is not None:
        listed = domain_ips.select(F.col("ip").alias("dest_ip")).distinct().withColumn("__listed", F.lit(True))
        counted = counted.join(listed, "dest_ip", "left")
        allowed = allowed | F.coalesce("__listed", F.lit(False))
    if allowed_ranges is not None:
        counted = range_matches(counted, allowed_ranges, "dest_ip", "range", out="__range")
        allowed = allowed | F.col("__range").isNotNull()
    verdict = F.when(allowed, "allowed").otherwise("would_block")
    return counted.groupBy("dest_ip", verdict.alias("verdict")).agg(F.sum("connections").alias("connections"))


def dns_drift(resolved: DataFrame) -> DataFrame:
    """Changes of a domain's addresses between snapshots, from (domain, snapshot, ip) rows."""
    sets = resolved.groupBy("domain", "snapshot").agg(F.array_sort(F.collect_set("ip")).alias("ips"))
    w = Window.partitionBy("domain").orderBy("snapshot")
    out = sets.withColumn("previous", F.lag("ips").over(w)).filter("previous IS NOT NULL AND previous <> ips")
    return out.withColumns({"added": F.array_except("ips", "previous"), "removed": F.array_except("previous", "ips")})


def new_processes(snapshots: DataFrame, day: str = "day") -> DataFrame:
    """Processes in a snapshot that the one before did not have; the first snapshot is the baseline."""
    # One row per snapshot: the time of the one before.
    steps = snapshots.select(day).distinct().withColumn("__before", F.lag(day).over(Window.orderBy(day)))
    steps = steps.where("__before IS NOT NULL")
    held = snapshots.withColumnRenamed(day, "__before").join(steps, "__before").select(day, "pid")
    return snapshots.join(steps.select(day), day, "left_semi").join(held, [day, "pid"], "left_anti")
