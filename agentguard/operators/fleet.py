"""Fleet: overview, compliance, check-ins, keys, tokens, policy lifecycle, rollouts, health, integrity."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentguard.sources.readers import METRICS

# Allowed policy transitions, health ranking, defense layers, rollout waves.
TRANSITIONS = [
    ("draft", "approved"), ("draft", "rejected"), ("approved", "published"), ("approved", "rejected"), ("published", "superseded"),
]
HEALTH_RANK = {"healthy": 0, "unknown": 1, "degraded": 1, "down": 2}
LAYERS = [(1, "proxy"), (2, "firewall"), (3, "ebpf")]
WAVES = ("canary", "wave1", "wave2", "full")


def overview(agents: DataFrame) -> DataFrame:
    """One row: agents in all, healthy, unhealthy and stale."""
    return agents.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "unhealthy", "stale")])


def version_distribution(agents: DataFrame) -> DataFrame:
    return agents.filter("version <> ''").groupBy("version").agg(F.count("*").alias("agents"))


def with_policy_state(agents: DataFrame, groups: DataFrame, versions: DataFrame) -> DataFrame:
    """Add compliance and the current version of each agent's group.

    Unassigned: no group, an unknown one, or one without a current version. The group and
    version tables are joined by key; the optimiser broadcasts them when they are small.
    """
    g = groups.select(F.col("group_id").alias("policy_group_id"), F.col("current_version_id").alias("version_id"))
    v = versions.select("version_id", F.col("policy_hash").alias("current_hash"))
    out = agents.join(g, "policy_group_id", "left").join(v, "version_id", "left")
    state = (
        F.when(F.col("version_id").isNull(), "unassigned")
        .when(F.col("current_hash").isNull(), "non_compliant")
        .when(F.col("policy_hash") == F.col("current_hash"), "compliant")
        .otherwise("non_compliant")
    )
    return out.withColumn("compliance", state)


def compliance_counts(agents: DataFrame, groups: DataFrame, versions: DataFrame) -> DataFrame:
    return with_policy_state(agents, groups, versions).groupBy("compliance").agg(F.count("*").alias("agents"))


def pending_policy_updates(agents: DataFrame, groups: DataFrame, versions: DataFrame) -> DataFrame:
    """Agents whose policy hash differs from the current version: the update each one gets."""
    state = with_policy_state(agents, groups, versions)
    late = state.filter("current_hash IS NOT NULL AND NOT (policy_hash <=> current_hash)")
    return late.select("agent_id", F.lit("update_policy").alias("action"), "version_id", F.col("current_hash").alias("policy_hash"))


def latest_checkins(checkins: DataFrame, n: int = 10) -> DataFrame:
    """The newest n check-ins per agent; the row-number filter becomes a per-group limit before the shuffle."""
    w = Window.partitionBy("agent_id").orderBy(F.col("timestamp").desc(), F.col("checkin_id").desc())
    return checkins.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def current_state(checkins: DataFrame) -> DataFrame:
    """State of each agent by its newest check-in."""
    newest = F.max_by(F.struct("timestamp", "health_status", "checkin_id"), F.struct("timestamp", "checkin_id"))
    return checkins.groupBy("agent_id").agg(newest.alias("s")).select(
        "agent_id", F.col("s.timestamp").alias("last_checkin_at"), F.col("s.health_status").alias("status"), F.col("s.checkin_id").alias("checkin_id"))


def stale_agents(state: DataFrame, now: Column, threshold_seconds: int) -> DataFrame:
    """Agents whose newest check-in is older than the threshold and that are not marked stale yet."""
    age = now.cast("timestamp").cast("long") - F.col("last_checkin_at").cast("timestamp").cast("long")
    return state.filter((F.col("status") != "stale") & (age > threshold_seconds))


def _metrics(checkins: DataFrame) -> Column:
    return F.from_json(F.coalesce("metrics_summary", F.lit("{}")), METRICS)


def security_totals(checkins: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """One row: decisions and denials of the last hours; malformed metrics count nothing."""
    recent = checkins.filter(F.col("timestamp") > now - F.make_dt_interval(hours=F.lit(hours))).withColumn("m", _metrics(checkins))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return recent.agg(total("m.decisions_total").alias("total_decisions"), total("m.decisions_denied").alias("total_denied"))


def detection_totals(checkins: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(scanner, detections): the maps of all recent check-ins added up by key."""
    recent = checkins.filter(F.col("timestamp") > now - F.make_dt_interval(hours=F.lit(hours))).select(_metrics(checkins).alias("m"))
    pairs = recent.select(F.explode("m.scanner_detections").alias("scanner", "n"))
    return pairs.groupBy("scanner").agg(F.sum("n").alias("detections"))


def agents_with_tag(agents: DataFrame, status: str | None = None, tag: str | None = None) -> DataFrame:
    out = agents.filter(F.col("status") == status) if status else agents
    return out.filter(F.array_contains("tags", tag)) if tag else out


def active_keys(keys: DataFrame) -> DataFrame:
    """The newest active key of each group."""
    pick = F.max_by("key_id", F.struct("created_at", "key_id"))
    return keys.filter("status = 'active'").groupBy("group_id").agg(pick.alias("key_id"))


def fold_key_events(events: DataFrame) -> DataFrame:
    """Status of each key from its events (created, rotated, revoked): the last one counts."""
    last = F.max_by(F.struct("event", "ts"), F.struct("ts", "event_id"))
    rotated = F.max(F.when(F.col("event") == "rotated", F.col("ts")))
    folded = events.groupBy("key_id").agg(last.alias("l"), rotated.alias("rotated_at"))
    return folded.select("key_id", F.when(F.col("l.event") == "created", "active").otherwise(F.col("l.event")).alias("status"), "rotated_at")


def key_counts(keys: DataFrame, now: Column) -> DataFrame:
    """(status, keys, overdue): overdue are active keys past their expiry."""
    overdue = F.count_if((F.col("status") == "active") & (F.col("expires_at") < now))
    return keys.groupBy("status").agg(F.count("*").alias("keys"), overdue.alias("overdue"))


def token_uses(uses: DataFrame, tokens: DataFrame) -> DataFrame:
    """Add accepted: the first use of a token that was issued. The winner is an aggregate, so a token tried very often stays cheap."""
    first = uses.groupBy("token").agg(F.min(F.struct("ts", "use_id")).alias("__f")).select("token", F.col("__f.use_id").alias("__winner"))
    issued = tokens.select("token").distinct().withColumn("__issued", F.lit(True))
    known = first.join(issued, "token", "left")
    accepted = F.coalesce("__issued", F.lit(False)) & (F.col("use_id") == F.col("__winner"))
    return uses.join(known, "token").withColumn("accepted", accepted).drop("__winner", "__issued")


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """Status changes of a policy version that are not allowed, with the status they met. A version starts as a draft.

    A refused change leaves the status as it is. Statuses only move forward, so a version has no
    more accepted changes than the longest path of TRANSITIONS; each is the first event after the
    one before that its status allows, found by an aggregate, so a version with very many events
    costs no more memory than others.
    """
    key = F.struct("ts", "event_id")
    state = _accepted_changes(events)
    steps = events.join(state, "version_id")
    previous_status, accepted = F.col("__s0"), F.lit(False)
    for k in range(1, _longest_path() + 1):
        at = F.col(f"__k{k}")
        previous_status = F.when(at.isNotNull() & (key > at), F.col(f"__s{k}")).otherwise(previous_status)
        accepted = accepted | F.coalesce(key == at, F.lit(False))
    opening = (key == F.col("__first")) & (F.col("status") == "draft")
    refused = steps.withColumn("previous", previous_status).where(~(accepted | opening))
    return refused.select(*events.columns, "previous")


def version_states(events: DataFrame) -> DataFrame:
    """(version_id, status) after all changes that were accepted."""
    last = F.coalesce(*[F.col(f"__s{k}") for k in range(_longest_path(), -1, -1)])
    return _accepted_changes(events).select("version_id", last.alias("status"))


def _accepted_changes(events: DataFrame) -> DataFrame:
    """Per version its first event and, for each accepted change k, its key __k<k> and status __s<k>."""

    def allowed(before: Column, after: Column) -> Column:
        return functools.reduce(operator.or_, [(before == x) & (after == y) for x, y in TRANSITIONS])

    key = F.struct("ts", "event_id")
    first = events.groupBy("version_id").agg(F.min(key).alias("__first"))
    state = first.select("version_id", "__first", F.lit("draft").alias("__s0"), F.lit(None).cast(events.select(key.alias("k")).schema["k"].dataType).alias("__k0"))
    for k in range(_longest_path()):
        meets = events.join(state.select("version_id", f"__s{k}", f"__k{k}"), "version_id").where(
            (F.col(f"__k{k}").isNull() if k == 0 else key > F.col(f"__k{k}")) & allowed(F.col(f"__s{k}"), F.col("status")))
        found = meets.groupBy("version_id").agg(F.min(F.struct("ts", "event_id", "status")).alias("__m")).select(
            "version_id", F.struct("__m.ts", "__m.event_id").alias(f"__k{k + 1}"), F.col("__m.status").alias(f"__s{k + 1}"))
        state = state.join(found, "version_id", "left")
    return state


def _longest_path(status: str = "draft") -> int:
    return max((1 + _longest_path(b) for a, b in TRANSITIONS if a == status), default=0)


def current_versions(events: DataFrame) -> DataFrame:
    """The version published last in each group; a publication that was refused moves nothing."""
    state = _accepted_changes(events)
    accepted = F.array(*[F.struct(F.col(f"__k{k}").alias("key"), F.col(f"__s{k}").alias("status")) for k in range(1, _longest_path() + 1)])
    published = state.select("version_id", F.explode(accepted).alias("__c")).where("__c.status = 'published'").select("version_id", "__c.key.event_id")
    pick = F.max_by("version_id", F.struct("ts", "event_id"))
    return events.join(published, ["version_id", "event_id"], "left_semi").groupBy("group_id").agg(pick.alias("current_version_id"))


def rollout_waves(agents: DataFrame, order: str, canary_percent: int, wave1_percent: int = 25, wave2_percent: int = 50) -> DataFrame:
    """Wave of each agent in `order`: canary first (at least one agent), then wave1, wave2 and the rest.

    Numbering needs a total order. Agents are range-partitioned and sorted; counts per range
    give each one its offset, so no single task sees the whole fleet.
    """
    n = F.col("__n")
    canary = F.when((F.floor(n * canary_percent / 100) == 0) & (n > 0) & F.lit(canary_percent > 0), 1).otherwise(F.floor(n * canary_percent / 100))
    numbered = number_rows(agents, order)
    total = agents.agg(F.count("*").alias("__n"))
    out = numbered.join(F.broadcast(total))  # one row
    wave = (
        F.when(F.col("position") <= canary, WAVES[0])
        .when(F.col("position") <= canary + F.floor(n * wave1_percent / 100), WAVES[1])
        .when(F.col("position") <= canary + F.floor(n * (wave1_percent + wave2_percent) / 100), WAVES[2])
        .otherwise(WAVES[3])
    )
    return out.withColumn("wave", wave).drop("__n")


def number_rows(df: DataFrame, order: str, buckets: int = 256) -> DataFrame:
    """Add position (from 1) by a unique order column of any sortable type, from counts per bucket.

    Buckets lie between quantiles of a sample of about 16 values per bucket, drawn by hash, so ids that are
    clustered are spread as evenly as others.
    """
    total = df.agg(F.count(order)).first()[0]
    share = min(1.0, 16 * buckets / max(1, total))
    drawn = F.pmod(F.xxhash64(order), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted(r[0] for r in df.where(F.col(order).isNotNull() & drawn).select(order).collect())
    cuts = sorted(set(sample[:: max(1, len(sample) // buckets)]))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array(F.lit(None))
    cut = df.withColumn("__b", F.size(F.filter(bounds, lambda c: c <= F.col(order))))
    sizes = cut.groupBy("__b").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most a row per bucket
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0))).drop("__c")
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(order))
    return cut.withColumn("__i", inside).join(offsets, "__b").withColumn("position", F.col("__before") + F.col("__i")).drop("__b", "__i", "__before")


def pending_tasks(tasks: DataFrame) -> DataFrame:
    """The first pending task of each agent."""
    pick = F.min_by(F.struct("task_id", "target_version", "wave"), F.struct("scheduled_at", "task_id"))
    return tasks.filter("status = 'pending'").groupBy("agent_id").agg(pick.alias("t")).select("agent_id", "t.*")


def rollout_stats(rollouts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(rollout_id, total, completed, failed), counted by the tasks' own rollout."""
    counts = tasks.groupBy("rollout_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    joined = rollouts.select("rollout_id").join(counts, "rollout_id", "left")
    return joined.select("rollout_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "completed", "failed")])


def wave_failure_rates(tasks: DataFrame, max_rate: float) -> DataFrame:
    """(rollout_id, wave, finished, failed, failure_rate, halt) over finished tasks."""
    finished = F.count_if(F.col("status").isin("completed", "failed", "rolled_back"))
    failed = F.count_if(F.col("status").isin("failed", "rolled_back"))
    counts = tasks.groupBy("rollout_id", "wave").agg(finished.alias("finished"), failed.alias("failed"))
    rate = F.when(F.col("finished") > 0, F.col("failed") / F.col("finished")).otherwise(F.lit(0.0))
    return counts.withColumn("failure_rate", rate).withColumn("halt", F.col("failure_rate") > max_rate)


def health_rollup(reports: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, overall, missing_layers) of every host: the worst layer counts; a missing or unknown one degrades.

    Only reports of the known layers count, the last of each by time and report_id.
    """
    rank = F.lit(1)
    for status, r in HEALTH_RANK.items():
        rank = F.when(F.col("status") == status, r).otherwise(rank)
    known = reports.filter(F.col("layer").isin(*[k for k, _ in LAYERS]))
    last = known.groupBy("host", "layer").agg(F.max_by("status", F.struct("ts", "report_id")).alias("status"))
    found = last.groupBy("host").agg(F.max(rank).alias("worst"), F.count("*").alias("layers"))
    per = hosts.select("host").join(found, "host", "left").select("host", F.coalesce("worst", F.lit(0)).alias("worst"), F.coalesce("layers", F.lit(0)).alias("layers"))
    worst = F.greatest("worst", F.when(F.col("layers") < len(LAYERS), 1).otherwise(0))
    overall = F.when(worst == 2, "down").when(worst == 1, "degraded").otherwise("healthy")
    return per.select("host", overall.alias("overall"), (F.lit(len(LAYERS)) - F.col("layers")).alias("missing_layers"))


def integrity_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(host, tampered): items whose hash differs from, or is missing against, the expected one."""
    a = actual.select("host", F.col("binary_hash").alias("__b"), F.col("policy_hash").alias("__p"))
    joined = expected.join(a, "host", "left")
    items = [
        F.when(~F.coalesce(F.col("binary_hash") == F.col("__b"), F.lit(False)), "binary (hash mismatch)"),
        F.when(~F.coalesce(F.col("policy_hash") == F.col("__p"), F.lit(False)), "policy (hash mismatch)"),
    ]
    return joined.select("host", F.array_compact(F.array(*items)).alias("tampered"))
