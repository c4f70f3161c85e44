"""Policies as a table: (policy_id, version, kind, field, value), kind `scalar` or `list`.

The number of policies does not enter the plan: requests are joined to their policy's row. Entries that say something of a
part of the requests also have a `subject` and, where the last one counts, a `position`:

| field | subject | value |
|---|---|---|
| denylist, allowlist, agent_allowlist, domain_allowlist | | tool, agent or domain pattern |
| arg_filter | tool | RE2 pattern |
| channel_blocked, channel_allowed | channel | tool |
| default_action, max_message_bytes | | scalar |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentguard.functions import net, text as tx
from agentguard.operators.domaintable import with_matched_domain
from agentguard.operators.patterntable import pattern_hits, pattern_table
from agentguard.operators.policy import ALLOW, DENY, MAX_MESSAGE_BYTES
from agentguard.session import staged


def version_changes(rows: DataFrame, keys=("policy_id",), version: str = "version") -> DataFrame:
    """(keys, version, field, change_type, old_value, new_value) between consecutive versions of each policy.

    A scalar that changes gives one row; the entries that a list gains or loses give a row each. A field
    that a version does not have counts as absent there, so it is compared with the version before all the same.
    """
    versions = rows.select(*keys, version).distinct()
    w = Window.partitionBy(*keys).orderBy(version)
    steps = versions.withColumn("__old", F.lag(version).over(w)).where("__old IS NOT NULL")
    values = rows.groupBy(*keys, version, "kind", "field").agg(F.array_sort(F.collect_set("value")).alias("v"))
    new = steps.join(values, [*keys, version]).select(*keys, version, "kind", "field", F.col("v").alias("new"))
    old = steps.join(values.withColumnRenamed(version, "__old"), [*keys, "__old"]).select(*keys, version, "kind", "field", F.col("v").alias("old"))
    both = old.join(new, [*keys, version, "kind", "field"], "full_outer")
    none = F.array().cast("array<string>")
    had, has = F.coalesce("old", none), F.coalesce("new", none)
    change = lambda kind, a, b: F.struct(F.lit(kind).alias("change_type"), a.alias("old_value"), b.alias("new_value"))
    null = F.lit(None).cast("string")
    scalar = F.array(change("changed", F.get(had, F.lit(0)), F.get(has, F.lit(0))))
    lists = F.concat(F.transform(F.array_except(has, had), lambda x: change("added", null, x)),
                     F.transform(F.array_except(had, has), lambda x: change("removed", x, null)))
    changed = both.where(had != has).withColumn("__c", F.explode(F.when(F.col("kind") == "scalar", scalar).otherwise(lists)))
    return changed.select(*keys, version, "field", "__c.*")


def _entries(rows: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """The entries of the policies that requests name, dealt by policy before they are grouped.

    Entries may be many times the table that they are made from, and hardly two of a task fall together: what groups them where
    they are read sorts all of them in the few tasks of that table.
    """
    named = staged(requests.select(key).where(F.col(key).isNotNull()).distinct(), "policies-named")
    return rows.join(named, key, "left_semi").repartition(key)


def evaluate_by_table(requests: DataFrame, rows: DataFrame, key: str = "policy_id", method: str = "method", raw: str = "raw") -> DataFrame:
    """Add decision and reason to requests by the policy that each names: size, denylist, allowlist, default action.

    `rows` holds one version per policy. A request whose policy is unknown is denied.
    """
    listed = lambda f: F.collect_set(F.when((F.col("kind") == "list") & (F.col("field") == f), F.lower("value")))
    scalar = lambda f: F.max(F.when((F.col("kind") == "scalar") & (F.col("field") == f), F.col("value")))
    policies = _entries(rows, requests, key).groupBy(key).agg(
        listed("denylist").alias("__deny"), listed("allowlist").alias("__allow"), scalar("default_action").alias("__default"),
        scalar("max_message_bytes").cast("long").alias("__most"))
    out = requests.join(policies, key, "left")
    name = F.lower(tx.canonical_method(F.col(method)))
    verdict = lambda decision, reason: F.struct(decision.alias("decision"), F.lit(reason).alias("reason"))
    deny, allow = F.lit(DENY), F.lit(ALLOW)
    judged = (
        F.when(F.col("__deny").isNull(), verdict(deny, "unknown policy"))
        .when(F.octet_length(raw) > F.coalesce("__most", F.lit(MAX_MESSAGE_BYTES)), verdict(deny, "message too large"))
        .when(F.array_contains("__deny", name), verdict(deny, "tool explicitly denied by denylist"))
        .when((F.size("__allow") > 0) & ~F.array_contains("__allow", name), verdict(deny, "tool not in allowlist"))
        .when(F.size("__allow") > 0, verdict(allow, "tool in allowlist, scans passed"))
        .when(F.coalesce("__default", deny) == ALLOW, verdict(allow, "default allowed"))
        .otherwise(verdict(deny, "default denied")))
    return out.withColumn("__v", judged).select("*", "__v.*").drop("__v", "__deny", "__allow", "__default", "__most")


def _verdict(decision, reason) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(text(decision).alias("decision"), text(reason).alias("reason"))


def evaluate_rows(requests: DataFrame, rows: DataFrame, key: str = "policy_id", request_id: str = "msg_id", raw: str = "raw", method: str = "method",
                  args: str = "args", url: str = "url", agent: str = "agent", channel: str = "channel") -> DataFrame:
    """Add decision, reason, agent_allowed, channel_decision and channel_reason to requests by the policy that each names.

    All entries of a policy count: size, denylist, allowlist, argument filters, domains of web tools, default action, agents and
    channels. `rows` holds one version per policy; `request_id` tells requests apart. A request whose policy is unknown is denied, as is
    one whose tool has a filter that is no RE2 pattern. Of several filters for a tool the one with the greatest `position` counts.
    """
    listed = lambda f: F.collect_set(F.when(F.col("field") == f, F.lower("value")))
    scalar = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    rows = _entries(rows, requests, key)
    policies = rows.groupBy(key).agg(
        listed("denylist").alias("__deny"), listed("allowlist").alias("__allow"), listed("agent_allowlist").alias("__agents"),
        F.count_if(F.col("field") == "domain_allowlist").alias("__domains"), scalar("default_action").alias("__default"),
        scalar("max_message_bytes").cast("long").alias("__most"))
    out = requests.join(policies, key, "left").withColumn("__tool", tx.canonical_method(F.col(method)))

    filters = rows.where("field = 'arg_filter'").groupBy(key, F.col("subject").alias("__tool")).agg(F.max_by("value", "position").alias("pattern"))
    patterns = pattern_table(filters, [key, "__tool"])
    # Staged, as the plan would have it four times, and without the policies, which add no row.
    sent = staged(requests.select(request_id, key, tx.canonical_method(F.col(method)).alias("__tool"), args), "filter-texts")
    hits = pattern_hits(sent, patterns, [key, "__tool"], request_id, args).select(request_id).distinct()
    out = out.join(hits.withColumn("__hit", F.lit(True)), request_id, "left")
    out = out.join(patterns.where("problem IS NOT NULL").select(key, "__tool", F.col("problem").alias("__problem")), [key, "__tool"], "left")

    domains = rows.where("field = 'domain_allowlist'").select(key, F.col("value").alias("pattern"))
    web = F.startswith("__tool", F.lit("web."))
    out = out.withColumn("__host", F.when(web, net.extract_domain(F.col(url))))
    out = with_matched_domain(out, domains, [key], "__host", "pattern", "__domain")

    channels = rows.where("field IN ('channel_blocked', 'channel_allowed')").select(
        key, F.col("subject").alias("__channel"), F.substring("field", 9, 7).alias("rule"), F.col("value").alias("tool"))
    per_channel = channels.groupBy(key, "__channel").agg(
        F.collect_set(F.when(F.col("rule") == "blocked", F.col("tool"))).alias("__blocked"),
        F.collect_set(F.when(F.col("rule") == "allowed", F.col("tool"))).alias("__listed"))
    out = out.withColumn("__channel", F.col(channel)).join(per_channel, [key, "__channel"], "left")

    name = F.lower("__tool")
    problem, has = net.url_problem(F.col(url)), F.size("__allow") > 0
    checked = web & (F.col("__domains") > 0)
    judged = (
        F.when(F.col("__deny").isNull(), _verdict(DENY, "unknown policy"))
        .when(F.octet_length(raw) > F.coalesce("__most", F.lit(MAX_MESSAGE_BYTES)), _verdict(DENY, "message too large"))
        .when(F.array_contains("__deny", name), _verdict(DENY, "tool explicitly denied by denylist"))
        .when(has & ~F.array_contains("__allow", name), _verdict(DENY, "tool not in allowlist"))
        .when(F.col("__problem").isNotNull(), _verdict(DENY, F.concat(F.lit("invalid argument filter: "), "__problem")))
        .when(F.col("__hit"), _verdict(DENY, "sensitive data detected in arguments"))
        .when(checked & (F.coalesce(F.col(url), F.lit("")) == ""), _verdict(DENY, "cannot extract URL from web request for domain validation"))
        .when(checked & problem.isNotNull(), _verdict(DENY, F.concat(F.lit("unsafe URL rejected: "), problem)))
        .when(checked & (F.col("__host") == ""), _verdict(DENY, "cannot parse domain from URL"))
        .when(checked & F.col("__domain").isNull(), _verdict(DENY, "domain not in allowlist"))
        .when(has, _verdict(ALLOW, "tool in allowlist, scans passed"))
        .when(F.coalesce("__default", F.lit(DENY)) == ALLOW, _verdict(ALLOW, "default allowed"))
        .otherwise(_verdict(DENY, "default denied")))
    tool, where = F.col("__tool"), F.col(channel)
    said = (
        F.when(F.col("__blocked").isNull(), _verdict(ALLOW, "no policy for channel"))
        .when(F.array_contains("__blocked", tool), _verdict(DENY, F.format_string('tool "%s" blocked for channel "%s"', tool, where)))
        .when((F.size("__listed") > 0) & F.array_contains("__listed", tool), _verdict(ALLOW, "tool allowed for channel"))
        .when(F.size("__listed") > 0, _verdict(DENY, F.format_string('tool "%s" not in allowed list for channel "%s"', tool, where)))
        .otherwise(_verdict(ALLOW, "tool not restricted for channel")))
    allowed = F.coalesce((F.size("__agents") == 0) | F.array_contains("__agents", F.lower(F.col(agent))), F.lit(False))
    out = out.withColumns({"__v": judged, "__c": said, "agent_allowed": allowed})
    return out.select(*requests.columns, "__v.decision", "__v.reason", "agent_allowed",
                      F.col("__c.decision").alias("channel_decision"), F.col("__c.reason").alias("channel_reason"))


#: Fields of a policy document, by what they must hold.
_TEXT_LISTS = ("allowlist", "denylist", "domain_allowlist")
_COUNTS = ("evaluation_timeout_ms", "max_message_bytes")
_FIELDS = ("version", "default_action", *_TEXT_LISTS, "arg_filters", *_COUNTS)
RECORD_CHECKS = ("not_an_object", "no_default_action", "bad_default_action", "bad_version", *(f"bad_{f}" for f in _TEXT_LISTS), "bad_arg_filters",
                 *(f"bad_{f}" for f in _COUNTS), "unknown_field")


def policy_record_checks(rows: DataFrame, document: str = "document") -> DataFrame:
    """The rows with one boolean per constraint of a policy document (JSON); true means violated.

    A text that is no JSON object violates `not_an_object` alone. Whole numbers may be written with a zero fraction.
    """
    text = F.col(document)
    value = F.try_parse_json(text)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT<")), F.lit(False))
    part = lambda f, kind="variant": F.try_variant_get("__value", f"$.{f}", kind)
    kind = lambda f: F.schema_of_variant(part(f))
    # A field that is there as null has the type VOID; one that is not there has none.
    wrong = lambda f, ok: F.col("__object") & F.coalesce(~ok, F.lit(False)) & kind(f).isNotNull()
    filters = F.forall(part("arg_filters", "array<variant>"), lambda x: F.schema_of_variant(x) == "OBJECT<regex: STRING, tool: STRING>")
    number = lambda f: F.coalesce(kind(f).rlike("^(BIGINT|DECIMAL|DOUBLE)") & (part(f, "double") >= 1) & (part(f, "double") == F.floor(part(f, "double"))), F.lit(False))
    found = rows.withColumns({"__value": value, "__object": is_object})
    checks = {
        "not_an_object": ~F.col("__object"), "no_default_action": F.col("__object") & kind("default_action").isNull(),
        "bad_default_action": wrong("default_action", (kind("default_action") == "STRING") & part("default_action", "string").isin(ALLOW, DENY)),
        "bad_version": wrong("version", kind("version") == "STRING"),
        **{f"bad_{f}": wrong(f, kind(f).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(F.forall(part(f, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))) for f in _TEXT_LISTS},
        "bad_arg_filters": wrong("arg_filters", F.startswith(kind("arg_filters"), F.lit("ARRAY<")) & F.coalesce(filters, F.lit(False))),
        **{f"bad_{f}": wrong(f, number(f)) for f in _COUNTS},
        "unknown_field": F.col("__object") & (F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, _FIELDS)))) > 0),
    }
    return found.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}).drop("__value", "__object")
