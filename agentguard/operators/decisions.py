"""Allow/deny decisions for requests and responses: one projection per message, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.functions import jsonfuncs, net, text as tx
from agentguard.functions.entropy import window_stats
from agentguard.functions.expr import computed_once, let
from agentguard.functions.regex import re2
from agentguard.operators import malscan, redact, scan
from agentguard.operators.policy import ALLOW, DENY, Policy
from agentguard.operators.scan import SCAN_RESULT, drop_views, with_views
from agentguard.operators.vulnscan import vuln_finding
from agentguard.rules import injection, malware, pii, secrets, vuln
from agentguard.sources.readers import over_size

VERDICT = f"struct<decision:string,reason:string,stage:string,finding:{SCAN_RESULT}>"

# Platforms and the directive forms that refer to one.
PLATFORMS = ("slack", "github", "jira", "confluence", "google", "microsoft", "gitlab", "jsm")
DIRECTIVE_PREFIXES = ("use ", "invoke ", "call ")
DIRECTIVE_SUFFIXES = ("-send", "-create", "-delete", "-update", "-search", "-list", "-get")


def verdict(decision, reason, stage: str, finding: Column | None = None) -> Column:
    reason = reason if isinstance(reason, Column) else F.lit(reason)
    decision = decision if isinstance(decision, Column) else F.lit(decision)
    return F.struct(
        decision.alias("decision"), reason.alias("reason"), F.lit(stage).alias("stage"),
        (scan.no_result() if finding is None else finding).alias("finding"),
    ).cast(VERDICT)


def parse_requests(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add json_status, method (canonical), params (JSON text) and args (flattened strings)."""
    df = df.withColumn("json_status", jsonfuncs.json_status(F.col(raw)))
    rpc = F.from_json(F.when(F.col("json_status") == "ok", F.col(raw)), "struct<method:string,params:string>")
    df = df.withColumn("__rpc", rpc)
    params = F.coalesce(F.col("__rpc.params"), F.when(F.col(raw).rlike(r'"params"\s*:\s*null'), F.lit("null")))
    nested = F.col("params").rlike(r"^\s*[\[{]")
    return (
        df.withColumn("method", tx.canonical_method(F.col("__rpc.method")))
        .withColumn("params", params)
        .withColumn("args", F.when(nested, jsonfuncs.flatten_json_strings(F.col("params"))).otherwise(F.concat("params", F.lit(" "))))
        .drop("__rpc")
    )


def _in_list(value: Column, names) -> Column:
    return F.lower(value).isin(*[n.lower() for n in names]) if names else F.lit(False)


def _arg_filter_stage(policy: Policy) -> Column:
    hit = F.lit(False)
    for tool, regex in policy.effective_arg_filters().items():
        hit = F.when(F.col("method") == tool, F.col("args").rlike(re2(regex))).otherwise(hit)
    return F.when(hit, verdict(DENY, "sensitive data detected in arguments", "arg_filter"))


def _domain_stage(policy: Policy) -> Column:
    if not policy.domain_allowlist:
        return F.lit(None).cast(VERDICT)
    url = F.get_json_object("params", "$.url")
    denied = lambda reason: verdict(DENY, reason, "domain_allowlist")

    def judge(pair: Column) -> Column:
        allowed = F.lit(False)
        for pattern in policy.domain_allowlist:
            allowed = allowed | net.match_domain(pair["domain"], F.lit(pattern))
        return (
            F.when(F.coalesce(pair["url"], F.lit("")) == "", denied("cannot extract URL from web request for domain validation"))
            .when(pair["problem"].isNotNull(), denied(F.concat(F.lit("unsafe URL rejected: "), pair["problem"])))
            .when(pair["domain"] == "", denied("cannot parse domain from URL"))
            .when(~allowed, denied("domain not in allowlist"))
        )

    facts = F.struct(url.alias("url"), net.url_problem(url).alias("problem"), net.extract_domain(url).alias("domain"))
    return F.when(F.startswith("method", F.lit("web.")), let(facts, judge))


def _finding_stage(finding: Column, stage: str) -> Column:
    return let(finding, lambda f: F.when(f.isNotNull(), verdict(DENY, f["description"], stage, f)))


def _unless_tool(tools, finding: Column) -> Column:
    return F.when(~F.col("method").isin(*tools), finding) if tools else finding


def _scanned_rules(policy: Policy, direction: str) -> tuple:
    """Rules that a message of this direction is looked through for."""
    rules: tuple = ()
    if policy.prompt_injection:
        rules += (*injection.PACK, injection.IMPERATIVE_START)
    if policy.vuln_scan and direction == "request":
        rules += vuln.PACK
    if policy.malware_scan and direction == "response":
        rules += (*malware.PACK, injection.BASE64_RUN)
    if policy.secrets_scan:
        rules += secrets.select(policy.secrets_scan.rules, policy.secrets_scan.custom)
    if policy.pii_scan:
        rules += pii.select(policy.pii_scan.rules)
    return rules


def request_verdict(policy: Policy, views, default_action: Column | None = None, raw: str = "raw") -> Column:
    """The first stage that decides, evaluated lazily in order of cost."""
    default = default_action if default_action is not None else F.lit(policy.default_action)
    allowed = _in_list(F.col("method"), policy.allowlist)
    missing = F.coalesce(F.col("method"), F.lit("")) == ""
    stages = [
        F.when(over_size(F.col(raw), policy.max_message_bytes), verdict(DENY, "message too large", "message_size")),
        F.when(F.col("json_status") == "duplicate", verdict(DENY, "duplicate JSON keys detected", "duplicate_keys")),
        F.when(F.col("json_status") == "invalid", verdict(DENY, "invalid JSON-RPC format", "parse_error")),
        F.when(missing, verdict(DENY, "missing method field in JSON-RPC", "parse_error")),
        F.when(F.col("params").isNull(), verdict(DENY, "invalid params JSON in JSON-RPC", "parse_error")),
        F.when(_in_list(F.col("method"), policy.denylist), verdict(DENY, "tool explicitly denied by denylist", "denylist")),
    ]
    if policy.allowlist:
        stages.append(F.when(~allowed, verdict(DENY, "tool not in allowlist", "allowlist")))
    stages += [_arg_filter_stage(policy), _domain_stage(policy)]
    if policy.vuln_scan:
        cfg = policy.vuln_scan
        stages.append(_finding_stage(_unless_tool(cfg.exclude_tools, vuln_finding(views, cfg.rules)), "vuln_scan"))
    if policy.prompt_injection and policy.prompt_injection.scan_requests:
        found = scan.injection_finding(views, "request", policy.prompt_injection.sensitivity)
        stages.append(_finding_stage(found, "injection_scan"))
    if policy.secrets_scan and policy.secrets_scan.scan_requests:
        cfg = policy.secrets_scan
        found = scan.secrets_finding(views, secrets.select(cfg.rules, cfg.custom))
        stages.append(_finding_stage(_unless_tool(cfg.exclude_tools, found), "secrets_scan"))
    if policy.pii_scan and policy.pii_scan.scan_requests:
        cfg = policy.pii_scan
        found = scan.pii_finding(views, pii.select(cfg.rules, cfg.min_confidence))
        stages.append(_finding_stage(_unless_tool(cfg.exclude_tools, found), "pii_scan"))
    if policy.allowlist:
        stages.append(verdict(ALLOW, "tool in allowlist, scans passed", "allowlist"))
    else:
        reason = F.when(default == ALLOW, "default allowed").otherwise("default denied")
        stages.append(verdict(F.when(default == ALLOW, ALLOW).otherwise(DENY), reason, "default_action"))
    return F.coalesce(*stages)


def _finish(df: DataFrame, out: str) -> DataFrame:
    """Spread the verdict over decision, reason, stage and scan_results."""
    v = F.col(out)
    return df.withColumns({
        "decision": v["decision"],
        "reason": v["reason"],
        "stage": v["stage"],
        "scan_results": F.array_compact(F.array(v["finding"])),
    }).drop(out)


def evaluate_requests(df: DataFrame, policy: Policy, raw: str = "raw", default_action: Column | None = None) -> DataFrame:
    """Add decision, reason, stage and scan_results to JSON-RPC requests.

    `default_action` may be a column, e.g. from an override that was active at the time.
    """
    parsed = parse_requests(df, raw)
    parsed, views = with_views(parsed, F.col("args"), _scanned_rules(policy, "request"), normalised=bool(policy.prompt_injection))
    parsed = computed_once(parsed, "__v", request_verdict(policy, views, default_action, raw))
    return drop_views(_finish(parsed, "__v"))


def shadow_compare(df: DataFrame, live: Policy, candidate: Policy, raw: str = "raw") -> DataFrame:
    """Evaluate two policies in one pass over the messages."""
    parsed = parse_requests(df, raw)
    rules = _scanned_rules(live, "request") + _scanned_rules(candidate, "request")
    normalised = bool(live.prompt_injection or candidate.prompt_injection)
    parsed, views = with_views(parsed, F.col("args"), rules, normalised=normalised)
    parsed = computed_once(parsed, "live", request_verdict(live, views, raw=raw))
    parsed = computed_once(parsed, "candidate", request_verdict(candidate, views, raw=raw))
    return drop_views(parsed.withColumns({
        "live_decision": F.col("live.decision"), "live_stage": F.col("live.stage"),
        "candidate_decision": F.col("candidate.decision"), "candidate_stage": F.col("candidate.stage"),
    }).drop("live", "candidate"))


def _brackets(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(names, " "), F.lit("]"))


def evaluate_responses(df: DataFrame, policy: Policy, body: str = "body", method: str = "method") -> DataFrame:
    """Add decision, reason, stage, scan_results, redacted_body and was_redacted.

    Injection and malware deny; credentials and personal data deny or are redacted, the
    second scanner reading what the first one left.
    """
    tool = F.col(method)
    df, views = with_views(df, F.col(body), _scanned_rules(policy, "response"), normalised=bool(policy.prompt_injection))
    none = scan.no_result()
    inj, mal = none, none
    if policy.prompt_injection and policy.prompt_injection.scan_responses:
        cfg = policy.prompt_injection
        high = None
        if cfg.sensitivity == "high":
            stats = window_stats(injection.ENTROPY_WINDOW, injection.ENTROPY_STEP, injection.ENTROPY_MIN_NONSPACE, injection.ENTROPY_LIMIT)
            df = df.withColumn("__windows", stats(views.nfkc))
            high = F.col("__windows.high") > 0
        inj = scan.injection_finding(views, "response", cfg.sensitivity, high)
        if cfg.trusted_response_tools:
            inj = F.when(~tool.isin(*cfg.trusted_response_tools), inj)
    df = df.withColumn("__inj", inj)
    if policy.malware_scan:
        cfg = policy.malware_scan
        df = malscan.with_malware_finding(df, views, "__mal", cfg.checks, cfg.entropy_threshold, cfg.max_decoded_size)
    else:
        df = df.withColumn("__mal", mal)

    work = views.raw
    sec_found, sec_rules = none, ()
    if policy.secrets_scan and policy.secrets_scan.scan_responses:
        cfg = policy.secrets_scan
        sec_rules = secrets.select(cfg.rules, cfg.custom)
        sec_found = scan.secrets_finding(views, sec_rules)
        if cfg.exclude_tools:
            sec_found = F.when(~tool.isin(*cfg.exclude_tools), sec_found)
    df = df.withColumn("__sec", sec_found)
    redacting = bool(sec_rules) and policy.secrets_scan.action == "redact"
    nothing = F.struct(work.alias("text"), F.array().cast(redact.NOTHING).alias("found"))
    redacted = redact.redact_secrets(views.name("raw"), views.name("fold"), sec_rules) if redacting else nothing
    # Computed once, as the second look for rules would otherwise hold the first one and all of the redaction.
    df = computed_once(df, "__work", F.when(F.col("__sec").isNotNull(), redacted).otherwise(nothing) if redacting else nothing)

    # The second scanner reads the text the first one left.
    pii_found, pii_rules = none, ()
    if policy.pii_scan and policy.pii_scan.scan_responses:
        cfg = policy.pii_scan
        pii_rules = pii.select(cfg.rules)
        df, left = with_views(df, F.col("__work.text"), pii_rules, prefix="__u", normalised=False)
        pii_found = scan.pii_finding(left, pii.select(cfg.rules, cfg.min_confidence))
        if cfg.exclude_tools:
            pii_found = F.when(~tool.isin(*cfg.exclude_tools), pii_found)
    df = df.withColumn("__pii", pii_found)
    pii_redacting = bool(pii_rules) and policy.pii_scan.action == "redact"
    kept = F.struct(F.col("__work.text").alias("text"), F.array().cast(redact.NOTHING).alias("found"))
    if pii_redacting:
        clean = redact.redact_pii("__work.text", "__u_fold", pii_rules)
        kept = F.when(F.col("__pii").isNotNull(), clean).otherwise(kept)
    df = df.withColumn("__final", kept)

    was = (F.size("__work.found") > 0) | (F.size("__final.found") > 0)
    reasons = F.array_compact(F.array(
        F.when(F.size("__work.found") > 0, F.concat(F.lit("secrets redacted: "), _brackets(F.col("__work.found")))),
        F.when(F.size("__final.found") > 0, F.concat(F.lit("PII redacted: "), _brackets(F.col("__final.found")))),
    ))
    blocks_secrets = bool(sec_rules) and not redacting
    blocks_pii = bool(pii_rules) and not pii_redacting
    stages = [
        _finding_stage(F.col("__inj"), "injection_scan"),
        _finding_stage(F.col("__mal"), "malware_scan"),
        _finding_stage(F.col("__sec"), "secrets_scan") if blocks_secrets else F.lit(None).cast(VERDICT),
        _finding_stage(F.col("__pii"), "pii_scan") if blocks_pii else F.lit(None).cast(VERDICT),
        F.when(was, verdict(ALLOW, F.concat(F.lit("response redacted: "), F.array_join(reasons, "; ")), "response_redaction")),
        verdict(ALLOW, "response clean", "response_clean"),
    ]
    df = computed_once(df, "__v", F.coalesce(*stages))
    denied_early = F.col("__inj").isNotNull() | F.col("__mal").isNotNull()
    soft = F.array_compact(F.array("__sec", "__pii"))
    results = F.when(F.col("__v.stage").isin("injection_scan", "malware_scan"), F.array_compact(F.array("__v.finding"))).otherwise(
        F.when(F.col("__v.stage") == "secrets_scan", F.array_compact(F.array("__sec")))
        .when(F.col("__v.stage") == "response_clean", F.array().cast(f"array<{SCAN_RESULT}>"))
        .otherwise(soft)
    )
    df = df.withColumns({
        "decision": F.col("__v.decision"), "reason": F.col("__v.reason"), "stage": F.col("__v.stage"),
        "scan_results": results,
        "was_redacted": was & ~denied_early & (F.col("__v.decision") == ALLOW),
        "redacted_body": F.when(was & ~denied_early & (F.col("__v.decision") == ALLOW), F.col("__final.text")),
    })
    df = df.drop("__inj", "__mal", "__sec", "__pii", "__work", "__final", "__v", "__windows")
    return drop_views(drop_views(df), "__u")


def agent_scope(text: Column, scopes: Column) -> Column:
    """Platform outside the agent's scopes that a response directs to, or NULL. Empty scopes allow all."""
    low = F.lower(text)
    found = F.lit(None).cast("string")
    for platform in reversed(PLATFORMS):
        directive = tx.contains_any(
            low, [p + platform for p in DIRECTIVE_PREFIXES] + [platform + s for s in DIRECTIVE_SUFFIXES])
        out_of_scope = ~F.array_contains(F.transform(scopes, F.lower), platform)
        found = F.when(out_of_scope & F.contains(low, F.lit(platform + "-")) & directive, F.lit(platform)).otherwise(found)
    return F.when(F.size(scopes) > 0, found)


def agent_allowed(agent: Column, policy: Policy) -> Column:
    """Agent is on the allowlist; an empty list allows every agent."""
    return _in_list(agent, policy.agent_allowlist) if policy.agent_allowlist else F.lit(True)


def channel_verdict(df: DataFrame, rules: DataFrame, channel: str = "channel", tool: str = "tool") -> DataFrame:
    """Add channel_decision and channel_reason from rule rows (channel, kind, tool).

    Blocked tools come first; a channel with allowed tools denies the others. The rules are
    joined on their key, so any number of channels costs one lookup per message.
    """
    r = rules.withColumnsRenamed({"channel": "r_channel", "tool": "r_tool"})
    per_channel = r.groupBy("r_channel").agg(F.max(F.when(F.col("kind") == "allowed", 1).otherwise(0)).alias("has_allowed"))
    per_tool = r.groupBy("r_channel", "r_tool").agg(
        F.max((F.col("kind") == "blocked").cast("int")).alias("is_blocked"),
        F.max((F.col("kind") == "allowed").cast("int")).alias("is_allowed"),
    )
    c, t = F.col(channel), F.col(tool)
    out = df.join(per_channel, c == F.col("r_channel"), "left").withColumn("__known", F.col("r_channel").isNotNull()).drop("r_channel")
    out = out.join(per_tool, (c == F.col("r_channel")) & (t == F.col("r_tool")), "left").drop("r_channel", "r_tool")
    blocked = F.coalesce("is_blocked", F.lit(0)) == 1
    listed = F.coalesce("is_allowed", F.lit(0)) == 1
    has_list = F.coalesce("has_allowed", F.lit(0)) == 1
    reason = (
        F.when(~F.col("__known"), "no policy for channel")
        .when(blocked, F.format_string('tool "%s" blocked for channel "%s"', t, c))
        .when(has_list & listed, "tool allowed for channel")
        .when(has_list, F.format_string('tool "%s" not in allowed list for channel "%s"', t, c))
        .otherwise("tool not restricted for channel")
    )
    denied = F.col("__known") & (blocked | (has_list & ~listed))
    return out.withColumns({
        "channel_decision": F.when(denied, DENY).otherwise(ALLOW), "channel_reason": reason,
    }).drop("__known", "has_allowed", "is_blocked", "is_allowed")


def evaluate_policies(df: DataFrame, policies: dict[str, Policy], raw: str = "raw") -> DataFrame:
    """Every message under several policies in one pass: a row per (message, policy)."""
    parsed = parse_requests(df, raw)
    rules = sum((_scanned_rules(p, "request") for p in policies.values()), ())
    normalised = any(p.prompt_injection for p in policies.values())
    parsed, views = with_views(parsed, F.col("args"), rules, normalised=normalised)
    per_policy = F.array(*[
        F.struct(F.lit(name).alias("policy_id"), request_verdict(p, views).alias("v")) for name, p in policies.items()
    ])
    out = parsed.withColumn("__p", F.explode_outer(per_policy)).select("*", "__p.policy_id", F.col("__p.v").alias("__v")).drop("__p")
    return drop_views(_finish(out, "__v"))
