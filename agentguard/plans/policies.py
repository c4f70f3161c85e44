"""Policy, response, permission and data-loss queries over seeded messages."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from agentguard.functions import jsonfuncs, labels, net, text as tx
from agentguard.operators import decisions as dec, permissions as perm
from agentguard.operators.policy import (
    ChannelPolicy, InjectionScan, MalwareScan, PiiScan, Policy, SecretsScan, VulnScan,
)
from agentguard.operators.policydiff import check_cases, diff_policies
from agentguard.operators.scan import drop_views, with_views
from agentguard.plans import inputs
from agentguard.plans.base import q, register, sql_valid, values
from agentguard.plans.detection import _B64_KW, _IMPERATIVE, SQL_URL_VERDICT, sql_urls_indexed
from agentguard.rules import injection, malware, permissions as prules, pii, secrets, vuln

LIVE = Policy(
    default_action="deny",
    allowlist=("chat.send", "chat.stream", "tools.invoke", "web.get", "search.query", "code.generate"),
    denylist=("shell.exec", "file.write"),
    arg_filters=(
        ("chat.send", r"never used: replaced by the next filter"),
        ("chat.send", r"\b\d{3}-\d{2}-\d{4}\b"),
        ("tools.invoke", r"(api_key|password|token|secret)[^\w]*[=:]?\s*['\"]?[a-zA-Z0-9/+._-]{20,}"),
    ),
    domain_allowlist=("api.example.com", "*.example.org"),
    vuln_scan=VulnScan(exclude_tools=("code.generate",)),
    prompt_injection=InjectionScan(sensitivity="high"),
    malware_scan=MalwareScan(),
    secrets_scan=SecretsScan(action="redact"),
    pii_scan=PiiScan(action="redact", exclude_tools=("search.query",)),
    agent_allowlist=("scribe", "ledger", "concierge", "builder"),
    channels={
        "slack": ChannelPolicy(blocked_tools=("web.get", "tools.invoke")),
        "telegram": ChannelPolicy(allowed_tools=("chat.send", "search.query"), blocked_tools=("file.read",)),
    },
)
CANDIDATE = Policy(
    default_action="allow",
    denylist=("shell.exec", "tools.invoke"),
    vuln_scan=VulnScan(rules=("sqli", "xss")),
    secrets_scan=SecretsScan(action="block", rules=("aws", "github")),
    pii_scan=PiiScan(action="redact", min_confidence="high"),
    siem_enabled=True,
)
_ARGS_VIEW = {"raw": "args", "lower": "lower(args)", "nfkc_lower": "lower(args)"}


# --- SQL text of the request pipeline for the checking engine -------------------------------

def _stage(stage: str, cond: str, reason: str) -> str:
    return f"CASE WHEN {cond} THEN {q(stage + '#')} || {reason} END"


def _rule_stages(stage, rules, reason, view) -> list[str]:
    return [_stage(stage, f"regexp_matches({view[r.view]}, {q(r.pattern)})", q(reason(r))) for r in rules]


def _sql_imperative(col: str) -> str:
    segs = f"list_filter(string_split_regex({col}, '[.!\\n]'), lambda s: s <> '')"
    imp = f"list_filter({segs}, lambda s: regexp_matches(regexp_replace(lower(s), '^\\s+', ''), '^({_IMPERATIVE})'))"
    return f"(strlen({col}) >= 100 AND len({segs}) >= 3 AND len({imp}) / len({segs}) > 0.4)"


def _sql_base64_cte(source: str) -> str:
    return f"""
      SELECT msg_id, bool_or({_B64_KW}) AS b64 FROM (
        SELECT msg_id, lower(try(decode(from_base64(rpad(rtrim(b, '='), (ceil(strlen(rtrim(b, '=')) / 4.0) * 4)::INT, '='))))) AS d
        FROM (SELECT msg_id, unnest(regexp_extract_all(text, {q(injection.BASE64_PATTERN)})) AS b FROM {source})) GROUP BY msg_id"""


def sql_request_stages(policy: Policy) -> str:
    """First deciding stage as `stage#reason`, over the columns made by `sql_requests`."""
    low = lambda names: "(" + ", ".join(q(n.lower()) for n in names) + ")"
    s = [
        _stage("message_size", f"strlen(raw) > {policy.max_message_bytes}", q("message too large")),
        _stage("duplicate_keys", "status = 'duplicate'", q("duplicate JSON keys detected")),
        _stage("parse_error", "status = 'invalid'", q("invalid JSON-RPC format")),
        _stage("parse_error", "coalesce(method, '') = ''", q("missing method field in JSON-RPC")),
        _stage("parse_error", "NOT has_params", q("invalid params JSON in JSON-RPC")),
    ]
    if policy.denylist:
        s.append(_stage("denylist", f"lower(method) IN {low(policy.denylist)}", q("tool explicitly denied by denylist")))
    if policy.allowlist:
        s.append(_stage("allowlist", f"lower(method) NOT IN {low(policy.allowlist)}", q("tool not in allowlist")))
    for tool, regex in policy.effective_arg_filters().items():
        s.append(_stage("arg_filter", f"method = {q(tool)} AND regexp_matches(args, {q(regex)})", q("sensitive data detected in arguments")))
    if policy.domain_allowlist:
        match = " OR ".join(
            f"(host = {q(d[2:])} OR ends_with(host, {q(d[1:])}))" if d.startswith("*.") else f"host = {q(d)}" for d in policy.domain_allowlist)
        web = "starts_with(method, 'web.')"
        s += [
            _stage("domain_allowlist", f"{web} AND url = ''", q("cannot extract URL from web request for domain validation")),
            _stage("domain_allowlist", f"{web} AND contains(url, '@')", q("unsafe URL rejected: URL contains embedded credentials")),
            _stage("domain_allowlist", f"{web} AND NOT ({match})", q("domain not in allowlist")),
        ]
    if policy.vuln_scan:
        groups = {"sqli": vuln.SQLI, "path_traversal": vuln.PATH_TRAVERSAL, "command_injection": vuln.COMMAND_INJECTION, "xss": vuln.XSS}
        v = []
        for g in vuln.ORDER:
            if policy.vuln_scan.rules and g not in policy.vuln_scan.rules:
                continue
            if g == "ssrf":
                v.append("CASE WHEN ssrf IS NOT NULL THEN 'vuln_scan#' || ssrf END")
            else:
                v += _rule_stages("vuln_scan", groups[g], lambda r: f"vuln_scan: {vuln.REASONS[r.rule_id]} (pattern: {r.pattern})", _ARGS_VIEW)
        tools = policy.vuln_scan.exclude_tools
        body = f"coalesce({', '.join(v)})"
        s.append(f"CASE WHEN method NOT IN ({', '.join(map(q, tools))}) THEN {body} END" if tools else body)
    if policy.prompt_injection:
        s += _rule_stages("injection_scan", injection.PACK, lambda r: f"prompt_injection: {injection.REASONS[r.rule_id]} (pattern: {r.pattern})", _ARGS_VIEW)
        if policy.prompt_injection.sensitivity == "high":
            s.append(_stage("injection_scan", "b64", q("prompt_injection: base64-encoded injection payload detected")))
        s.append(_stage("injection_scan", _sql_imperative("args"), q("prompt_injection: high imperative instruction density in tool arguments")))
    if policy.secrets_scan:
        rules = secrets.select(policy.secrets_scan.rules)
        s += _rule_stages("secrets_scan", rules, lambda r: f"secrets_scan: {r.note} detected", _ARGS_VIEW)
    if policy.pii_scan:
        p = [
            _stage("pii_scan", f"regexp_extract(args, {q(r.pattern)}) <> '' AND {sql_valid(r.validator, f'regexp_extract(args, {q(r.pattern)})')}",
                   q(f"pii_scan: {r.name} detected ({r.note})"))
            for r in pii.select(policy.pii_scan.rules, policy.pii_scan.min_confidence)
        ]
        tools = policy.pii_scan.exclude_tools
        body = f"coalesce({', '.join(p)})"
        s.append(f"CASE WHEN method NOT IN ({', '.join(map(q, tools))}) THEN {body} END" if tools else body)
    if policy.allowlist:
        s.append(q("allowlist#tool in allowlist, scans passed"))
    else:
        s.append(q("default_action#default allowed" if policy.default_action == "allow" else "default_action#default denied"))
    return f"coalesce({', '.join(s)})"


_SQL_URL_HOST = "CASE WHEN contains(url, '://') THEN regexp_extract(url, '://(?:[^/]*@)?([^/:?#]*)', 1) ELSE split_part(url, '/', 1) END"
SQL_REQUESTS = f"""(
  SELECT b.*, u.ssrf, x.b64 FROM (
    SELECT *, CASE WHEN NOT json_valid(raw) THEN 'invalid' WHEN shape = 'dup' THEN 'duplicate' ELSE 'ok' END AS status,
      CASE WHEN shape IN ('nomethod', 'junk', 'single') THEN NULL ELSE trim(regexp_replace(sent_method, '\\s+', ' ', 'g')) END AS method,
      shape <> 'noparams' AS has_params, concat('q ', text, ' url ', url, ' ') AS args, {_SQL_URL_HOST} AS host
    FROM {inputs.SQL_MESSAGES}) b
  LEFT JOIN (SELECT k, min_by(verdict, idx) AS ssrf FROM ({SQL_URL_VERDICT.replace("@source@", sql_urls_indexed(
      "(SELECT msg_id, concat('q ', text, ' url ', url, ' ') AS args FROM " + inputs.SQL_MESSAGES + ")", "msg_id", "args"))})
      WHERE verdict IS NOT NULL GROUP BY k) u ON b.msg_id = u.k
  LEFT JOIN ({_sql_base64_cte(inputs.SQL_MESSAGES)}) x ON b.msg_id = x.msg_id)"""


def sql_decided(policy: Policy, name: str = "v") -> str:
    allow = f"{name} LIKE 'allowlist#tool in%' OR {name} = 'default_action#default allowed'"
    return (
        f"CASE WHEN {allow} THEN 'allow' ELSE 'deny' END AS decision, "
        f"substr({name}, instr({name}, '#') + 1) AS reason, split_part({name}, '#', 1) AS stage"
    )


SQL_REQUEST_DECISIONS = f"SELECT msg_id, conv_id, ts, agent, channel, method, raw, {sql_decided(LIVE)} FROM (SELECT *, {sql_request_stages(LIVE)} AS v FROM {SQL_REQUESTS})"


def request_decisions_df(spark, sf, policy=LIVE):
    return dec.evaluate_requests(inputs.messages(spark, sf), policy)


@register("request_decisions", f"SELECT msg_id, decision, reason, stage FROM ({SQL_REQUEST_DECISIONS})")
def request_decisions(spark, sf):
    return request_decisions_df(spark, sf).select("msg_id", "decision", "reason", "stage")


@register("shadow_compare", f"""
    SELECT split_part(a, '#', 1) AS live_stage, la AS live_decision, split_part(b, '#', 1) AS candidate_stage, lb AS candidate_decision,
      count(*) AS messages, count_if(la <> lb) AS changed
    FROM (SELECT *, CASE WHEN a LIKE 'allowlist#tool in%' THEN 'allow' ELSE 'deny' END AS la,
        CASE WHEN b LIKE 'default_action#default allowed' THEN 'allow' ELSE 'deny' END AS lb
      FROM (SELECT *, {sql_request_stages(LIVE)} AS a, {sql_request_stages(CANDIDATE)} AS b FROM {SQL_REQUESTS}))
    GROUP BY ALL
""")
def shadow_compare(spark, sf):
    both = dec.shadow_compare(inputs.messages(spark, sf), LIVE, CANDIDATE)
    changed = F.count_if(F.col("live_decision") != F.col("candidate_decision")).alias("changed")
    return both.groupBy("live_stage", "live_decision", "candidate_stage", "candidate_decision").agg(F.count("*").alias("messages"), changed)


@register("policy_matrix", f"""
    SELECT policy_id, stage, decision, count(*) AS messages FROM (
      SELECT 'live' AS policy_id, {sql_decided(LIVE)} FROM (SELECT {sql_request_stages(LIVE)} AS v FROM {SQL_REQUESTS})
      UNION ALL
      SELECT 'candidate' AS policy_id, {sql_decided(CANDIDATE)} FROM (SELECT {sql_request_stages(CANDIDATE)} AS v FROM {SQL_REQUESTS}))
    GROUP BY ALL
""")
def policy_matrix(spark, sf):
    rows = dec.evaluate_policies(inputs.messages(spark, sf), {"live": LIVE, "candidate": CANDIDATE})
    return rows.groupBy("policy_id", "stage", "decision").agg(F.count("*").alias("messages"))


SMALL = dataclasses.replace(CANDIDATE, max_message_bytes=1500)


@register("message_size", f"SELECT msg_id, decision, reason FROM (SELECT msg_id, {sql_decided(SMALL)} FROM (SELECT *, {sql_request_stages(SMALL)} AS v FROM {SQL_REQUESTS})) WHERE stage = 'message_size'")
def message_size(spark, sf):
    rows = dec.evaluate_requests(inputs.messages(spark, sf), SMALL)
    return rows.where("stage = 'message_size'").select("msg_id", "decision", "reason")


@register("json_checks", f"""
    SELECT msg_id, status AS json_status, method, CASE WHEN status = 'ok' AND shape IN ('ok') THEN args END AS args,
      strlen(raw) > 1500 AS over_size FROM {SQL_REQUESTS}
""".replace("status = 'ok' AND shape IN ('ok')", "shape = 'ok'").replace("SELECT msg_id, status", "SELECT msg_id, status"))
def json_checks(spark, sf):
    from agentguard.sources.readers import over_size

    parsed = dec.parse_requests(inputs.messages(spark, sf))
    return parsed.select(
        "msg_id", "json_status", F.when(F.col("json_status") == "ok", F.col("method")).otherwise(
            F.when(F.col("json_status") == "duplicate", tx.canonical_method(F.col("sent_method")))).alias("method"),
        F.when(F.col("shape") == "ok", F.col("args")).alias("args"), over_size(F.col("raw"), 1500).alias("over_size"))


# --- responses ------------------------------------------------------------------------------

RESPONSE_POLICY = Policy(
    default_action="deny", prompt_injection=InjectionScan(trusted_response_tools=("search.query",)),
    malware_scan=MalwareScan(), secrets_scan=SecretsScan(action="redact"),
    pii_scan=PiiScan(action="redact", exclude_tools=("code.generate",)),
)


def sql_fold(source: str, text: str, found: str, rules, tag, active: str) -> str:
    """Redaction of column `text`, one subquery per rule; adds the list `found`."""
    sql = f"SELECT *, []::VARCHAR[] AS {found} FROM {source}"
    for r in rules:
        hits = f"CASE WHEN {active} THEN list_filter(regexp_extract_all({text}, {q(r.pattern)}), lambda x: {sql_valid(r.validator, 'x')}) ELSE [] END"
        step = (
            "list_reduce(h, lambda acc, x: CASE WHEN instr(acc, x) = 0 THEN acc ELSE "
            f"left(acc, instr(acc, x) - 1) || {q(tag(r))} || substr(acc, instr(acc, x) + length(x)) END, {text})"
        )
        sql = (
            f"SELECT * EXCLUDE (h) REPLACE (CASE WHEN len(h) > 0 THEN {step} ELSE {text} END AS {text}, "
            f"CASE WHEN len(h) > 0 THEN list_append({found}, {q(r.name)}) ELSE {found} END AS {found}) "
            f"FROM (SELECT *, {hits} AS h FROM ({sql}))"
        )
    return sql


def sql_injection_reason(col: str) -> str:
    parts = [
        f"CASE WHEN regexp_matches(lower({col}), {q(r.pattern)}) THEN {q(f'prompt_injection_response: {injection.REASONS[r.rule_id]} (pattern: {r.pattern})')} END"
        for r in injection.PACK
    ]
    parts.append(f"CASE WHEN {_sql_imperative(col)} THEN 'prompt_injection_response: high imperative instruction density in tool response' END")
    return f"coalesce({', '.join(parts)})"


def sql_malware_reason(col: str) -> str:
    view = {"raw": col, "lower": f"lower({col})"}
    what = lambda r: f"{r.name} detected" if r.rule_id == "script_detection" else f"signature match — {r.name}"
    parts = [f"CASE WHEN regexp_matches({view[r.view]}, {q(r.pattern)}) THEN {q('malware_scan: ' + what(r))} END" for r in malware.PACK]
    return f"coalesce({', '.join(parts)})"


def sql_malware_blobs(source: str, key: str, col: str) -> str:
    """(k, blob_reason): the first decoded blob with a finding."""
    magic = " ".join(f"WHEN octet_length(d) >= 4 AND starts_with(hex(d), {q(m)}) THEN {q(f'malware_scan: executable content detected — {n} (magic bytes match)')}" for n, m in malware.MAGICS)
    words = " ".join(f"WHEN contains(lower(try(decode(d))), {q(k)}) THEN {q(f'malware_scan: dangerous keyword detected in decoded content: {k}')}" for k in malware.DANGEROUS_KEYWORDS)
    return f"""SELECT k, min_by(v, idx) AS blob_reason FROM (SELECT k, idx, CASE {magic} {words} END AS v FROM (
        SELECT k, idx, try(from_base64(rpad(rtrim(bs[idx], '='), (ceil(strlen(rtrim(bs[idx], '=')) / 4.0) * 4)::INT, '='))) AS d FROM (
          SELECT k, bs, unnest(range(1, len(bs) + 1)) AS idx FROM (SELECT {key} AS k, regexp_extract_all({col}, {q(injection.BASE64_PATTERN)}) AS bs FROM {source}))))
        WHERE v IS NOT NULL GROUP BY k"""


def _sql_responses() -> str:
    sec = " OR ".join(f"regexp_matches(text, {q(r.pattern)})" for r in secrets.PACK)
    base = f"""(SELECT m.msg_id, trim(m.sent_method) AS method, m.text, m.text AS work,
        CASE WHEN trim(m.sent_method) <> 'search.query' THEN {sql_injection_reason('m.text')} END AS inj,
        coalesce({sql_malware_reason('m.text')}, b.blob_reason) AS mal, ({sec}) AS has_sec
      FROM {inputs.SQL_MESSAGES} m LEFT JOIN ({sql_malware_blobs(inputs.SQL_MESSAGES, 'msg_id', 'text')}) b ON m.msg_id = b.k)"""
    after_secrets = sql_fold(base, "work", "sec_found", secrets.PACK, lambda r: secrets.PLACEHOLDER, "has_sec")
    detect = " OR ".join(
        f"(regexp_extract(work, {q(r.pattern)}) <> '' AND {sql_valid(r.validator, f'regexp_extract(work, {q(r.pattern)})')})"
        for r in pii.select(min_confidence="medium"))
    flagged = f"(SELECT *, (method <> 'code.generate' AND ({detect})) AS has_pii FROM ({after_secrets}))"
    folded = sql_fold(flagged, "work", "pii_found", pii.PACK, pii.placeholder, "has_pii")
    reasons = (
        "'response redacted: ' || array_to_string(list_filter([CASE WHEN len(sec_found) > 0 THEN 'secrets redacted: [' || array_to_string(sec_found, ' ') || ']' END, "
        "CASE WHEN len(pii_found) > 0 THEN 'PII redacted: [' || array_to_string(pii_found, ' ') || ']' END], lambda x: x IS NOT NULL), '; ')"
    )
    return f"""
      SELECT msg_id, CASE WHEN inj IS NOT NULL OR mal IS NOT NULL THEN 'deny' ELSE 'allow' END AS decision,
        CASE WHEN inj IS NOT NULL THEN inj WHEN mal IS NOT NULL THEN mal WHEN red THEN {reasons} ELSE 'response clean' END AS reason,
        CASE WHEN inj IS NOT NULL THEN 'injection_scan' WHEN mal IS NOT NULL THEN 'malware_scan' WHEN red THEN 'response_redaction' ELSE 'response_clean' END AS stage,
        CASE WHEN inj IS NULL AND mal IS NULL AND red THEN work END AS redacted_body
      FROM (SELECT *, len(sec_found) > 0 OR len(pii_found) > 0 AS red FROM ({folded}))"""


@register("response_decisions", _sql_responses())
def response_decisions(spark, sf):
    msgs = inputs.messages(spark, sf).withColumn("method", F.trim("sent_method"))
    return dec.evaluate_responses(msgs, RESPONSE_POLICY, body="text").select("msg_id", "decision", "reason", "stage", "redacted_body")


# --- channels, scopes, agents ---------------------------------------------------------------

CHANNEL_ROWS = [
    (name, kind, tool) for name, cp in LIVE.channels.items()
    for kind, tools in (("blocked", cp.blocked_tools), ("allowed", cp.allowed_tools)) for tool in tools
]


@register("channel_policy", f"""
    WITH r AS {values(CHANNEL_ROWS, ["channel", "kind", "tool"])}
    SELECT msg_id, CASE WHEN blocked OR (has_allowed AND NOT allowed) THEN 'deny' ELSE 'allow' END AS channel_decision,
      CASE WHEN NOT known THEN 'no policy for channel' WHEN blocked THEN 'tool "' || tool || '" blocked for channel "' || channel || '"'
        WHEN has_allowed AND allowed THEN 'tool allowed for channel'
        WHEN has_allowed THEN 'tool "' || tool || '" not in allowed list for channel "' || channel || '"' ELSE 'tool not restricted for channel' END AS channel_reason
    FROM (SELECT *, EXISTS (SELECT 1 FROM r WHERE r.channel = m.channel) AS known,
        EXISTS (SELECT 1 FROM r WHERE r.channel = m.channel AND r.tool = m.tool AND kind = 'blocked') AS blocked,
        EXISTS (SELECT 1 FROM r WHERE r.channel = m.channel AND r.tool = m.tool AND kind = 'allowed') AS allowed,
        EXISTS (SELECT 1 FROM r WHERE r.channel = m.channel AND kind = 'allowed') AS has_allowed
      FROM (SELECT msg_id, channel, trim(sent_method) AS tool FROM {inputs.SQL_MESSAGES}) m)
""")
def channel_policy(spark, sf):
    msgs = inputs.messages(spark, sf).select("msg_id", "channel", F.trim("sent_method").alias("tool"))
    rules = perm.lookup(spark, CHANNEL_ROWS, "channel string, kind string, tool string")
    return dec.channel_verdict(msgs, rules).select("msg_id", "channel_decision", "channel_reason")


_SCOPES = {"scribe": ["jira", "confluence"], "Ledger": ["google"], "concierge": ["slack", "jira"], "scout": []}


def _scopes_col(agent):
    out = F.array().cast("array<string>")
    for name, scopes in _SCOPES.items():
        out = F.when(agent == name, F.array(*map(F.lit, scopes)).cast("array<string>")).otherwise(out)
    return out


@register("agent_scope", f"""
    SELECT msg_id, agent, lower(agent) IN ({", ".join(q(a) for a in LIVE.agent_allowlist)}) AS agent_allowed,
      CASE WHEN len(scopes) > 0 THEN coalesce({", ".join(
        f"CASE WHEN NOT list_contains(scopes, {q(p)}) AND contains(low, {q(p + '-')}) AND (" + " OR ".join(
            f"contains(low, {q(d)})" for d in [v + p for v in dec.DIRECTIVE_PREFIXES] + [p + s for s in dec.DIRECTIVE_SUFFIXES]) + f") THEN {q(p)} END"
        for p in dec.PLATFORMS)}) END AS out_of_scope
    FROM (SELECT *, lower(text) AS low, CASE {" ".join(f"WHEN agent = {q(a)} THEN {s or '[]'}" for a, s in _SCOPES.items())} ELSE [] END AS scopes FROM {inputs.SQL_MESSAGES})
""")
def agent_scope(spark, sf):
    msgs = inputs.messages(spark, sf)
    return msgs.select(
        "msg_id", "agent", dec.agent_allowed(F.col("agent"), LIVE).alias("agent_allowed"),
        dec.agent_scope(F.col("text"), _scopes_col(F.col("agent"))).alias("out_of_scope"))


@register("intent_labels", f"""
    SELECT m AS method, CASE
        WHEN regexp_matches(m, '{"|".join(labels.SUSPICIOUS_METHOD)}') THEN 'unknown'
        WHEN regexp_matches(m, '{"|".join(labels.CODE_METHOD)}') THEN 'code_generation'
        WHEN regexp_matches(m, 'file\\.|fs\\.|read_file|write_file|list_dir') THEN 'file_operation'
        WHEN regexp_matches(m, '{"|".join(labels.SEARCH_METHOD)}') THEN 'search'
        WHEN regexp_matches(m, '{"|".join(labels.CHAT_METHOD)}') AND regexp_matches(lower(text), '{"|".join(labels.CODE_PARAMS)}') THEN 'code_generation'
        WHEN regexp_matches(m, '{"|".join(labels.CHAT_METHOD)}') THEN 'chat' ELSE 'unknown' END AS intent, count(*) AS messages
    FROM (SELECT lower(trim(sent_method)) AS m, text FROM {inputs.SQL_MESSAGES}) GROUP BY ALL
""")
def intent_labels(spark, sf):
    msgs = inputs.messages(spark, sf).withColumn("method", F.lower(F.trim("sent_method")))
    return msgs.groupBy("method", labels.classify_intent(F.col("method"), F.col("text")).alias("intent")).agg(F.count("*").alias("messages"))


@register("egress_urls", f"""
    SELECT msg_id, url, CASE WHEN NOT starts_with(url, 'https://') THEN 'must use https'
        WHEN h = '' THEN 'no host' WHEN h IN ('localhost', 'ip6-localhost', 'ip6-loopback') THEN 'localhost' WHEN h = '169.254.169.254' THEN 'metadata endpoint'
        WHEN regexp_matches(h, '^(127|10)\\.\\d+\\.\\d+\\.\\d+$|^192\\.168\\.\\d+\\.\\d+$|^169\\.254\\.|^172\\.(1[6-9]|2\\d|3[01])\\.') THEN 'internal address' END AS problem
    FROM (SELECT msg_id, u AS url, lower(regexp_extract(u, '://(?:[^/?#]*@)?([^/:?#]*)', 1)) AS h FROM (
      SELECT msg_id, unnest(regexp_extract_all(text, {q(tx.URL_PATTERN)})) AS u FROM {inputs.SQL_MESSAGES}))
""")
def egress_urls(spark, sf):
    from agentguard.operators.ssrf import URL_JAVA

    urls = inputs.messages(spark, sf).select("msg_id", F.explode_outer(tx.extract_urls(F.col("text"), URL_JAVA)).alias("url")).filter("url IS NOT NULL")
    return urls.withColumn("problem", net.egress_url_problem(F.col("url")))


# --- policy difference and case table --------------------------------------------------------

_SQL_DIFF = [
    ("default_action", "deny", "allow", "changed"), ("prompt_injection", "enabled", "disabled", "changed"), ("malware_scan", "enabled", "disabled", "changed"),
    ("siem.enabled", "false", "true", "changed"), ("allowlist", "6 entries: chat.send, chat.stream, code.generate, search.query, tools.invoke, web.get", None, "removed"),
    ("denylist", "1 entries: file.write", None, "removed"), ("denylist", None, "+1 entries: tools.invoke", "added"),
    ("domain_allowlist", "2 entries: *.example.org, api.example.com", None, "removed"),
]


@register("policy_diff", f"""
    SELECT d.*, coalesce(h.n, 0) AS decided_messages FROM {values(_SQL_DIFF, ["field", "old_value", "new_value", "change_type"])} d
    LEFT JOIN (SELECT stage, count(*) AS n FROM ({SQL_REQUEST_DECISIONS}) GROUP BY stage) h ON d.field = h.stage
""")
def policy_diff(spark, sf):
    """Differences of the two policies, each with the messages the changed field decided."""
    diff = diff_policies(spark, LIVE, CANDIDATE)
    hits = request_decisions_df(spark, sf).groupBy(F.col("stage").alias("field")).agg(F.count("*").alias("decided_messages"))
    return diff.join(hits, "field", "left").withColumn("decided_messages", F.coalesce("decided_messages", F.lit(0)))


#: What a case expects of a message: tools that write are denied, all others allowed; every ninth message has no decision.
_CASES = "CASE WHEN lower(trim(sent_method)) IN ('shell.exec', 'file.read', 'notes.write') THEN 'deny' ELSE 'allow' END"


@register("policy_case_mismatches", f"""
    SELECT c.msg_id, c.expected, d.decision AS actual FROM (SELECT msg_id, {_CASES} AS expected FROM {inputs.SQL_MESSAGES}) c
    LEFT JOIN (SELECT msg_id, decision FROM ({SQL_REQUEST_DECISIONS}) WHERE msg_id % 9 <> 0) d ON c.msg_id = d.msg_id WHERE c.expected IS DISTINCT FROM d.decision
""")
def policy_case_mismatches(spark, sf):
    """A table of cases run against the live policy: the cases whose decision is another one, or missing."""
    cases = inputs.messages(spark, sf).select("msg_id", F.expr(_CASES).alias("expected"))
    return check_cases(request_decisions_df(spark, sf).where("msg_id % 9 <> 0"), cases, "msg_id").select("msg_id", "expected", "actual")


# --- permissions ------------------------------------------------------------------------------

_SAMPLE = {"agents": inputs.PROFILES, "aliases": inputs.ALIASES, "grants": inputs.GRANTS}
PERMS = perm.Permissions(**_SAMPLE)
_CLASS_HITS = ", ".join(f"CASE WHEN regexp_matches(text, {q(r.pattern)}) THEN {q(f'{r.name}({r.category})')} END" for r in prules.CLASS_RULES)
_RANK = "CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in labels.CLASS_LEVELS.items()) + " END"
SQL_CLASSIFIED = f"""(
    SELECT *, CASE WHEN len(list_filter(hits, lambda h: contains(h, '(RESTRICTED)'))) > 0 THEN 'RESTRICTED'
        WHEN len(list_filter(hits, lambda h: contains(h, '(CONFIDENTIAL)'))) > 0 THEN 'CONFIDENTIAL'
        WHEN len(list_filter(hits, lambda h: contains(h, '(INTERNAL)'))) > 0 THEN 'INTERNAL' ELSE 'PUBLIC' END AS level
    FROM (SELECT *, list_filter([{_CLASS_HITS}], lambda h: h IS NOT NULL) AS hits FROM @source@))"""


@register("classify_messages", f"SELECT msg_id, level, level = 'RESTRICTED' AS blocked, array_to_string(hits, ', ') AS labels FROM {SQL_CLASSIFIED.replace('@source@', inputs.SQL_MESSAGES)}")
def classify_messages(spark, sf):
    df, views = with_views(inputs.messages(spark, sf), F.col("text"), PERMS.class_rules, normalised=False)
    out = df.select("msg_id", perm.classify(views, PERMS).alias("c"))
    return out.select("msg_id", "c.level", "c.blocked", F.array_join("c.labels", ", ").alias("labels"))


@register("classify_documents", f"SELECT level, count(*) AS documents, sum(len(hits))::BIGINT AS labels FROM {SQL_CLASSIFIED.replace('@source@', 'documents')} GROUP BY level")
def classify_documents(spark, sf):
    from agentguard.plans.base import table

    df, views = with_views(table(spark, sf, "documents", texts=True).select("text"), F.col("text"), PERMS.class_rules, normalised=False)
    out = df.select(perm.classify(views, PERMS).alias("c"))
    return out.groupBy("c.level").agg(F.count("*").alias("documents"), F.sum(F.size("c.labels")).alias("labels"))


_SQL_AGENT = f"""CASE lower(agent) {" ".join(f"WHEN '{a}' THEN '{n}'" for a, n in inputs.ALIASES)} {" ".join(f"WHEN '{a[0]}' THEN '{a[0]}'" for a in inputs.PROFILES)} ELSE 'default' END"""
_SQL_CEILING = f"""CASE {_SQL_AGENT} {" ".join(f"WHEN '{n}' THEN {labels.CLASS_LEVELS[c]}" for n, _, c in inputs.PROFILES)} END"""


@register("ceiling_check", f"SELECT msg_id, {_SQL_AGENT} AS agent, level, {_RANK.format(c='level')} <= {_SQL_CEILING} AS within FROM {SQL_CLASSIFIED.replace('@source@', inputs.SQL_MESSAGES)}")
def ceiling_check(spark, sf):
    df = perm.resolve_agent(inputs.messages(spark, sf), PERMS)
    df, views = with_views(df, F.col("text"), PERMS.class_rules, normalised=False)
    out = df.withColumn("c", perm.classify(views, PERMS))
    return out.select("msg_id", F.col("agent_canonical").alias("agent"), "c.level", perm.within_ceiling(F.col("c.level"), F.col("agent_ceiling")).alias("within"))


_TRIES = [("READ", 0), ("WRITE", 1)]


@register("scope_check", f"""
    WITH g AS {values(inputs.GRANTS, ["agent", "platform", "perm"])}
    SELECT msg_id, platform, permission,
      CASE WHEN a IN ({", ".join(q(n) for n, enabled, _ in inputs.PROFILES if not enabled)}) THEN 'agent "' || a || '" is disabled'
        WHEN NOT EXISTS (SELECT 1 FROM g WHERE g.agent = a AND g.platform = m.platform) THEN 'agent "' || a || '" has no access to platform "' || platform || '"'
        WHEN NOT EXISTS (SELECT 1 FROM g WHERE g.agent = a AND g.platform = m.platform AND g.perm = m.permission) THEN 'agent "' || a || '" lacks ' || permission || ' permission on "' || platform || '"'
        ELSE 'scope allowed' END AS scope_reason
    FROM (SELECT msg_id, {_SQL_AGENT} AS a, CASE conv_id % 4 WHEN 0 THEN 'jira' WHEN 1 THEN 'google' WHEN 2 THEN 'slack' ELSE 'gateway' END AS platform,
        CASE turn % 2 WHEN 0 THEN 'READ' ELSE 'WRITE' END AS permission FROM {inputs.SQL_MESSAGES}) m
""")
def scope_check(spark, sf):
    platform = F.element_at(F.array(*map(F.lit, ("jira", "google", "slack", "gateway"))), (F.col("conv_id") % 4 + 1).cast("int"))
    msgs = inputs.messages(spark, sf).withColumn("platform", platform).withColumn(
        "permission", F.when(F.col("turn") % 2 == 0, "READ").otherwise("WRITE"))
    return perm.check_scope(msgs, PERMS).select("msg_id", "platform", "permission", "scope_reason")


DLP = perm.Permissions(**_SAMPLE, corporate_email_domains=("example.com", "acme.test"), dlp_custom=((r"CVE-\d{4}-\d+", "cve", "[CVE]"),))


def _sql_dlp(source: str, text: str) -> str:
    """One subquery per pattern; RE2 replaces all hits at once."""
    sql = f"SELECT *, {text} AS s, []::VARCHAR[] AS labels FROM {source}"
    for r in DLP.all_dlp_rules():
        sql = (
            f"SELECT * REPLACE (regexp_replace(s, {q(r.pattern)}, {q(r.note)}, 'g') AS s, "
            f"list_concat(labels, list_transform(regexp_extract_all(s, {q(r.pattern)}), lambda x: {q(r.name)})) AS labels) FROM ({sql})"
        )
    return sql


@register("dlp_scrub", f"SELECT msg_id, s AS scrubbed, len(labels)::INT AS redactions, array_to_string(labels, ', ') AS labels FROM ({_sql_dlp(inputs.SQL_MESSAGES, 'text')})")
def dlp_scrub(spark, sf):
    out = inputs.messages(spark, sf).select("msg_id", perm.dlp_scrub("text", DLP).alias("d"))
    return out.select("msg_id", F.col("d.text").alias("scrubbed"), F.size("d.labels").alias("redactions"), F.array_join("d.labels", ", ").alias("labels"))


_PLATFORMS = {a: sorted({p for n, p, _ in inputs.GRANTS if n == a}) for a, _, _ in inputs.PROFILES}


def _sql_sanitize(col: str) -> str:
    parts = [f"CASE WHEN strlen({col}) > 1200 THEN 'response exceeds max length (' || strlen({col}) || ' > 1200)' END"]
    parts += [f"CASE WHEN regexp_matches({col}, {q(r.pattern)}) THEN {q('injection detected: ' + r.name)} END" for r in prules.RESPONSE_INJECTION]
    parts += [f"CASE WHEN regexp_matches({col}, {q(r.pattern)}) THEN {q('cross-action detected: ' + r.name)} END" for r in prules.CROSS_ACTION]
    for p in prules.PLATFORMS:
        acts = " OR ".join(f"contains(lower({col}), {q(p + s)})" for s in ("-send", "-create", "-delete", "-update", "-search", "-list", "-get"))
        dirs = " OR ".join(f"contains(lower({col}), {q(v + p)})" for v in ("use ", "invoke ", "call "))
        parts.append(f"CASE WHEN NOT list_contains(platforms, {q(p)}) AND ({acts}) THEN {q(f'cross-scope: response references {p} platform (agent lacks access)')} END")
        parts.append(f"CASE WHEN NOT list_contains(platforms, {q(p)}) AND ({dirs}) THEN {q(f'cross-scope: response directs use of {p} platform (agent lacks access)')} END")
    return f"coalesce({', '.join(parts)})"


_SQL_PLATFORMS = f"CASE {_SQL_AGENT} {' '.join(f'WHEN {q(a)} THEN {p}' for a, p in _PLATFORMS.items())} END"
SANITIZE = perm.Permissions(**_SAMPLE, max_response_bytes=1200)


@register("sanitize_responses", f"SELECT msg_id, {_sql_sanitize('text')} AS problem FROM (SELECT *, {_SQL_PLATFORMS} AS platforms FROM {inputs.SQL_MESSAGES})")
def sanitize_responses(spark, sf):
    df = perm.resolve_agent(inputs.messages(spark, sf), SANITIZE)
    df, views = with_views(df, F.col("text"), normalised=False)
    return df.select("msg_id", perm.sanitize_response(views, SANITIZE, F.col("agent_platforms")).alias("problem"))


_SQL_DLP_DEFAULT = _sql_dlp("(SELECT *, " + _SQL_PLATFORMS + f" AS platforms, {_SQL_CEILING} AS ceiling FROM " + SQL_CLASSIFIED.replace("@source@", inputs.SQL_MESSAGES) + ")", "text")


@register("permission_pipeline", f"""
    SELECT action, result, count(*) AS rows FROM (
      SELECT unnest(list_filter([
        {{'action': 'classify', 'result': CASE WHEN level = 'RESTRICTED' THEN 'deny' ELSE 'allow' END}},
        CASE WHEN level <> 'RESTRICTED' AND {_RANK.format(c='level')} > ceiling THEN {{'action': 'ceiling', 'result': 'deny'}} END,
        CASE WHEN level <> 'RESTRICTED' AND {_RANK.format(c='level')} <= ceiling AND len(labels) > 0 THEN {{'action': 'dlp', 'result': 'allow'}} END,
        CASE WHEN level <> 'RESTRICTED' AND {_RANK.format(c='level')} <= ceiling AND {_sql_sanitize('s')} IS NOT NULL THEN {{'action': 'sanitize', 'result': 'deny'}} END
      ], lambda x: x IS NOT NULL), recursive := true) FROM ({_SQL_DLP_DEFAULT}))
    GROUP BY ALL
""")
def permission_pipeline(spark, sf):
    perms = perm.Permissions(
        **_SAMPLE,
        corporate_email_domains=DLP.corporate_email_domains, dlp_custom=DLP.dlp_custom, max_response_bytes=1200)
    msgs = inputs.messages(spark, sf).withColumn("answer", perm.dlp_scrub("text", perms)["text"])
    out = perm.permission_pipeline(msgs, perms, response="answer")
    return out.select(F.explode_outer("audit").alias("a")).filter("a IS NOT NULL").groupBy("a.action", "a.result").agg(F.count("*").alias("rows"))


@register("conversation_scrub", f"""
    SELECT conv_id, string_agg(s, ' ' ORDER BY turn) || ' ' AS user_text FROM ({_sql_dlp("(SELECT * FROM " + inputs.SQL_MESSAGES + " WHERE role = 'user')", 'text')}) GROUP BY conv_id
""")
def conversation_scrub(spark, sf):
    from agentguard.sources.readers import conversation_user_text

    msgs = inputs.messages(spark, sf).filter("role = 'user'")
    scrubbed = msgs.withColumn("text", perm.dlp_scrub("text", DLP)["text"])
    return conversation_user_text(scrubbed)
