"""Permissions: agent scopes, data classification, data-loss scrubbing, response sanitising."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentguard.functions.expr import computed_once, let, sql_str
from agentguard.functions.labels import CLASS_LEVELS, class_rank
from agentguard.functions.regex import check_user_pattern
from agentguard.operators.redact import candidates_sql
from agentguard.operators.scan import TextViews, drop_views, fires_sql, with_views
from agentguard.rules import permissions as defaults
from agentguard.rules.model import Rule
from agentguard.sources.readers import local_table

OFF, REDACT, BLOCK = "OFF", "REDACT", "BLOCK"


def lookup(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A rule table; the optimiser broadcasts it by its size."""
    return local_table(spark, rows, schema)


@dataclass(frozen=True)
class Permissions:
    """Rule tables of the permission layer."""

    agents: tuple[tuple[str, bool, str], ...] = ()  # name, enabled, ceiling; `default` serves unknown agents
    aliases: tuple[tuple[str, str], ...] = ()  # alias, name
    grants: tuple[tuple[str, str, str], ...] = ()  # name, platform, permission
    class_rules: tuple[Rule, ...] = defaults.CLASS_RULES
    block_levels: tuple[str, ...] = defaults.BLOCK_LEVELS
    dlp_mode: str = REDACT
    dlp_rules: tuple[Rule, ...] = defaults.DLP_RULES
    dlp_custom: tuple[tuple[str, str, str], ...] = ()  # pattern, label, replacement
    corporate_email_domains: tuple[str, ...] = ()
    allow_phrases: tuple[str, ...] = ()
    max_response_bytes: int = defaults.MAX_RESPONSE_BYTES
    injection_rules: tuple[Rule, ...] = defaults.RESPONSE_INJECTION
    cross_action_rules: tuple[Rule, ...] = defaults.CROSS_ACTION
    platforms: tuple[str, ...] = defaults.PLATFORMS
    extra: dict = field(default_factory=dict)

    def all_dlp_rules(self) -> tuple[Rule, ...]:
        """Built-in patterns, then custom ones, then corporate e-mail domains."""
        rules = self.dlp_rules + tuple(
            Rule("dlp", label, check_user_pattern(pattern), name=label, note=repl or "[REDACTED]")
            for pattern, label, repl in self.dlp_custom
        )
        if self.corporate_email_domains:
            domains = "|".join(re.escape(d) for d in self.corporate_email_domains)
            rules += (Rule(
                "dlp", "corporate email", rf"[a-zA-Z0-9._%+\-]+@(?:{domains})", name="corporate email", note="[CORP-EMAIL]",
                needs=("@",), java=rf"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@(?:{domains})",
            ),)
        return rules


def agent_name(model: Column) -> Column:
    """Agent in a model name: the part after the last slash, lower case."""
    return F.lower(F.substring_index(model, "/", -1))


def resolve_agent(df: DataFrame, perms: Permissions, agent: str = "agent") -> DataFrame:
    """Add agent_canonical, agent_enabled, agent_ceiling and agent_platforms.

    Aliases and names are matched without case; an unknown name gets the default profile.
    """
    spark = df.sparkSession
    names = {a[0]: a for a in perms.agents}
    platforms = {a: sorted({p for n, p, _ in perms.grants if n == a}) for a in names}
    rows = [(key.lower(), *names[target], platforms[target]) for key, target in
            [*((n, n) for n in names), *perms.aliases] if target in names]
    schema = "__key string, agent_canonical string, agent_enabled boolean, agent_ceiling string, agent_platforms array<string>"
    profiles = lookup(spark, dict((r[0], r) for r in rows).values(), schema)
    out = df.withColumn("__key", F.lower(agent)).join(profiles, "__key", "left").drop("__key")
    if "default" not in names:
        return out
    fallback = ("default", names["default"][1], names["default"][2], platforms["default"])
    unknown = F.col("agent_canonical").isNull()
    return out.withColumns({
        "agent_enabled": F.when(unknown, F.lit(fallback[1])).otherwise(F.col("agent_enabled")),
        "agent_ceiling": F.when(unknown, F.lit(fallback[2])).otherwise(F.col("agent_ceiling")),
        "agent_platforms": F.when(unknown, F.array(*map(F.lit, fallback[3]))).otherwise(F.col("agent_platforms")),
        "agent_canonical": F.coalesce("agent_canonical", F.lit("default")),
    })


def check_scope(df: DataFrame, perms: Permissions, agent: str = "agent", platform: str = "platform", permission: str = "permission") -> DataFrame:
    """Add scope_allowed and scope_reason for (agent, platform, permission) requests."""
    out = resolve_agent(df, perms, agent)
    per_platform = sorted({(n, p.lower()) for n, p, _ in perms.grants})
    grants = [(n, p, sorted({m.upper() for a, q, m in perms.grants if a == n and q.lower() == p})) for n, p in per_platform]
    table = lookup(df.sparkSession, grants, "agent_canonical string, __platform string, __perms array<string>")
    out = out.withColumn("__platform", F.lower(platform)).join(table, ["agent_canonical", "__platform"], "left")
    name, perm = F.col("agent_canonical"), F.upper(permission)
    granted = F.array_contains("__perms", perm)
    reason = (
        F.when(name.isNull(), F.format_string('unknown agent "%s"', F.col(agent)))
        .when(~F.col("agent_enabled"), F.format_string('agent "%s" is disabled', name))
        .when(F.col("__perms").isNull(), F.format_string('agent "%s" has no access to platform "%s"', name, F.col(platform)))
        .when(~granted, F.format_string('agent "%s" lacks %s permission on "%s"', name, perm, F.col(platform)))
        .otherwise("scope allowed")
    )
    return out.withColumn("scope_reason", reason).withColumn("scope_allowed", F.col("scope_reason") == "scope allowed").drop("__platform", "__perms")


def classify(views: TextViews, perms: Permissions) -> Column:
    """Struct (level, blocked, labels): every rule that matches, the highest level wins."""
    hits = F.expr("array_compact(array(" + ", ".join(
        f"CASE WHEN {fires_sql(r, views)} THEN named_struct('rank', {CLASS_LEVELS[r.category]}, "
        f"'level', {sql_str(r.category)}, 'label', {sql_str(r.name)}) END"
        for r in perms.class_rules
    ) + "))")

    def judge(found: Column) -> Column:
        rank = F.coalesce(F.array_max(F.transform(found, lambda h: h["rank"])), F.lit(0))
        level = F.element_at(F.array(*map(F.lit, CLASS_LEVELS)), rank + 1)
        return F.struct(
            level.alias("level"),
            level.isin(*perms.block_levels).alias("blocked") if perms.block_levels else F.lit(False).alias("blocked"),
            F.transform(found, lambda h: F.concat(h["label"], F.lit("("), h["level"], F.lit(")"))).alias("labels"),
        )

    return let(hits, judge)


def within_ceiling(level: Column, ceiling: Column) -> Column:
    """Level at or below the agent's ceiling; an unknown level on either side is refused."""
    return F.coalesce(class_rank(level) <= class_rank(ceiling), F.lit(False))


def dlp_scrub(text: str, perms: Permissions) -> Column:
    """`dlp_scrub_sql` as a column."""
    return F.expr(dlp_scrub_sql(text, perms))


def dlp_scrub_sql(text: str, perms: Permissions) -> str:
    """Struct (allowed, text, labels, bypassed): patterns applied in order to the evolving text.

    REDACT replaces hits, BLOCK stops at the first one, OFF changes nothing. Hits that hold
    an allowed phrase stay and are listed in `bypassed`. A fold with one branch per rule;
    `text` is SQL text.
    """
    empty = "cast(array() AS array<string>)"

    def state(allowed, body, labels, bypassed):
        return f"named_struct('allowed', {allowed}, 'text', {body}, 'labels', {labels}, 'bypassed', {bypassed})"

    start = state("true", text, empty, empty)
    rules = perms.all_dlp_rules()
    if perms.dlp_mode == OFF or not rules:
        return start
    phrases = [p.lower() for p in perms.allow_phrases]

    def allowed_phrase(hit: str) -> str:
        return "(" + (" OR ".join(f"contains(lower({hit}), {sql_str(p)})" for p in phrases) or "false") + ")"

    def step(rule: Rule) -> str:
        pattern = sql_str(rule.java_pattern)
        taken = f"filter(hs, h -> NOT {allowed_phrase('h')})" if phrases else "hs"
        bypassed = f"concat(s.bypassed, filter(hs, h -> {allowed_phrase('h')}))" if phrases else "s.bypassed"
        if perms.dlp_mode == BLOCK:
            body = (
                f"IF(size({taken}) > 0, {state('false', text, f'array({sql_str(rule.name)})', bypassed)}, "
                f"{state('s.allowed', 's.text', 's.labels', bypassed)})"
            )
        else:
            labels = f"concat(s.labels, transform({taken}, x -> {sql_str(rule.name)}))"
            scrubbed = f"regexp_replace(s.text, {pattern}, {sql_str(rule.note)})"
            if phrases:
                # Walk the pieces between hits so that hits with an allowed phrase keep their place.
                scrubbed = (
                    f"transform(array(split(s.text, {pattern})), ps -> aggregate(arrays_zip(slice(ps, 2, size(hs)), hs), ps[0], "
                    f"(acc, z) -> concat(acc, IF({allowed_phrase('z.hs')}, z.hs, {sql_str(rule.note)}), coalesce(z.`0`, ''))))[0]"
                )
            body = state("s.allowed", scrubbed, labels, bypassed)
        return f"IF(s.allowed AND rlike(s.text, {pattern}), transform(array(regexp_extract_all(s.text, {pattern}, 0)), hs -> {body})[0], s)"

    steps = " ".join(f"WHEN {i} THEN {step(r)}" for i, r in enumerate(rules))
    fold = f"replace(lower({text}), '\u017f', 's')"
    order = f"transform(array({fold}), f -> {candidates_sql(text, 'f', rules)})[0]"
    return f"aggregate({order}, {start}, (s, i) -> CASE i {steps} ELSE s END)"


def sanitize_response(views: TextViews, perms: Permissions, platforms: Column) -> Column:
    """Reason to block a response, or NULL when it is clean. `platforms` are those the agent may use."""
    raw = views.raw
    size = F.octet_length(raw)
    stages = [F.when(size > perms.max_response_bytes, F.concat(
        F.lit("response exceeds max length ("), size.cast("string"), F.lit(f" > {perms.max_response_bytes})")))]
    rules = [("injection", r) for r in perms.injection_rules] + [("cross-action", r) for r in perms.cross_action_rules]
    stages += [
        F.expr(f"CASE WHEN {fires_sql(r, views)} THEN {sql_str(f'{kind} detected: {r.name}')} END") for kind, r in rules
    ]

    def scope(p: str) -> str:
        def any_of(words):
            return " OR ".join(f"contains({views.name('lower')}, {sql_str(w)})" for w in words)

        actions = any_of(p + s for s in ("-send", "-create", "-delete", "-update", "-search", "-list", "-get"))
        directives = any_of(v + p for v in ("use ", "invoke ", "call "))
        return (
            f"WHEN NOT array_contains(ps, {sql_str(p)}) AND ({actions}) THEN 'cross-scope: response references {p} platform (agent lacks access)' "
            f"WHEN NOT array_contains(ps, {sql_str(p)}) AND ({directives}) THEN 'cross-scope: response directs use of {p} platform (agent lacks access)'"
        )

    cases = " ".join(scope(p) for p in perms.platforms)
    lowered = F.transform(platforms, F.lower)
    stages.append(F.call_function(
        "transform", F.array(lowered), F.expr(f"ps -> CASE WHEN size(ps) > 0 THEN CASE {cases} END END"))[0])
    return F.coalesce(*stages)


AUDIT = "struct<action:string,result:string,reason:string,classification:string,details:string>"


def _audit(action: str, result, reason, classification=None, details=None) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        F.lit(action).alias("action"), col(result).alias("result"), col(reason).alias("reason"),
        col(classification).alias("classification"), col(details).alias("details"),
    ).cast(AUDIT)


def permission_pipeline(df: DataFrame, perms: Permissions, text: str = "text", agent: str = "agent", response: str | None = None) -> DataFrame:
    """Classify, check the ceiling, scrub, and sanitise the response.

    Adds blocked_by (step or NULL), class_level, scrubbed_text and audit, one audit row per
    step that was reached. `response` names the answer's column, if there is one.
    """
    out = resolve_agent(df, perms, agent)
    out, views = with_views(out, F.col(text), perms.class_rules, normalised=False)
    out = computed_once(out, "__class", classify(views, perms))
    out = computed_once(out, "__dlp", dlp_scrub(text, perms))
    level, name = F.col("__class.level"), F.lower(agent)
    present = F.col(text) != ""
    blocked = F.col("__class.blocked")
    under = within_ceiling(level, F.col("agent_ceiling"))
    redactions = F.size("__dlp.labels")
    reason = F.concat(F.lit("classification "), level, F.lit(" exceeds agent "), name, F.lit(" ceiling"))
    step = (
        F.when(present & blocked, "classify").when(present & ~under, "ceiling")
        .when(present & ~F.col("__dlp.allowed"), "dlp")
    )
    rows = [
        F.when(present, _audit("classify", F.when(blocked, "deny").otherwise("allow"), F.concat(F.lit("level="), level), level, F.array_join("__class.labels", ", "))),
        F.when(present & ~blocked & ~under, _audit("ceiling", "deny", reason, level)),
        F.when(present & ~blocked & under & (redactions > 0), _audit(
            "dlp", F.when(F.col("__dlp.allowed"), "allow").otherwise("deny"),
            F.concat(F.lit(f"mode={perms.dlp_mode} redactions="), redactions.cast("string")), None, F.array_join("__dlp.labels", ", "))),
    ]
    if response:
        out, answer = with_views(out, F.col(response), prefix="__r", normalised=False)
        bad = sanitize_response(answer, perms, F.col("agent_platforms"))
        out = computed_once(out.withColumn("__step", step), "__bad", F.when(F.col("__step").isNull() & (answer.raw != ""), bad))
        rows.append(F.when(F.col("__bad").isNotNull(), _audit("sanitize", "deny", F.col("__bad"))))
        step = F.coalesce("__step", F.when(F.col("__bad").isNotNull(), "sanitize"))
    out = out.withColumns({
        "blocked_by": step, "class_level": level, "scrubbed_text": F.col("__dlp.text"), "audit": F.array_compact(F.array(*rows)),
    })
    return drop_views(drop_views(out.drop("__class", "__dlp", "__step", "__bad")), "__r")


def _scrub_turn(perms: Permissions) -> Column:
    body = dlp_scrub_sql("m.content", perms)
    return F.expr(f"m -> named_struct('role', m.role, 'content', IF(m.role = 'user', {body}.text, m.content))")


def scrub_user_turns(messages: Column, perms: Permissions) -> Column:
    """Each user message of a chat scrubbed on its own; other roles stay as they are."""
    return F.call_function("transform", messages, _scrub_turn(perms))


def ephemeral_session(df: DataFrame, salt: str, user: str = "user") -> DataFrame:
    """Replace the user by a salted pseudonym and mark the request as not stored."""
    return df.withColumn(user, F.sha2(F.concat(F.lit(salt), F.col(user)), 256)).withColumn("store", F.lit(False))
