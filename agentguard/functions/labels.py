"""Enumerations as expressions: severities, reason labels, scanner names, intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations and keyword lists.
SEVERITY_WEIGHTS = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CLASS_LEVELS = {"PUBLIC": 0, "INTERNAL": 1, "CONFIDENTIAL": 2, "RESTRICTED": 3}
SUSPICIOUS_METHOD = ("ignore", "override", "system", "prompt", "inject", "bypass")
CODE_METHOD = (
    "code", "generate", "write_code", "create_file", "edit_file",
    "refactor", "implement", "compile", "build", "debug",
)
FILE_METHOD = ("file.", "fs.", "read_file", "write_file", "list_dir")
SEARCH_METHOD = ("search", "query", "find", "lookup", "browse")
CHAT_METHOD = ("chat", "message", "send", "completions", "conversation")
CODE_PARAMS = (
    "write code", "write a script", "generate code", "create a function",
    "implement", "write a program", "code for", "write python",
    "write go", "write java", "write rust", "write typescript",
    "write javascript", "write sql", "bash script", "shell script",
)


def _any(text: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | F.contains(text, F.lit(w))
    return cond


def _lookup(value: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, label in table.items():
        out = F.when(value == key, F.lit(label)).otherwise(out)
    return out


def severity_weight(severity: Column) -> Column:
    """critical 5 down to info 1; anything else 0."""
    return _lookup(severity, SEVERITY_WEIGHTS, 0)


def class_rank(level: Column) -> Column:
    """PUBLIC 0 up to RESTRICTED 3; NULL for an unknown level."""
    return _lookup(F.upper(level), CLASS_LEVELS, None)


def normalize_reason(reason: Column) -> Column:
    """Short label of a deny reason, for counters."""
    return (
        F.when(F.startswith(reason, F.lit("prompt_injection")), "injection")
        .when(F.startswith(reason, F.lit("malware_scan")), "malware")
        .when(F.startswith(reason, F.lit("vuln_scan")), "vuln")
        .when(F.startswith(reason, F.lit("secrets_scan")), "secrets")
        .when(F.startswith(reason, F.lit("pii_scan")), "pii")
        .when(F.contains(reason, F.lit("denylist")), "denylist")
        .when(F.contains(reason, F.lit("not in allowlist")), "not_in_allowlist")
        .when(F.contains(reason, F.lit("timeout")), "timeout")
        .when(F.contains(reason, F.lit("sensitive data")), "arg_filter")
        .otherwise("policy")
    )


def reason_to_event(reason: Column) -> Column:
    """Security event (type, severity) published for a deny reason."""

    def event(event_type, severity):
        return F.struct(F.lit(event_type).alias("event_type"), F.lit(severity).alias("severity"))

    return (
        F.when(F.startswith(reason, F.lit("prompt_injection")), event("injection_blocked", "high"))
        .when(F.startswith(reason, F.lit("malware_scan")), event("malware_blocked", "critical"))
        .when(F.startswith(reason, F.lit("vuln_scan")), event("vuln_blocked", "high"))
        .when(F.startswith(reason, F.lit("sensitive data")), event("arg_filter_match", "medium"))
        .when(F.startswith(reason, F.lit("cross_scope")), event("policy_deny", "high"))
        .otherwise(event("policy_deny", "low"))
    )


def scanner_type(decision: Column, reason: Column, redacted: Column) -> Column:
    """Scanner column of the audit row; empty when the policy itself decided."""
    denied = decision == "deny"
    return (
        F.when(denied & F.startswith(reason, F.lit("vuln_scan")), "vuln")
        .when(denied & F.startswith(reason, F.lit("prompt_injection")), "injection")
        .when(denied & F.startswith(reason, F.lit("malware_scan")), "malware")
        .when(denied & F.startswith(reason, F.lit("secrets_scan")), "secrets")
        .when(denied & F.startswith(reason, F.lit("pii_scan")), "pii")
        .when(redacted, "redaction")
        .otherwise("")
    )


def classify_intent(method: Column, params: Column) -> Column:
    """What the request asks for; a method that looks crafted stays `unknown`."""
    m, p = F.lower(method), F.lower(params)
    return (
        F.when(_any(m, SUSPICIOUS_METHOD), "unknown")
        .when(_any(m, CODE_METHOD), "code_generation")
        .when(_any(m, FILE_METHOD), "file_operation")
        .when(_any(m, SEARCH_METHOD), "search")
        .when(_any(m, CHAT_METHOD) & _any(p, CODE_PARAMS), "code_generation")
        .when(_any(m, CHAT_METHOD), "chat")
        .otherwise("unknown")
    )
