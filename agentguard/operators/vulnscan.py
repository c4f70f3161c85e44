"""Exploit payloads in tool arguments: the first finding in the order of the rule groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentguard.operators.scan import TextViews, _clip, finding_sql, fires_sql, first_of, no_result
from agentguard.operators.ssrf import first_ssrf
from agentguard.rules import vuln

_GROUPS = {
    "sqli": vuln.SQLI,
    "path_traversal": vuln.PATH_TRAVERSAL,
    "command_injection": vuln.COMMAND_INJECTION,
    "xss": vuln.XSS,
}


def vuln_finding(views: TextViews, rules=()) -> Column:
    """First finding, or NULL. `rules` restricts the groups; none named means all."""
    stages: list[Column] = [no_result()]
    for group in vuln.ORDER:
        if rules and group not in rules:
            continue
        if group == "ssrf":
            found = finding_sql("vuln", "ssrf", "v.description", "v.excerpt")
            stages.append(F.call_function(
                "transform", F.array(first_ssrf(views.raw)), F.expr(f"v -> CASE WHEN v IS NOT NULL THEN {found} END"))[0])
            continue
        branches = [
            (fires_sql(r, views), r, f"vuln_scan: {vuln.REASONS[group]} (pattern: {r.pattern})", _clip(r.pattern)) for r in _GROUPS[group]
        ]
        if group == "path_traversal":
            branches.append((
                f"contains({views.name('raw')}, char(0))", _GROUPS[group][0], "vuln_scan: path traversal detected — null byte in path", "null byte"))
        stages.append(F.expr(first_of(branches)))
    return F.coalesce(*stages)
