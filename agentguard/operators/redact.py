"""Redaction: rules applied one after another to the evolving text, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agentguard.functions.expr import sql_str
from agentguard.functions.validators import validator_sql
from agentguard.rules import pii, secrets

NOTHING = "array<string>"


def candidates_sql(text: str, fold: str, rules) -> str:
    """Numbers of the rules whose literals and guard the text has, as a SQL array."""
    guards = list(dict.fromkeys(r.guard for r in rules if r.guard))

    def candidate(i, rule) -> str:
        parts = []
        if rule.guard:
            parts.append(f"g[{guards.index(rule.guard)}]")
        if rule.needs:
            parts.append("(" + " OR ".join(f"contains({fold}, {sql_str(n)})" for n in rule.needs) + ")")
        return f"CASE WHEN {' AND '.join(parts)} THEN {i} END" if parts else str(i)

    tests = ", ".join(f"rlike({text}, {sql_str(g)})" for g in guards) or "true"
    listed = ", ".join(candidate(i, r) for i, r in enumerate(rules))
    return f"array_compact(transform(array(array({tests})), g -> array({listed}))[0])"


def _step(rule, tag: str) -> str:
    """State `s` (text, found) after one rule: each accepted hit replaces its first occurrence.

    The text is split at the pattern once and put together with the tags. That is the same unless a hit
    also occurs before its own place, outside a match; only then are the hits replaced one by one.
    """
    pattern = sql_str(rule.java_pattern)
    every = f"regexp_extract_all(s.text, {pattern}, 0)"
    valid = f"filter(es, h -> {validator_sql(rule.validator, 'h')})" if rule.validator else "es"
    tagged = f"IF({validator_sql(rule.validator, 'es[i - 1]')}, {sql_str(tag)}, es[i - 1])" if rule.validator else sql_str(tag)
    joined = f"array_join(transform(split(s.text, {pattern}, -1), (p, i) -> IF(i = 0, p, concat({tagged}, p))), '')"
    one_by_one = (
        "aggregate(hs, s.text, (t, h) -> IF(instr(t, h) = 0, t, "
        f"concat(substr(t, 1, instr(t, h) - 1), {sql_str(tag)}, substr(t, instr(t, h) + length(h)))))"
    )
    replaced = f"transform(array({joined}), j -> IF(exists(array_distinct(hs), h -> contains(j, h)), {one_by_one}, j))[0]"
    after = f"named_struct('text', {replaced}, 'found', array_append(s.found, {sql_str(rule.name)}))"
    picked = f"transform(array({valid}), hs -> IF(size(hs) = 0, s, {after}))[0]"
    return f"IF(rlike(s.text, {pattern}), transform(array({every}), es -> {picked})[0], s)"


def redact(text: str, fold: str, rules, tag_of) -> Column:
    """Struct (text, found): the redacted text and the names of the rules applied.

    A fold over the rules whose literals and guard the original text has: redaction only
    removes text or adds tags, so what is missing there cannot appear later. Inputs are SQL
    texts of the text and of its folded form (`text.folded`).
    """
    rules = tuple(rules)
    start = f"named_struct('text', {text}, 'found', cast(array() AS {NOTHING}))"
    if not rules:
        return F.expr(start)
    steps = " ".join(f"WHEN {i} THEN {_step(r, tag_of(r))}" for i, r in enumerate(rules))
    return F.expr(f"aggregate({candidates_sql(text, fold, rules)}, {start}, (s, i) -> CASE i {steps} ELSE s END)")


def redact_pii(text: str, fold: str, rules=pii.PACK) -> Column:
    """Personal data becomes `[CATEGORY_REDACTED]`; every confidence level is redacted."""
    return redact(text, fold, rules, pii.placeholder)


def redact_secrets(text: str, fold: str, rules=secrets.PACK) -> Column:
    """Credentials become `[REDACTED]`."""
    return redact(text, fold, rules, lambda _: secrets.PLACEHOLDER)
