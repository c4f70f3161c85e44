"""Detection: rule packs applied to a text column, one projection for all rules.

Both modes read the text once and need no shuffle:

* `scan_all`  - every rule that fires, one row each, with its number of hits;
* `first_finding` - the first rule that fires, as a lazily evaluated `coalesce`.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.functions import jsonfuncs, text as tx
from agentguard.functions.candidates import rule_numbers
from agentguard.functions.expr import let, sql_str
from agentguard.functions.validators import validator_sql
from agentguard.rules import injection
from agentguard.rules.model import Rule

SCAN_RESULT = (
    "struct<scanner:string,rule_id:string,description:string,match_excerpt:string,"
    "confidence:string,blocked:boolean,metadata:map<string,string>>"
)


@dataclass(frozen=True)
class TextViews:
    """Names of the columns that hold the forms of one text that rules read."""

    prefix: str
    normalised: bool
    rules: tuple[Rule, ...] = ()

    def name(self, form: str) -> str:
        if form.startswith("nfkc") and not self.normalised:
            form = "lower" if form == "nfkc_lower" else "raw"
        return f"{self.prefix}_{form}"

    def __getattr__(self, form: str) -> Column:
        if form.startswith("_"):
            raise AttributeError(form)
        return F.col(self.name(form))

    def has(self, rule: Rule, otherwise: Column) -> Column:
        """RE2 finds the rule in the text; `otherwise`, where the rule is not among those looked for."""
        return F.expr(f"array_contains({self.prefix}_rules, {self.rules.index(rule)})") if rule in self.rules else otherwise

    def view(self, rule: Rule) -> Column:
        return F.col(self.name(rule.view))


def with_views(df: DataFrame, text: Column, rules=(), prefix: str = "__t", normalised: bool = True) -> tuple[DataFrame, TextViews]:
    """Add the text forms, and the numbers of those of `rules` that RE2 finds, as columns, computed once per row."""
    views = TextViews(prefix, normalised, tuple(dict.fromkeys(rules)))
    df = df.withColumn(f"{prefix}_raw", F.coalesce(text, F.lit("")))
    df = df.withColumn(f"{prefix}_lower", F.lower(views.raw))
    if normalised:
        df = df.withColumn(f"{prefix}_nfkc", jsonfuncs.nfkc(views.raw))
        df = df.withColumn(f"{prefix}_nfkc_lower", F.when(views.nfkc == views.raw, views.lower).otherwise(F.lower(views.nfkc)))
    df = df.withColumn(f"{prefix}_fold", F.replace(views.lower, F.lit("\u017f"), F.lit("s")))
    if views.rules:
        folds = [views.name("nfkc_lower") if r.view.startswith("nfkc") and normalised else views.name("lower") for r in views.rules]
        read = [views.name(r.view) for r in views.rules]
        names = list(dict.fromkeys([views.name("raw"), *folds, *read]))
        numbers = rule_numbers(views.rules, [F.col(n) for n in names], [names.index(n) for n in read], [names.index(n) for n in folds])
        df = df.withColumn(f"{prefix}_rules", numbers)
    return df, views


def drop_views(df: DataFrame, prefix: str = "__t") -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(f"{prefix}_")])


def fires_sql(rule: Rule, views: TextViews) -> str:
    """`fires` as SQL text: one parse instead of a call per node."""
    matches = f"rlike({views.name(rule.view)}, {sql_str(rule.java_pattern)})"
    if rule in views.rules:
        return f"array_contains({views.prefix}_rules, {views.rules.index(rule)}) AND {matches}"
    if not rule.needs:
        return matches
    # NFKC folds the long s and the Kelvin sign itself, so its lower case is its fold.
    fold = views.name("nfkc_lower") if rule.view.startswith("nfkc") and views.normalised else views.name("fold")
    return "(" + " OR ".join(f"contains({fold}, {sql_str(n)})" for n in rule.needs) + f") AND {matches}"


def fires(rule: Rule, views: TextViews) -> Column:
    """The rule's pattern occurs; the numbers, or literals, keep the regex off most texts."""
    return F.expr(fires_sql(rule, views))


def _rule_hits_sql(rule: Rule, order: int, views: TextViews) -> str:
    """Struct of one rule's result on one text; `n_hits` counts the hits that pass validation."""
    found = f"regexp_extract_all({views.name(rule.view)}, {sql_str(rule.java_pattern)}, 0)"
    valid = f"filter(hs, h -> {validator_sql(rule.validator, 'h')})" if rule.validator else "hs"
    body = (
        f"named_struct('scanner', {sql_str(rule.scanner)}, 'rule_id', {sql_str(rule.rule_id)}, "
        f"'rule_order', {order}, 'confidence', {sql_str(rule.confidence)}, 'n_hits', size({valid}), "
        f"'first_hit_valid', {validator_sql(rule.validator, 'hs[0]')}, 'first_hit', hs[0])"
    )
    return f"CASE WHEN {fires_sql(rule, views)} THEN transform(array({found}), hs -> {body})[0] END"


def scan_all(df: DataFrame, text: str, rules, keep) -> DataFrame:
    """One row per (row, rule) with at least one accepted hit: `keep` columns plus the finding."""
    rules = tuple(rules)
    normalised = any(r.view.startswith("nfkc") for r in rules)
    df, views = with_views(df.select(*dict.fromkeys([*keep, text])), F.col(text), rules, normalised=normalised)
    hits = F.expr("array_compact(array(" + ", ".join(_rule_hits_sql(r, i, views) for i, r in enumerate(rules)) + "))")
    # Outer: a plain explode would also compute the hits for an inferred "not empty" filter.
    out = df.select(*keep, F.explode_outer(hits).alias("h")).select(*keep, "h.*")
    return out.filter("n_hits > 0")


NO_METADATA = "cast(map() AS map<string,string>)"


def finding_sql(scanner: str, rule_id: str, description: str, excerpt: str, confidence: str = "high", metadata: str = NO_METADATA) -> str:
    """A finding as SQL text; description, excerpt and metadata are SQL, the rest plain text."""
    return (
        f"named_struct('scanner', {sql_str(scanner)}, 'rule_id', {sql_str(rule_id)}, 'description', {description}, "
        f"'match_excerpt', {excerpt}, 'confidence', {sql_str(confidence)}, 'blocked', true, 'metadata', {metadata})"
    )


def coalesce_sql(stages) -> str:
    return f"coalesce(cast(NULL AS {SCAN_RESULT}), {', '.join(stages)})"


def findings_table(rows) -> str:
    """Fixed findings as one array literal: (scanner, rule_id, description, excerpt, confidence) rows.

    Written as JSON so that the plan holds one constant instead of a dozen nodes per rule.
    """
    items = [
        {"scanner": s, "rule_id": r, "description": d, "match_excerpt": e, "confidence": c, "blocked": True, "metadata": {}}
        for s, r, d, e, c in rows
    ]
    return f"from_json({sql_str(json.dumps(items, ensure_ascii=False))}, 'array<{SCAN_RESULT}>')"


def first_of(stages) -> str:
    """Finding of the first branch (condition, rule, description, excerpt) that holds, or NULL."""
    stages = list(stages)
    cases = " ".join(f"WHEN {cond} THEN {i}" for i, (cond, *_) in enumerate(stages, 1))
    rows = [(rule.scanner, rule.rule_id, text, excerpt, rule.confidence) for _, rule, text, excerpt in stages]
    return f"element_at({findings_table(rows)}, CASE {cases} END)"


def no_result() -> Column:
    return F.lit(None).cast(SCAN_RESULT)


def _clip(text: str) -> str:
    return text if len(text) <= tx.EXCERPT_RUNES else text[: tx.EXCERPT_RUNES] + "..."


# --- injection -----------------------------------------------------------------------------


def base64_injection(text: Column, max_blobs: int | None = None) -> Column:
    """A base64 run whose decoded text holds an injection keyword.

    Every run is decoded; `max_blobs` restores a limit on how many are looked at.
    """
    blobs = tx.all_matches(text, injection.BASE64_JAVA)
    blobs = F.slice(blobs, 1, max_blobs) if max_blobs else blobs

    def suspicious(blob):
        decoded = F.lower(F.decode(F.try_to_binary(blob, F.lit("base64")), "ISO-8859-1"))
        return F.coalesce(tx.contains_any(decoded, injection.BASE64_KEYWORDS), F.lit(False))

    return text.rlike(injection.BASE64_GUARD) & F.exists(blobs, suspicious)


def imperative_stats(text: Column) -> Column:
    """Struct (segments, imperative) over the sentence-like segments of a text."""
    segments = F.filter(F.split(text, r"[.!\n]"), lambda s: s != "")
    starts = "^(?:" + "|".join(injection.IMPERATIVE_STARTS) + ")"
    imperative = F.filter(segments, lambda s: F.lower(F.regexp_replace(s, r"^[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+", "")).rlike(starts))
    return F.struct(F.size(segments).alias("segments"), F.size(imperative).alias("imperative"))


def imperative_density(text: Column, begins: Column | None = None) -> Column:
    """More than 40 % of at least three segments start with an imperative; `begins` says whether one does at all."""
    dense = let(
        imperative_stats(text),
        lambda s: (s["segments"] >= injection.IMPERATIVE_MIN_SEGMENTS)
        & (s["imperative"] / s["segments"] > injection.IMPERATIVE_RATIO),
    )
    short = tx.byte_len(text) < injection.IMPERATIVE_MIN_BYTES
    return F.when(short if begins is None else ~begins | short, F.lit(False)).otherwise(dense)


def injection_finding(views: TextViews, direction: str = "request", sensitivity: str = "medium",
                      high_entropy: Column | None = None, max_blobs: int | None = None) -> Column:
    """First injection finding of a text, or NULL.

    `high_entropy` is a boolean column computed beforehand (see `entropy.window_stats`); it
    is used for responses at high sensitivity.
    """
    reason = "prompt_injection" if direction == "request" else "prompt_injection_response"
    patterns = F.expr(first_of(
        (fires_sql(r, views), r, f"{reason}: {injection.REASONS[r.rule_id]} (pattern: {r.pattern})", _clip(r.pattern))
        for r in injection.PACK
    ))
    where = "arguments" if direction == "request" else "response"

    def structural(cond: Column, rule_id: str, text: str) -> Column:
        return F.when(cond, F.expr(finding_sql("injection", rule_id, sql_str(text), f"left({views.name('nfkc')}, {tx.EXCERPT_RUNES})")))

    stages = [patterns]
    if sensitivity == "high":
        inner = "" if direction == "request" else f"{reason}: "
        stages.append(structural(base64_injection(views.nfkc, max_blobs), "base64_injection",
                                 f"{inner}prompt_injection: base64-encoded injection payload detected"))
    if sensitivity != "low":
        stages.append(structural(imperative_density(views.nfkc, views.has(injection.IMPERATIVE_START, F.lit(True))), "imperative_density",
                                 f"{reason}: high imperative instruction density in tool {where}"))
    if sensitivity == "high" and direction == "response" and high_entropy is not None:
        stages.append(structural(high_entropy, "high_entropy",
                                 f"{reason}: high-entropy block detected in response (possible encoded payload)"))
    return F.coalesce(*stages)


# --- PII and secrets -----------------------------------------------------------------------

REDACTED_EXCERPT = f"IF(octet_length(h) < 8, '{tx.MASK}', concat(left(h, 4), '{tx.MASK}', right(h, 2)))"


def _first_hit(views: TextViews, rules, describe) -> Column:
    """Finding of the first rule whose first hit is valid; the excerpt hides the value."""
    if not rules:
        return no_result()

    def branch(i: int, rule: Rule) -> str:
        hit = f"regexp_extract({views.name(rule.view)}, {sql_str(rule.java_pattern)}, 0)"
        cond = fires_sql(rule, views)
        if rule.validator:
            cond += f" AND exists(array({hit}), h -> {validator_sql(rule.validator, 'h')})"
        return f"WHEN {cond} THEN named_struct('i', {i}, 'h', {hit})"

    table = findings_table((r.scanner, r.rule_id, describe(r), "", r.confidence) for r in rules)
    found = f"CASE {' '.join(branch(i, r) for i, r in enumerate(rules, 1))} END"
    fields = ", ".join(
        f"'{f}', " + (f"transform(array(x.h), h -> {REDACTED_EXCERPT})[0]" if f == "match_excerpt" else f"t.{f}")
        for f in ("scanner", "rule_id", "description", "match_excerpt", "confidence", "blocked", "metadata")
    )
    body = f"transform(array(element_at({table}, x.i)), t -> named_struct({fields}))[0]"
    return F.expr(f"transform(array({found}), x -> CASE WHEN x IS NOT NULL THEN {body} END)[0]")


def pii_finding(views: TextViews, rules) -> Column:
    """First PII rule whose first hit is valid, or NULL. A failed check skips that rule."""
    return _first_hit(views, tuple(rules), lambda r: f"pii_scan: {r.name} detected ({r.note})")


def secrets_finding(views: TextViews, rules) -> Column:
    """First credential rule that fires, with the value hidden, or NULL."""
    return _first_hit(views, tuple(rules), lambda r: f"secrets_scan: {r.note} detected")
