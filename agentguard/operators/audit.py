"""Audit trail: decision rows, queries, field encryption, integrity digests, record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.functions import jsonfuncs, labels
from agentguard.operators.scan import SCAN_RESULT

DETAIL = f"struct<pipeline_stage:string,eval_duration_ms:double,scan_results:array<{SCAN_RESULT}>,active_overrides:array<string>>"
DECISION_COLUMNS = (
    "decision_id", "timestamp", "session_id", "tool", "arguments_hash", "decision", "reason", "policy_version",
    "scanner_type", "correlation_id", "classification", "source", "response_blocked", "agent_name", "decision_details",
)
#: Values of the record checks.
DECISIONS = ("allow", "deny", "redacted")
STAGES = (
    "message_size",
    "denylist", "allowlist", "arg_filter", "domain_allowlist", "vuln_scan", "injection_scan", "secrets_scan", "pii_scan",
    "malware_scan", "default_action", "timeout", "parse_error", "duplicate_keys", "response_clean", "response_injection",
    "response_malware", "response_secrets", "response_pii",
)
SCANNERS = ("vuln", "injection", "malware", "secrets", "pii")
CONFIDENCES = ("high", "medium", "low")
MAX_EXCERPT = 103


def decision_rows(df: DataFrame, policy_version: str, **columns: Column) -> DataFrame:
    """Audit rows from evaluated messages; `columns` fills fields the messages name differently."""
    def col(name, default):
        if name in columns:
            return columns[name]
        return F.col(name) if name in df.columns else default

    text = F.lit(None).cast("string")
    redacted = F.col("was_redacted") if "was_redacted" in df.columns else F.lit(False)
    details = F.struct(
        F.col("stage").alias("pipeline_stage"),
        col("eval_duration_ms", F.lit(0.0)).cast("double").alias("eval_duration_ms"),
        F.col("scan_results").alias("scan_results"),
        col("active_overrides", F.array().cast("array<string>")).alias("active_overrides"),
    ).cast(DETAIL)
    return df.select(
        col("decision_id", F.lit(None)).cast("bigint").alias("decision_id"),
        col("timestamp", F.current_timestamp()).alias("timestamp"),
        col("session_id", text).alias("session_id"),
        col("tool", text).alias("tool"),
        jsonfuncs.hash_arguments(col("params", text)).alias("arguments_hash"),
        "decision", "reason",
        F.lit(policy_version).alias("policy_version"),
        labels.scanner_type(F.col("decision"), F.col("reason"), redacted).alias("scanner_type"),
        col("correlation_id", text).alias("correlation_id"),
        col("classification", text).alias("classification"),
        col("source", text).alias("source"),
        col("response_blocked", F.lit(False)).alias("response_blocked"),
        col("agent_name", text).alias("agent_name"),
        details.alias("decision_details"),
    )


def details_json(details: Column) -> Column:
    """Decision details as stored text; `from_details_json` reads it back."""
    return F.to_json(details)


def from_details_json(text: Column) -> Column:
    return F.from_json(text, DETAIL)


def policy_version(policy_text: Column) -> Column:
    """Short version of a policy: the first eight hex digits of its SHA-256."""
    return F.left(F.sha2(policy_text, 256), F.lit(8))


def query(decisions: DataFrame, tool_calls: DataFrame | None = None, since=None, until=None, decision=None, tool=None,
          hash_prefix=None, scanner=None, rule_id=None, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Audit search, newest first if `ordered` or limited. Filters reach the scan; a limit becomes a top-k."""
    out = decisions
    if since is not None:
        out = out.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        out = out.filter(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    if decision:
        out = out.filter(F.col("decision") == decision)
    if tool:
        out = out.filter(F.contains(F.lower("tool"), F.lit(tool.lower())))
    if hash_prefix:
        out = out.filter(F.startswith("arguments_hash", F.lit(hash_prefix)))
    if scanner:
        out = out.filter(F.col("scanner_type") == scanner)
    if rule_id:
        out = out.filter(F.exists("decision_details.scan_results", lambda r: r["rule_id"] == rule_id))
    newest = [F.col("timestamp").desc(), F.col("decision_id").desc()]
    # The limit applies before the join with the calls, which may hold large payloads.
    out = out.orderBy(*newest).limit(limit) if limit else out
    if tool_calls is not None:
        out = out.join(tool_calls.select("decision_id", "request_json", "response_json"), "decision_id", "left")
    sort = limit and tool_calls is not None or ordered and not limit
    return out.orderBy(*newest) if sort else out


def text_search(decisions: DataFrame, text: str, decision: str | None = None, scanner: str | None = None) -> DataFrame:
    """Rows whose tool or reason contains the text, without case."""
    needle = F.lit(text.lower())
    out = decisions.filter(F.contains(F.lower("tool"), needle) | F.contains(F.lower("reason"), needle))
    if decision:
        out = out.filter(F.col("decision") == decision)
    return out.filter(F.col("scanner_type") == scanner) if scanner else out


def recent(decisions: DataFrame, since=None, source: str | None = None, limit: int = 100) -> DataFrame:
    """The newest `limit` rows, with empty text in place of NULL."""
    out = decisions if since is None else decisions.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    out = out.filter(F.col("source") == source) if source else out
    texts = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string"]
    newest = out.orderBy(F.col("timestamp").desc(), F.col("decision_id").desc()).limit(limit)
    return newest.withColumns({c: F.coalesce(c, F.lit("")) for c in texts})


def encrypt(value: Column, key: Column) -> Column:
    """AES-GCM with a marker byte in front: 0x01, nonce, ciphertext, tag."""
    return F.concat(F.unhex(F.lit("01")), F.aes_encrypt(value.cast("binary"), key, F.lit("GCM")))


def decrypt(value: Column, key: Column) -> Column:
    """Marked values are decrypted; unmarked ones are plain text from before encryption; NULL when unreadable."""
    marked = F.substring(value, 1, 1) == F.unhex(F.lit("01"))
    body = F.substr(value, F.lit(2))
    return F.when(marked, F.try_aes_decrypt(body, key, F.lit("GCM"))).otherwise(value)


def row_digest(columns, key: str = "") -> Column:
    """SHA-256 of a row's values in column order, behind a secret key if one is given.

    Each value is written with its length, and NULL differently from any value, so no two rows look alike.
    """
    def part(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(F.lit(key), *[part(c) for c in columns]), 256)


def table_digest(df: DataFrame, partition, columns, key: str = "") -> DataFrame:
    """(partition, rows, digest): independent of row order, with partial sums before the shuffle.

    A row's SHA-256 is cut into eight numbers, all of its bits, and these are added up per partition; the
    sums and the row count are hashed. No group is ever collected. Sums of plain hashes can be forged with
    effort: give a `key` where the digest must prove that nobody tampered.
    """
    h = F.col("__h")
    parts = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = df.select(*partition, row_digest(columns, key).alias("__h")).groupBy(*partition).agg(
        F.count("*").alias("rows"), *[F.sum(p).alias(f"__s{i}") for i, p in enumerate(parts)])
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"__s{i}").cast("string") for i in range(8)])
    return sums.select(*partition, "rows", F.sha2(text, 256).alias("digest"))


def verify_digests(stored: DataFrame, current: DataFrame, partition) -> DataFrame:
    """Partitions whose digest changed, appeared or vanished since the checkpoint."""
    joined = stored.withColumnsRenamed({"digest": "stored_digest", "rows": "stored_rows"}).join(current, list(partition), "full_outer")
    status = (
        F.when(F.col("stored_digest").isNull(), "new").when(F.col("digest").isNull(), "missing")
        .when(F.col("stored_digest") != F.col("digest"), "changed")
    )
    return joined.withColumn("status", status).filter("status IS NOT NULL")


def record_checks(decisions: DataFrame) -> DataFrame:
    """One boolean per constraint of a decision record; true means violated."""
    results = F.col("decision_details.scan_results")
    bad_enum = lambda c, allowed: c.isNotNull() & ~c.isin(*allowed)
    return decisions.withColumns({
        "missing_timestamp": F.col("timestamp").isNull(),
        "missing_tool": F.coalesce("tool", F.lit("")) == "",
        "missing_policy": F.coalesce("policy_version", F.lit("")) == "",
        "bad_decision": ~F.coalesce("decision", F.lit("")).isin(*DECISIONS),
        "bad_stage": bad_enum(F.col("decision_details.pipeline_stage"), STAGES),
        "negative_duration": F.col("decision_details.eval_duration_ms") < 0,
        "bad_scanner": F.exists(results, lambda r: bad_enum(r["scanner"], SCANNERS)),
        "bad_confidence": F.exists(results, lambda r: bad_enum(r["confidence"], CONFIDENCES)),
        "long_excerpt": F.exists(results, lambda r: F.length(r["match_excerpt"]) > MAX_EXCERPT),
    })


CHECKS = (
    "missing_timestamp", "missing_tool", "missing_policy", "bad_decision", "bad_stage", "negative_duration",
    "bad_scanner", "bad_confidence", "long_excerpt",
)


def violation_counts(checked: DataFrame) -> DataFrame:
    """(constraint, violations) in one pass over checked records."""
    counts = checked.agg(*[F.count_if(F.col(c)).alias(c) for c in CHECKS])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("constraint"), F.col(c).alias("violations")) for c in CHECKS]))
    return counts.select(pairs.alias("p")).select("p.*")


def inject_canary(params: Column, token: Column, key: str = "_canary") -> Column:
    """Add a canary to object arguments; other arguments stay as they are."""
    parsed = F.from_json(params, "map<string,string>")
    flat = F.to_json(F.map_concat(F.map_filter(parsed, lambda k, v: k != key), F.create_map(F.lit(key), token)))
    # Nested values keep their JSON text, so the canary is put in front of the first member.
    nested = F.concat(F.lit('{"' + key + '":"'), token, F.lit('",'), F.substr(F.trim(params), F.lit(2)))
    is_object = params.rlike(r"^\s*\{")
    empty = params.rlike(r"^\s*\{\s*\}\s*\z")
    return F.when(is_object & empty, flat).when(is_object, nested).otherwise(params)
