"""Response streams: framing, carry-over between chunks, scanning, block latch, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agentguard.functions.expr import computed_once, let
from agentguard.functions.labels import classify_intent
from agentguard.operators import malscan, redact, scan
from agentguard.operators.policy import Policy
from agentguard.operators.scan import SCAN_RESULT, drop_views, with_views
from agentguard.rules import injection, malware, pii, secrets

OVERLAP = 200
SLICE_CHUNKS = 16 * OVERLAP
DONE = "[DONE]"


def _sse_data(frame: Column) -> Column:
    """Data lines of an event, joined by newline."""
    lines = F.filter(F.split(frame, "\n"), lambda x: F.startswith(x, F.lit("data:")))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")


def sse_events(df: DataFrame, text: str) -> DataFrame:
    """A row per event with data: adds seq, frame and data. Empty events and the end mark are skipped and not numbered."""
    frames = F.transform(F.split(text, "\n\n"), lambda f: F.struct(f.alias("frame"), _sse_data(f).alias("data")))
    kept = F.filter(frames, lambda f: ~f["data"].isin("", DONE))
    return df.select("*", F.posexplode(kept).alias("seq", "__f")).select("*", "__f.frame", "__f.data").drop("__f")


def ndjson_lines(df: DataFrame, text: str) -> DataFrame:
    """A row per non-blank line, trimmed: adds seq and data."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    return df.select("*", F.posexplode(F.filter(lines, lambda x: x != "")).alias("seq", "data"))


def sse_rebuild(frame: Column, data: Column) -> Column:
    """The event with other data: the first data line carries it, further ones go, other fields stay."""
    lines = F.split(frame, "\n")
    is_data = lambda x: F.startswith(x, F.lit("data:"))
    first = F.array_position(F.transform(lines, lambda x: is_data(x)), True)
    marked = F.transform(lines, lambda x, i: F.when(~is_data(x), F.concat(x, F.lit("\n"))).when(
        i + 1 == first, F.concat(F.lit("data: "), data, F.lit("\n"))))
    return F.array_join(F.array_compact(marked), "")


def last_bytes(text: Column, most: int = OVERLAP) -> Column:
    """The longest end of a text that has at most so many bytes in UTF-8, in whole characters."""

    def cut(tail: Column) -> Column:
        # Bytes 80 to BF continue a character: a tail that begins with some has lost its beginning.
        broken = F.regexp_extract(F.hex(F.substring(tail, 1, 3)), "^(?:[89AB][0-9A-F]){0,3}", 0)
        return F.decode(F.substring(tail, (F.length(broken) / 2).cast("int") + 1, F.octet_length(tail)), "UTF-8")

    return F.when(F.octet_length(text) <= most, text).otherwise(let(F.substring(F.encode(text, "UTF-8"), F.lit(-most), F.lit(most)), cut))


def with_overlap(df: DataFrame, stream: str, seq: str, text: str, out: str = "carry") -> DataFrame:
    """Add the last 200 bytes of the stream before each chunk, in whole characters.

    `seq` counts the chunks of a stream without gaps, as framing numbers them. Long streams are
    cut by `seq`; a cut repeats the 200 chunks before it, which are enough to fill the
    carry-over. Frames follow byte offsets, so that a frame never holds more than 200 bytes.
    """
    late = F.pmod(F.col(seq), F.lit(SLICE_CHUNKS)) >= SLICE_CHUNKS - OVERLAP
    # Chunks are not empty: framing drops empty events and blank lines.
    cut = df.withColumn("__own", F.floor(F.col(seq) / SLICE_CHUNKS)).withColumn(
        "__slice", F.explode(F.when(late, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    piece = Window.partitionBy(stream, "__slice")
    before = piece.orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__start", F.coalesce(F.sum(F.octet_length(text)).over(before), F.lit(0)))
    near = piece.orderBy("__start").rangeBetween(-OVERLAP, -1)
    far = piece.orderBy("__start").rangeBetween(Window.unboundedPreceding, -OVERLAP - 1)
    tail = F.right(F.col(text), F.lit(OVERLAP))
    cut = cut.withColumns({"__near": F.array_join(F.collect_list(text).over(near), ""), "__far": F.last(tail).over(far)})
    carry = last_bytes(F.concat(F.coalesce("__far", F.lit("")), F.col("__near")))
    return cut.withColumn(out, carry).filter("__own = __slice").drop("__own", "__slice", "__start", "__near", "__far")


def _unless_code(finding: Column, code: Column, rule_id: str) -> Column:
    """In a code-generation stream, a finding of this rule is expected and dropped."""
    return F.when(~(code & (finding["rule_id"] == rule_id)), finding)


def scan_chunks(df: DataFrame, policy: Policy, text: str = "text", carry: str = "carry", method: str = "request_method", params: str = "request_params") -> DataFrame:
    """Verdict on each chunk by itself: block_reason, block_results, soft_results, redacted_text, was_redacted.

    The window of carry-over and chunk is scanned; only the new chunk is redacted. A stateless
    projection, the same in batch and streaming. The redaction columns do not read the
    blocking ones, so that each side of `latch` runs its own rules only.
    """
    df = df.withColumn("__code", classify_intent(F.col(method), F.col(params)) == "code_generation")
    window = F.concat(F.coalesce(carry, F.lit("")), F.col(text))
    sec_rules = secrets.select(policy.secrets_scan.rules, policy.secrets_scan.custom) if policy.secrets_scan else ()
    pii_rules = pii.select(policy.pii_scan.rules) if policy.pii_scan else ()
    looked_for = (*injection.PACK, injection.IMPERATIVE_START, *malware.PACK, injection.BASE64_RUN, *sec_rules, *pii_rules)
    df, views = with_views(df, window, looked_for, normalised=bool(policy.prompt_injection))
    none = scan.no_result()
    inj = scan.injection_finding(views, "response", policy.prompt_injection.sensitivity) if policy.prompt_injection else none
    df = df.withColumn("__inj", inj)
    if policy.malware_scan:
        cfg = policy.malware_scan
        df = malscan.with_malware_finding(df, views, "__mal", cfg.checks, cfg.entropy_threshold, cfg.max_decoded_size)
    else:
        df = df.withColumn("__mal", none)
    df = df.withColumn("__hard", F.coalesce(
        _unless_code(F.col("__inj"), F.col("__code"), "encoding_attack"), _unless_code(F.col("__mal"), F.col("__code"), "script_detection")))
    df = df.withColumn("__sec", scan.secrets_finding(views, sec_rules) if sec_rules else none)
    df = df.withColumn("__pii", scan.pii_finding(views, pii.select(policy.pii_scan.rules, policy.pii_scan.min_confidence)) if pii_rules else none)
    hard, sec, per = F.col("__hard"), F.col("__sec"), F.col("__pii")
    sec_blocks = bool(sec_rules) and policy.secrets_scan.action != "redact"
    pii_blocks = bool(pii_rules) and policy.pii_scan.action != "redact"

    df = df.withColumn("__chunk_fold", F.replace(F.lower(text), F.lit("ſ"), F.lit("s")))
    kept = F.expr(f"named_struct('text', {text}, 'found', cast(array() AS array<string>))")
    after_sec = F.when(sec.isNotNull(), redact.redact_secrets(text, "__chunk_fold", sec_rules)).otherwise(kept) if sec_rules and not sec_blocks else kept
    df = df.withColumn("__one", after_sec)
    again = F.expr("named_struct('text', __one.text, 'found', cast(array() AS array<string>))")
    after_pii = F.when(per.isNotNull(), redact.redact_pii("__one.text", "__chunk_fold", pii_rules)).otherwise(again) if pii_rules and not pii_blocks else again
    df = df.withColumn("__two", after_pii)

    block = F.coalesce(
        hard["description"], sec["description"] if sec_blocks else F.lit(None), per["description"] if pii_blocks else F.lit(None))
    none_yet = F.array().cast(f"array<{SCAN_RESULT}>")
    soft = F.array_compact(F.array(none if sec_blocks else sec, none if pii_blocks else per))
    blocking = F.coalesce(hard, sec if sec_blocks else none, per if pii_blocks else none)
    df = df.withColumns({
        "block_reason": block, "code_generation": F.col("__code"),
        "block_results": F.when(blocking.isNotNull(), F.array(blocking)).otherwise(none_yet).cast(f"array<{SCAN_RESULT}>"),
        "soft_results": soft.cast(f"array<{SCAN_RESULT}>"),
        "was_redacted": (F.size("__one.found") > 0) | (F.size("__two.found") > 0), "redacted_text": F.col("__two.text"),
    })
    return drop_views(df.drop("__code", "__inj", "__mal", "__hard", "__sec", "__pii", "__one", "__two", "__chunk_fold"))


def latch(scanned: DataFrame, stream: str, seq: str) -> DataFrame:
    """Add decision, reason and results: from the first blocked chunk on, a stream is denied for its reason.

    The first block per stream is an aggregate (a row per blocked stream), joined back. Only
    that side runs the blocking rules, only the other one runs the redacting rules.
    """
    blocking = computed_once(
        scanned.select(stream, seq, "block_reason", "block_results"), "__b",
        F.struct(F.col(seq).alias("at"), F.col("block_reason").alias("why"), F.col("block_results")))
    first = blocking.filter("__b.why IS NOT NULL").groupBy(stream).agg(F.min_by("__b", seq).alias("__first"))
    out = scanned.drop("block_reason", "block_results").join(first, stream, "left")
    denied = F.coalesce(F.col(seq) >= F.col("__first.at"), F.lit(False))
    late = F.coalesce(F.col(seq) > F.col("__first.at"), F.lit(False))
    nothing = F.array().cast(f"array<{SCAN_RESULT}>")
    return out.withColumns({
        "decision": F.when(denied, "deny").otherwise("allow"),
        "reason": F.when(denied, F.col("__first.why")).when(F.col("was_redacted"), "chunk redacted").otherwise(""),
        "was_redacted": F.col("was_redacted") & ~denied,
        "results": F.when(late, nothing).when(denied, F.col("__first.block_results")).otherwise(F.col("soft_results")),
        "scanned": ~late,
        "redacted_text": F.when(~denied, F.col("redacted_text")),
    }).drop("__first", "soft_results")


def finalize(latched: DataFrame, stream: str) -> DataFrame:
    """One row per stream: stage, reason, chunks scanned, findings, code_generation."""
    grouped = latched.groupBy(stream).agg(
        F.max("decision").alias("__d"), F.max(F.when(F.col("decision") == "deny", F.col("reason"))).alias("__why"),
        F.bool_or("was_redacted").alias("__r"), F.count_if("scanned").alias("chunks"),
        F.sum(F.size("results")).alias("findings"), F.bool_or("code_generation").alias("code_generation"))
    blocked, red = F.col("__d") == "deny", F.col("__r")
    return grouped.select(
        stream,
        F.when(blocked, "stream_blocked").when(red, "stream_redacted").otherwise("stream_clean").alias("stage"),
        F.when(blocked, F.col("__why")).when(red, "streaming response redacted").otherwise("streaming response clean").alias("reason"),
        "chunks", "findings", "code_generation")
