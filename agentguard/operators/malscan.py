"""Malware in tool responses: script and signature rules, and decoded base64 blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentguard.functions import text as tx
from agentguard.functions.entropy import byte_entropies
from agentguard.functions.jsonfuncs import flatten_json_strings
from agentguard.functions.expr import sql_str
from agentguard.operators.scan import TextViews, coalesce_sql, finding_sql, fires_sql, first_of, no_result
from agentguard.rules import injection, malware
from agentguard.rules.model import Rule

BLOBS = "array<string>"


def base64_blobs(text: Column, max_blobs: int | None = None, has_run: Column | None = None) -> Column:
    """Base64 runs of a text, and those that JSON escapes hide from a plain look at it.

    Every run is returned; `max_blobs` restores a limit on the runs of the text itself. `has_run` says whether it has one, if that is known.
    """
    direct = tx.all_matches(text, injection.BASE64_JAVA)
    direct = F.slice(direct, 1, max_blobs) if max_blobs else direct
    hidden = tx.all_matches(flatten_json_strings(text), injection.BASE64_JAVA)
    escaped = F.contains(text, F.lit("\\")) & text.rlike(r"^\s*\{")
    found = F.when(text.rlike(injection.BASE64_GUARD) if has_run is None else has_run, direct).otherwise(F.array().cast(BLOBS))
    return F.when(escaped, F.concat(found, F.array_except(hidden, found))).otherwise(found)


def decoded(blob: Column) -> Column:
    """Bytes of a padded or unpadded base64 run; NULL when it is not base64."""
    return F.try_to_binary(blob, F.lit("base64"))


def magic_sql(data: str) -> str:
    """Name of the executable format by its first bytes, as SQL text; NULL when there is none."""
    head = f"hex(substring({data}, 1, 24))"
    cases = " ".join(f"WHEN startswith({head}, '{magic}') THEN {sql_str(name)}" for name, magic in malware.MAGICS)
    return f"CASE WHEN octet_length({data}) < 4 THEN NULL {cases} END"


def le_u32_sql(data: str, offset: str) -> str:
    """Little-endian unsigned number of four bytes; `offset` counts from 1."""
    pairs = f"regexp_extract_all(hex(substring({data}, {offset}, 4)), '..', 0)"
    return f"cast(conv(array_join(reverse({pairs}), ''), 16, 10) AS bigint)"


def archive_bomb_sql(data: str) -> str:
    """Struct (rule_id, ratio) for a ZIP or GZIP header that promises over 100:1, or NULL."""
    packed, unpacked = le_u32_sql(data, "19"), le_u32_sql(data, "23")
    size, head = f"octet_length({data})", f"hex(substring({data}, 1, 4))"
    original = le_u32_sql(data, f"{size} - 3")

    def branch(magic, rule_id, cond, ratio):
        return f"WHEN startswith({head}, '{magic}') AND {cond} AND {ratio} > {malware.BOMB_RATIO} THEN named_struct('rule_id', '{rule_id}', 'ratio', {ratio})"

    return (
        f"CASE WHEN {size} < 30 THEN NULL "
        + branch(malware.ZIP_MAGIC, "zip_bomb", f"{packed} > 0 AND {unpacked} > 0", f"{unpacked} / nullif({packed}, 0)") + " "
        + branch(malware.GZIP_MAGIC, "gzip_bomb", f"{original} > 0", f"{original} / {size}") + " END"
    )


def _rule_branch(rule, cond: str) -> tuple:
    what = f"{rule.name} detected" if rule.rule_id == "script_detection" else f"signature match — {rule.name}"
    return cond, rule, f"malware_scan: {what}", rule.name


def text_finding(views: TextViews, checks=malware.CHECKS) -> Column:
    """First script or signature rule that fires on the text itself, or NULL."""
    rules = [r for r in malware.PACK if ("script_detection" if r.rule_id == "script_detection" else "signatures") in checks]
    return F.expr(first_of(_rule_branch(r, fires_sql(r, views)) for r in rules)) if rules else no_result()


def blob_finding_sql(b: str, checks=malware.CHECKS, threshold: float = malware.ENTROPY_THRESHOLD,
                     max_size: int = malware.MAX_DECODED_SIZE) -> str:
    """First finding on one blob: a struct (blob, data, entropy, text, low) named `b`."""
    data, size = f"{b}.data", f"octet_length({b}.data)"

    def plain(rule_id, text):
        return finding_sql("malware", rule_id, sql_str(f"malware_scan: {text}"), "''")

    stages = [
        f"CASE WHEN octet_length({b}.blob) > {2 * max_size} THEN {plain('blob_size', 'base64 blob exceeds max decoded size')} END",
        f"CASE WHEN {size} > {max_size} THEN {plain('decoded_size', 'decoded content exceeds max size')} END",
    ]
    if "magic_bytes" in checks:
        found = finding_sql("malware", "executable_magic", "concat('malware_scan: executable content detected — ', m, ' (magic bytes match)')", "m")
        stages.append(f"transform(array({magic_sql(data)}), m -> CASE WHEN m IS NOT NULL THEN {found} END)[0]")
    if "entropy" in checks:
        shown, limit = f"format_string('%.2f', {b}.entropy)", f"{threshold:.2f}"
        found = finding_sql(
            "malware", "high_entropy", f"concat('malware_scan: high-entropy blob detected (entropy: ', {shown}, ' > threshold: {limit})')",
            "''", "medium", f"map('entropy', {shown}, 'threshold', '{limit}')")
        stages.append(f"CASE WHEN {b}.entropy > {threshold} AND {size} > {malware.ENTROPY_MIN_BYTES} THEN {found} END")
    if "archive_safety" in checks:
        text = "concat('malware_scan: potential {k} bomb detected (compression ratio: ', format_string('%.0f', a.ratio), ':1)')"
        zip_found = finding_sql("malware", "zip_bomb", text.format(k="zip"), "'PK'")
        gzip_found = finding_sql("malware", "gzip_bomb", text.format(k="gzip"), "'gzip'")
        stages.append(
            f"transform(array({archive_bomb_sql(data)}), a -> CASE a.rule_id WHEN 'zip_bomb' THEN {zip_found} WHEN 'gzip_bomb' THEN {gzip_found} END)[0]")
    keyword = Rule("malware", "dangerous_decoded_content", "")
    fixed = [
        (f"contains({b}.low, {sql_str(k)})", keyword, f"malware_scan: dangerous keyword detected in decoded content: {k}", k)
        for k in malware.DANGEROUS_KEYWORDS
    ]
    if "script_detection" in checks:
        fixed += [_rule_branch(r, f"rlike({b}.low, {sql_str(r.java_pattern)})") for r in malware.SCRIPTS]
    if "signatures" in checks:
        fixed += [_rule_branch(r, f"rlike({b}.text, {sql_str(r.java_pattern)})") for r in malware.SIGNATURES]
    stages.append(first_of(fixed))
    return f"CASE WHEN {data} IS NOT NULL OR octet_length({b}.blob) > {2 * max_size} THEN {coalesce_sql(stages)} END"


def with_malware_finding(df: DataFrame, views: TextViews, out: str, checks=malware.CHECKS,
                         threshold: float = malware.ENTROPY_THRESHOLD, max_size: int = malware.MAX_DECODED_SIZE,
                         max_blobs: int | None = None) -> DataFrame:
    """Add the first malware finding of a response. Only rows with blobs reach the Arrow step."""
    checks = tuple(checks) or malware.CHECKS
    df = df.withColumn("__blobs", base64_blobs(views.raw, max_blobs, views.has(injection.BASE64_RUN, views.raw.rlike(injection.BASE64_GUARD))))
    df = df.withColumn("__decoded", F.transform("__blobs", decoded))
    has_blobs = F.size("__blobs") > 0
    if "entropy" in checks:
        df = df.withColumn("__entropy", byte_entropies(F.when(has_blobs, F.col("__decoded"))))
    else:
        df = df.withColumn("__entropy", F.array().cast("array<double>"))
    verdicts = F.expr(f"""
        filter(transform(
          transform(arrays_zip(__blobs, __decoded, __entropy), z -> named_struct(
            'blob', z.__blobs, 'data', z.__decoded, 'entropy', z.__entropy,
            'text', decode(z.__decoded, 'ISO-8859-1'), 'low', lower(decode(z.__decoded, 'ISO-8859-1')))),
          b -> {blob_finding_sql('b', checks, threshold, max_size)}), v -> v IS NOT NULL)""")
    found = F.coalesce(text_finding(views, checks), F.when(has_blobs, F.get(verdicts, F.lit(0))))
    return df.withColumn(out, found).drop("__blobs", "__decoded", "__entropy")
