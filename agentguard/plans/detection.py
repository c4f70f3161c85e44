"""Detection queries over documents, pages and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from agentguard.functions import text as tx, validators
from agentguard.functions.entropy import window_stats
from agentguard.functions.expr import computed_once
from agentguard.operators import malscan, redact, scan, ssrf
from agentguard.operators.scan import with_views
from agentguard.plans import inputs
from agentguard.plans.base import TEXT_VIEWS, q, register, sql_findings, sql_fires, sql_valid, table, values
from agentguard.plans.samples import SAMPLES
from agentguard.rules import injection, malware, pii, secrets, vuln


def _summary(found):
    """Counts per rule: map-side aggregation over the findings, a row per rule."""
    return found.groupBy("scanner", "rule_id", "rule_order").agg(
        F.count("*").alias("texts"), F.sum("n_hits").alias("hits"), F.count_if("first_hit_valid").alias("detected"))


def _register_pack(name, source, key, column, rules, payload=False):
    sql_source = inputs.SQL_MESSAGES if payload else source
    views = {v: e.replace("text", column) for v, e in TEXT_VIEWS.items()}

    @register(name, sql_findings(sql_source, key, views, rules))
    def run(spark, sf):
        df = inputs.messages(spark, sf) if payload else table(spark, sf, source, texts=True)
        return _summary(scan.scan_all(df, column, rules, [key]))


_register_pack("pii_findings", "documents", "doc_id", "text", pii.PACK)
_register_pack("secrets_findings", "documents", "doc_id", "text", secrets.PACK)
_register_pack("injection_findings", "conversations", "msg_id", "text", injection.PACK, payload=True)
_register_pack("vuln_findings", "conversations", "msg_id", "text", vuln.PACK, payload=True)
_register_pack("malware_findings", "conversations", "msg_id", "text", malware.PACK, payload=True)
_register_pack("pii_messages", "conversations", "msg_id", "text", pii.PACK, payload=True)
_register_pack("secrets_messages", "conversations", "msg_id", "text", secrets.PACK, payload=True)
_register_pack("xss_pages", "pages", "page_id", "html", vuln.XSS)


ALL_RULES = (*injection.PACK, *vuln.PACK, *malware.PACK, *secrets.PACK, *pii.PACK)

#: What NFKC does to the signs that occur in these texts: spaces of other widths become plain ones.
_SQL_NFKC = r"lower(regexp_replace(text, '[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g'))"


# The whole text of every document; a null id counts as 0 and remainders are never negative, in both engines.
_WHOLE = "SELECT d.doc_id, concat(coalesce(d.text, ''), ' ', s.sample, ' end') AS text FROM @documents@ d JOIN @samples@ s ON (coalesce(d.doc_id, 0) % {n} + {n}) % {n} = s.pid".format(n=len(SAMPLES))
SQL_WHOLE = "(" + _WHOLE.replace("@documents@", "documents").replace("@samples@", values(list(enumerate(SAMPLES)), ["pid", "sample"])) + ")"


def whole_findings(docs, samples):
    """Counts of all rules over the whole texts of all rows, each followed by a text that one rule finds."""
    texts = inputs.run_sql(docs.sparkSession, _WHOLE, documents=docs, samples=samples)
    return _summary(scan.scan_all(texts, "text", ALL_RULES, ["doc_id"]))


@register("rule_documents", sql_findings(SQL_WHOLE, "doc_id", TEXT_VIEWS | {"nfkc_lower": _SQL_NFKC}, ALL_RULES))
def rule_documents(spark, sf):
    """All rules over whole documents, each followed by a text that one rule finds."""
    return whole_findings(table(spark, sf, "documents", texts=True), inputs.inline(spark, list(enumerate(SAMPLES)), "pid int, sample string"))


@register("excerpts", "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS excerpt FROM documents")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.truncate_excerpt(F.col("text")).alias("excerpt"))


def _sql_redact(source: str, key: str, rules, tag) -> str:
    """The same fold, one subquery per rule, for the checking engine."""
    sql = f"SELECT {key}, text AS t, []::VARCHAR[] AS found FROM {source}"
    for r in rules:
        hits = f"list_filter(regexp_extract_all(t, {q(r.pattern)}), lambda x: {sql_valid(r.validator, 'x')})"
        step = (
            "list_reduce(h, lambda acc, x: CASE WHEN instr(acc, x) = 0 THEN acc ELSE "
            f"left(acc, instr(acc, x) - 1) || {q(tag(r))} || substr(acc, instr(acc, x) + length(x)) END, t)"
        )
        sql = (
            f"SELECT {key}, CASE WHEN len(h) > 0 THEN {step} ELSE t END AS t, "
            f"CASE WHEN len(h) > 0 THEN list_append(found, {q(r.name)}) ELSE found END AS found "
            f"FROM (SELECT *, {hits} AS h FROM ({sql}))"
        )
    return f"SELECT {key}, t AS redacted, array_to_string(found, '|') AS found FROM ({sql}) WHERE len(found) > 0"


def _redacted(df, key, expr):
    r = computed_once(df, "r", expr)
    return r.filter(F.size("r.found") > 0).select(key, F.col("r.text").alias("redacted"), F.array_join("r.found", "|").alias("found"))


@register("pii_redacted", _sql_redact("documents", "doc_id", pii.PACK, pii.placeholder))
def pii_redacted(spark, sf):
    docs = table(spark, sf, "documents", texts=True).select("doc_id", "text").withColumn("fold", tx.folded(F.col("text")))
    return _redacted(docs, "doc_id", redact.redact_pii("text", "fold"))


@register("secrets_redacted", _sql_redact("documents", "doc_id", secrets.PACK, lambda r: secrets.PLACEHOLDER))
def secrets_redacted(spark, sf):
    docs = table(spark, sf, "documents", texts=True).select("doc_id", "text").withColumn("fold", tx.folded(F.col("text")))
    return _redacted(docs, "doc_id", redact.redact_secrets("text", "fold"))


_CARD = r"\b(?:\d[ -]?){12,18}\d\b"


@register("luhn_cards", f"""
    SELECT doc_id, card, {sql_valid('luhn', 'card')} AS valid FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, {q(_CARD)})) AS card FROM documents)
""")
def luhn_cards(spark, sf):
    docs = table(spark, sf, "documents", texts=True)
    from agentguard.functions.regex import re2

    cards = docs.filter(F.col("text").rlike("[0-9]{2}")).select("doc_id", F.explode_outer(tx.all_matches(F.col("text"), re2(_CARD))).alias("card")).filter("card IS NOT NULL")
    return cards.withColumn("valid", validators.validate("luhn", F.col("card")))


@register("pii_first_match", f"""
    SELECT rule_id, count(*) AS messages, min(excerpt) AS sample FROM (
      SELECT coalesce({", ".join(
          f"CASE WHEN {sql_valid(r.validator, f'h{i}')} AND h{i} <> '' THEN {q(r.rule_id)} END" for i, r in enumerate(pii.select(min_confidence='medium')))}) AS rule_id,
        coalesce({", ".join(
          f"CASE WHEN {sql_valid(r.validator, f'h{i}')} AND h{i} <> '' THEN CASE WHEN strlen(h{i}) < 8 THEN '****' ELSE left(h{i}, 4) || '****' || right(h{i}, 2) END END" for i, r in enumerate(pii.select(min_confidence='medium')))}) AS excerpt
      FROM (SELECT {", ".join(f"regexp_extract(text, {q(r.pattern)}) AS h{i}" for i, r in enumerate(pii.select(min_confidence='medium')))} FROM {inputs.SQL_MESSAGES}))
    WHERE rule_id IS NOT NULL GROUP BY rule_id
""")
def pii_first_match(spark, sf):
    rules = pii.select(min_confidence="medium")
    df, views = scan.with_views(inputs.messages(spark, sf), F.col("text"), rules, normalised=False)
    hit = computed_once(df, "f", scan.pii_finding(views, rules)).filter("f IS NOT NULL")
    return hit.groupBy(F.col("f.rule_id").alias("rule_id")).agg(F.count("*").alias("messages"), F.min("f.match_excerpt").alias("sample"))


_IMPERATIVE = "|".join(injection.IMPERATIVE_STARTS)


@register("imperative_density", f"""
    SELECT doc_id, len(segs) AS segments, len(imp) AS imperative,
      strlen(text) >= 100 AND len(segs) >= 3 AND len(imp) / len(segs) > 0.4 AS dense
    FROM (SELECT *, list_filter(segs, lambda s: regexp_matches(regexp_replace(lower(s), '^\\s+', ''), '^({_IMPERATIVE})')) AS imp
      FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '[.!\\n]'), lambda s: s <> '') AS segs FROM documents))
""")
def imperative_density(spark, sf):
    docs = table(spark, sf, "documents", texts=True)
    stats = docs.select("doc_id", "text", scan.imperative_stats(F.col("text")).alias("s"))
    return stats.select(
        "doc_id", F.col("s.segments").cast("long").alias("segments"), F.col("s.imperative").cast("long").alias("imperative"),
        scan.imperative_density(F.col("text")).alias("dense"))


_B64_KW = " OR ".join(f"contains(d, {q(k)})" for k in injection.BASE64_KEYWORDS)


@register("base64_injection", f"""
    SELECT msg_id, bool_or({_B64_KW}) AS injected FROM (
      SELECT msg_id, lower(try(decode(from_base64(rpad(rtrim(b, '='), (ceil(strlen(rtrim(b, '=')) / 4.0) * 4)::INT, '='))))) AS d
      FROM (SELECT msg_id, unnest(regexp_extract_all(text, {q(injection.BASE64_PATTERN)})) AS b FROM {inputs.SQL_MESSAGES}))
    GROUP BY msg_id HAVING bool_or({_B64_KW})
""")
def base64_injection(spark, sf):
    msgs = inputs.messages(spark, sf).select("msg_id", "text")
    return computed_once(msgs, "injected", scan.base64_injection(F.col("text"))).filter("injected").select("msg_id", "injected")


@register("window_entropy", """
    WITH w AS (
      SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS x FROM (
        SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 50)) AS i FROM (SELECT doc_id, hex(text) AS h FROM documents)
        WHERE length(h) >= 200)),
    c AS (SELECT doc_id, i, b, count(*) AS n FROM (SELECT doc_id, i, unnest(regexp_extract_all(x, '..')) AS b FROM w) GROUP BY ALL),
    e AS (SELECT doc_id, i, -sum(n / 100.0::DOUBLE * log2(n / 100.0::DOUBLE)) AS ent FROM c GROUP BY ALL)
    SELECT doc_id, count(*)::INT AS windows, round(max(ent), 6) AS max_entropy FROM e GROUP BY doc_id
""")
def window_entropy(spark, sf):
    stats = window_stats(injection.ENTROPY_WINDOW, injection.ENTROPY_STEP, injection.ENTROPY_MIN_NONSPACE, injection.ENTROPY_LIMIT)
    docs = computed_once(table(spark, sf, "documents", texts=True), "s", stats(F.col("text")))
    return docs.filter("s.windows > 0").select("doc_id", "s.windows", F.round("s.max_entropy", 6).alias("max_entropy"))


_SQL_HOST = r"regexp_replace(regexp_extract(u, '(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '^\[|\]$', '', 'g')"
_SQL_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
_SQL_PRIVATE = " OR ".join([
    f"starts_with(m, {q(p)})" for p in ("10.", "192.168.", "127.", "169.254.", "0.")
] + ["(starts_with(m, '172.') AND split_part(m, '.', 2)::INT BETWEEN 16 AND 31)"])
_SQL_PARTS = lambda x: f"list_filter(string_split({x}, ':'), lambda g: g <> '')"
_SQL_BYTE = lambda k: f"try_cast('0x' || substr(v6, {25 + 2 * k}, 2) AS INT)"
#: A host's IPv6 address as 32 hex digits (empty if it is none), with a dotted end and `::` written out.
_SQL_FULL = f"""SELECT * EXCLUDE (hx, left_part, right_part), CASE WHEN contains(host, ':') THEN array_to_string(list_transform(
      CASE WHEN contains(hx, '::') THEN list_concat({_SQL_PARTS('left_part')}, list_transform(range(0, 8 - len({_SQL_PARTS('left_part')}) - len({_SQL_PARTS('right_part')})), lambda k: '0'), {_SQL_PARTS('right_part')})
      ELSE string_split(hx, ':') END, lambda g: lpad(g, 4, '0')), '') ELSE '' END AS v6
    FROM (SELECT *, split_part(hx, '::', 1) AS left_part, split_part(hx, '::', 2) AS right_part FROM (
      SELECT *, CASE WHEN regexp_matches(host, ':[0-9]+(\\.[0-9]+){{3}}$') THEN regexp_extract(lower(host), '^(.*:)[0-9.]+$', 1) || (
        WITH o AS (SELECT list_transform(string_split(regexp_extract(host, '[0-9.]+$'), '.'), lambda x: try_cast(x AS BIGINT)) AS b)
        SELECT printf('%x:%x', b[1] * 256 + b[2], b[3] * 256 + b[4]) FROM o) ELSE lower(host) END AS hx FROM @hosts@))"""
#: Verdict on each URL, as SQL: input rows (k, idx, u) of `source`.
SQL_URL_VERDICT = f"""
  SELECT *, CASE
    WHEN scheme IN ('file', 'gopher', 'dict', 'ftp') THEN {q(ssrf.PREFIX)} || 'disallowed scheme "' || scheme || '"'
    WHEN host = '' THEN NULL
    WHEN host IN ('169.254.169.254', 'metadata.google.internal') THEN {q(ssrf.PREFIX + 'cloud metadata endpoint')}
    WHEN lower(host) IN ({", ".join(q(h) for h in vuln.LOOPBACK_V6)}) THEN {q(ssrf.PREFIX)} || 'IPv6 localhost/loopback ' || host
    WHEN (regexp_matches(m, {q(_SQL_V4)}) AND ({_SQL_PRIVATE})) OR regexp_matches(v6, '^(?:0{{31}}1|f[cd]|fe[89ab])')
      THEN {q(ssrf.PREFIX)} || 'private/internal IP ' || host
    WHEN regexp_matches(host, '^[0-9]{{6,}}$') THEN {q(ssrf.PREFIX + 'decimal IP encoding')}
    WHEN starts_with(lower(host), '0x') THEN {q(ssrf.PREFIX + 'hex IP encoding')}
  END AS verdict
  FROM (SELECT *, lower(regexp_extract(u, '(?i)^([a-z][a-z0-9+.\\-]*):', 1)) AS scheme,
      CASE WHEN starts_with(v6, '00000000000000000000ffff') THEN concat_ws('.', {", ".join(_SQL_BYTE(k) for k in range(4))}) ELSE host END AS m
    FROM ({_SQL_FULL.replace("@hosts@", f"(SELECT *, {_SQL_HOST} AS host FROM @source@)")}))
"""


def sql_urls_indexed(source: str, key: str, column: str) -> str:
    return (
        f"(SELECT k, us[idx] AS u, idx FROM (SELECT {key} AS k, us, unnest(range(1, len(us) + 1)) AS idx "
        f"FROM (SELECT {key}, regexp_extract_all({column}, {q(tx.URL_PATTERN)}) AS us FROM {source})))"
    )


@register("ssrf_urls", "SELECT k AS msg_id, u AS url, verdict FROM (" + SQL_URL_VERDICT.replace(
    "@source@", sql_urls_indexed(inputs.SQL_MESSAGES, "msg_id", "text")) + ")")
def ssrf_urls(spark, sf):
    msgs = inputs.messages(spark, sf).select("msg_id", "text")
    return msgs.select("msg_id", F.explode_outer(ssrf.url_verdicts(F.col("text"))).alias("v")).filter("v IS NOT NULL").select(
        "msg_id", F.col("v.url").alias("url"), F.col("v.verdict.description").alias("verdict"))


@register("page_hosts", f"""
    SELECT host, count(*) AS urls, count(DISTINCT page_id) AS pages FROM (
      SELECT page_id, lower({_SQL_HOST}) AS host FROM (
        SELECT page_id, unnest(regexp_extract_all(html, {q(tx.URL_PATTERN)})) AS u FROM pages UNION ALL SELECT page_id, url FROM pages))
    GROUP BY host
""")
def page_hosts(spark, sf):
    from agentguard.functions.net import url_host

    pages = table(spark, sf, "pages", texts=True)
    urls = pages.select("page_id", F.explode(F.concat(tx.extract_urls(F.col("html"), ssrf.URL_JAVA), F.array("url"))).alias("u"))
    # Two-step distinct: a hot host is reduced on every task before it meets one reducer.
    per_page = urls.groupBy(F.lower(url_host(F.col("u"))).alias("host"), "page_id").agg(F.count("*").alias("n"))
    return per_page.groupBy("host").agg(F.sum("n").alias("urls"), F.count("*").alias("pages"))


@register("blob_findings", f"""
    SELECT msg_id, blob, substr(hex(d), 1, 8) AS head, CASE
        WHEN octet_length(d) < 4 THEN NULL
        {" ".join(f"WHEN starts_with(hex(d), {q(m)}) THEN {q(n)}" for n, m in malware.MAGICS)}
      END AS magic, octet_length(d)::INT AS size
    FROM (SELECT msg_id, b AS blob, try(from_base64(rpad(rtrim(b, '='), (ceil(strlen(rtrim(b, '=')) / 4.0) * 4)::INT, '='))) AS d
      FROM (SELECT msg_id, unnest(regexp_extract_all(text, {q(injection.BASE64_PATTERN)})) AS b FROM {inputs.SQL_MESSAGES}))
    WHERE d IS NOT NULL
""")
def blob_findings(spark, sf):
    msgs = inputs.messages(spark, sf).select("msg_id", "text")
    blobs = msgs.select("msg_id", F.explode_outer(malscan.base64_blobs(F.col("text"))).alias("blob"))
    blobs = blobs.withColumn("d", malscan.decoded(F.col("blob"))).filter("d IS NOT NULL")
    return blobs.select(
        "msg_id", "blob", F.substr(F.hex("d"), F.lit(1), F.lit(8)).alias("head"),
        F.expr(malscan.magic_sql("d")).alias("magic"), F.octet_length("d").alias("size"))


# --- entropy and archives -------------------------------------------------------------------

#: Ends of documents: two hundred signs of 94, or of 40, or none.
_SIGNS = "CASE doc_id % 3 WHEN 0 THEN 94 WHEN 1 THEN 40 END"
_STRANGE_TEXT = f"coalesce(text, '') || coalesce(array_to_string(list_transform(range(0, 200), lambda i: chr((33 + (i * (1 + 2 * (doc_id % 20)) + doc_id) % ({_SIGNS}))::INT)), ''), '')"


@register("high_entropy_bodies", f"""
    WITH d AS (SELECT doc_id, hex({_STRANGE_TEXT}) AS h FROM documents),
    w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 50)) AS i FROM d WHERE length(h) >= 200)),
    b AS (SELECT doc_id, i, unnest(regexp_extract_all(x, '..')) AS b FROM w),
    c AS (SELECT doc_id, i, b, count(*) AS n FROM b GROUP BY ALL),
    e AS (SELECT doc_id, i, -sum(n / 100.0::DOUBLE * log2(n / 100.0::DOUBLE)) AS ent, sum(n) FILTER (b NOT IN ('20', '09', '0A', '0B', '0C', '0D') AND NOT (b BETWEEN '80' AND 'BF')) AS signs FROM c GROUP BY ALL)
    SELECT doc_id, count(*)::INT AS high_windows FROM e WHERE ent > {injection.ENTROPY_LIMIT} AND signs >= {injection.ENTROPY_MIN_NONSPACE} GROUP BY doc_id
""")
def high_entropy_bodies(spark, sf):
    """Documents with windows of high entropy, after an end that has one in a third of them."""
    stats = window_stats(injection.ENTROPY_WINDOW, injection.ENTROPY_STEP, injection.ENTROPY_MIN_NONSPACE, injection.ENTROPY_LIMIT)
    number = F.col("doc_id")
    signs = F.when(number % 3 == 0, 94).when(number % 3 == 1, 40)
    end = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.chr(33 + (i * (1 + 2 * (number % 20)) + number) % signs)), "")
    docs = table(spark, sf, "documents", texts=True).select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce(end, F.lit(""))).alias("text"))
    return computed_once(docs, "s", stats(F.col("text"))).filter("s.high > 0").select("doc_id", F.col("s.high").alias("high_windows"))


#: Largest decoded size in the query below, in place of ten megabytes.
_MOST_DECODED = 2000


@register("blob_verdicts", """
    SELECT doc_id, rule_id FROM (SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN CASE WHEN doc_id % 50 + 90 > 100 THEN 'zip_bomb' END WHEN 2 THEN CASE WHEN doc_id % 50 + 80 > 100 THEN 'gzip_bomb' END
      WHEN 3 THEN 'high_entropy' WHEN 5 THEN 'decoded_size' WHEN 6 THEN 'blob_size' END AS rule_id FROM documents) WHERE rule_id IS NOT NULL
""")
def blob_verdicts(spark, sf):
    """Blobs of seven kinds, a kind by id: plain, archives that promise more or less than they may, high and fair entropy, and two that are too large."""
    number, kind = F.col("doc_id"), F.col("doc_id") % 7
    le = lambda n: F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4)])
    zeros = lambda n: F.lit("00" * n)
    # Begins with a zero byte, as no executable does.
    spread = lambda size, of: F.concat(zeros(1), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.lpad(F.hex((i * 7 + number) % of), 2, "0")), ""))
    hexes = (
        F.when(kind == 0, spread(60, 4)).when(kind == 1, F.concat(F.lit("504B0304"), zeros(14), le(F.lit(10)), le(10 * (number % 50 + 90)), zeros(10)))
        .when(kind == 2, F.concat(F.lit("1F8B0800"), zeros(26), le(34 * (number % 50 + 80)))).when(kind == 3, spread(300, 256)).when(kind == 4, spread(300, 64))
        .when(kind == 5, zeros(_MOST_DECODED + 1)).otherwise(zeros(3 * _MOST_DECODED)))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit(" "), F.regexp_replace(F.base64(F.unhex(hexes)), r"\s", ""), F.lit(" end")).alias("text"))
    df, views = with_views(docs, F.col("text"), (*malware.PACK, injection.BASE64_RUN), normalised=False)
    df = malscan.with_malware_finding(df, views, "found", max_size=_MOST_DECODED)
    # A filter on the finding itself would be copied below the entropy step, and scan every text twice.
    return computed_once(df.select("doc_id", "found"), "once", F.col("found")).where("once IS NOT NULL").select("doc_id", "once.rule_id")
