"""Response stream queries: documents cut into chunks, framed bodies, live twins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from agentguard.functions import text as tx
from agentguard.operators import chunks as ch
from agentguard.operators.policy import InjectionScan, MalwareScan, PiiScan, Policy, SecretsScan
from agentguard.plans import auditing, events, inputs
from agentguard.plans.base import q, register, sql_valid, table
from agentguard.plans.policies import sql_fold, sql_injection_reason, sql_malware_blobs, sql_malware_reason
from agentguard.rules import pii, secrets
from agentguard.session import shared_dir, staged
from agentguard.streaming import processors as live

PIECE = 400
MICRO_BATCH = 256 << 20
POLICY = Policy(prompt_injection=InjectionScan(), malware_scan=MalwareScan(), secrets_scan=SecretsScan(action="redact"), pii_scan=PiiScan())
_METHOD = "CASE stream_id % 3 WHEN 0 THEN 'chat.send' WHEN 1 THEN 'code.generate' ELSE 'search.query' END"

# Documents with one payload at a piece border, so that findings span chunks.
CHUNKS = f"""
SELECT stream_id, seq, body, substr(body, seq * {PIECE} + 1, {PIECE}) AS text, {_METHOD} AS request_method, 'write text' AS request_params
FROM (SELECT stream_id, body, unnest(range(0, (length(body) + {PIECE - 1}) // {PIECE})) AS seq FROM (@bodies@) x) y
"""
_BODIES = f"""
SELECT d.doc_id AS stream_id, concat(left(d.text, {PIECE} - 10), ' ', p.payload, ' ', substr(d.text, {PIECE} - 9)) AS body
FROM @documents@ d JOIN @payloads@ p ON ((coalesce(d.doc_id, 0) % 31) + 31) % 31 = p.pid
"""
SQL_CHUNKS = "(" + CHUNKS.replace("@bodies@", _BODIES).replace("@documents@", "documents").replace(
    "@payloads@", inputs.values(inputs.PAYLOADS, ["pid", "shape", "payload"])) + ")"


def chunks(spark, sf):
    """The pieces are cut in one pass over a body, which does not go with them."""
    payloads = inputs.inline(spark, inputs.PAYLOADS, "pid int, shape string, payload string")
    bodies = inputs.run_sql(spark, _BODIES, documents=table(spark, sf, "documents", texts=True), payloads=payloads)
    return _cut(bodies)


def _cut(bodies):
    pieces = F.regexp_extract_all("body", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = bodies.select("stream_id", F.posexplode(pieces).alias("seq", "text"))
    return cut.select("stream_id", F.col("seq").cast("bigint").alias("seq"), "text", F.expr(_METHOD).alias("request_method"), F.lit("write text").alias("request_params"))


#: End of a text in at most 200 bytes and whole characters, for the checking engine.
_SQL_TAIL = "substr({x}, list_min(list_filter(range(1, 202), lambda k: octet_length(encode(substr({x}, k))) <= 200)))"
_SQL_CARRY = "CASE WHEN seq = 0 THEN '' ELSE " + _SQL_TAIL.replace("{x}", f"substr(body, greatest(seq * {PIECE} - 199, 1), least(200, seq * {PIECE}))") + " END"


def _sql_scanned() -> str:
    """Latched chunks for the checking engine; the carry-over is cut from the whole text."""
    code = "request_method = 'code.generate'"
    base = f"""(SELECT *, {_SQL_CARRY} || text AS w, text AS work,
        stream_id * 1000000 + seq AS cid FROM {SQL_CHUNKS})"""
    sec = " OR ".join(f"regexp_matches(w, {q(r.pattern)})" for r in secrets.PACK)
    detect = " OR ".join(
        f"(regexp_extract(w, {q(r.pattern)}) <> '' AND {sql_valid(r.validator, f'regexp_extract(w, {q(r.pattern)})')})"
        for r in pii.select(min_confidence="medium"))
    found = f"""(SELECT b.* EXCLUDE (body), {sql_injection_reason('w')} AS inj, coalesce({sql_malware_reason('w')}, m.blob_reason) AS mal, ({sec}) AS has_sec, ({detect}) AS has_pii
        FROM {base} b LEFT JOIN ({sql_malware_blobs(base, 'cid', 'w')}) m ON b.cid = m.k)"""
    sql = sql_fold(found, "work", "f1", secrets.PACK, lambda r: secrets.PLACEHOLDER, "has_sec")
    sql = sql_fold(f"({sql})", "work", "f2", pii.PACK, pii.placeholder, "has_pii")
    block = (
        f"coalesce(CASE WHEN NOT ({code} AND coalesce(inj LIKE '%encoding attack%', false)) THEN inj END, "
        f"CASE WHEN NOT ({code} AND coalesce({sql_is_script()}, false)) THEN mal END)"
    )
    return f"""
      SELECT stream_id, seq, CASE WHEN seq >= first_at THEN 'deny' ELSE 'allow' END AS decision,
        CASE WHEN seq >= first_at THEN why WHEN len(f1) + len(f2) > 0 THEN 'chunk redacted' ELSE '' END AS reason,
        CASE WHEN seq >= first_at THEN NULL ELSE work END AS redacted_text, coalesce(seq >= first_at, false) = false AND len(f1) + len(f2) > 0 AS was_redacted, first_at
      FROM (SELECT *, min(CASE WHEN block IS NOT NULL THEN seq END) OVER (PARTITION BY stream_id) AS first_at, min_by(block, seq) FILTER (WHERE block IS NOT NULL) OVER (PARTITION BY stream_id) AS why
        FROM (SELECT *, {block} AS block FROM ({sql})))"""


def sql_is_script() -> str:
    from agentguard.rules import malware

    return "mal IN (" + ", ".join(q(f"malware_scan: {r.name} detected") for r in malware.SCRIPTS) + ")"


def _latched(spark, sf):
    """Scanned chunks with the block latch. The scan is written once, as the latch reads it twice."""
    carried = ch.with_overlap(chunks(spark, sf), "stream_id", "seq", "text")
    kept = ("stream_id", "seq", "block_reason", "block_results", "soft_results", "redacted_text", "was_redacted", "code_generation")
    return ch.latch(staged(ch.scan_chunks(carried, POLICY).select(*kept), "chunk-scan"), "stream_id", "seq")


@register("chunk_scan", f"SELECT stream_id, seq, decision, reason, redacted_text, was_redacted FROM ({_sql_scanned()})")
def chunk_scan(spark, sf):
    return _latched(spark, sf).select("stream_id", "seq", "decision", "reason", "redacted_text", "was_redacted")


@register("chunk_overlap", f"""
    SELECT stream_id, seq, {_SQL_CARRY} AS carry FROM {SQL_CHUNKS}
""")
def chunk_overlap(spark, sf):
    return ch.with_overlap(chunks(spark, sf), "stream_id", "seq", "text").select("stream_id", "seq", "carry")


@register("stream_summary", f"""
    SELECT stage, count(*) AS streams, sum(chunks)::BIGINT AS chunks FROM (
      SELECT stream_id, CASE WHEN bool_or(decision = 'deny') THEN 'stream_blocked' WHEN bool_or(was_redacted) THEN 'stream_redacted' ELSE 'stream_clean' END AS stage,
        count_if(first_at IS NULL OR seq <= first_at) AS chunks FROM ({_sql_scanned()}) GROUP BY stream_id) GROUP BY stage
""")
def stream_summary(spark, sf):
    out = ch.finalize(_latched(spark, sf), "stream_id")
    return out.groupBy("stage").agg(F.count("*").alias("streams"), F.sum("chunks").alias("chunks"))


# A framed body per conversation turn: an event line, the text's lines as data lines, an end mark.
_SSE = """SELECT msg_id, concat('event: message', chr(10), 'data: ', replace(text, chr(10), concat(chr(10), 'data:')), chr(10), chr(10), 'id: 7', chr(10), chr(10), 'data: [DONE]', chr(10), chr(10), 'data:second', chr(10), 'retry: 5', chr(10), chr(10)) AS body FROM @messages@"""


@register("sse_frames", f"""
    SELECT msg_id, 0 AS seq, text AS data, concat('event: message', chr(10), 'data: X', chr(10)) AS rebuilt FROM {inputs.SQL_MESSAGES}
    UNION ALL SELECT msg_id, 1, 'second', concat('data: X', chr(10), 'retry: 5', chr(10)) FROM {inputs.SQL_MESSAGES}
""")
def sse_frames(spark, sf):
    bodies = inputs.run_sql(spark, _SSE, messages=inputs.messages(spark, sf))
    return ch.sse_events(bodies, "body").select("msg_id", "seq", "data", ch.sse_rebuild(F.col("frame"), F.lit("X")).alias("rebuilt"))


@register("ndjson_lines", f"""
    SELECT msg_id, count(*) AS lines, sum(strlen(x))::BIGINT AS bytes FROM (
      SELECT msg_id, regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '^\\s+', ''), '\\s+$', '') AS x FROM {inputs.SQL_MESSAGES}) WHERE x <> '' GROUP BY msg_id
""")
def ndjson_lines(spark, sf):
    lines = ch.ndjson_lines(inputs.messages(spark, sf).select("msg_id", "text"), "text")
    return lines.groupBy("msg_id").agg(F.count("*").alias("lines"), F.sum(tx.byte_len(F.col("data"))).alias("bytes"))


# --- live twins: the same input read as a stream, until it is used up ---------------------------


def run_stream(spark, streamed, key: str, ends=()):
    """Run a streaming query to the end of its input; gives the output path and schema.

    Checkpoint and output go to the shared folder of the cluster. `ends` are (rows, folder) pairs of `closed`: they are written when all
    else has been read, and the query goes on from its checkpoint, so that what waits for the watermark is given out.
    """
    folder = f"{shared_dir(spark)}/{key}-{os.urandom(6).hex()}"

    def run():
        streamed.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option(
            "checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").start().awaitTermination()

    run()
    if ends:
        for rows, at in ends:
            rows.write.mode("append").parquet(at)
        run()
    return f"{folder}/out", streamed.schema


def written(spark, streamed, key: str, ends=()):
    """The rows a streaming query wrote until its input was used up."""
    path, schema = run_stream(spark, streamed, key, ends)
    return spark.read.schema(schema).parquet(path)


#: A closing row of the event table is far behind all others; its own time never comes.
_CLOSING = "2100-01-01 00:00:00"


def closed(spark, sf, name: str, time: str):
    """(stream, ends): a table as a stream that can be closed. The closing row has a time and nothing else."""
    stream = read_stream(spark, sf, name)
    folder = f"{shared_dir(spark)}/closing-{os.urandom(6).hex()}"
    row = spark.range(1).select(*[
        (F.lit(_CLOSING) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    row.limit(0).write.parquet(folder)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), [(row, folder)]


def latest(spark, streamed, key: str, keys, value: str):
    """The last value of each key that an updating query gave until its input was used up.

    Each batch goes to a folder of its own number, so a batch that is repeated replaces itself.
    """
    folder = f"{shared_dir(spark)}/{key}-{os.urandom(6).hex()}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        streamed.writeStream.outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def read_stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    # The brackets make it a pattern that only this table's name fits. A micro-batch has a bound, whatever the table's size.
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(MICRO_BATCH)).parquet(f"{sf}/{name}[.]parquet")


@register("live_threat_score", events.sql_of("threat_score"))
def live_threat_score(spark, sf):
    raw, ends = closed(spark, sf, "events", "ts")
    return written(spark, live.stream_threat_scores(inputs.run_sql(spark, events.SECURITY_EVENTS, events=raw)), "threat", ends)


@register("live_overrides", f"SELECT node_id, action, start_us, end_us, trigger_event_id FROM ({events.sql_of('overrides')})")
def live_overrides(spark, sf):
    raw, ends = closed(spark, sf, "events", "ts")
    return written(spark, live.stream_overrides(inputs.run_sql(spark, events.SECURITY_EVENTS, events=raw), events.RULES), "overrides", ends)


@register("live_source_counts", f"""
    SELECT source, event_id, epoch_us(ts) AS us, count(*) OVER (PARTITION BY source ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY source, ts) + row_number() OVER (PARTITION BY source, ts ORDER BY event_id) AS recent FROM {events.SQL_EVENTS}
""")
def live_source_counts(spark, sf):
    raw, ends = closed(spark, sf, "events", "ts")
    stream = inputs.run_sql(spark, events.SECURITY_EVENTS, events=raw)
    return written(spark, live.stream_trailing_counts(stream, ["source"], 300), "recent", ends)


@register("live_deny_events", f"SELECT event_type, severity, tool, count(*) AS events FROM (SELECT tool, {auditing.SQL_EVENT_KIND} FROM {auditing.SQL_DECISIONS} WHERE decision = 'deny') GROUP BY ALL")
def live_deny_events(spark, sf):
    stream = inputs.run_sql(spark, auditing.DECISIONS, events=read_stream(spark, sf, "events"))
    out = written(spark, live.deny_events(stream), "deny")
    return out.groupBy("event_type", "severity", "tool").agg(F.count("*").alias("events"))


@register("live_counters", f"SELECT date_trunc('day', timestamp)::TIMESTAMP AS window_start, decision, scanner_type, count(*) AS decisions FROM {auditing.SQL_DECISIONS} GROUP BY ALL")
def live_counters(spark, sf):
    stream = inputs.run_sql(spark, auditing.DECISIONS, events=read_stream(spark, sf, "events"))
    return latest(spark, live.stream_counters(stream, "1 day"), "counters", ["window_start", "decision", "scanner_type"], "decisions")


@register("live_source_activity", f"SELECT time_bucket(INTERVAL 5 MINUTE, ts)::TIMESTAMP AS window_start, source, count(*) AS events FROM {events.SQL_EVENTS} GROUP BY ALL")
def live_source_activity(spark, sf):
    stream = inputs.run_sql(spark, events.SECURITY_EVENTS, events=read_stream(spark, sf, "events"))
    return latest(spark, live.stream_source_activity(stream), "activity", ["window_start", "source"], "events")


@register("live_chunk_scan", f"SELECT stream_id, seq, decision, reason, redacted_text, was_redacted FROM ({_sql_scanned()})")
def live_chunk_scan(spark, sf):
    payloads = inputs.inline(spark, inputs.PAYLOADS, "pid int, shape string, payload string")
    stream = _cut(inputs.run_sql(spark, _BODIES, documents=read_stream(spark, sf, "documents"), payloads=payloads))
    path, schema = run_stream(spark, live.scan_stream(stream, POLICY), "chunks")
    scanned = spark.readStream.schema(schema).parquet(path)
    return written(spark, live.stream_latch(scanned), "latched").select("stream_id", "seq", "decision", "reason", "redacted_text", "was_redacted")
