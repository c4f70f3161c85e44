"""Structured Streaming twins of the ordered operators, with per-key state."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from agentguard.functions.labels import SEVERITY_WEIGHTS, reason_to_event, severity_weight
from agentguard.operators.adaptive import DECAY_SECONDS, DEFAULT_WINDOW, MAX_SCORE, SECOND
from agentguard.operators.chunks import OVERLAP, scan_chunks
from agentguard.operators.ordered import micros
from agentguard.streaming.ordered_state import SequenceFold, TimeFold, with_store

WATERMARK = "10 minutes"


def _tail(text: str) -> str:
    """The longest end of a text of at most OVERLAP bytes, in whole characters."""
    raw = text.encode("utf-8", "surrogatepass")[-OVERLAP:]
    while raw and 0x80 <= raw[0] < 0xC0:
        raw = raw[1:]
    return raw.decode("utf-8", "surrogatepass")


def _as(df: DataFrame, columns) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _types(df: DataFrame, columns) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in columns]


def _in_sequence(df: DataFrame, key: str, columns, fold: str, step, output: str) -> DataFrame:
    processor = SequenceFold(columns, _types(df, columns), StructType.fromDDL(output).names, fold, step)
    return with_store(df).groupBy(key).transformWithState(processor, output, "append", "none")


def stream_overlap(chunks: DataFrame, stream: str = "stream_id", seq: str = "seq", text: str = "text", last: str | None = None) -> DataFrame:
    """Add the carry-over to each chunk. The state of a stream is its last 200 bytes, and the chunks that came before their turn.

    It is kept until a chunk with a true `last` column ends the stream; a pause does not end it. `seq` counts the
    chunks of a stream from 0 without gaps, as framing numbers them.
    """
    rest = [c for c in chunks.columns if c not in (stream, seq)]
    rows = chunks.select(stream, F.col(seq).cast("bigint").alias(seq), (F.col(last) if last else F.lit(False)).alias("__last"), *rest)
    columns = [seq, "__last", *rest]
    at = columns.index(text)

    def carry(state, row):
        tail = state[0] if state else ""
        return (_tail(tail + row[at]),), [(row[0], *row[2:], tail)]

    out = f"{_as(rows, [stream, seq, *rest])}, carry string"
    return _in_sequence(rows, stream, columns, "tail string", carry, out).select(*chunks.columns, "carry")


def stream_latch(scanned: DataFrame, stream: str = "stream_id", seq: str = "seq", last: str | None = None) -> DataFrame:
    """Deny every chunk after the first blocked one. The state of a stream is its block reason, and the chunks that came before their turn.

    A block holds until a chunk with a true `last` column ends the stream, however long it pauses.
    """
    rows = scanned.select(
        stream, F.col(seq).cast("bigint").alias(seq), (F.col(last) if last else F.lit(False)).alias("__last"), "block_reason", "was_redacted", "redacted_text")

    def latch(state, row):
        number, _, why_here, was, text = row
        why = (state[0] if state else "") or why_here or ""
        redacted = bool(was) and not why
        reason = why or ("chunk redacted" if redacted else "")
        return (why,), [(number, "deny" if why else "allow", reason, redacted, None if why else text)]

    out = f"{_as(rows, [stream, seq])}, decision string, reason string, was_redacted boolean, redacted_text string"
    return _in_sequence(rows, stream, [seq, "__last", "block_reason", "was_redacted", "redacted_text"], "why string", latch, out)


def scan_stream(chunks: DataFrame, policy) -> DataFrame:
    """Live overlap and scan. Its output table is the source of `stream_latch`: a query holds
    one arbitrary state, so the two run as chained queries."""
    scanned = scan_chunks(stream_overlap(chunks), policy)
    return scanned.drop("block_results", "soft_results", "carry")


def _by_time(rows: DataFrame, key, columns, fold: str, step, output: str, **how) -> DataFrame:
    """Fold rows (key, us, id, ...) by time; `ts` is the event time. Rows behind the watermark are taken when they come."""
    processor = TimeFold(columns, _types(rows, columns), StructType.fromDDL(output).names, fold, step, **how)
    return with_store(rows).withWatermark("ts", WATERMARK).groupBy(key if isinstance(key, str) else list(key)).transformWithState(processor, output, "append", "EventTime")


def stream_threat_scores(events: DataFrame, node: str = "node_id", event_id: str = "event_id") -> DataFrame:
    """Threat score after every event, once the watermark has passed it.

    The state of a node is (last decay, score). It stays: a node's first event is scored unlike one after a pause, however long.
    """
    rows = events.select(
        node, micros(F.col("ts")).alias("us"), F.col(event_id).alias("id"), severity_weight(F.col("severity")).cast("bigint").alias("weight"),
        F.col("ts").cast("timestamp").alias("ts"))

    def score(state, row):
        us, number, weight = row
        last, value = state or (None, 0)
        value = min(MAX_SCORE, value + weight)
        if last is None:
            last = us
        elif us - last > DECAY_SECONDS * SECOND:
            value, last = max(0, value - (us - last) // (DECAY_SECONDS * SECOND)), us
        return (last, value), [(number, value)]

    output = f"{_as(rows, [node])}, `{event_id}` {rows.schema['id'].dataType.simpleString()}, threat_score bigint"
    return _by_time(rows, node, ["us", "id", "weight"], "last bigint, score bigint", score, output)


def stream_trailing_counts(events: DataFrame, keys, window_seconds: int = DEFAULT_WINDOW, event_id: str = "event_id", most: int | None = None) -> DataFrame:
    """(keys, event_id, us, recent): events of the same keys in the last seconds, up to and with each in order of time and id, once the watermark has passed it.

    The state of a key is the times of its window with their counts; with `most`, counts end there and so do the times. It leaves the
    store when the window has passed.
    """
    keys = list(keys)
    span = window_seconds * SECOND
    rows = events.select(*keys, micros(F.col("ts")).alias("us"), F.col(event_id).alias("id"), F.col("ts").cast("timestamp").alias("ts"))

    # The step works on queues of times and counts and the sum of the counts, so that a row costs the same whatever the window holds.
    def count(state, row):
        us, number = row
        times, counts, held = state = state or [deque(), deque(), 0]
        if times and times[-1] == us:
            counts[-1] += 1
        else:
            times.append(us)
            counts.append(1)
        held += 1
        while times[0] <= us - span or most is not None and held - counts[0] >= most:
            times.popleft()
            held -= counts.popleft()
        state[2] = held
        return state, [(number, us, held if most is None else min(most, held))]

    output = f"{_as(rows, keys)}, `{event_id}` {rows.schema['id'].dataType.simpleString()}, us bigint, recent bigint"
    return _by_time(rows, keys, ["us", "id"], "times array<bigint>, counts array<bigint>", count, output,
                    keep=lambda state, us: state[0][-1] > us - span, wake=lambda state: state[0][-1] + span,
                    load=lambda stored: [deque(stored[0]), deque(stored[1]), sum(stored[1])], save=lambda state: (list(state[0]), list(state[1])))


def stream_overrides(events: DataFrame, rules, node: str = "node_id", event_id: str = "event_id") -> DataFrame:
    """Overrides as they fire, once the watermark has passed their events.

    The state of a node holds expiries and, of each counted kind, as many of the newest times as a rule asks for. Expired
    overrides and times that no rule looks back to leave it with every event, and a node's state goes when all of them have passed.
    """
    rules = tuple(rules)
    span = {}
    most = {}
    for r in rules:
        if r.min_count:
            kind = (r.source, r.type)
            span[kind] = max(span.get(kind, 0), (r.window_seconds or DEFAULT_WINDOW) * SECOND)
            most[kind] = max(most.get(kind, 0), r.min_count)
    rows = events.select(
        node, micros(F.col("ts")).alias("us"), F.col(event_id).alias("id"), "source", "event_type", "severity", F.col("ts").cast("timestamp").alias("ts"))

    def fires(rule, source, kind, severity, us, recent) -> bool:
        if rule.source and source != rule.source or rule.type and kind != rule.type:
            return False
        if rule.min_severity and SEVERITY_WEIGHTS.get(severity, 0) < SEVERITY_WEIGHTS[rule.min_severity]:
            return False
        if rule.min_count:
            cutoff = us - (rule.window_seconds or DEFAULT_WINDOW) * SECOND
            return sum(t > cutoff for t in recent.get((rule.source, rule.type), ())) >= rule.min_count
        return True

    def step(state, row):
        us, number, source, event_type, severity = row
        actions, ends, kinds, times = state or ([], [], [], [])
        active = {a: end for a, end in zip(actions, ends, strict=True) if end > us}
        recent: dict = {}
        for name, t in zip(kinds, times, strict=True):
            kind = tuple(name.split("\x1f"))
            if t > us - span.get(kind, 0):
                recent.setdefault(kind, []).append(t)
        kind = (source, event_type)
        if kind in span:
            recent[kind] = [*recent.get(kind, []), us][-most[kind]:]
        out = []
        for rule in rules:
            if rule.action not in active and fires(rule, source, event_type, severity, us, recent):
                active[rule.action] = us + rule.duration * SECOND
                out.append((rule.action, us, active[rule.action], number))
        flat = [("\x1f".join(k), t) for k, ts in recent.items() for t in ts]
        return (list(active), list(active.values()), [k for k, _ in flat], [t for _, t in flat]), out

    def end(state) -> int:
        """When nothing of a state can matter any more."""
        actions, ends, kinds, times = state
        return max([0, *ends, *(t + span.get(tuple(k.split("\x1f")), 0) for k, t in zip(kinds, times, strict=True))])

    output = f"{_as(rows, [node])}, action string, start_us bigint, end_us bigint, trigger_event_id {rows.schema['id'].dataType.simpleString()}"
    return _by_time(rows, node, ["us", "id", "source", "event_type", "severity"], "actions array<string>, ends array<bigint>, kinds array<string>, times array<bigint>",
                    step, output, keep=lambda state, us: end(state) > us, wake=end)


def stream_counters(decisions: DataFrame, window: str = "1 hour") -> DataFrame:
    """Decision counters per event-time window, for update mode: a window's row is written anew as it grows.

    Rows later than the watermark are not counted; `late_rows` says how many there were.
    """
    return _windowed(decisions, "timestamp", window, ["decision", "scanner_type"], "decisions")


def stream_source_activity(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Events per source and event-time window, for update mode."""
    return _windowed(events, "ts", window, ["source"], "events")


def _windowed(df: DataFrame, time: str, window: str, keys, out: str) -> DataFrame:
    timed = df.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", WATERMARK)
    grouped = timed.groupBy(F.window("__ts", window).alias("w"), *keys).agg(F.count("*").alias(out))
    return grouped.select(F.col("w.start").alias("window_start"), *keys, out)


def late_rows(query) -> int:
    """Rows that a query's stateful operators refused so far because they came behind the watermark."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def deny_events(decisions: DataFrame) -> DataFrame:
    """Security events published for denied decisions; a stateless projection."""
    denied = decisions.filter("decision = 'deny'")
    return denied.select(
        F.col("timestamp").cast("timestamp").alias("ts"), reason_to_event(F.col("reason")).alias("e"), "session_id", "tool", "reason",
        F.lit("proxy").alias("source")).select("*", "e.event_type", "e.severity").drop("e")
