"""Threat scores and adaptive overrides over security events.

Both are ordered folds. A fold step only depends on a small state, so each (node, run of
time slices) is summarised on its own as a table "state on entry -> state on exit"; the tables are
chained per node, a row per chunk; and every chunk is then worked through from its known
entry state. A node with a third of all events is spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentguard.functions.labels import SEVERITY_WEIGHTS, severity_weight
from agentguard.operators.ordered import interval_join, micros, trailing_count
from agentguard.session import staged

SECOND = 1_000_000
# Score cap, decay period, default window and override duration (seconds).
MAX_SCORE = 100
DECAY_SECONDS = 30
DEFAULT_WINDOW = 60
DEFAULT_DURATION = 300
ACTION_EVENTS = {
    "elevate_sensitivity": "sensitivity_elevated",
    "elevate_default_deny": "default_deny_activated",
    "block_session": "session_blocked",
    "add_temp_firewall_rule": "temp_rule_added",
}
SENSITIVITY_LEVELS = {1: "low", 2: "medium", 3: "high"}
SLICE_SECONDS = 3600
CHUNK_ROWS = 20_000
CUTS = 256  # parts of a time slice that has more rows than a chunk
NEVER = -(2**62)


@dataclass(frozen=True)
class AdaptiveRule:
    """When events of a kind call for an action. Empty fields match everything."""

    action: str
    source: str = ""
    type: str = ""
    min_severity: str = ""
    min_count: int = 0
    window_seconds: int = DEFAULT_WINDOW
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.min_count > 0 and not (self.source and self.type):
            raise ValueError("a rule with min_count needs a source and a type")

    @property
    def duration(self) -> int:
        d = self.params.get("duration_seconds", 0)
        return d if d > 0 else DEFAULT_DURATION


def event_filter(types=(), sources=(), min_severity: str = ""):
    """Condition for a subscription; empty lists take everything."""
    cond = F.lit(True)
    if types:
        cond = cond & F.col("event_type").isin(*types)
    if sources:
        cond = cond & F.col("source").isin(*sources)
    if min_severity:
        cond = cond & (severity_weight(F.col("severity")) >= SEVERITY_WEIGHTS[min_severity])
    return cond


def trailing_counts(events: DataFrame, keys, window_seconds: int = DEFAULT_WINDOW, out: str = "recent") -> DataFrame:
    """Events of the same keys in the last seconds, the current one included."""
    df = events.withColumn("__us", micros(F.col("ts")))
    return trailing_count(df, keys, "__us", window_seconds * SECOND, out).drop("__us")


# --- greedy chains --------------------------------------------------------------------------


def _follow(times: np.ndarray, reach: np.ndarray, strict: bool) -> np.ndarray:
    """Index of the next link after each row: the first time past (or at) its reach."""
    return np.searchsorted(times, reach, side="right" if strict else "left")


def _exit_tables(times, reach, entries, strict):
    """Reach of the last link in the chunk, for a chain that starts at each of the first rows."""
    n, nxt = len(times), _follow(times, reach, strict)
    cur = np.arange(entries)
    while True:
        step = nxt[cur]
        go = step < n
        if not go.any():
            return reach[cur]
        cur = np.where(go, step, cur)


def _distinct_exits(entries, exits):
    """The last entry of each run with one exit, which stands for the run. Chains of uneven times merge soon and leave few; of even times, all stay."""
    keep = np.append(exits[1:] != exits[:-1], True)
    return entries[keep], exits[keep]


def _pieces(batches):
    """Columns of each whole (chain_key, chunk) from batches sorted by group; memory is one group."""
    held: list[dict] = []

    def joined():
        return held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for pdf in batches:
        if pdf.empty:
            continue
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        keys, chunks = cols["chain_key"], cols["chunk"]
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if held and (held[0]["chain_key"][0] != keys[a] or held[0]["chunk"][0] != chunks[a]):
                yield joined()
                held = []
            held.append({c: v[a:b] for c, v in cols.items()})
    if held:
        yield joined()


def _cut(rows: DataFrame, slice_us: int) -> DataFrame:
    """Number the chunks of each key: time slices, packed up to a number of rows.

    Quiet keys become one chunk, busy ones as many as their rows need. A slice with more rows than a chunk
    is cut at quantiles of its times, so that all rows of a second still make many chunks. Only counts per
    (key, slice) go through the window. `rows` is read several times: give a table.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col("us") / slice_us)).withColumn("__sub", F.lit(0))
    counts = staged(sliced.groupBy("chain_key", "__slice", "__sub").agg(F.count("*").alias("__n")), "chain-counts")
    busy = counts.where(F.col("__n") > CHUNK_ROWS).select("chain_key", "__slice")
    if not busy.isEmpty():
        at = [k / CUTS for k in range(1, CUTS)]
        cuts = staged(sliced.join(busy, ["chain_key", "__slice"]).groupBy("chain_key", "__slice").agg(
            F.percentile_approx("us", at, 10 * CUTS).alias("__cuts")), "chain-cuts")
        inside = F.size(F.filter("__cuts", lambda c: c < F.col("us")))
        sliced = sliced.join(cuts, ["chain_key", "__slice"], "left").withColumn(
            "__sub", F.when(F.col("__cuts").isNull(), 0).otherwise(inside)).drop("__cuts")
        counts = sliced.groupBy("chain_key", "__slice", "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("chain_key").orderBy("__slice", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    packed = counts.select(
        "chain_key", "__slice", "__sub", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / CHUNK_ROWS).alias("chunk"))
    return sliced.join(packed, ["chain_key", "__slice", "__sub"]).drop("__slice", "__sub")


def _map_chunks(df: DataFrame, order, fn, schema: str, rows_per_batch: int = 20_000) -> DataFrame:
    """Apply `fn` (columns to lists of columns) to each (chain_key, chunk) in `order`; small groups share a batch.

    The rows are dealt by a hash of the group: a shuffle by its columns would be left out where a join has made one, and a join
    that becomes a broadcast at run time reads its shuffle in other parts, which tear groups apart.
    """

    def run(batches):
        out: dict = {}
        for piece in _pieces(batches):
            for name, values in fn(piece).items():
                out.setdefault(name, []).extend(values)
            if len(out["chain_key"]) >= rows_per_batch:
                yield pd.DataFrame(out)
                out = {}
        if out:
            yield pd.DataFrame(out)

    spread = df.repartition(F.xxhash64("chain_key", "chunk")).sortWithinPartitions("chain_key", "chunk", *order)
    return spread.mapInPandas(run, schema)


def _carry_state(batches, init, advance, columns):
    """Entry state of every chunk, walking the rows (sorted by key, chunk) with one state in hand."""
    key = state = None
    for pdf in batches:
        rows = []
        for row in pdf.itertuples(index=False):
            if row.chain_key != key:
                key, state = row.chain_key, init
            rows.append((row.chain_key, row.chunk, *state))
            state = advance(state, row)
        yield pd.DataFrame(rows, columns=columns)


def greedy_chain(df: DataFrame, key: str, us: str, ties, reach_us: str, max_reach_seconds: int, strict: bool = False) -> DataFrame:
    """Rows that start a link: the first row of a key, then each first row at (`strict`: after)
    the previous link's reach. `ties` order rows of the same time; one row per time can win.

    A chain enters a chunk within one reach of its first row, which bounds the entry table.
    """
    first = df.groupBy(key, us).agg(F.min(F.struct(*ties, *[c for c in df.columns if c not in (key, us, *ties)])).alias("__r"))
    rows = staged(first.select(
        F.col(key).alias("chain_key"), F.col(us).alias("us"), F.col("__r")[reach_us].alias("reach"), "__r"), "chain-rows")
    slim = staged(_cut(rows.select("chain_key", "us", "reach"), max(SLICE_SECONDS, max_reach_seconds) * SECOND), "chain-chunks")

    def summarise(piece: dict) -> dict:
        times, reach = piece["us"], piece["reach"]
        entries = min(len(times), int(np.searchsorted(times, times[0] + max_reach_seconds * SECOND, side="right")) + 1)
        starts, exits = _distinct_exits(times[:entries], _exit_tables(times, reach, entries, strict))
        return {"chain_key": piece["chain_key"][:1], "chunk": piece["chunk"][:1], "entries": [starts], "exits": [exits]}

    def advance(state, row):
        i = int(_follow(np.asarray(row.entries), np.array([state[0]]), strict)[0])
        return (int(row.exits[i]),) if i < len(row.exits) else state

    key_type = rows.schema["chain_key"].dataType.simpleString()
    tables = _map_chunks(slim, ["us"], summarise, f"chain_key {key_type}, chunk bigint, entries array<bigint>, exits array<bigint>")
    states = tables.repartition("chain_key").sortWithinPartitions("chain_key", "chunk").mapInPandas(
        lambda it: _carry_state(it, (NEVER,), advance, ["chain_key", "chunk", "entry"]), f"chain_key {key_type}, chunk bigint, entry bigint")

    def pick(piece: dict) -> dict:
        times, nxt = piece["us"], _follow(piece["us"], piece["reach"], strict)
        i, links = int(_follow(times, piece["entry"][:1], strict)[0]), []
        while i < len(times):
            links.append(i)
            i = int(nxt[i])
        return {"chain_key": piece["chain_key"][links], "us": times[links]}

    links = _map_chunks(slim.join(states, ["chain_key", "chunk"]), ["us"], pick, f"chain_key {key_type}, us bigint")
    chosen = rows.join(links, ["chain_key", "us"])
    return chosen.select(F.col("chain_key").alias(key), F.col("us").alias(us), "__r.*")


# --- threat score ---------------------------------------------------------------------------


def _clip_after(b, lo, hi, add, low, high):
    """Compose clip(s + add, low, high) after clip(s + b, lo, hi)."""
    return b + add, np.clip(lo + add, low, high), np.clip(hi + add, low, high)


def _decay_steps(later, earlier):
    return (later - earlier) // (DECAY_SECONDS * SECOND)


def _score_table(times, weights):
    """For a decay that falls on each of the first rows: weight up to it, last decay time in the
    chunk, and the score change after it as clip(s + b, lo, hi)."""
    n = len(times)
    total = np.cumsum(weights)
    nxt = np.searchsorted(times, times + DECAY_SECONDS * SECOND, side="right")
    entries = min(n, int(np.searchsorted(times, times[0] + DECAY_SECONDS * SECOND, side="right")) + 1)
    cur = np.arange(entries)
    b, lo, hi = np.zeros(entries, np.int64), np.zeros(entries, np.int64), np.full(entries, MAX_SCORE)
    active = nxt[cur] < n
    while active.any():
        step = np.where(active, np.minimum(nxt[cur], n - 1), cur)
        gain, loss = total[step] - total[cur], _decay_steps(times[step], times[cur])
        nb, nlo, nhi = _clip_after(b, lo, hi, gain - loss, 0, np.maximum(0, MAX_SCORE - loss))
        b, lo, hi = np.where(active, nb, b), np.where(active, nlo, lo), np.where(active, nhi, hi)
        cur = step
        active = nxt[cur] < n
    tail = total[-1] - total[cur]
    b, lo, hi = _clip_after(b, lo, hi, tail, 0, MAX_SCORE)
    return times[:entries], total[:entries], times[cur], b, lo, hi, int(total[-1])


def _advance_score(state, row):
    """State (last decay, score) after a chunk."""
    last, score = state
    entries = np.asarray(row.entries)
    i = 0 if last == NEVER else int(np.searchsorted(entries, last + DECAY_SECONDS * SECOND, side="right"))
    if i >= len(entries):
        return last, min(MAX_SCORE, score + int(row.total))
    at = min(MAX_SCORE, score + int(row.gain[i]))
    if last != NEVER:
        at = max(0, at - int(_decay_steps(int(entries[i]), last)))
    return int(row.last[i]), int(np.clip(at + row.b[i], row.lo[i], row.hi[i]))


def _scores(times, weights, last, score):
    """Score after every event of a chunk, from its entry state."""
    out, i, n = np.empty(len(times), np.int64), 0, len(times)
    while i < n:
        j = i if last == NEVER else int(np.searchsorted(times, last + DECAY_SECONDS * SECOND, side="right"))
        if j > i:
            out[i:j] = np.minimum(MAX_SCORE, score + np.cumsum(weights[i:j]))
            score = int(out[j - 1])
        if j < n:
            score = min(MAX_SCORE, score + int(weights[j]))
            if last != NEVER:
                score = max(0, score - int(_decay_steps(times[j], last)))
            last, out[j] = times[j], score
        i = j + 1
    return out


def threat_scores(
        events: DataFrame, node: str = "node_id", event_id: str = "event_id", slice_seconds: int = SLICE_SECONDS, turn: str | None = None) -> DataFrame:
    """Score after every event: severity weights add up to 100 at most; when over 30 s have
    passed since the last decay, a point is lost for each full 30 s. A node starts at its
    first event. Events of the same time are taken in order of `turn`, where it is given, and id.
    """
    turns = [F.col(turn).alias("turn")] if turn else []
    timed = staged(events.select(
        F.col(node).alias("chain_key"), F.col(event_id).alias("event"), micros(F.col("ts")).alias("us"), *turns,
        severity_weight(F.col("severity")).cast("bigint").alias("weight"),
    ), "score-rows")
    order = ["us", *(["turn"] if turn else []), "event"]
    rows = staged(_cut(timed, slice_seconds * SECOND), "score-chunks")
    key_type = rows.schema["chain_key"].dataType.simpleString()
    id_type = rows.schema["event"].dataType.simpleString()

    def summarise(piece: dict) -> dict:
        entries, gain, last, b, lo, hi, total = _score_table(piece["us"], piece["weight"])
        return {
            "chain_key": piece["chain_key"][:1], "chunk": piece["chunk"][:1], "entries": [entries], "gain": [gain],
            "last": [last], "b": [b], "lo": [lo], "hi": [hi], "total": [total]}

    arrays = ", ".join(f"{c} array<bigint>" for c in ("entries", "gain", "last", "b", "lo", "hi"))
    tables = _map_chunks(rows, order, summarise, f"chain_key {key_type}, chunk bigint, {arrays}, total bigint")
    states = tables.repartition("chain_key").sortWithinPartitions("chain_key", "chunk").mapInPandas(
        lambda it: _carry_state(it, (NEVER, 0), _advance_score, ["chain_key", "chunk", "last", "score"]),
        f"chain_key {key_type}, chunk bigint, last bigint, score bigint")

    def score(piece: dict) -> dict:
        out = _scores(piece["us"], piece["weight"], int(piece["last"][0]), int(piece["score"][0]))
        return {"chain_key": piece["chain_key"], "event": piece["event"], "score": out}

    scored = _map_chunks(rows.join(states, ["chain_key", "chunk"]), order, score, f"chain_key {key_type}, event {id_type}, score bigint")
    return scored.select(F.col("chain_key").alias(node), F.col("event").alias(event_id), F.col("score").alias("threat_score"))


# --- overrides ------------------------------------------------------------------------------


def rule_matches(events: DataFrame, rules, node: str = "node_id") -> DataFrame:
    """A row per (event, rule) whose trigger holds, with the action and its duration."""
    df = events
    windows = sorted({r.window_seconds or DEFAULT_WINDOW for r in rules if r.min_count > 0})
    for w in windows:
        df = trailing_counts(df, [node, "source", "event_type"], w, f"__recent_{w}")
    matched = []
    for number, r in enumerate(rules):
        cond = F.lit(True)
        if r.source:
            cond = cond & (F.col("source") == r.source)
        if r.type:
            cond = cond & (F.col("event_type") == r.type)
        if r.min_severity:
            cond = cond & (severity_weight(F.col("severity")) >= SEVERITY_WEIGHTS[r.min_severity])
        if r.min_count > 0:
            cond = cond & (F.col(f"__recent_{r.window_seconds or DEFAULT_WINDOW}") >= r.min_count)
        level = SENSITIVITY_LEVELS.get(r.params.get("level", 3), "high") if r.action == "elevate_sensitivity" else None
        matched.append(F.when(cond, F.struct(
            F.lit(number).alias("rule_no"), F.lit(r.action).alias("action"), F.lit(r.duration).alias("duration"), F.lit(level).alias("level"))))
    hits = F.array_compact(F.array(*matched))
    return df.withColumn("__m", F.explode_outer(hits)).filter("__m IS NOT NULL").select("*", "__m.*").drop("__m", *[f"__recent_{w}" for w in windows])


def overrides(events: DataFrame, rules, node: str = "node_id", event_id: str = "event_id") -> DataFrame:
    """Overrides in force per node and action: a match fires unless the action is still active."""
    rules = tuple(rules)
    rows = rule_matches(events, rules, node).select(
        F.concat_ws("\x1f", F.col(node).cast("string"), "action").alias("chain"), micros(F.col("ts")).alias("start_us"),
        F.col(event_id).alias("event_id"), "rule_no", (micros(F.col("ts")) + F.col("duration").cast("bigint") * SECOND).alias("end_us"),
        F.col(node).alias("node"), "action", "level", "event_type", "source")
    fired = greedy_chain(rows, "chain", "start_us", ["event_id", "rule_no"], "end_us", max(r.duration for r in rules))
    return fired.select(
        F.col("node").alias(node), "action", "level", "start_us", "end_us",
        F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("expires_at"),
        F.col("event_id").alias("trigger_event_id"), F.concat_ws(":", "source", "event_type").alias("trigger"))


def meta_events(fired: DataFrame, node: str = "node_id") -> DataFrame:
    """The security event each override publishes."""
    kind = F.concat(F.lit("adaptive_"), F.col("action"))
    for action, event_type in ACTION_EVENTS.items():
        kind = F.when(F.col("action") == action, F.lit(event_type)).otherwise(kind)
    reason = F.concat(F.lit("adaptive response: "), F.col("action"), F.lit(" triggered by "), F.col("trigger"))
    return fired.select(
        node, F.col("start").alias("ts"), kind.alias("event_type"), F.lit("info").alias("severity"),
        F.lit("adaptive").alias("source"), reason.alias("reason"))


def active_overrides(messages: DataFrame, fired: DataFrame, keys, message_id: str) -> DataFrame:
    """Add active_overrides (names) and default_action_override to messages by interval join."""
    points = messages.withColumn("__us", micros(F.col("ts")))
    kept = fired.filter(F.col("action").isin("elevate_sensitivity", "elevate_default_deny"))
    joined = interval_join(points, kept.select(*keys, "action", "level", "start_us", "end_us"), keys, "__us", "start_us", "end_us", "inner")
    name = F.when(F.col("action") == "elevate_sensitivity", F.concat(F.lit("sensitivity_override:"), F.coalesce("level", F.lit("high")))).otherwise("default_action_override:deny")
    # At most one override per action holds at a time, so a message has at most two rows here.
    per = joined.groupBy(message_id).agg(
        F.array_sort(F.collect_set(name)).alias("active_overrides"),
        F.max(F.when(F.col("action") == "elevate_default_deny", "deny")).alias("default_action_override"))
    out = messages.join(per, message_id, "left")
    return out.withColumn("active_overrides", F.coalesce("active_overrides", F.array().cast("array<string>")))
