"""Ordered live operators: results of the batch twins, bounded and ending state, rows out of turn."""

import random

import pytest
from pyspark.sql import functions as F

from agentguard.operators.adaptive import AdaptiveRule
from agentguard.streaming import processors as live
from agentguard.streaming.ordered_state import SequenceFold, TimeFold

SECOND = 1_000_000


def run(stream, tmp_path, name):
    """Run to the end of the input; the query, and the rows it wrote."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-c").option("path", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query, stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp_path}/{name}").collect()


def feed(spark, tmp_path, batches, schema, name="in"):
    """One file, and so one micro-batch, for each list of rows."""
    folder = tmp_path / name
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("ts", F.timestamp_micros("us"))


def state_rows(query) -> list[int]:
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


EVENTS = "node_id int, event_id long, us long, source string, event_type string, severity string"
#: A row so late that the watermark passes all others.
END = (-1, -1, 4_000_000_000 * SECOND, "", "", "low")


@pytest.fixture(scope="module")
def hot():
    """A node with most events, over many batches; each batch in no order."""
    rng = random.Random(2)
    rows, us = [], 1_700_000_000 * SECOND
    for k in range(900):
        us += rng.choice([0, 0, SECOND // 7, SECOND, 40 * SECOND])
        rows.append((1 if rng.random() < 0.9 else rng.randrange(2, 5), k, us, "proxy", rng.choice(["a", "b"]), rng.choice(["low", "medium", "critical"])))
    batches = [rows[k:k + 100] for k in range(0, 900, 100)]
    for b in batches:
        rng.shuffle(b)
    # More batches, as the watermark moves between them, and a state that has ended leaves with the one after.
    return rows, [*batches, [END], [END], [END]]


def test_scores_of_a_hot_node(spark, hot, tmp_path):
    rows, batches = hot
    query, got = run(live.stream_threat_scores(feed(spark, tmp_path, batches, EVENTS)), tmp_path, "scores")
    weights = {"low": 2, "medium": 3, "critical": 5}
    want, state = {}, {}
    for node, number, us, _, _, severity in rows:
        last, value = state.get(node, (None, 0))
        value = min(100, value + weights[severity])
        if last is None:
            last = us
        elif us - last > 30 * SECOND:
            value, last = max(0, value - (us - last) // (30 * SECOND)), us
        state[node] = last, value
        want[number] = value
    assert {r.event_id: r.threat_score for r in got} == want
    # All that waited has left: two numbers a node stay, and the closing row.
    assert state_rows(query)[-1] <= 2 * len(state) + 8 < max(state_rows(query))


def test_trailing_counts_end_their_state(spark, hot, tmp_path):
    rows, batches = hot
    query, got = run(live.stream_trailing_counts(feed(spark, tmp_path, batches, EVENTS), ["node_id", "event_type"], 60), tmp_path, "counts")
    want = {n: sum(x[0] == node and x[4] == kind and us - 60 * SECOND < x[2] and (x[2], x[1]) <= (us, n) for x in rows) for node, n, us, _, kind, _ in rows}
    assert {r.event_id: r.recent for r in got} == want
    assert state_rows(query)[-1] <= 5 < max(state_rows(query))  # only the closing rows wait: windows that have passed left the store
    capped = run(live.stream_trailing_counts(feed(spark, tmp_path, batches, EVENTS, "again"), ["node_id", "event_type"], 60, most=3), tmp_path, "capped")[1]
    assert {r.event_id: r.recent for r in capped} == {n: min(3, c) for n, c in want.items()}


def test_overrides_end_their_state(spark, hot, tmp_path):
    rows, batches = hot
    rules = [AdaptiveRule("elevate_default_deny", source="proxy", type="a", min_count=4, window_seconds=30, params={"duration_seconds": 90}),
             AdaptiveRule("elevate_sensitivity", source="proxy", type="b", min_severity="critical", params={"duration_seconds": 45})]
    query, got = run(live.stream_overrides(feed(spark, tmp_path, batches, EVENTS), rules), tmp_path, "overrides")
    want, active = set(), {}
    for node, n, us, _, kind, severity in rows:
        recent = sum(x[0] == node and x[4] == "a" and us - 30 * SECOND < x[2] and (x[2], x[1]) <= (us, n) for x in rows)
        for action, fires, length in (("elevate_default_deny", kind == "a" and recent >= 4, 90), ("elevate_sensitivity", kind == "b" and severity == "critical", 45)):
            if fires and us >= active.get((node, action), us):
                active[node, action] = us + length * SECOND
                want.add((node, action, us, us + length * SECOND, n))
    assert {tuple(r) for r in got} == want and want
    assert state_rows(query)[-1] <= 5 < max(state_rows(query))


def test_rows_behind_the_watermark_are_taken_when_they_come(spark, tmp_path):
    us = 1_700_000_000 * SECOND
    batches = [[(1, 1, us, "", "", "low")], [(1, 2, us + 7200 * SECOND, "", "", "medium")], [(1, 3, us + SECOND, "", "", "critical")], [END], [END]]
    _, got = run(live.stream_trailing_counts(feed(spark, tmp_path, batches, EVENTS), ["node_id"], 60), tmp_path, "late")
    assert {(r.event_id, r.recent) for r in got} == {(1, 1), (2, 1), (3, 2)}


def test_chunks_out_of_turn(spark, tmp_path):
    """A long stream whose chunks come in no order within and across batches; it ends, and leaves nothing behind."""
    rng = random.Random(4)
    text = {s: [("é" if rng.random() < 0.3 else "x") * rng.randrange(1, 90) for _ in range(n)] for s, n in ((1, 300), (2, 5), (3, 1))}
    chunks = [(s, k, t, k == len(parts) - 1) for s, parts in text.items() for k, t in enumerate(parts)]
    rng.shuffle(chunks)
    schema = "stream_id int, seq int, text string, final boolean"
    for k in range(0, len(chunks), 80):
        spark.createDataFrame(chunks[k:k + 80], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query, got = run(live.stream_overlap(stream, last="final"), tmp_path, "carry")
    assert len(got) == len(chunks) and state_rows(query)[-1] == 0 and max(state_rows(query)) > 3
    for r in got:
        assert r.carry == live._tail("".join(text[r.stream_id][:r.seq])) and r.text == text[r.stream_id][r.seq]


class _Store(dict):
    """Map or value state without Spark."""

    def containsKey(self, k):  # noqa: N802
        return k in self

    def getValue(self, k):  # noqa: N802
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        del self[k]

    def exists(self):
        return "v" in self

    def get(self):
        return self["v"]

    def update(self, v):
        self["v"] = v


class _Handle:
    def __init__(self):
        self.timers, self.stores = [], {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.stores.setdefault(name, _Store())

    getValueState = getMapState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_folds_hold_no_more_than_their_bound():
    """Rows of one key are taken one by one: what waits is put away before more than `held_rows` are in memory."""
    held = []

    class Watched(_Store):
        def updateValue(self, k, v):  # noqa: N802
            if len(k) == 2:
                held.append(len(v[0]))
            super().updateValue(k, v)

    handle = _Handle()
    handle.stores["rows"] = Watched()
    fold = TimeFold(["us", "id"], ["bigint", "bigint"], ["key", "id"], "n bigint", lambda s, r: (((s or (0,))[0] + 1,), [(r[1],)]), held_rows=10)
    fold.init(handle)
    list(fold.handleInputRows(("k",), ({"us": 5, "id": k} for k in range(1000)), None))
    assert max(held) == 10 and len(held) == 100 and len(handle.timers) == 1
    handle.stores["rows"] = Watched()
    chunks = SequenceFold(["seq", "last"], ["bigint", "boolean"], ["key", "seq"], "n bigint", lambda s, r: ((1,), [(r[0],)]), held_rows=10)
    handle.stores.pop("parts")
    chunks.init(handle)
    out = [r.seq for r in chunks.handleInputRows(("k",), ({"seq": k, "last": k == 99} for k in range(99, -1, -1)), None)]
    assert out == list(range(100)) and not handle.stores["rows"] and not handle.stores["parts"]
