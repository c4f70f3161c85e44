"""Faults that show only when tables grow, brought about on small ones."""

import random

import pytest
from pyspark.sql import functions as F

from agentguard.functions import literals as lit
from agentguard.operators import adaptive as ad, patterntable, policytable
from agentguard.operators.rangetable import range_matches
from agentguard.streaming.ordered_state import TimeFold
from tests.test_live import _Handle, _Store

SECOND = 1_000_000
WEIGHTS = {"low": 2, "medium": 3, "critical": 5}


@pytest.fixture
def late_broadcasts(spark):
    """Joins are planned by a shuffle and become broadcasts at run time, as they do when one side of large tables turns out small."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def fold(rows):
    """(node, id) -> score of rows (node, id, us, severity) in their order."""
    state, want = {}, {}
    for node, number, us, severity in rows:
        last, value = state.get(node, (us, 0))
        value = min(100, value + WEIGHTS[severity])
        if us - last > 30 * SECOND:
            value, last = max(0, value - (us - last) // (30 * SECOND)), us
        state[node] = last, value
        want[node, number] = value
    return want


def test_groups_are_dealt_after_a_join_by_the_same_columns(spark, late_broadcasts):
    """Without a shuffle of its own, the fold would read what the join leaves: where that becomes a broadcast, parts of groups."""
    left = spark.range(100).select((F.col("id") % 5).alias("chain_key"), (F.col("id") % 1).alias("chunk"), F.col("id").alias("us"))
    right = spark.range(5).select(F.col("id").alias("chain_key"), (F.col("id") % 1).alias("chunk"))
    whole = ad._map_chunks(left.join(right, ["chain_key", "chunk"]), ["us"], lambda p: {"chain_key": p["chain_key"][:1]}, "chain_key bigint")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("MapInPandas"):plan.index("SortMergeJoin")]
    assert "REPARTITION_BY_COL" in above
    assert sorted(r[0] for r in whole.collect()) == [0, 1, 2, 3, 4]


def test_scores_of_one_time_in_the_order_of_their_turn(spark):
    rows = [(1, 9 - k, 1000 * SECOND + (k // 5) * 300 * SECOND, ["low", "critical", "medium", "critical", "low"][k % 5]) for k in range(10)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "node_id int, event_id long, us long, severity string, own_us long")
    got = {(r.node_id, r.event_id): r.threat_score for r in ad.threat_scores(df.withColumn("ts", F.timestamp_micros("us")), turn="own_us").collect()}
    assert got == fold(rows)


class _Counted(_Store):
    """State that counts its writes and can be cleared."""

    writes = 0

    def updateValue(self, k, v):  # noqa: N802
        self.writes += 1
        super().updateValue(k, v)

    def clear(self):
        dict.clear(self)


class _Clock:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("count, shuffled, most", [(40, True, 2), (3000, False, 900), (3000, True, 900)])
def test_rows_far_apart_wait_in_few_places_and_come_in_order(count, shuffled, most):
    """A slot and a timer for every row made the folds wait for the store."""
    handle = _Handle()
    handle.stores = {name: _Counted() for name in ("rows", "parts", "fold")}
    fold = TimeFold(["us", "id"], ["bigint", "bigint"], ["key", "id"], "n bigint", lambda s, r: (((s or (0,))[0] + 1,), [(r[1],)]), held_rows=50)
    fold.init(handle)
    rows = [{"us": (k - 30) * 600 * SECOND + k % 3, "id": k} for k in range(count)]
    if shuffled:
        random.Random(1).shuffle(rows)
    list(fold.handleInputRows(("k",), rows, None))
    assert len(handle.timers) == 1
    got = []
    for ms in (-5_000_000, 7_205_000, 600_000 * count):
        clock = _Clock(ms)
        got += [r.id for r in fold.handleExpiredTimer(("k",), clock, clock)]
        assert len(got) == sum(r["us"] < ms // 10_000 * 10_000_000 for r in rows)
    assert got == list(range(count)) and not handle.stores["rows"] and not handle.stores["parts"]
    assert handle.stores["rows"].writes <= 3 * most


def test_ranges_are_not_gathered_on_the_driver(spark):
    ranges = spark.createDataFrame([("10.0.0.0/8",), ("10.1.0.0/16",), ("10.1.0.0/16",), ("2001:db8::/32",), ("none",)], "range string")
    rows = spark.createDataFrame([(1, "10.1.2.3"), (2, "10.2.2.3"), (3, "2001:DB8::1"), (4, "11.0.0.1"), (5, "x"), (6, None)], "id int, ip string")
    out = range_matches(rows, ranges)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.matched for r in out.collect()} == {1: "10.1.0.0/16", 2: "10.0.0.0/8", 3: "2001:db8::/32", 4: None, 5: None, 6: None}


def test_equal_patterns_are_tried_once(spark, monkeypatch):
    """Many policies share a pattern without a literal; every one of them has its hits."""
    rows = [(k, k % 2, [r"\d{3}-\d{4}", "(?i)secret word"][k // 2 % 2]) for k in range(80)]
    known = patterntable.pattern_table(spark.createDataFrame(rows, "pattern_id int, policy_id int, pattern string"), ["policy_id"])
    most, tried = [], patterntable._tried

    def watched(frame, text_id):
        most.append(frame.agg(F.max(F.size("__try"))).first()[0])
        return tried(frame, text_id)

    monkeypatch.setattr(patterntable, "_tried", watched)
    texts = spark.createDataFrame([(1, 0, "call 555-1234"), (2, 1, "a SECRET word 555-1234"), (3, 0, None), (4, 2, "555-1234")], "doc_id int, policy_id int, text string")
    hits = patterntable.pattern_hits(texts, known, ["policy_id"], "doc_id", "text").join(known.select("pattern_no", "pattern_id"), "pattern_no")
    want = {(1, k) for k, p, x in rows if p == 0 and x.startswith(r"\d")} | {(2, k) for k, p, _ in rows if p == 1}
    assert {(r.doc_id, r.pattern_id) for r in hits.collect()} == want and hits.count() == len(want)
    assert most == [1, 1]


def test_entries_of_policies_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Entries that one task makes of a small table were sorted by that task, those of policies that no request names too."""
    entries = [(k, "default_action", None, "allow", 0) for k in range(300)] + [(k, "arg_filter", "t", f"word{k % 3}", k % 2) for k in range(300)]
    rows = spark.createDataFrame(entries, "policy_id int, field string, subject string, value string, position int").coalesce(1)
    sent = spark.createDataFrame([(1, 7, "a word1"), (2, 7, "a word2"), (3, 900, "x"), (4, None, "x"), (5, 299, None)], "msg_id int, policy_id int, args string").selectExpr(
        "*", "'t' AS method", "'{}' AS raw", "'' AS url", "'a' AS agent", "'c' AS channel")
    seen, made = [], policytable.pattern_table
    monkeypatch.setattr(policytable, "pattern_table", lambda filters, keys: seen.append(filters) or made(filters, keys))
    got = {r.msg_id: (r.decision, r.reason) for r in policytable.evaluate_rows(sent, rows).collect()}
    unknown = ("deny", "unknown policy")
    assert got == {1: ("deny", "sensitive data detected in arguments"), 2: ("allow", "default allowed"), 3: unknown, 4: unknown, 5: ("allow", "default allowed")}
    assert sorted(r.policy_id for r in seen[0].collect()) == [7, 299]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.rindex("== Initial Plan ==") if "== Initial Plan ==" in plan else 0:]
    assert plan.rindex("Aggregate(") < plan.index("REPARTITION_BY_COL")


def test_policies_of_scalars_and_lists_are_dealt_before_they_are_grouped(spark):
    rows = spark.createDataFrame([(k, "scalar", "default_action", "allow") for k in range(300)], "policy_id int, kind string, field string, value string").coalesce(1)
    sent = spark.createDataFrame([(1, 7), (2, 900), (3, None)], "msg_id int, policy_id int").selectExpr("*", "'t' AS method", "'{}' AS raw")
    out = policytable.evaluate_by_table(sent, rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Aggregate(") < plan.index("REPARTITION_BY_COL")
    assert {r.msg_id: r.reason for r in out.collect()} == {1: "default allowed", 2: "unknown policy", 3: "unknown policy"}


def test_only_what_re2_finds_is_tried_again(spark, monkeypatch):
    """A text that shares a trigram with a pattern was tried on it: with many of both, on nearly all pairs."""
    texts = spark.createDataFrame([(k, k % 2, f"abcd bcde tion and tion w{k}x") for k in range(40)] + [(40, 0, "ABCDE 5-12"), (41, None, "abcde"), (None, 0, "abcde"), (42, 0, None)], "id int, owner int, text string")
    given = [(0, "abcde"), (1, "abcde"), (0, r"(?i)tion\s+tion"), (0, "(?i)abcd(e|f)"), (1, "w1x|w3x"), (0, "bcd.{0,1000}tion"), (None, "abcd"), (0, r"\d-\d")]
    known = patterntable.pattern_table(spark.createDataFrame([(n, *x) for n, x in enumerate(given)], "no int, owner int, pattern string"), ["owner"])
    pairs, tried = [], patterntable._tried
    monkeypatch.setattr(patterntable, "_tried", lambda frame, text_id: pairs.append(frame.agg(F.sum(F.size("__try"))).first()[0]) or tried(frame, text_id))
    want = sorted([(40, 3), (1, 4), (3, 4), (40, 7)] + [(k, 5) for k in range(0, 40, 2)])
    for sizes in ((3 << 20, 20_000), (200, 2)):
        for name, value in zip(("LOT_BYTES", "LOT_PATTERNS"), sizes, strict=True):
            monkeypatch.setattr(patterntable, name, value, raising=False)
        hits = patterntable.pattern_hits(texts, known, ["owner"], "id", "text").join(known.select("pattern_no", "no"), "pattern_no")
        assert sorted((r.id, r.no) for r in hits.collect()) == want
    assert pairs == [23, 22, 23, 22]
    hits = patterntable.pattern_hits(texts, known, [], "id", "text").join(known.select("pattern_no", "no"), "pattern_no")
    assert {r.id for r in hits.where("no = 1").collect()} == {41} and hits.where("no = 6").count() == 41


def test_literals_are_found_in_many_texts_at_once():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcAſK\0é ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "abc", "xabcabcabcabc"]
    literals = {lit.fold("".join(rng.choice("abcsk ") for _ in range(rng.choice([3, 3, 4, 8, 9, 12])))) for _ in range(200)} | {"abcabcabcabc", "abcabcabcabcab", "abc", "bca", "cab"}
    held = lit.Holders([x.encode() for x in texts], literals)
    assert all(held.of(x).tolist() == [x in lit.fold(t) for t in texts] for x in literals) and held.of("abcabcabcabc").sum() >= 1
    assert held.of_all([["abc", "bca"], ["cab"]]).tolist() == [("abc" in t or "bca" in t) and "cab" in t for t in map(lit.fold, texts)]
    assert lit.Holders([], literals).of("abc").tolist() == [] and lit.Holders([b"\xffabc"], {"abc"}).of("abc").tolist() == [True]
