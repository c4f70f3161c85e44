"""Tables of patterns, domains and ranges, leaks, and the ordered operators on one hot key, against plain versions."""

import ipaddress
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentguard.functions.literals import fold, required_clauses
from agentguard.operators import fleet, leaks, ordered, policytable
from agentguard.operators.domaintable import with_matched_domain
from agentguard.operators.patterntable import pattern_hits, pattern_table
from agentguard.operators.rangetable import range_matches


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


# --- patterns -------------------------------------------------------------------------------


@pytest.mark.parametrize(("pattern", "clauses"), [
    ("abcd", [["abcd"]]), ("ab?cde", [["cde"]]), ("abc+def", [["abc"], ["cdef"]]), ("(?i)API_key\\s*=", [["api_key"]]), ("ab", []), ("a.*b", []),
    ("(password|token|pin) is", [["password", "pin", "token"], [" is"]]), ("(password|pw) is it", [[" is it"]]), ("(abc)?def", [["def"]]), ("x{3}yz", [["xxxyz"]]),
    ("x{5}yz", [["xxx"], ["xxxyz"]]), ("x{0,2}yzw", [["yzw"]]), ("abc|xyz", [["abc", "xyz"]]), ("abc|x", []), (r"\bfoo\.bar\b", [["foo.bar"]]), (r"foo\d+bar[a-z]baz", [["foo"], ["bar"], ["baz"]]),
    (r"\Qa.b(c\Ed", [["a.b("]]), (r"\Qa.b(c\E?d", []), (r"[]abc]def", [["def"]]), (r"(?:abc(?i:DEF))ghi", [["abc"], ["def"], ["ghi"]]), (r"é-long", [["-long"]]), ("[[:alpha:]]end", [["end"]]), (r"\p{Greek}abc", [["abc"]])])
def test_required_clauses(pattern, clauses):
    assert required_clauses(pattern) == clauses


def test_every_match_holds_a_literal_of_each_clause():
    rng = random.Random(8)
    parts = ["abc", "de", "x", "(abc|bcd)", "(ab|c)", "[a-c]", "b+", "c?", "d*", "a{2}", "a{1,3}", "(bca)*", "(cab)+", ".", "\\b", "(?i:BcD)"]
    matches = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
        text = "".join(rng.choice("abcdexBCD ") for _ in range(30))
        for m in re.finditer(pattern, text):
            matches += 1
            for clause in required_clauses(pattern):
                assert any(x in fold(m.group()) for x in clause), (pattern, m.group(), clause)
    assert matches > 1000


PATTERNS = [
    (1, "a", r"(?i)secret[_ ]key"), (2, "a", r"\d{4}"), (3, "a", r"(alpha|beta)\s+gamma"), (4, "b", r"secret"), (5, "b", r"^[^x]{3}y"), (6, "a", r"(?i)straße"),
    (7, "a", r"(?i)ask"), (8, "a", r"(?=x)"), (9, "a", None), (10, None, "secret")]
TEXTS = [
    (1, "a", "my SECRET_KEY is 1234"), (2, "b", "a secret"), (3, "a", "beta  gamma"), (4, "a", None), (5, "b", "abcy"), (6, "a", "STRAßE, aſK"), (7, None, "secret"),
    (8, "c", "secret"), (9, "a", ""), (10, "a", "beta gamma 2024 secret key " * 500)]


def test_patterns_are_found_by_key(spark):
    rows = spark.createDataFrame(PATTERNS, "no int, owner string, pattern string")
    texts = spark.createDataFrame(TEXTS, "id int, owner string, text string")
    known = pattern_table(rows, ["owner"])
    assert {r.no for r in known.where("problem IS NOT NULL").collect()} == {8, 9}
    found = pattern_hits(texts, known, ["owner"], "id", "text").join(known, "pattern_no").select("id", "no")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (2, 4), (3, 3), (5, 5), (6, 6), (6, 7), (10, 1), (10, 2), (10, 3)]


def test_plan_does_not_grow_with_patterns(spark):
    texts = spark.createDataFrame([(k, "a", f"text w{k}w and more") for k in range(50)] + [(99, "b", "w1w more")], "id int, owner string, text string")
    sizes = []
    for n in (3, 600):
        rows = spark.createDataFrame([("a", f"w{k}w[a-z ]+more") for k in range(n)], "owner string, pattern string")
        hits = pattern_hits(texts, pattern_table(rows, ["owner"]), ["owner"], "id", "text")
        assert hits.count() == min(n, 50)
        text = re.sub(r"#\d+L?|[0-9a-f]{8,}|\d+", "", plan(hits))
        assert "w[a-z" not in text and "NestedLoop" not in text and "CartesianProduct" not in text
        sizes.append(len(text))
    assert abs(sizes[0] - sizes[1]) < 0.02 * sizes[0]


def test_a_filter_that_is_no_pattern_denies(spark):
    rows = spark.createDataFrame(
        [(1, "default_action", None, "allow", 0), (1, "arg_filter", "t", "(unclosed", 0), (2, "default_action", None, "allow", 0), (2, "arg_filter", "t", "fine", 0), (2, "arg_filter", "t", "other", 1)],
        "policy_id int, field string, subject string, value string, position int")
    sent = spark.createDataFrame(
        [(k, p, t, x) for k, (p, t, x) in enumerate([(1, "t", "x"), (1, "u", "x"), (2, "t", "all fine"), (2, "t", "an other"), (3, "t", "x"), (2, "web.get", "x")])],
        "msg_id int, policy_id int, method string, args string").selectExpr("*", "args AS raw", "'' AS url", "'a' AS agent", "'c' AS channel")
    got = {r.msg_id: (r.decision, r.reason, r.agent_allowed) for r in policytable.evaluate_rows(sent, rows).collect()}
    assert got[0][0] == "deny" and got[0][1].startswith("invalid argument filter") and got[1] == ("allow", "default allowed", True)
    assert got[2][0] == "allow" and got[3][1] == "sensitive data detected in arguments" and got[4] == ("deny", "unknown policy", False) and got[5][0] == "allow"


# --- domains and ranges -----------------------------------------------------------------------


def test_domains_against_all_pairs(spark):
    rng = random.Random(3)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    hosts = [(k, rng.randrange(3), name()) for k in range(300)] + [(300, 1, None), (301, 1, ""), (302, 1, "a."), (303, None, "a")]
    patterns = [(rng.randrange(3), rng.choice(["", "*."]) + name()) for _ in range(60)] + [(1, "*."), (2, None), (None, "a")]
    df = spark.createDataFrame(hosts, "id int, policy int, host string")
    out = with_matched_domain(df, spark.createDataFrame(patterns, "policy int, pattern string"), ["policy"])
    for r in out.collect():
        fits = [p for o, p in patterns if o == r.policy and o is not None and p is not None and r.host is not None and (
            r.host == p or p.startswith("*.") and (r.host == p[2:] or r.host.endswith(p[1:])))]
        want = max(fits, key=lambda p: (not p.startswith("*."), len(p)), default=None)
        assert r.matched == want, r
    assert "NestedLoop" not in plan(out) and "CartesianProduct" not in plan(out) and out.count() == len(hosts)


def test_longest_of_a_hundred_thousand_ranges(spark):
    rng = random.Random(4)
    ranges = [f"{ipaddress.IPv4Address(rng.getrandbits(32))}/{rng.randint(6, 32)}" for _ in range(50_000)]
    ranges += [f"{ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.getrandbits(20) << 76) + rng.getrandbits(64))}/{rng.randint(30, 128)}" for _ in range(50_000)]
    ranges += ["10.1.2.3", "::1", "::/0", "0.0.0.0/0", "bad", "1.2.3.4/33", "1.2.3.4/x", None, "fe80::/10"]
    addresses = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(150)] + ["10.1.2.3", "::ffff:10.1.2.3", "::1", "nothing", None, "fe80::1", "FEBF::2"]
    addresses += [str(ipaddress.IPv6Address((0x20010DB8 << 96) + (rng.getrandbits(20) << 76) + rng.getrandbits(64))) for _ in range(150)]
    known = spark.createDataFrame([(r,) for r in ranges], "range string")
    out = range_matches(spark.createDataFrame([(a,) for a in addresses], "ip string"), known)
    assert "NestedLoop" not in plan(out) and "CartesianProduct" not in plan(out)

    def bits(a, n=None):
        ip = ipaddress.ip_address(a)
        return (int(ip), n if n is not None else 128) if ip.version == 6 else ((0xFFFF << 32) + int(ip), 96 + (32 if n is None else n))

    table = {}
    for r in ranges:
        try:
            base, _, n = (r or "").partition("/")
            value, length = bits(base, int(n) if n else None)
        except ValueError:
            continue
        if length <= 128 and not ("." in base and length > 128):
            key = (length, value >> (128 - length))
            table[key] = min(table.get(key, r), r)
    for r in out.collect():
        want = None
        try:
            value, _ = bits(r.ip)
            want = next((table[n, value >> (128 - n)] for n in range(128, -1, -1) if (n, value >> (128 - n)) in table), None)
        except (ValueError, TypeError):
            pass
        assert r.matched == want, (r, want)


# --- ordered operators --------------------------------------------------------------------------


def test_a_year_makes_few_cells(spark):
    year, start = 365 * 86_400_000_000, 1_700_000_000_123_457
    rows = spark.createDataFrame([(start, start + year), (5, 6), (7, 7), (9, 8), (-3, 4), (0, 1 << 62)], "s long, e long")
    cells = rows.withColumn("c", ordered.cells_of(F.col("s"), F.col("e"))).collect()
    assert len(cells[0].c) < 120 and len(cells[5].c) < 150
    for r in cells[:1] + cells[4:5]:
        spans = sorted((c.cell << (20 + 2 * c.level), (c.cell + 1) << (20 + 2 * c.level)) for c in r.c)
        assert spans[0][0] <= r.s and spans[-1][1] >= r.e and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_interval_join_against_all_pairs(spark, how):
    rng = random.Random(6)
    intervals = []
    for k in range(150):
        s = rng.randrange(10**13)
        intervals.append((rng.randrange(2), s, s + rng.choice([0, 1, 10**3, 10**7, 10**12, 10**13]), k))
    points = [(rng.randrange(3), rng.choice([rng.randrange(10**13), intervals[rng.randrange(150)][1], intervals[rng.randrange(150)][2]]), k) for k in range(300)]
    points += [points[0], (None, 5, 1000)]
    out = ordered.interval_join(
        spark.createDataFrame(points, "key int, us long, id int"), spark.createDataFrame(intervals, "key int, s long, e long, no int"), ["key"], "us", "s", "e", how)
    got = sorted((r.id, -1 if r.no is None else r.no) for r in out.collect())
    want = []
    for key, us, i in points:
        met = [no for k, s, e, no in intervals if k == key and s <= us < e]
        want += [(i, no) for no in met] or ([(i, -1)] if how == "left" else [])
    assert got == sorted(want)


def test_trailing_count_of_one_key_in_one_second(spark, monkeypatch):
    """All rows in one second of one key: many pieces, none of them large, and exact counts."""
    monkeypatch.setattr(ordered, "PIECE_ROWS", 20_000)
    n, window = 200_000, 1_000
    times = np.sort(np.random.default_rng(1).integers(0, 1_000_000, n))
    df = spark.createDataFrame([(int(t), k) for k, t in enumerate(times)], "us long, id long").withColumn("key", F.lit("hot"))
    got = {r.id: r.c for r in ordered.trailing_count(df, ["key"], "us", window, "c").collect()}
    want = np.searchsorted(times, times, "right") - np.searchsorted(times, times - window, "right")
    assert [got[k] for k in range(n)] == want.tolist()
    pieces = ordered.in_pieces(df.select("key", "us").distinct(), ["key", "us"], "test")
    sizes = [r["count"] for r in pieces.groupBy("__piece").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 60_000


@pytest.mark.parametrize("rows", [7, 100_000])
def test_counts_sums_and_intervals_across_pieces(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "PIECE_ROWS", rows)
    rng = random.Random(rows)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(40) * 10, k) for k in range(120)] + [("a", None, 500)]
    df = spark.createDataFrame(data, "key string, us long, id int")
    for strict in (True, False):
        got = {r.id: r.c for r in ordered.trailing_count(df, ["key"], "us", 50, "c", strict).collect()}
        for key, us, k in data:
            want = None if us is None else sum(x == key and t is not None and (us - 50 < t or not strict and us - 50 == t) and t <= us for x, t, _ in data)
            assert got[k] == want
    real = df.where("us IS NOT NULL")
    sums = {r.id: r.s for r in ordered.running_sum(real.withColumn("w", F.col("id").cast("long")), ["key"], "us", ["id"], "w", "s").collect()}
    for key, us, k in data[:-1]:
        assert sums[k] == sum(i for x, t, i in data[:-1] if x == key and (t, i) <= (us, k))
    spans = [(key, us, us + rng.choice([0, 5, 10, 30]), k) for key, us, k in data[:-1]]
    if rows == 7:
        spans.append(("b", -100, 10_000, 900))
    got = {(r.key, r.start_us, r.end_us, r.merged) for r in ordered.merge_intervals(spark.createDataFrame(spans, "key string, s long, e long, id int"), ["key"], "s", "e").collect()}
    want = set()
    for key in ("a", "b", None):
        merged = []
        for s, e in sorted((s, e) for x, s, e, _ in spans if x == key):
            if merged and s <= merged[-1][1]:
                merged[-1] = [merged[-1][0], max(merged[-1][1], e), merged[-1][2] + 1]
            else:
                merged.append([s, e, 1])
        want |= {(key, *m) for m in merged}
    assert got == want


# --- leaks and versions -------------------------------------------------------------------------


def test_leaks_against_containment(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    issued = [(word(rng.randint(1, 5)), rng.choice("xyz")) for _ in range(40)] + [("", "x"), (None, "y"), ("aa", "x"), ("aa", "x")]
    bodies = [(word(rng.randint(0, 40)), rng.choice("xyz")) for _ in range(60)] + [(None, "x"), ("aaaa", "y"), ("aaaa", "y"), ("z" * 100_000 + "aa", "z")]
    got = {(r.leaked_by, r.issued_to): r.leaks for r in leaks.canary_leaks(
        spark.createDataFrame(issued, "token string, tool string"), spark.createDataFrame(bodies, "body string, tool string")).collect()}
    want = {}
    for body, by in bodies:
        for token, to in issued:
            if token and body and token in body and by != to:
                want[by, to] = want.get((by, to), 0) + 1
    assert got == want


def test_a_refused_publication_moves_nothing(spark):
    rows = [("v1", 1, "approved", 1), ("v1", 2, "published", 2), ("v2", 3, "published", 3), ("v2", 4, "approved", 4), ("v3", 5, "rejected", 5), ("v3", 6, "published", 6)]
    df = spark.createDataFrame(rows, "version_id string, event_id int, status string, ts int").withColumn("group_id", F.lit(1))
    assert [tuple(r) for r in fleet.current_versions(df).collect()] == [(1, "v1")]
