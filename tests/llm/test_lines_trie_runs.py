"""Line dedup, the conversation trie and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentguard.llm import line_dedup as ld
from agentguard.llm import periodic_runs as pr
from agentguard.llm import prefix_trie as pt
from agentguard.llm.grammar import both_ways, recompress

BLANK = " \t\n\x0b\x0c\r"


# --- lines ------------------------------------------------------------------------------------


def plain_lines(rows, least=10):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(BLANK))
    order = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(low(line), set()).add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(low(x)) < least or len(holders[low(x)]) < 2 or min(holders[low(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(df):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()], key=str)


LINES = [
    (5, "A line of some length\nshort\nA line of some length\n\n"), (3, " a LINE of some length\x0b\r\nshort\nown words of this one"),
    (9, None), (8, ""), (7, "\n"), (6, "Äline of sömé length\nälineof s\n ÄLINE OF SÖMÉ LENGTH"), (4, "äline of sömé length"),
    (None, "a line of some length\nonly without an id, twice"), (None, "only without an id, twice"), (2, "twice the same id, the same line\nx"),
    (2, "twice the same id, the same line"), (11, "0123456789\n012345678"), (12, "0123456789\n012345678"), (13, "　wide blank line ok"), (14, "wide blank line ok")]


def test_lines_on_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + LINES
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, address string, at int")
    assert line_rows(ld.drop_repeated_lines(df)) == plain_lines(rows)
    assert ld.drop_repeated_lines(none).count() == 0


def test_lines_in_many_shards_and_cells(spark, monkeypatch):
    """Small shards, and a line in every row, dealt to many cells."""
    monkeypatch.setattr(ld, "SHARD_KEYS", 8)
    monkeypatch.setattr(ld, "CELL_PROBES", 16)
    rng = random.Random(5)
    rows = [(k, "\n".join(["The same line in all rows", *(f"line number {rng.randrange(200)}" for _ in range(rng.randrange(8)))])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ld.drop_repeated_lines(df)
    assert line_rows(found) == plain_lines(rows)
    assert found.agg(F.max("most_held")).first()[0] == 150


def test_lines_with_text_ids_and_a_very_long_text(spark):
    rows = [("b", "\n".join(f"this is line {k}" for k in range(20_000))), ("a", "\n".join(f"this is line {k}" for k in range(0, 20_000, 3))), ("c", "y" * 2_000_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: (r.n_lines, r.n_dropped, len(r.kept)) for r in ld.drop_repeated_lines(df).collect()} == {
        "a": (6667, 0, len(rows[1][1])), "b": (20_000, 6667, len(rows[0][1]) - len(rows[1][1]) - 1), "c": (1, 0, 2_000_000)}


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        if n > 2:
            a[: n // 2] = a[0]  # equal in one half of the key
        made = ld.PerfectHash.build(a, b)
        again = ld.PerfectHash.unpacked(made.sizes, made.packed())
        assert sorted(again.slots(a, b).tolist()) == list(range(n))
        assert len(made.bits) <= 4 * n + 4096


# --- trie -------------------------------------------------------------------------------------


def plain_trie(rows):
    """Nodes by brute force over (conv, turn, role, text), conversations as in the query."""
    talks = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(c, []).append((role or "", text or ""))
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = talks.get(int(c - np.fmod(c, 5)), []) if c is not None else []
        rebuilt[c] = tuple(base[:h]) + tuple(own[h:])
    return plain_nodes(list(rebuilt.items()), lambda t: len(t[1].encode()))


def plain_nodes(sequences, size):
    members, ends = {}, {}
    for c, s in sequences:
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    first = {k: min((c for c in m if c is not None), default=None) for k, m in members.items()}
    kids = Counter(x[:-1] for x in members if x)
    out = []
    for k, m in members.items():
        below = [x for x in members if x[: len(k)] == k]
        listed = ",".join(map(str, sorted(c for c in ends.get(k, []) if c is not None)))
        out.append((first[k], len(k), first[k[:-1]] if k else None, len(m), kids[k], sum(not kids[x] for x in below),
                    sum((len(members[x]) - 1) * size(x[-1]) for x in below if x), hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


TALKS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "hé"), (0, 2, "user", "bye"), (1, 0, "user", "hi"), (1, None, None, None), (1, 1, "assistant", "no"),
    (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 0, "user", "ha"), (5, 3, "user", ""), (6, 1, "user", "hi"), (7, 0, "user", "hi"), (7, 1, "assistant", "hé"),
    (None, 0, "user", "hi"), (None, 1, "assistant", "hé"), (-3, 0, "user", "hi"), (11, 0, "", "x"), (12, 0, None, "x"), (23, 4, "user", "hi")]


def talk_query(df):
    return pt.trie_digest(pt.with_common_starts(pt.encode_turns(df)))


@pytest.mark.parametrize("turns", [1, 3, 100_000])
def test_trie_on_odd_rows(spark, monkeypatch, turns):
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    monkeypatch.setattr(pt, "ENDS_AT_ONCE", 2)
    df = spark.createDataFrame([(*r, "x", 1) for r in TALKS], "conv_id long, turn long, role string, text string, key string, code int")
    assert trie_rows(talk_query(df)) == plain_trie(TALKS)
    assert talk_query(df.limit(0)).count() == 0


@pytest.mark.parametrize("turns", [40, 300])
def test_trie_over_many_shards(spark, monkeypatch, turns):
    """A common first turn, one conversation repeated very often, empty ones, and prefixes that end at shard borders."""
    monkeypatch.setattr(pt, "SHARD_TURNS", turns)
    monkeypatch.setattr(pt, "ENDS_AT_ONCE", 7)
    rng = random.Random(turns)
    sequences = [(k, tuple([1] + [rng.randrange(3) for _ in range(rng.randrange(7))]) if rng.random() < 0.8 else tuple(rng.randrange(4) for _ in range(rng.randrange(3)))) for k in range(250)]
    sequences += [(1000 + k, (1, 2, 0, 1)) for k in range(120)] + [(2000 + k, ()) for k in range(30)]
    rng.shuffle(sequences)
    df = spark.createDataFrame([(c, list(s), [x + 2 for x in s]) for c, s in sequences], "conv long, codes array<long>, sizes array<long>")
    assert trie_rows(pt.trie_digest(df)) == plain_nodes(sequences, lambda x: x + 2)


def test_tree_is_balanced_and_walks_without_recursion():
    found = [(np.array([k]), np.array([1]), 1, k) for k in range(1023)]
    tree = pt.build_tree(found)
    heights = [0] * len(tree.code)
    for links in zip(tree.lower, tree.higher, strict=True):
        assert all(x == -1 or x > 0 for x in links)
    stack = [(tree.below[0], 1)]
    while stack:
        at, height = stack.pop()
        heights[at] = height
        stack += [(x, height + 1) for x in (tree.lower[at], tree.higher[at]) if x >= 0]
    assert max(heights) == 10
    deep = pt.build_tree([(np.arange(50_000), np.ones(50_000, dtype=int), 2, 1)])
    rows = list(pt.shard_rows(0, deep, [], list(range(50_000))))
    assert len(rows) == 50_001


# --- runs -------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in dropped)).hexdigest())


def run_rows(df):
    return sorted([tuple(r) for r in pr.run_digest(pr.find_runs(pr.with_repeated_ends(df))).collect()], key=str)


def test_runs_on_odd_rows(spark, odd, none):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, "la " * 12), (None, "la " * 11), (20, "a b c " * 4), (20, "a b a b " * 6), (21, "A a " * 6)]
    rows += [(100 + k, " ".join(str(rng.randrange(1 + k % 4)) for _ in range(k))) for k in range(80)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, g int")
    assert run_rows(df) == sorted([plain_row(i, t) for i, t in rows], key=str)
    assert run_rows(none) == []


def test_runs_on_given_rows(spark, given):
    rows = [(r.doc_id, r.text) for r in given.collect() if len((r.text or "").split()) < 700]
    assert len(rows) > 100
    df = given.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id")
    assert run_rows(df) == sorted([plain_row(i, t) for i, t in rows], key=str)


def test_runs_of_one_very_long_text():
    words = [b"%d" % (k * k % 1009) for k in range(100_000)]
    found = [tuple(r) for r in pr.runs_of([words, [b"x"] * 50_000])[0].tolist()]
    assert found == [(0, 100_000, 1009)]


def test_extensions_against_comparison():
    rng = np.random.default_rng(4)
    for alphabet in (1, 2, 4, 30):
        n = 400
        body = rng.integers(0, alphabet, n)
        body[200:300] = body[50:150]
        symbols = np.concatenate([[100], body, [101]])
        right, left = both_ways(symbols)
        x, y = rng.integers(1, n + 1, (2, 3000))
        x, y = x[x != y], y[x != y]

        def reach(i, j, step):
            k = 0
            while symbols[i + k * step] == symbols[j + k * step]:
                k += 1
            return k

        assert right.right(x, y).tolist() == [reach(i, j, 1) for i, j in zip(x, y, strict=True)]
        last = len(symbols) - 1
        assert left.right(last - x, last - y).tolist() == [reach(i, j, -1) for i, j in zip(x, y, strict=True)]


def test_grammar_stays_shallow():
    """Whatever the numbers of neighbouring symbols are, some level soon tells them apart."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        a, b = rng.integers(0, 2_000_000, 2)
        symbols = np.concatenate([[3_000_000], np.tile([a, b, b + 1], 300), [3_000_001]])
        levels, _ = recompress(symbols)
        assert len(levels[-1]) <= 2 and len(levels) < 110


# --- faults of earlier operators ----------------------------------------------------------------


def test_ids_above_sixteen_bits_come_back():
    from agentguard.llm.flat import Spans, codes
    from agentguard.llm.words import IdCache

    flat = codes("ab cd")
    spans = Spans(flat, np.array([0, 3]), np.array([2, 5]))
    cache = IdCache()
    for _ in range(2):
        ids, start, count = cache.resolve(spans, lambda words: (np.array([70_000 + len(w) for w in words]), np.ones(len(words), dtype=np.int64)))
        assert ids[start].tolist() == [70_002, 70_002] and count.tolist() == [1, 1]


def test_language_is_learned_from_rows_without_an_id(spark, given):
    """Neither rows without any id nor many copies of one row keep a language from being learned, and no more than the bound comes back."""
    from agentguard.llm import language_id

    rows = given.select(F.lit(None).cast("long").alias("doc_id"), "text", "lang")
    copies = rows.where("lang = 'en'").limit(1).crossJoin(spark.range(500)).select("doc_id", "text", "lang")
    model = language_id.train(rows.unionByName(copies), per_language=50)
    assert {x for own in model.languages.values() for x in own} == {r.lang for r in given.select("lang").where("lang IS NOT NULL").distinct().collect()}


def test_token_files_split_rows_without_an_id(spark):
    """All rows lack an id: they are dealt over several files, in order of the bytes of their ids."""
    from agentguard.llm import token_files
    from agentguard.llm.queries import vocabulary
    from agentguard.llm.shared import new_folder

    df = spark.createDataFrame([(None, f"text number {k} of many") for k in range(400)], "doc_id long, text string")
    folder = new_folder(spark, "test-token-files")
    manifest, table = token_files.write_files(df, vocabulary("word_bpe_49k.json"), folder)
    assert manifest.select("file").distinct().count() > 1
    rows = sorted(token_files.read_files(manifest, folder, table).collect(), key=lambda r: r.start)
    assert len(rows) == 400 and all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
