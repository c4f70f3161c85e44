"""Chat formatting, language identification, mixing, archives, search and the pipeline."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentguard.llm import chat_format, language_id, mixing, topk, warc
from agentguard.llm.shared import new_folder

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s>"), (1, 2, "user", "[INST] <\\/s> [\\\\/INST]"), (1, 3, "assistant", ""),
    (2, 0, "system", None), (2, 1, "user", "tail\nwith lines"), (3, 5, "assistant", "only"), (3, 5, "assistant", "only"),
    (4, None, None, None), (4, 0, "odd role\n[INST]", "<s>[/INST]"), (None, 0, "user", "no id"), (5, 0, "assistant", "x" * 50_000 + "</s>"),
]


def test_chat_reads_back_what_went_in(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("n", F.lit(2))
    examples = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.conversation_digest(examples).collect()}
    assert len(got) == 6
    for conv in got:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = examples.where("conv_id = 1").orderBy("example").collect()
    assert [r.text.count("<s>") for r in first] == [1, 2] and first[0].text == "[INST]user\nhi[/INST]<s>hello <\\/s></s>"
    assert chat_format.conversation_digest(chat_format.format_conversations(df.limit(0))).count() == 0
    assert "Python" not in examples._jdf.queryExecution().toString()


def test_language_on_given_rows(given):
    rows = language_id.identify(given).join(given.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_rows(spark, odd, none):
    got = language_id.identify(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {4, 5, 6, 7}
    assert language_id.identify(none).count() == 0 and language_id.keep_identified(none).columns == none.columns
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}
    one = odd.withColumn("lang", F.lit("xx"))
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"und", "xx"}


def test_features_cover_the_whole_text(monkeypatch):
    text = "Straße und Häuser " * 200
    whole = language_id.features(text)
    monkeypatch.setattr(language_id, "_BLOCK", 97)
    assert np.allclose(whole, language_id.features(text))


def test_targets_share_the_excess():
    sizes = {"a": 10, "b": 100, "c": 90, None: 0}
    goal = mixing.targets(sizes, mixing.cyclic_weights(list(sizes)), 200)
    assert goal["a"] == 30 and goal[None] == 0 and abs(sum(goal.values()) - 200) < 1e-9 and abs(goal["c"] - 1.5 * goal["b"]) < 1e-9


def test_tree_deals_every_unit_once():
    units = np.array([500, 1, 0, 77])
    dealt = mixing.split_tree(units, 9, 4)
    assert (dealt.sum(axis=0) == units).all() and set(dealt.sum(axis=1)) <= {64, 65}
    assert (dealt == mixing.split_tree(units, 9, 4)).all()


def mixed(df):
    sizes, mixture = mixing.plan_mixture(df)
    return sizes, mixture, mixing.taken_words(sizes, mixture).collect()


def test_mixing_on_given_rows(given):
    sizes, mixture, rows = mixed(given)
    by = {}
    for r in rows:
        assert r.taken in {k * r.size for k in range(4)}
        target, taken = by.get(r.source, (r.target, 0))
        by[r.source] = (target, taken + r.taken)
    largest = max(r.size for r in rows)
    assert all(abs(taken - target) <= largest for target, taken in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixed(given)[2]))
    places = mixture.groupBy("shard").agg(F.count("*").alias("n"), F.max("position").alias("p"), F.countDistinct("position").alias("d")).collect()
    assert all(r.n == r.p == r.d for r in places)


def test_mixing_on_odd_rows(odd, none):
    _, _, rows = mixed(odd)
    assert len(rows) == odd.count()
    assert {r.doc_id: r.size for r in rows}[2] == 11 and {r.size for r in rows if r.doc_id in (4, 5, 6)} == {0}
    assert mixed(none)[2] == [] and mixing.mix_documents(none).columns == none.columns
    assert mixing.mix_documents(odd).columns == odd.columns


def test_mixing_of_a_source_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 1)  # as many blocks as 262,144 documents of a source have
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 5000, "a").otherwise("b").alias("source"))
    _, mixture, rows = mixed(docs)
    taken = {s: sum(r.taken for r in rows if r.source == s) for s in "ab"}
    assert len(rows) == 6000 and taken == {"a": 9_000, "b": 9_000}  # 18,000 words by weights 1 and 2, of "b" no more than three times its own
    assert {r.copies for r in rows if r.source == "b"} == {3} and {r.copies for r in rows if r.source == "a"} == {0, 1}
    assert mixture.select("shard").distinct().count() > 16 and mixing.mix_documents(docs).count() == 6000


PAGES = [
    (1, "http://a/\r\nX: y", "p" * 100), (2, None, "p" * 100), (2, None, "p" * 100), (3, "http://b/%41", "p" * 99), (4, "u", "p" * 99),
    (5, "u", None), (6, "u", ""), (None, "u", "p" * 100), (None, "u", "q" * 200), (None, "u", "q" * 200), (7, "é" * 9000, "é\r\n\r\n" * 40_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit(2))


def test_archives_round_trip(pages):
    got = sorted(str(tuple(r)) for r in warc.archive_and_read(pages).collect())
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = min((p for p, _, h in PAGES if h == html and p is not None), default=None)
        revisit = len(raw) >= 100 and first is not None and i != first
        want.append(str((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None)))
    assert got == sorted(want)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_archive_filters_reach_the_reader(spark, pages):
    folder = new_folder(spark, "warc-test")
    warc.write_warc(warc.as_records(pages), folder)
    every = warc.read_warc(spark, folder)
    assert every.count() == len(PAGES)
    assert {r.record_id for r in every.where("record_type = 'revisit'").collect()} == {"2", ""}
    assert {r.target_uri for r in every.where("record_id in ('1', '7')").collect()} == {"http://a/\r\nX: y", "é" * 9000}
    reader = warc.WarcReader(folder, True)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("payload",), b"")]))
    assert len(left) == 1 and reader.wanted({"record_type": "revisit"}) and not reader.wanted({"record_type": "response"})


def test_unpacking_stops_at_the_headers():
    row = {"record_type": "response", "record_id": "1", "target_uri": "u", "refers_to": None, "payload_digest": "d", "payload_bytes": 9, "payload": bytes(1 << 22)}
    data = warc.record(row)
    size, columns, rest, unpack = warc._open_member(data[:4096])
    assert size == len(data) and columns["record_id"] == "1" and len(rest) <= 8192
    assert warc._payload(unpack, rest, data[:4096], data[4096:], size) == row["payload"]


def brute(rows, every, k):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            best.setdefault(i, []).append(np.floor(1024 * np.array(v, dtype=np.float64)))
    out = []
    for q in best:
        if q % every == 0:
            query = max(best[q], key=list)
            scores = sorted((-max(int((query[: len(v)] * v[: len(query)]).sum()) for v in vs), i) for i, vs in best.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_against_all_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 128)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * (1 if seed == 1 else rng.pareto(1))]) for i in range(600)]
    rows += [(600 + i, rows[i][1]) for i in range(50)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, 10, 5).collect())) == brute(rows, 10, 5)


def test_search_on_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [0.5, -1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (7, []), (8, [3.0]), (None, [1.0, 1.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("vec", F.lit(2))
    assert sorted(map(tuple, topk.search(df, 100, 10).collect())) == brute(rows, 100, 10)
    assert topk.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 4096])
def test_search_with_an_id_that_repeats_more_than_k_times(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(0, [1.0, 1.0])] + [(7, [60.0, 40.0])] * 11 + [(i, [float(i), float(i % 3)]) for i in range(20, 50)]
    rows += [(i, [float(x) for x in rng.normal(size=2)]) for i in (8, 9) for _ in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = sorted(map(tuple, topk.search(df, 100, 10).collect()))
    assert got == brute(rows, 100, 10) and len(got) == 10


def test_pipeline_stages(spark, odd):
    import corpus_pipeline
    from agentguard.llm.shared import stage

    docs, texts = stage(odd, "pipeline-test"), []
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, ""), f"pipeline-test-{name}")
        assert docs.columns == odd.columns
        texts.append([r.doc_id for r in docs.collect()])
    language, exact, near, _ = texts
    assert not {4, 5, 6, 7} & set(language) and {1, 2, 3, 8, 9, 10, 11} <= set(language)
    assert 1 in exact and 2 not in exact and near.count(3) <= 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count()
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, odd.limit(0), "").count() == 0
