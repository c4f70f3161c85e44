"""Exact and near duplicates against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from agentguard.llm import exact_dedup as ex
from agentguard.llm import ngram_join as ng
from agentguard.llm.components import components


def plain_exact(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(i)
    out = []
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def exact_rows(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("how", [{}, {"key_bits": 3}, {"bucket_entries": 1}, {"key_bits": 6, "bucket_entries": 2}])
def test_exact_on_odd_rows(odd, how):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert exact_rows(ex.exact_dedup(odd, **how)) == plain_exact(rows)


def test_exact_on_given_rows_and_empty(given, none):
    assert exact_rows(ex.exact_dedup(given)) == plain_exact([(r.doc_id, r.text) for r in given.collect()])
    assert ex.exact_dedup(none).count() == 0
    assert ex.drop_duplicates(none).columns == none.columns


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(k,) for k in [*range(0, 64), 1 << 59]], "key long")
    directory, depth = ex.build_directory(keys, 65, 8, 60)
    rows = directory.collect()
    assert depth == max(r.local_depth for r in rows) and len({r.cell for r in rows}) == len(rows)
    assert min(r.local_depth for r in rows if r.bucket >> (depth - 1)) == 1  # the lone key of the upper half stays shallow


def test_exact_plan_has_no_python(odd):
    assert "Python" not in ex.exact_dedup(odd)._jdf.queryExecution().toString()


def plain_components(rows, words, percent):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    found = {}
    for k, (i, _) in enumerate(rows):
        found.setdefault(find(k), []).append(i)
    return sorted([(rows[k][0], len(sets[k]), min((i for i in found[find(k)] if i is not None), default=None)) for k in range(len(rows))], key=str)


def near_rows(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def edited(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(120)]
    rows = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 11, 14, 20, 22, 40, 90, 300]))]
        for _ in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), "\n".join(text) if rng.random() < 0.2 else " ".join(text).upper()))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_near_against_all_pairs(spark, words, percent):
    rows = edited(percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(ng.similar_components(df, words, percent)) == plain_components(rows, words, percent)


def test_near_on_odd_rows_and_empty(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert near_rows(ng.similar_components(odd, 3, 90)) == plain_components(rows, 3, 90)
    assert ng.similar_components(none, 3, 90).count() == 0
    assert ng.keep_one_of_each(none).columns == none.columns


def test_near_in_tiles(spark, monkeypatch):
    """A cluster larger than a tile: every two tiles meet."""
    monkeypatch.setattr(ng, "LEAST_TILE", 3)
    monkeypatch.setattr(ng, "MOST_TILE", 3)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1:]])) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(ng.similar_components(df, 3, 80)) == plain_components(rows, 3, 80)


TWICE = [
    (1, "a b c d e f g h"), (3, "another text of seven words it is"), (3, "a b c d e f g h"), (3, "a b c d e f g h"),
    (None, "a text without any id at all"), (None, "a text without any id at all"), (None, "one more text that has no id"),
    (None, "a b c d e f g h"), (5, "given twice and with the same id"), (5, "given twice and with the same id"), (6, None), (7, None)]


@pytest.mark.parametrize("keep", [ex.drop_duplicates, ng.keep_one_of_each])
def test_each_row_is_judged_by_itself(spark, keep):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(TWICE)], "doc_id long, text string, id int")
    found = [(r.doc_id, r.text) for r in keep(df).collect()]
    want = {(1, TWICE[0][1]), TWICE[1], TWICE[4], TWICE[6], TWICE[8], (6, None)} | ({(7, None)} if keep is ng.keep_one_of_each else set())
    assert len(found) == len(want) and set(found) == want


def test_tree_never_loses_a_point():
    rng = np.random.default_rng(1)
    vectors, percent = rng.poisson(2, (300, 16)).astype(np.int32), 60
    sizes = vectors.sum(axis=1)
    tree = ng.CountTree(vectors, sizes)
    for i in range(0, 300, 17):
        found = set(tree.order[tree.near(vectors[i], int(sizes[i]), percent)].tolist())
        bound = np.minimum(vectors, vectors[i]).sum(axis=1)
        fits = (bound >= ng.needed(sizes, int(sizes[i]), percent)) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        assert found == set(np.flatnonzero(fits).tolist())


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 301), (301, 300)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[k] == 0 for k in range(51)) and all(found[k] == 100 for k in range(100, 140)) and found[301] == 300
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
