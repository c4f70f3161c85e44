"""Registered training-data queries on the smallest tables: against their SQL, or whole and of the promised columns."""

import pytest

from agentguard.llm import ORACLES, QUERIES
from tests.check import compare, oracle_connection

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op3": ["doc_id", "held_out", "lang_pred", "score"],
    "op4": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5": ["doc_id", "n_shingles", "component_id"],
    "op6": ["doc_id", "size", "source_size", "target", "taken"],
    "op9": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op13": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_reference(spark, name):
    got, want, diff = compare(QUERIES[name](spark, SF), oracle_connection(SF), ORACLES[name])
    assert not diff and got == want, (got, want, diff[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_per_document(spark, given, name):
    rows = QUERIES[name](spark, SF)
    assert rows.columns[: len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == sorted(r.doc_id for r in given.select("doc_id").collect())
