"""Filters on costly columns do not repeat them."""

import os

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_blob_verdicts_scan_a_text_once(spark):
    plan = queries()["blob_verdicts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line.split("Filter ", 1)[1] for line in plan.splitlines() if "Filter " in line]
    assert filters and all(f.startswith("isnotnull(once#") for f in filters)
