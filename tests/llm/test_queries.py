"""The registered queries against their SQL, and the contract of the pipeline."""

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from checks import compare
from litvec.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_agrees_with_sql(spark, monkeypatch, name):
    monkeypatch.setattr(compare, "QUERIES", QUERIES)
    monkeypatch.setattr(compare, "ORACLES", ORACLES)
    monkeypatch.setitem(compare.SQL_TYPES, "boolean", "BOOLEAN")
    assert compare.difference(spark, SF_DIR, name) is None


def test_registered():
    names = [*QUERIES, "pipeline"]
    assert set(names) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
