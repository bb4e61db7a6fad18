"""Every query with SQL gives the same rows as DuckDB; the others give rows."""

import glob
import os

import pytest
from compare import differences, duck

from tallframe.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_llm_stands_apart():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tallframe")
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "tallframe.llm" not in open(path).read(), path
