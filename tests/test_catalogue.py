"""Every query with an oracle gives its SQL's rows; every other query runs."""

import os
import pathlib
import re

import pytest

from tests import oracle
from weftline.plans import catalogue

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    oracle.agree(spark, con, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - {"collective_resolve"}))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, oracle.DATA).collect() is not None


def test_nothing_imports_the_training_data_subpackage():
    root = pathlib.Path(catalogue.__file__).parents[1]
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert not re.search(r"(from|import)\s+(weftline)?\.{0,2}llm|weftline\.llm", path.read_text()), path


def test_entry_module():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
