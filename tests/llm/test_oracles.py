"""Queries of the training-data operators that SQL can express."""

import os

import pytest

from tests import oracle
from weftline.llm import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no driver tables here")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    oracle.agree(spark, oracle.connect(), registry.QUERIES[name], registry.ORACLES[name])
