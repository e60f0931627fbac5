"""Every query outside llm against its SQL on the smallest tables, types included."""

from __future__ import annotations

import os

import oracle
import pytest

from quillstone.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert not oracle.kinds(df, con, registry.ORACLE[name])
    assert not oracle.difference(df, con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE.keys()))
def test_query_without_sql(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
