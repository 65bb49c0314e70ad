"""Every query with SQL gives the SQL's rows on the smallest tables; the others give rows."""

from __future__ import annotations

import pytest
from nightlights import registry

from oracle import same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {r.lamp_class for r in __spark_entry__.entry(spark).collect()} >= {"all"}
