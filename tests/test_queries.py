"""Every registered query of the library runs, and equals its oracle where it has one."""

from __future__ import annotations

import pytest

from tests.compare import assert_same
from vellum import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    if name in ORACLES:
        assert_same(spark, sf_dir, QUERIES[name], ORACLES[name])
    else:
        df = QUERIES[name](spark, sf_dir)
        assert len(set(df.columns)) == len(df.columns)
        df.collect()
