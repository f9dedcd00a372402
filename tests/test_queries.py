"""Every core query against its DuckDB oracle."""

import pytest

from arborspark import catalog
from tests.compare import assert_same, duck


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, data, name):
    assert_same(catalog.queries()[name](spark, data), duck(data), catalog.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
