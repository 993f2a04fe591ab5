"""Every engine query against its SQL."""

import pytest
from compare import same

from quarterlight import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name]))


def test_entry_has_every_query(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
