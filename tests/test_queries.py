"""Every registered query of the engine's own operators against its SQL, or at least to its end."""

import pytest
from cadenza.plans import catalog
from oracle import same

from conftest import SF

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        same(df, SF, catalog.ORACLES[name])
    else:
        assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
