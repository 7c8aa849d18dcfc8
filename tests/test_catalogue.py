"""Every query of the catalogue, against its SQL where it has some; else it gives rows."""

import oracle
import pytest

from tarnspark.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert not oracle.difference(df, sf_dir, ORACLES[name])
    else:
        assert df.count() > 0
