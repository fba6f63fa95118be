"""Every registered retrieval query against its SQL."""

import pytest
from conftest import SF

from loomgraph.plans.oracles import ORACLES
from loomgraph.plans.queries import QUERIES


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, same):
    same(QUERIES[name](spark, SF), duck, ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
