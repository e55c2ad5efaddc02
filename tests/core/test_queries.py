"""Each query of the library against its SQL."""

import pytest
from oracle import compare

from loomgraph.queries import graphs, graphs_sql, segmenting

QUERIES = {**segmenting.QUERIES, **graphs.QUERIES}
SQL = {**segmenting.ORACLES, **graphs_sql.ORACLES}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    compare(spark, QUERIES[name], SQL[name])
