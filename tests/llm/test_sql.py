import pytest

from tests.oracle import SF, assert_same, connect
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), connect(), ORACLES[name])
