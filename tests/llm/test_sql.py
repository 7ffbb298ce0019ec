import oracle
import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None
