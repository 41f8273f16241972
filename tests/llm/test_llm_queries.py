"""The subpackage's queries run on the smallest tables; their SQL, where there is some, says the same."""

import oracle
import pytest

from wakeline.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_runs(spark, name):
    df = q.queries()[name](spark, SF)
    if name in q.oracle_sql():
        assert oracle.difference(df, oracle.connect(SF), q.oracle_sql()[name]) == ""
    else:
        assert df.count() > 0
