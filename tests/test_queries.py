"""Every registered query of the reference's operators against its SQL on the smallest tables."""

import compare
import pytest

from lamina import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return compare.database(SF)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLES:
        assert compare.difference(df, con, plans.ORACLES[name]) == ""
    else:
        # The same rows on a second run, rows at all, and no value that isn't a number.
        one, two = (compare.spark_rows(x) for x in (df, plans.QUERIES[name](spark, SF)))
        assert one[1] and len(set(df.columns)) == len(df.columns) and "nan" not in {v for r in one[1] for v in r if isinstance(v, str)}
        assert one[0] == two[0] and len(one[1]) == len(two[1]) and all(compare.same(a, b) for a, b in zip(one[1], two[1], strict=True))
