"""Every query with SQL equals DuckDB's result on the smallest tables; the others run."""

import pytest
from oracle import compare

from siftmill.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        df.write.format("noop").mode("overwrite").save()
    else:
        compare(df, sql, sf_dir)
