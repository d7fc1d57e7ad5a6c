"""Every registered query with SQL against that SQL on the smallest tables; the others run."""

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = [n for n in entry.catalogue.QUERIES]


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    if name in entry.oracle_sql():
        want = duck.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
