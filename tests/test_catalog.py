"""Every query of the catalog against its SQL."""

import pytest

from tessera.plans import catalog


def plain(v):
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    return [plain(x) for x in v] if isinstance(v, list) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name in catalog.ORACLES:
        cur = duck.execute(catalog.ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == rows_of(columns, cur.fetchall())
    else:
        assert got


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
