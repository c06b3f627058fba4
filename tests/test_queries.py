"""Every registered query of the library runs; those with SQL give what the SQL gives."""

import duckdb
import pytest

from tidegrid import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def scale(request):
    """Some rules are met on the larger tables alone."""
    folder = f"/root/testdata/{request.param}"
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, c


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else repr(v)


def rows(table, names):
    return sorted("|".join(map(cell, r)) for r in zip(*(table[c].to_pylist() for c in names), strict=True))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, scale, name):
    sf, con = scale
    got = plans.QUERIES[name](spark, sf).toArrow()
    if name not in plans.SQL:
        assert got.num_rows > 0
        return
    want = con.execute(plans.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, want.column_names) == rows(want, want.column_names)
