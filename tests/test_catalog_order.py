"""Means of doubles are added in the table's order, as the SQL on one thread adds them, wherever the rows lay."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Suppliers whose mean price lies halfway between two decimals or whose mean discount is 0.05, four times with shifted keys, in seven files of unlike sizes."""
    d = tmp_path_factory.mktemp("halves")
    (d / "lineitem.parquet").mkdir()
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"""CREATE TABLE x AS SELECT * REPLACE (l_suppkey + k * 1000 AS l_suppkey) FROM range(4) r(k), '{SF}/lineitem.parquet' WHERE l_suppkey IN (SELECT l_suppkey FROM '{SF}/lineitem.parquet' GROUP BY 1
      HAVING sum(l_discount::DECIMAL(9, 2)) * 20 = count(*) OR sum(l_extendedprice::DECIMAL(18, 2) * 100)::HUGEINT * 20000 % count(*) = 0 AND sum(l_extendedprice::DECIMAL(18, 2) * 100)::HUGEINT * 20000 // count(*) % 2 = 1)""")
    n, cuts = c.execute("SELECT count(*) FROM x").fetchone()[0], [0, 0.05, 0.3, 0.4, 0.45, 0.6, 0.9, 1]
    for k in range(7):
        c.execute(f"COPY (SELECT * FROM x LIMIT {int(n * cuts[k + 1]) - int(n * cuts[k])} OFFSET {int(n * cuts[k])}) TO '{d}/lineitem.parquet/{k}.parquet' (FORMAT parquet)")
    c.execute(f"COPY (SELECT * FROM '{SF}/supplier.parquet') TO '{d}/supplier.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    c.execute(f"CREATE VIEW supplier AS SELECT * FROM '{d}/supplier.parquet'")
    return c, str(d)


@pytest.mark.parametrize("name", ["catalog_index", "catalog_rank", "summary_card"])
def test_means_halfway_between_decimals(spark, halves, name):
    c, d = halves
    cur = c.execute(entry.plans.SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in entry.plans.QUERIES[name](spark, d).select(*names).collect()) == want
