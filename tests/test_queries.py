import duckdb
import pytest

from coverscope.queries import ORACLES, QUERIES
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_as_its_sql(spark, name):
    same(spark, SF, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stories_are_ranked_by_sums_as_they_come_out(spark, tmp_path):
    """1/10 + 2/10 is more than 3/10 by its last bit, whatever the order, so the SQL puts story 1 before story 2."""
    outlets = {1: [1, 2, 2], 2: [1] * 3, 3: [1] * 6 + [2] * 8}
    items = [(story, part, outlet) for story, own in outlets.items() for part, outlet in enumerate(own)]
    con = duckdb.connect()
    tables = {
        "nation": "select 0 as n_nationkey, 'JP' as n_name, 0 as n_regionkey",
        "customer": "select 1 as c_custkey, 0 as c_nationkey",
        "orders": "select range as o_orderkey, 1 as o_custkey, date '2000-05-28' as o_orderdate from range(1, 4)",
        "supplier": "select range as s_suppkey, 0 as s_nationkey from range(1, 3)",
        "part": "select range as p_partkey, 1 as p_size, 'Brand#2' as p_brand, 'a title' as p_name from range(14)",
        "lineitem": f"""select story::bigint as l_orderkey, part::bigint as l_partkey, outlet::bigint as l_suppkey, part::bigint as l_linenumber, 45.0::double as l_quantity, 0.05::double as l_discount, 'A' as l_returnflag, 'F' as l_linestatus,
          timestamp '2000-05-28' as l_shipdate from (values {", ".join(map(str, items))}) v(story, part, outlet)""",
    }
    for name, sql in tables.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    same(spark, str(tmp_path), QUERIES["region_stories"], ORACLES["region_stories"])
    assert [r["cluster_id"] for r in QUERIES["region_stories"](spark, str(tmp_path)).orderBy("rank").collect()] == [3, 1, 2]
