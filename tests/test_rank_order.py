"""The rank queries against their SQL on part keys beyond a million."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ("precision_recall_at_k", "reciprocal_rank", "ndcg_at_k")


@pytest.mark.parametrize("name", NAMES)
def test_large_part_keys_rank_as_in_sql(spark, tmp_path, name):
    rows = [
        (1, 1_199_999, 1, 40.0), (1, 5, 2, 31.0), (1, 7, 3, 3.0), (1, 1_000_008, 4, 27.0), (2, 3_500_001, 1, 30.0), (2, 2, 2, 1.0), (2, 3, 3, 2.0), (2, 4, 4, 3.0),
        (3, 10, 1, 26.0), (3, 50, 2, 29.0), (3, 1_000_011, 2, 2.0), (3, 12, 3, 2.0),
    ]
    schema = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
        want = sorted(duck.sql(entry.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == want
