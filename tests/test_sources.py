"""Transfers of lines, with rows that the tables do not have."""

import pytest

from riskweave.sources import driver_tables as D


@pytest.fixture
def folder(spark, tmp_path):
    line = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
    import datetime

    day = datetime.datetime(1995, 1, 1)
    lines = [(1, i, 1, s, 100.0, 0.0, flag, day) for i, (s, flag) in enumerate([(7, "N"), (7, "A"), (7, "R"), (7, None), (8, "A"), (8, "R"), (9, "A"), (9, "R")])] + [(2, 0, 1, 7, 100.0, 0.0, "A", day)]
    spark.createDataFrame(lines, line).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 1), (8, 2), (8, 3)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_transfers_of_a_supplier_listed_twice_or_not_at_all(spark, folder):
    got = sorted((r["from_address"], r["to_address"], r["cents"]) for r in D.derive_transfers(spark, folder).collect())
    pays = [("C5", "S7", 10_000)] * 4 + [("C5", "S8", 10_000)] * 2 + [("C5", "S9", 10_000)] * 2
    refunds = [(f"S{s}", "C5", 5_000) for s in (7, 8, 9)]
    assert got == sorted(pays + refunds + [("S7", "H1", 4_000), ("S8", "H2", 4_000), ("S8", "H3", 4_000)])


def test_lines_are_read_once(spark, folder):
    plan = D.derive_transfers(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and sum("Relation [" in x and "l_orderkey" in x for x in plan.splitlines()) == 1
