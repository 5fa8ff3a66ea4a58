"""Packed columns, joins and counts of what is dealt out, and what is left of a shuffle once a table is written."""

import datetime
import random
import subprocess
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from riskweave.operators import asof, packed
from riskweave.operators.store import written
from riskweave.sources import driver_tables as D


def test_packs_hold_what_they_got():
    rng = random.Random(1)
    some = lambda v: None if rng.random() < 0.2 else v
    columns = {
        "i": pa.array([some(rng.randrange(-(1 << 62), 1 << 62)) for _ in range(99)], pa.int64()),
        "j": pa.array([some(rng.randrange(9)) for _ in range(99)], pa.int32()),
        "d": pa.array([some(rng.choice([rng.random(), float("inf")])) for _ in range(99)]),
        "b": pa.array([some(rng.random() < 0.5) for _ in range(99)]),
        "s": pa.array([some(rng.choice(["", "C12", "ä|b", "x" * 50])) for _ in range(99)]),
        "y": pa.array([some(rng.randbytes(rng.randrange(5))) for _ in range(99)], pa.binary()),
        "n": pa.array([None] * 99, pa.string()),
        "t": pa.array([some(datetime.datetime(1995, 1, 1 + i % 28)) for i in range(99)], pa.timestamp("us")),
        "l": pa.array([some([1.5, None]) for _ in range(99)], pa.list_(pa.float64())),
    }
    whole = pa.record_batch(columns)
    for a, n in ((0, 99), (13, 1), (40, 30)):
        part = whole.slice(a, n)
        assert packed.unpack(n, *packed.pack(part), whole.schema).to_pylist() == part.to_pylist()


def test_buckets_are_whole(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("key")).repartition(3)
    got = packed.in_buckets(rows, F.pmod(F.xxhash64("key"), F.lit(3)), lambda t: t.group_by("key").aggregate([("id", "sum")]).select(["key", "id_sum"]), "key string, id_sum long", ("key",))
    assert sorted(map(tuple, got.collect())) == [(str(k), sum(range(k, 1000, 7))) for k in range(7)]


def test_join_of_packs_equals_join(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice([None, *range(12)]), f"l{i}") for i in range(80)], "k long, a string").repartition(3)
    right = spark.createDataFrame([(rng.choice([None, *range(5, 16)]), None if i % 9 == 0 else i) for i in range(25)], "m int, b long").repartition(2)
    want = Counter(map(tuple, left.join(right, F.col("k") == F.col("m")).select("k", "a", "b").collect()))
    assert Counter(map(tuple, packed.matched(left, right, ("k", "m"), 3).collect())) == want and len(want) > 50
    assert packed.matched(left.limit(0), right, ("k", "m"), 3).count() == 0


def test_lines_find_their_orders_either_way(spark):
    lines, orders = (D.table(spark, "/root/testdata/sf0.001", t) for t in ("lineitem", "orders"))
    few, many = (Counter(map(tuple, D.ordered(lines.select(*D.LINE), orders.select("o_orderkey", "o_custkey"), most).select(*D.LINE, "o_custkey").collect())) for most in (1 << 19, 10))
    assert few == many and sum(many.values()) == lines.count()


def test_hubs_are_found_by_cells(spark):
    keys = [f"k{i % 40}" for i in range(400)] + ["hub"] * 30 + ["big"] * 25
    rows = spark.createDataFrame([(k,) for k in keys], "key string").repartition(4)
    for cells in (1, 7, 1 << 16):
        got = asof.sizes_of(rows, "key", 20, cells)
        assert (got.rows, got.hubs, sorted(r["key"] for r in got.keys.collect())) == (455, 2, ["big", "hub"])
    assert asof.sizes_of(rows, "key", 400)[:2] == (455, 0) and asof.sizes_of(rows.limit(0), "key", 1)[:2] == (0, 0)


def test_what_was_shuffled_for_a_table_is_dropped_once_it_is_written(spark):
    folder = spark.conf.get("spark.local.dir")
    size = lambda: int(subprocess.run(["du", "-sk", folder], capture_output=True, text=True, check=True).stdout.split()[0])
    before = size()
    out = written(spark.range(400_000).select(F.md5(F.col("id").cast("string")).alias("x")).repartition(4, "x"))
    assert out.count() == 400_000 and size() - before < 4000  # some 13 MB were shuffled


def test_scores_and_payees_are_dealt_out_packed(spark):
    """The sender's count was told by windows over rows and joined on the event; payees' counts were folded once more."""
    from riskweave.operators import legs as L
    from riskweave.plans import scores

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan(scores.l1_scores(spark, "/root/testdata/sf0.001"))
    tx = D.kept(D.derive_transfers(spark, "/root/testdata/sf0.001"))
    assert "FlatMapGroups" not in plan(asof.payout_fanin(L.payments_as_events(tx), L.legs(L.clean(tx))))
