"""A stream of transfers, some delivered twice, scored in micro-batches: the same as the batch."""

from pyspark.sql import functions as F

from riskweave import streaming
from riskweave.operators import asof
from riskweave.operators import legs as L

SCHEMA = "tx_hash string, from_address string, to_address string, amount_usd double, cents long, block_time long"


def transfers():
    day = 86_400_000
    return [(f"t{i}", f"C{i % 7}", f"S{i % 5}", float(i % 9), 100 * (i % 9), day + i * day // 3) for i in range(90)]


def destination(events, stored):
    return asof.destination_block(events, L.legs(L.clean(stored)))


def test_stream_equals_batch(spark, tmp_path):
    rows = transfers()
    source = str(tmp_path / "in")
    for part in (rows[:40], rows[30:70], rows[60:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    jobs = [lambda s: streaming.ingest(read(), store, str(tmp_path / "c1")), lambda s: streaming.ingest(read(), store, str(tmp_path / "c2"))]
    streaming.chain(spark, jobs)
    assert sorted(r[0] for r in spark.read.parquet(store).select("tx_hash").collect()) == sorted(r[0] for r in rows)
    events = L.payments_as_events(read())
    streaming.score_stream(events.dropDuplicates(["event_id"]), destination, store, out, str(tmp_path / "c3")).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA)
    want = destination(L.payments_as_events(whole), whole)
    got = spark.read.parquet(out).drop("batch")
    assert got.select(*want.columns).exceptAll(want).count() == want.exceptAll(got.select(*want.columns)).count() == 0


def test_repeats_and_earliest(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = transfers()[:20]
    spark.createDataFrame(rows + rows[5:9], SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = streaming.deduplicated(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 20
    freezes = stream.select(F.col("to_address").alias("address"), "block_time")
    q = streaming.earliest_freezes(freezes).writeStream.format("memory").queryName("first").outputMode("complete").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["address"]: r["block_time"] for r in spark.table("first").collect()} == {f"S{k}": 86_400_000 + k * 86_400_000 // 3 for k in range(5)}


def test_changes_of_earliest_freezes(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "changes")
    schema = "address string, block_time long"
    parts = [[("a", 50), ("b", 60), ("b", 60), (None, 1), ("c", None)], [("a", 50), ("b", 70), ("d", 10)], [("b", 20), ("a", 50), ("d", 11)], [("b", 20), ("c", 5), ("b", 25)]]
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    changes = []
    for part in parts:  # each part by a run of its own: the state outlives it
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        streaming.keep_changes(read(), table, str(tmp_path / "c")).awaitTermination()
        changes.append(sorted(map(tuple, spark.read.parquet(table).select("address", "block_time", "before").collect()), key=str))
    assert changes[0] == [("a", 50, None), ("b", 60, None)]
    assert set(changes[1]) - set(changes[0]) == {("d", 10, None)}
    assert set(changes[2]) - set(changes[1]) == {("b", 20, 60)}
    assert set(changes[3]) - set(changes[2]) == {("c", 5, None)} and len(changes[3]) == 5  # repeats and later rows change nothing
    got = {r["address"]: r["block_time"] for r in streaming.earliest_of(spark, table).collect()}
    assert got == {"a": 50, "b": 20, "c": 5, "d": 10}


def test_append_reads_the_days_around_a_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = transfers()
    streaming.append_new(spark.createDataFrame(rows[:60], SCHEMA), store)
    streaming.append_new(spark.createDataFrame(rows[50:], SCHEMA), store)
    streaming.append_new(spark.createDataFrame([(*r[:5], r[5] + 1000) for r in rows[:10]], SCHEMA), store)  # the same transfers a second later
    streaming.append_new(spark.createDataFrame([], SCHEMA), store)
    streaming.append_new(spark.createDataFrame([("no time", "a", "b", 1.0, 100, None)] * 2, SCHEMA), store)
    streaming.append_new(spark.createDataFrame([("no time", "a", "b", 1.0, 100, None)], SCHEMA), store)
    assert spark.read.parquet(store).count() == len(rows) + 1
