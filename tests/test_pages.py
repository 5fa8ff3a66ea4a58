"""Kept pages to histories, and a table that grows by whole batches."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from riskweave.sources import batches, pages

REFUSED = {"status": "0", "message": "NOTOK", "result": "too many requests"}
NOTHING = {"status": "0", "message": "No transactions found", "result": []}
NOTHING_SAID = {"status": "0", "message": "No transactions found", "result": "No transactions found"}


def answer(address, page, n=3):
    return {"status": "1", "message": "OK", "result": [{"hash": f"{address}-{page}-{i}", "value": str(i)} for i in range(n)]}


CASES = {
    "short": [answer("short", 1, 2)],
    "ends empty": [answer("ends empty", 1), NOTHING],
    "ends said": [answer("ends said", 1), NOTHING_SAID],
    "cut by budget": [answer("cut", p) for p in (1, 2, 3, 4)],
    "cut by keeping": [answer("kept", 1)],
    "gap": [answer("gap", 1), None, answer("gap", 3, 1)],
    "refused": [answer("refused", 1), REFUSED, answer("refused", 3, 1)],
    "refused after its end": [answer("late", 1, 1), REFUSED],
    "refused at once": [REFUSED],
    "broken": ["{no json"],
    "no pages": [None, answer("no", 2)],
    "empty": [NOTHING],
}
WANT = {  # pages, rows, refused, truncated
    "short": (1, 2, False, False), "ends empty": (2, 3, False, False), "ends said": (2, 3, False, False), "cut by budget": (3, 9, False, True), "cut by keeping": (1, 3, False, True), "gap": (1, 3, False, True),
    "refused": (3, 4, True, None), "refused after its end": (1, 1, False, False), "refused at once": (1, 0, True, None), "broken": (1, 0, True, None), "no pages": (0, 0, False, True), "empty": (1, 0, False, False),
}


@pytest.fixture
def folder(tmp_path):
    for address, payloads in CASES.items():
        (tmp_path / "a" / address).mkdir(parents=True)
        for i, p in enumerate(payloads, 1):
            if p is not None:
                (tmp_path / "a" / address / f"{i}.json").write_text(p if isinstance(p, str) else json.dumps(p))
    (tmp_path / "again" / "refused at once").mkdir(parents=True)  # a later run got an answer, compressed
    with gzip.open(tmp_path / "again" / "refused at once" / "1.json.gz", "wt") as f:
        f.write(json.dumps(answer("retried", 1, 1)))
    (tmp_path / "a" / "notes.txt").write_text("not a page")
    return str(tmp_path)


def test_histories_of_kept_pages(spark, folder):
    held = pages.read_pages(spark, folder)
    assert held.count() == sum(p is not None for ps in CASES.values() for p in ps) + 1
    got = {r["address"]: tuple(r)[1:] for r in pages.histories(held, most=3, page_rows=3).collect()}
    assert got == WANT | {"refused at once": (1, 1, False, False)}
    raw = [json.loads(r["raw"])["hash"] for r in pages.harvest(held, most=3, page_rows=3).collect()]
    assert len(raw) == len(set(raw)) == sum(rows for _, rows, refused, _ in (WANT | {"refused at once": (1, 1, False, False)}).values() if not refused)
    assert not any(h.startswith(("refused", "no-")) for h in raw)
    wanted = spark.createDataFrame([(a,) for a in [*CASES, "new"]], "address string")
    left = {r["address"] for r in pages.left_to_fetch(wanted, pages.histories(held, 3, 3)).collect()}
    assert left == {"refused", "broken", "no pages", "new"}


def test_batches_are_whole_or_nothing(spark, tmp_path):
    folder, schema = str(tmp_path / "table"), "address string, tx_hash string, n long"
    todo = spark.createDataFrame([(f"a{i}",) for i in range(40)], "address string")
    make = lambda part: part.select("address", F.concat(F.lit("t"), "address").alias("tx_hash"), F.lit(1).cast("long").alias("n"))
    assert batches.read_batches(spark, folder, schema).count() == 0

    def fails(part):
        return make(part).withColumn("n", F.when(F.col("address") == "a7", F.raise_error(F.lit("interrupted"))).otherwise(F.col("n")).cast("long"))

    with pytest.raises(Exception, match="interrupted"):
        batches.append_in_batches(todo, "address", fails, folder, 8)
    done = batches.committed(spark, folder)
    before = batches.read_batches(spark, folder, schema)
    assert 0 < len(done) < 8 and before.where("address = 'a7'").count() == 0
    held = before.count()
    assert batches.append_in_batches(todo, "address", make, folder, 8) == 8 - len(done)  # goes on where it stopped
    after = batches.read_batches(spark, folder, schema, ["tx_hash"])
    assert after.count() == 40 > held
    assert batches.append_in_batches(todo, "address", make, folder, 8) == 0  # a repeated run adds nothing
    assert batches.read_batches(spark, folder, schema).count() == 40
    assert not list((tmp_path / "table" / "_staged").glob("*"))
    with pytest.raises(ValueError, match="named"):
        batches.append_batch(todo, folder, "../x")
