"""Histories from kept answers of an explorer, a page a file, without a request.

A history is the pages of an address from the first on, as far as they were kept. It is complete when one of
them is not full, and cut when the pages asked for, or those that were kept, end before that. An answer that
refuses the request is no page: an address with one in its history has not been fetched, which is another
thing than having a short history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: <anything>/<address>/<page>.json, compressed or not
FILE = r"([^/]+)/(\d+)\.json(?:\.\w+)?$"
# Rows of a full page and what an answer without rows says.
PAGE_ROWS, NOTHING = 1000, "No transactions found"


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(address, page, payload) of the files below a folder of any store that Spark reads; other files are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    kept = files.where(F.col("path").rlike(FILE))
    part = lambda i: F.regexp_extract("path", FILE, i)
    return kept.select(F.url_decode(part(1)).alias("address"), part(2).cast("int").alias("page"), "payload")


def answers(pages: DataFrame) -> DataFrame:
    """(address, page, refused, items) of pages, one an address and page: an answer before a refusal, then the longest. items: the rows as JSON strings."""
    said = F.from_json("payload", "status string, message string, result string").alias("a")
    r = pages.select("address", "page", said).select("address", "page", "a.*").withColumn("items", F.from_json("result", "array<string>"))
    empty = F.startswith(F.coalesce("message", F.lit("")), F.lit(NOTHING))
    items = F.when(empty, F.coalesce("items", F.array().cast("array<string>"))).otherwise(F.col("items"))
    refused = items.isNull() | ((F.coalesce("status", F.lit("0")) == "0") & ~empty)
    best = F.max_by(F.struct("refused", "items"), F.struct(~F.col("refused"), F.size("items"), F.to_json("items")))
    return r.select("address", "page", refused.alias("refused"), items.alias("items")).groupBy("address", "page").agg(best.alias("b")).select("address", "page", "b.*")


def used_pages(pages: DataFrame, most: int, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The answers that make up histories of at most `most` pages, with `full` and `before` (pages that ended it already: 0)."""
    order = Window.partitionBy("address").orderBy("page")  # `most` rows an address
    short = (~F.col("refused") & (F.size("items") < page_rows)).cast("int")
    rows = answers(pages.where(F.col("page").between(1, most))).withColumns({"place": F.row_number().over(order), "ended": F.coalesce(F.sum(short).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return rows.where("place = page and ended = 0").withColumn("full", (short == 0))


def histories(pages: DataFrame, most: int, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(address, pages, rows, refused, truncated) of each address with a page: truncated if its history does not end in a page that is not full; null where it was refused."""
    used = used_pages(pages, most, page_rows)
    each = used.groupBy("address").agg(F.count("*").alias("pages"), F.sum(F.when(~F.col("refused"), F.size("items")).otherwise(0)).cast("long").alias("rows"), F.max("refused").alias("refused"), F.min("full").alias("truncated"))
    every = pages.select("address").distinct().join(each, "address", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    refused = F.coalesce("refused", F.lit(False))
    return every.select("address", zero("pages"), zero("rows"), refused.alias("refused"), F.when(~refused, F.coalesce("truncated", F.lit(True))).alias("truncated"))


def harvest(pages: DataFrame, most: int, page_rows: int = PAGE_ROWS) -> DataFrame:
    """(address, raw): the rows of all histories that were not refused, as JSON for the normalisers. Rows that several pages or addresses show stay repeated; a warehouse union drops them."""
    used = used_pages(pages, most, page_rows)
    refused = used.where("refused").select("address").distinct()
    return used.join(refused, "address", "left_anti").select("address", F.explode("items").alias("raw"))


def left_to_fetch(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Addresses that no history holds: those without a page, and those refused."""
    return wanted.select("address").distinct().join(held.where("not refused and pages > 0").select("address"), "address", "left_anti")


def address_sets(*held: DataFrame) -> DataFrame:
    """(address, complete) of every address that one of these tables (address, truncated) has fetched: complete if one of them has its whole history.

    Rows whose truncated is null were refused, and fetch nothing. One table's repeated rows count once.
    """
    rows = reduce(DataFrame.unionByName, (h.select("address", "truncated") for h in held))
    return rows.where("address is not null and truncated is not null").groupBy("address").agg(F.max(~F.col("truncated")).alias("complete"))
