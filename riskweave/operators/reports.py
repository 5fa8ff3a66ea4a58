"""Label sources as texts of any number of files, and their union with where each report comes from.

A source is a table of texts (column `value`): JSON files a row each, as `spark.read.text(path, wholetext=True)`
gives them, or lines of a list. A text that is no JSON, null or of another shape holds no reports.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalise import is_evm_address, is_tron_address, listed, sanctioned

REPORT = ["address", "chain", "source", "reported_at", "category", "weight"]
# Sources by name with the category and the weight of what they report.
SOURCES = {
    "tether_freeze": ("frozen_by_issuer", 1.0), "tether_freeze_eth": ("frozen_by_issuer", 1.0), "ofac_sdn": ("sanctioned", 1.0),
    "cryptoscamdb": ("reported_scam", 0.5), "scamsniffer": ("phishing", 0.5), "mew_darklist": ("reported_scam", 0.5),
}
COMMENT = 60  #: characters of a comment that make a category


def entries(texts: DataFrame, of: str, column: str = "value") -> DataFrame:
    """The elements (x, of a type) of the JSON arrays that these texts are."""
    return texts.select(F.explode(F.from_json(column, f"array<{of}>")).alias("x"))


def as_reports(rows: DataFrame, source: str, chain: Column, at: Column | None = None, category: Column | None = None) -> DataFrame:
    usual, weight = SOURCES[source]
    at = F.lit(None).cast("long") if at is None else at.cast("long")
    category = F.lit(usual) if category is None else F.coalesce(F.nullif(category, F.lit("")), F.lit(usual))
    return rows.select("address", chain.alias("chain"), F.lit(source).alias("source"), at.alias("reported_at"), category.alias("category"), F.lit(weight).alias("weight"))


def issuer_freezes(texts: DataFrame, valid: Callable[[Column], Column] = is_tron_address) -> DataFrame:
    """Reports of the issuer's freeze list, [{address, block_time, tx_hash}], that name a valid Tron address; one an entry."""
    rows = entries(texts, "struct<address:string,block_time:long>").select("x.*")
    return as_reports(rows.where(valid(F.col("address"))), "tether_freeze", F.lit("tron"), F.col("block_time"))


def issuer_freezes_evm(texts: DataFrame) -> DataFrame:
    """The same on Ethereum, addresses in lower case; an entry without a time is undated."""
    rows = entries(texts, "struct<address:string,block_time:long>").select(F.lower("x.address").alias("address"), "x.block_time")
    return as_reports(rows.where(is_evm_address(F.col("address"))), "tether_freeze_eth", F.lit("ethereum"), F.col("block_time"))


def sanctions(texts: DataFrame, valid: Callable[[Column], Column] = is_tron_address) -> DataFrame:
    """Reports of addresses on either chain that a sanctions list names, each once, written as there."""
    rows = sanctioned(texts).select("address").distinct()
    chain = F.when(valid(F.col("address")), "tron").when(is_evm_address(F.col("address")), "ethereum")
    rows = rows.withColumn("chain", chain).where("chain is not null")
    return as_reports(rows, "ofac_sdn", F.col("chain"))


def community(texts: DataFrame, valid: Callable[[Column], Column] = is_tron_address) -> DataFrame:
    """Reports of addresses that a community list mentions anywhere, each once."""
    return as_reports(listed(texts, valid=valid), "cryptoscamdb", F.col("chain"))


def phishing(texts: DataFrame) -> DataFrame:
    """Reports of a list of plain addresses; entries that are none, or no strings, are left out."""
    rows = entries(texts, "string").select(F.lower("x").alias("address"))
    return as_reports(rows.where(is_evm_address(F.col("address"))), "scamsniffer", F.lit("ethereum"))


def darklist(texts: DataFrame) -> DataFrame:
    """Reports of a list of {address, comment}: the comment's first characters are the category."""
    rows = entries(texts, "struct<address:string,comment:string>").select(F.lower("x.address").alias("address"), F.substring("x.comment", 1, COMMENT).alias("comment"))
    return as_reports(rows.where(is_evm_address(F.col("address"))), "mew_darklist", F.lit("ethereum"), category=F.col("comment"))


READERS: dict[str, Callable[..., DataFrame]] = {
    "tether_freeze": issuer_freezes, "tether_freeze_eth": issuer_freezes_evm, "ofac_sdn": sanctions,
    "cryptoscamdb": community, "scamsniffer": phishing, "mew_darklist": darklist,
}
_TRON = {"tether_freeze", "ofac_sdn", "cryptoscamdb"}


def collect_reports(texts: dict[str, DataFrame], valid: Callable[[Column], Column] = is_tron_address) -> DataFrame:
    """REPORT columns of all given sources (name -> texts), one after the other; what two sources say stays two reports."""
    unknown = set(texts) - set(SOURCES)
    if unknown or not texts:
        raise ValueError(f"no such sources: {sorted(unknown)}" if unknown else "no sources")
    return reduce(DataFrame.unionByName, (READERS[s](t, valid) if s in _TRON else READERS[s](t) for s, t in texts.items()))
