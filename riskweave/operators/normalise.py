"""Raw rows of explorers, event logs and address lists to transfers and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .prices import price_as_of
from .store import sent

# Symbols that count as dollars on either chain.
STABLE = ["USDT", "USDC", "TUSD", "USDD", "DAI", "FDUSD", "PYUSD"]
_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_valid(address: str | None) -> bool:
    """Base58 of 21 bytes beginning with 0x41 and a checksum of four."""
    if not address or len(address) != 34 or any(c not in _ALPHABET for c in address):
        return False
    n = 0
    for c in address:
        n = n * 58 + _ALPHABET.index(c)
    raw = n.to_bytes(26, "big")[-25:]
    return n < 1 << 200 and raw[0] == 0x41 and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


@F.pandas_udf(BooleanType())
def is_tron_address(x: pd.Series) -> pd.Series:
    return x.map(base58_valid)


def is_evm_address(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike("^0x[0-9a-f]{40}$"), F.lit(False))


OUT = ["chain", "tx_hash", "from_address", "to_address", "amount_usd", "asset", "block_time"]
_TRON = "type string, transaction_id string, `from` string, `to` string, value string, block_timestamp long, token_info struct<symbol:string,decimals:string>"
_BLOCKSCOUT = "transaction_hash string, timestamp string, `from` struct<hash:string>, `to` struct<hash:string>, total struct<value:string,decimals:string>, token struct<symbol:string,decimals:string>"
_ETHERSCAN = "hash string, timeStamp string, `from` string, `to` string, value string, contractAddress string, isError string, txreceipt_status string"


def _parsed(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """The fields of JSON rows, as a generator's output: of a plain projection Spark would parse the row anew for each field and each condition on one."""
    return raw.select(F.inline(F.array(F.from_json(column, schema))))


def _whole(value: Column, decimals: Column) -> Column:
    """An integer in a string, by its decimals; null if it is none."""
    return value.try_cast("decimal(38,0)").cast("double") / F.pow(F.lit(10.0), decimals)


def _decimals(default: int, *said: Column) -> Column:
    """The first decimals that are said, null if that is no number; `default` if none are."""
    first = F.coalesce(*said)
    return F.when(first.isNull(), default).otherwise(first.try_cast("int"))


def tron_transfers(raw: DataFrame, column: str = "raw", valid: Callable[[Column], Column] = is_tron_address) -> DataFrame:
    """Transfers of stable coins between valid addresses, from JSON rows; decimals are 6 unless said, and a row whose decimals are no number is left out."""
    r = _parsed(raw, column, _TRON)
    symbol = F.upper("token_info.symbol")
    usd = _whole(F.col("value"), _decimals(6, F.col("token_info.decimals")))
    rows = r.where((F.col("type") == "Transfer") & symbol.isin(STABLE)).where(valid(F.col("from")) & valid(F.col("to")))
    return rows.select(F.lit("tron").alias("chain"), F.col("transaction_id").alias("tx_hash"), F.col("from").alias("from_address"), F.col("to").alias("to_address"), usd.alias("amount_usd"), symbol.alias("asset"), F.col("block_timestamp").alias("block_time")).where("amount_usd is not null")


def blockscout_transfers(raw: DataFrame, column: str = "raw", stable: list[str] = STABLE) -> DataFrame:
    """Transfers by symbol; decimals are those of the amount, else of the token, else 18, times ISO, addresses in lower case."""
    r = _parsed(raw, column, _BLOCKSCOUT)
    usd = _whole(F.col("total.value"), _decimals(18, F.nullif(F.col("total.decimals"), F.lit("")), F.nullif(F.col("token.decimals"), F.lit(""))))
    at = F.unix_millis(F.try_to_timestamp("timestamp"))
    rows = r.where(F.upper("token.symbol").isin(stable))
    return rows.select(F.lit("ethereum").alias("chain"), F.col("transaction_hash").alias("tx_hash"), F.lower("from.hash").alias("from_address"), F.lower("to.hash").alias("to_address"), usd.alias("amount_usd"), F.upper("token.symbol").alias("asset"), at.alias("block_time")).where("amount_usd is not null and block_time is not null and from_address is not null and to_address is not null")


def etherscan_tokens(raw: DataFrame, contracts: DataFrame, column: str = "raw") -> DataFrame:
    """Transfers of known contracts (contract, asset, decimals): the contract, not a symbol, says which token it is."""
    r = _parsed(raw, column, _ETHERSCAN).withColumn("contract", F.lower("contractAddress"))
    rows = r.join(sent(contracts), "contract").withColumn("amount_usd", _whole(F.col("value"), F.col("decimals")))
    at = (F.col("timeStamp").try_cast("long") * 1000).alias("block_time")
    return rows.select(F.lit("ethereum").alias("chain"), F.col("hash").alias("tx_hash"), F.lower("from").alias("from_address"), F.lower("to").alias("to_address"), "amount_usd", "asset", at).where("amount_usd is not null and block_time is not null")


def etherscan_native(raw: DataFrame, candles: DataFrame, column: str = "raw") -> DataFrame:
    """Successful native transfers at the last closed candle's price; without a price they are left out."""
    r = _parsed(raw, column, _ETHERSCAN)
    ok = (F.coalesce("isError", F.lit("0")) == "0") & F.coalesce("txreceipt_status", F.lit("1")).isin("1", "")
    rows = r.where(ok).select(F.col("hash").alias("tx_hash"), F.lower("from").alias("from_address"), F.lower("to").alias("to_address"), _whole(F.col("value"), F.lit(18)).alias("eth"), (F.col("timeStamp").try_cast("long") * 1000).alias("block_time"))
    priced = price_as_of(rows.where("eth > 0 and to_address <> ''"), candles).where("price is not null")
    return priced.select(F.lit("ethereum").alias("chain"), "tx_hash", "from_address", "to_address", (F.col("eth") * F.col("price")).alias("amount_usd"), F.lit("ETH").alias("asset"), "block_time")


def log_addresses(logs: DataFrame, data: str = "data", time: str = "time") -> DataFrame:
    """(address, block_time) of event logs: the last 40 hex digits of the data, times in hex seconds."""
    hex_ = F.lower(F.regexp_replace(data, "^0x", ""))
    return logs.where(F.length(hex_) >= 40).select(F.concat(F.lit("0x"), F.substring(hex_, -40, 40)).alias("address"), (F.conv(F.regexp_replace(time, "^0x", ""), 16, 10).cast("long") * 1000).alias("block_time"))


def sanctioned(text: DataFrame, column: str = "value") -> DataFrame:
    """Distinct (currency, address) that a sanctions list names."""
    found = F.explode(F.regexp_extract_all(column, F.lit(r"(Digital Currency Address - \w+\s+[A-Za-z0-9]{25,60})"), 1))
    parts = F.regexp_extract
    rows = text.select(found.alias("x"))
    return rows.select(parts("x", r"Address - (\w+)", 1).alias("currency"), parts("x", r"([A-Za-z0-9]{25,60})$", 1).alias("address")).distinct()


def listed(text: DataFrame, column: str = "value", valid: Callable[[Column], Column] = is_tron_address) -> DataFrame:
    """Distinct (chain, address) that a community list mentions anywhere; EVM addresses in lower case."""
    tron = text.select(F.lit("tron").alias("chain"), F.explode(F.regexp_extract_all(column, F.lit("(T[1-9A-HJ-NP-Za-km-z]{33})"), 1)).alias("address"))
    evm = text.select(F.explode(F.regexp_extract_all(column, F.lit("(0x[0-9a-fA-F]{40})"), 1)).alias("address"))
    return tron.distinct().where(valid(F.col("address"))).unionByName(evm.select(F.lit("ethereum").alias("chain"), F.lower("address").alias("address")).distinct())


def earliest(old: DataFrame, new: DataFrame) -> DataFrame:
    """Freezes (address, block_time, tx_hash) of two reads: of each address the earliest, ties to the smaller hash."""
    return old.unionByName(new).groupBy("address").agg(F.min(F.struct("block_time", "tx_hash")).alias("x")).select("address", "x.*")


def usage_tally(events: DataFrame, band: str = "band", day: str = "day", who: str = "who") -> DataFrame:
    """(day, band, calls, browsers) of usage events."""
    return events.groupBy(day, band).agg(F.count("*").alias("calls"), F.count_distinct(who).alias("browsers"))
