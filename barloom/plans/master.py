"""Symbol master: listings of two markets, and the active universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.symbols import LISTED_SYMBOL, MARKETS, padded_code
from barloom.operators.series import keep_first
from barloom.sources.files import resolve_columns

# Spellings of listing columns.
CODE_NAMES = ["Symbol", "Code", "symbol", "code"]
TITLE_NAMES = ["Name", "name", "Company", "company"]


def symbol_master(listings: dict[str, DataFrame]) -> DataFrame:
    """market, ticker, symbol, name_ko from one listing per market; one row per symbol, valid symbols only."""
    parts = []
    for position, (market, suffix) in enumerate(MARKETS.items()):
        if market not in listings:
            continue
        listing = listings[market]
        used = resolve_columns(listing.columns, {"code": CODE_NAMES, "title": TITLE_NAMES})
        code = padded_code(F.col(used["code"]))
        title = F.trim(F.col(used["title"]).cast("string"))
        parts.append(
            listing.select(
                F.lit(market).alias("market"),
                code.alias("ticker"),
                F.concat(code, F.lit(suffix)).alias("symbol"),
                F.coalesce(title, F.lit("")).alias("name_ko"),
                F.lit(position).alias("_position"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.where(F.col("symbol").rlike(LISTED_SYMBOL))
    unique = keep_first(rows, ["symbol"], ["_position", "name_ko"])
    return unique.select("market", "ticker", "symbol", "name_ko").orderBy("market", "ticker")


def active_universe(codes: DataFrame, listing: DataFrame, fallback: Column) -> DataFrame:
    """symbol, company_name, sector, is_active: codes joined to listing details, name from ``fallback`` if blank."""
    wanted = codes.select(padded_code(F.col("code")).alias("symbol"), fallback.alias("_fallback"))
    wanted = keep_first(wanted, ["symbol"], ["_fallback"])
    details = keep_first(
        listing.select(padded_code(F.col("symbol")).alias("symbol"), "company_name", "sector"),
        ["symbol"],
        ["company_name", "sector"],
    )
    joined = wanted.join(details, "symbol", "left")
    return joined.select(
        "symbol",
        F.coalesce(F.nullif(F.trim("company_name"), F.lit("")), F.col("_fallback")).alias("company_name"),
        "sector",
        F.lit(True).alias("is_active"),
    ).orderBy("symbol")


def distinct_in_order(symbols: DataFrame, column: str = "symbol", position: str = "pos") -> DataFrame:
    """Distinct symbols in order of first appearance."""
    return symbols.groupBy(column).agg(F.min(position).alias(position)).orderBy(position)
