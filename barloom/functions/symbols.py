"""Ticker text: markets, currencies, codes, list parsing, snapshot keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange suffixes and what they stand for.
SUFFIX_KOSPI = ".KS"
SUFFIX_KOSDAQ = ".KQ"
MARKETS = {"KOSPI": SUFFIX_KOSPI, "KOSDAQ": SUFFIX_KOSDAQ}
MARKET_LABELS = {
    "en": {SUFFIX_KOSPI: "KOSPI", SUFFIX_KOSDAQ: "KOSDAQ"},
    "ko": {SUFFIX_KOSPI: "코스피", SUFFIX_KOSDAQ: "코스닥"},
}
BARE_CODE = r"^[0-9]{6}$"
LISTED_SYMBOL = r"^[0-9]{6}\.(KS|KQ)$"


def is_korean(symbol: Column) -> Column:
    return symbol.endswith(SUFFIX_KOSPI) | symbol.endswith(SUFFIX_KOSDAQ)


def country_of(symbol: Column) -> Column:
    return F.when(is_korean(symbol), "KR").otherwise("US")


def currency_of(symbol: Column) -> Column:
    return F.when(is_korean(symbol), "KRW").otherwise("USD")


def market_label(symbol: Column, language: str = "ko") -> Column:
    names = MARKET_LABELS["en" if language == "en" else "ko"]
    return (
        F.when(symbol.endswith(SUFFIX_KOSPI), names[SUFFIX_KOSPI])
        .when(symbol.endswith(SUFFIX_KOSDAQ), names[SUFFIX_KOSDAQ])
        .otherwise("")
    )


def bare_code(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\.(KS|KQ)$", "")


def padded_code(raw: Column) -> Column:
    """Listing code as six digits: trimmed, a trailing ".0" dropped, zero-filled.

    Codes longer than six characters stay whole (lpad alone would cut them).
    """
    code = F.regexp_replace(F.trim(raw.cast("string")), r"\.0$", "")
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def split_tickers(text: Column) -> Column:
    """Comma list to an array of trimmed upper-case tickers, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")


def iso_day(raw: Column) -> Column:
    """Leading YYYY-MM-DD of a text, "" when there is none."""
    return F.coalesce(F.regexp_extract(F.trim(raw), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))


def day_part(raw: Column) -> Column:
    """Text before the first blank."""
    return F.split(raw, " ")[0]


def checked_day(text: str | None) -> str | None:
    """A user-given ISO date, or None when it is not one (bad dates are ignored)."""
    if text is None:
        return None
    text = text.strip()
    return text if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None
