"""Security codes: conversion, boards, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions.numeric import any_of, col

# The canonical symbol shape and the board prefixes.
SYMBOL_PATTERN = r"^[0-9]{6}\.(SH|SZ)$"
STAR_PREFIXES = ("688", "689")
GROWTH_PREFIXES = ("300", "301")

# Factor-name prefix to category; anything else is "volume_price".
CATEGORIES = {
    "momentum": "momentum",
    "reversal": "reversal",
    "volatility": "volatility",
    "ivol": "volatility",
    "downside": "volatility",
    "overnight_reversal": "reversal",
    "intraday_momentum": "momentum",
    "amihud": "liquidity",
    "turnover": "liquidity",
    "book": "fundamental",
    "earnings": "fundamental",
}


def code_of(symbol: str | Column) -> Column:
    return F.split_part(col(symbol), F.lit("."), F.lit(1))


def vendor_to_symbol(code: str | Column) -> Column:
    """``sh.600000`` -> ``600000.SH``."""
    code = col(code)
    return F.concat_ws(".", F.split_part(code, F.lit("."), F.lit(2)), F.upper(F.split_part(code, F.lit("."), F.lit(1))))


def symbol_to_vendor(symbol: str | Column) -> Column:
    """``600000.SH`` -> ``sh.600000``."""
    symbol = col(symbol)
    return F.concat_ws(".", F.lower(F.split_part(symbol, F.lit("."), F.lit(2))), code_of(symbol))


def starts_with(text: Column, prefixes) -> Column:
    return any_of(text.startswith(p) for p in prefixes)


def board_allowed(symbol: str | Column, *, star: bool, growth: bool) -> Column:
    code = code_of(symbol)
    allowed = F.lit(True)
    if not star:
        allowed = allowed & ~starts_with(code, STAR_PREFIXES)
    if not growth:
        allowed = allowed & ~starts_with(code, GROWTH_PREFIXES)
    return allowed


def category_for(name: str | Column) -> Column:
    name = col(name)
    chain = None
    for prefix, category in CATEGORIES.items():
        test = name.startswith(prefix)
        chain = F.when(test, category) if chain is None else chain.when(test, category)
    return chain.otherwise("volume_price")
