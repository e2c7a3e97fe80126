"""Declared table layouts. Nothing is inferred from CSV."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["trade_date", "symbol"]
PRICES = ["open", "high", "low", "close"]
ACTIVITY = ["volume", "amount"]
REQUIRED = KEYS + PRICES + ACTIVITY
STATES = ["is_st", "is_suspended", "is_limit_up", "is_limit_down"]
KNOWN = ["is_st_known", "is_suspended_known", "limit_status_known"]
NUMERIC = PRICES + ACTIVITY + ["adj_factor", "market_cap"]

BAR = T.StructType(
    [
        T.StructField("trade_date", T.DateType()),
        T.StructField("symbol", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in PRICES + ["preclose"] + ACTIVITY],
        T.StructField("priority", T.IntegerType()),
    ]
)

# The seven market fields two vendors are merged on, and the
# tolerance above which they count as different.
MERGE_FIELDS = ["open", "high", "low", "close", "preclose", "volume", "amount"]
PRICE_TOLERANCE = 0.011
ACTIVITY_TOLERANCE = 1.0

# Vendor A (text bars) column names.
VENDOR_A_NAMES = {
    "date": "trade_date",
    "turn": "turnover_rate",
    "peTTM": "pe_ttm",
    "pbMRQ": "pb_mrq",
    "psTTM": "ps_ttm",
    "pcfNcfTTM": "pcf_ncf_ttm",
}
VENDOR_A_NUMBERS = MERGE_FIELDS + ["turnover_rate", "pe_ttm", "pb_mrq", "ps_ttm", "pcf_ncf_ttm"]

# Vendor B (exchange archive) column names.
VENDOR_B_NAMES = {
    "trddt": "trade_date",
    "opnprc": "open",
    "hiprc": "high",
    "loprc": "low",
    "clsprc": "close",
    "precloseprice": "preclose",
    "dnshrtrd": "volume",
    "dnvaltrd": "amount",
    "limitup": "up_limit",
    "limitdown": "down_limit",
    "dsmvtll": "market_value_raw",
    "dsmvosd": "float_market_value_raw",
    "dretwd": "return_cash_reinvested",
    "dretnd": "return_ex_cash",
    "trdsta": "trading_status_raw",
}
