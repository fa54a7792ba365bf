"""Named lists: fixed ones as plain values, shaped ones by rule, ranked ones by what is known before each month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names of the fixed lists.
LISTS: dict[str, list[str]] = {
    "etf_core": "SPY QQQ IWM DIA XLK XLF XLE XLV XLY XLP XLI XLB XLU XLRE SMH KRE GLD SLV GDX USO UNG DBC DBA CPER TLT IEF SHY HYG LQD TIP EEM EFA EWZ FXI".split(),
    "fx_majors": "EUR/USD GBP/USD USD/JPY USD/CHF AUD/USD USD/CAD NZD/USD".split(),
    "stockhunt_etfs": "SPY QQQ IWM TLT XLF GLD EFA DIA XLV XLE".split(),
    "stockhunt_crypto": "BTC ETH BNB XRP SOL DOGE ADA TRX AVAX LINK XMR BCH XLM VET DOT ATOM HBAR UNI XTZ LTC".split(),
    "stockhunt_commodities": "XAU/USD XAG/USD XPT/USD XPD/USD WTI/USD".split(),
    "cme_futures": "GC SI PL PA CL HG".split(),
}
COMMODITIES = LISTS["stockhunt_commodities"]


def listed(name: str, stored: DataFrame) -> DataFrame:
    """(list, place, symbol) of a fixed list's names that are stored. stored: symbol."""
    names = stored.sparkSession.createDataFrame([(name, i, s) for i, s in enumerate(LISTS[name])], "list string, place int, symbol string")
    return stored.select("symbol").distinct().join(F.broadcast(names), "symbol").select("list", "place", "symbol")  # a list's names


def pairs(stored: DataFrame) -> DataFrame:
    """Symbols spelled like currency pairs that are no commodities."""
    return stored.select("symbol").distinct().where(F.col("symbol").rlike("^[A-Z]{3}/[A-Z]{3}$") & ~F.col("symbol").isin(COMMODITIES))


def refused(asked: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of asked(list), those that are not allowed(list)."""
    return asked.select("list").distinct().join(allowed.select("list"), "list", "left_anti")
