"""Currency and fee expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_currency(ccy: Column) -> tuple[Column, Column]:
    """(currency, factor): pence quotes are pounds at 0.01, everything else is upper-cased."""
    code = F.upper(F.trim(F.coalesce(ccy, F.lit(""))))
    pence = code.isin("GBX", "GBP0", "PENCE")
    return F.when(pence, "GBP").otherwise(code), F.when(pence, 0.01).otherwise(1.0)


def after_fee(r: Column, annual_fee: float, periods: int = 52) -> Column:
    return r if not annual_fee else (1 + r) * (1.0 - ((1.0 + annual_fee) ** (1.0 / periods) - 1.0)) - 1


def row_key(isin: Column, code: Column, symbol: Column) -> Column:
    return F.coalesce(F.nullif(isin, F.lit("")), F.nullif(code, F.lit("")), symbol)
