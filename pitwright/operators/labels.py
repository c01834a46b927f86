"""What came after: the only operators that look ahead. Never an input of a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwright.operators.features import by_symbol


def forward_returns(panel: DataFrame, horizons: tuple[int, ...], *, gap: int = 1) -> DataFrame:
    """panel with fwd_h: the return over h quotations that starts `gap` after the row's own."""
    price = lambda n: F.lead("adj_close", n).over(by_symbol())
    return panel.withColumns({f"fwd_{h}": F.try_divide(price(h + gap), price(gap)) - 1 for h in horizons})
