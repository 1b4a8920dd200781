"""Expected price shown for a hotspot: average revenue plus average tip,
rounded half up to whole dollars (``-2.5 -> -2``, ``2.5 -> 3``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_price(avg_revenue: Column | str, avg_tip: Column | str) -> Column:
    rev = F.col(avg_revenue) if isinstance(avg_revenue, str) else avg_revenue
    tip = F.col(avg_tip) if isinstance(avg_tip, str) else avg_tip
    return F.floor(rev + tip + F.lit(0.5)).cast("bigint")
