"""Price repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POUNDS_UP_TO = 10.0
TENTHS_FROM = 1000.0


def repair_unit(price: Column) -> Column:
    """Bring a price to pence: pounds are scaled up, tenths of a penny down.

    Both bounds are inclusive and one rule at most applies, so apply it once only:
    10.0 becomes 1000.0, and a second pass would turn that into 100.0.
    """
    return (
        F.when(price <= POUNDS_UP_TO, price * 100.0)
        .when(price >= TENTHS_FROM, price / 10.0)
        .otherwise(price)
    )
