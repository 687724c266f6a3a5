"""Sums of money that do not depend on the order in which rows arrive.

Adding doubles gives a slightly different total for every partitioning. An amount is therefore
rounded to a whole number of 1/10,000 currency unit (half up, on the stored binary value), and
these are added as decimals: exact, order-free, and without a ceiling that lines could reach
(30 digits). Finer amounts are rounded before they are added. One amount may be up to 9e14; a
larger one stops the job, whatever the ANSI setting.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = 10_000.0
LARGEST = 9e14


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_units(amount: Column | str) -> Column:
    """The amount in 1/10,000, as a whole number."""
    value = _col(amount)
    fits = value.isNull() | (F.abs(value) <= LARGEST)
    units = F.floor(value * UNITS + 0.5).cast("bigint")
    return F.when(fits, units).otherwise(F.raise_error(F.lit(f"an amount is above {LARGEST}")).cast("bigint"))


def units_sum(amount: Column | str) -> Column:
    """A partial sum in 1/10,000; partial sums may be added up again."""
    return F.sum(money_units(amount).cast("decimal(20,0)"))


def from_units(total: Column) -> Column:
    return (total * F.lit(Decimal("0.0001"))).cast("double")


def money_sum(amount: Column | str) -> Column:
    return from_units(units_sum(amount))


def money_avg(amount: Column | str) -> Column:
    """Average over the non-NULL amounts."""
    return money_sum(amount) / F.count(_col(amount))


def round_to(value: Column | str, digits: int) -> Column:
    """Half-up rounding of the double itself.

    ``F.round(x, n)`` rounds the shortest decimal text of ``x`` (1.005 becomes 1.01);
    scaling first rounds the stored binary value, as SQL engines with C doubles do.
    """
    scale = float(10**digits)
    return F.round(_col(value) * scale) / F.lit(scale)
