"""Validity rules.

A rule is data: the shape a text must have, what it may not contain, how long it may be and which
values are allowed. The same rule refuses a parameter on the driver (``check``) and marks a
column in a job (``column``).
"""

from __future__ import annotations

import calendar
import datetime
import re
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The product types a parameter may name unless the caller gives others.
PRODUCT_TYPES = (
    "Body Lotion", "Laundry Soap", "Bath Bomb", "Body Butter", "Hand Soap",
    "Shower Oil", "Body Wash", "Sugar Scrub", "Candle", "Dryer Ball",
)

# What no item name may contain, how long it may be, and the shapes of the rest.
NAME_BLOCKED = ("'", '"', ";", "--", "/*", "*/", "\\")
NAME_MAX = 100
GUEST_PATTERN = "[A-Za-z0-9_-]{1,64}"
INT_PATTERN = "-?[0-9]+"
TABLE_PATTERN = "[A-Za-z][A-Za-z0-9_]{0,62}"


class InvalidInput(ValueError):
    """A parameter was refused; no query has been run."""


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@dataclass(frozen=True)
class TextRule:
    """What a text must look like; unset parts admit everything."""

    kind: str
    shape: str | None = None
    blocked: tuple[str, ...] = ()
    longest: int | None = None
    allowed: frozenset[str] | None = None

    def faults(self, value: str) -> list[str]:
        found = [f"holds {part!r}" for part in self.blocked if part in value]
        if self.shape is not None and not re.fullmatch(self.shape, value):
            found.append("has another shape")
        if self.longest is not None and len(value) > self.longest:
            found.append(f"has more than {self.longest} characters")
        if self.allowed is not None and value not in self.allowed:
            found.append("is not among the known ones")
        return found

    def check(self, value, field: str | None = None) -> str:
        found = self.faults(value) if isinstance(value, str) else ["is not text"]
        if found:
            raise InvalidInput(f"{field or self.kind}: as {self.kind}, {value!r} {', '.join(found)}")
        return value

    def column(self, col: Column) -> Column:
        """True where the text obeys the rule; NULL does not."""
        parts = [~F.contains(col, F.lit(part)) for part in self.blocked]
        if self.shape is not None:
            parts.append(col.rlike(rf"\A(?:{self.shape})\z"))
        if self.longest is not None:
            parts.append(F.length(col) <= self.longest)
        if self.allowed is not None:
            parts.append(col.isin(sorted(self.allowed)))
        return _sure(reduce(lambda a, b: a & b, parts, col.isNotNull()))


CATEGORY = TextRule("category", allowed=frozenset(PRODUCT_TYPES))
ITEM_NAME = TextRule("item name", blocked=NAME_BLOCKED, longest=NAME_MAX)
GUEST_ID = TextRule("guest id", shape=GUEST_PATTERN)
TABLE_NAME = TextRule("table name", shape=TABLE_PATTERN)
# Months and days by their digits, so that only the length of a month is left to reckon.
_DATE = TextRule("date", shape="(?!0000)[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])")
_INT = TextRule("integer", shape=INT_PATTERN)


def categories(allowed: Iterable[str] | None = PRODUCT_TYPES) -> TextRule:
    """``None`` admits any text; values never enter SQL text either way."""
    return replace(CATEGORY, allowed=None if allowed is None else frozenset(allowed))


# -- parameters ----------------------------------------------------------------------------


def check_category(value, allowed: Iterable[str] | None = PRODUCT_TYPES, field: str | None = None) -> str:
    return categories(allowed).check(value, field)


def check_item_name(value, field: str | None = None) -> str:
    return ITEM_NAME.check(value, field)


def check_guest_id(value, field: str | None = None) -> str:
    return GUEST_ID.check(value, field)


def check_table_name(value) -> str:
    return TABLE_NAME.check(value)


def check_date(value, field: str = "date") -> datetime.date:
    year, month, day = map(int, _DATE.check(value, field).split("-"))
    if day > calendar.monthrange(year, month)[1]:
        raise InvalidInput(f"{field} {value!r} is not in the calendar")
    return datetime.date(year, month, day)


def check_int(value, field: str = "value", low: int | None = None, high: int | None = None) -> int:
    """An int, or text of digits with an optional minus; white space around it is fine."""
    text = str(value).strip() if type(value) in (int, str) else value
    number = int(_INT.check(text, field))
    for bound, word, beyond in ((low, "below", -1), (high, "above", 1)):
        if bound is not None and (number - bound) * beyond > 0:
            raise InvalidInput(f"{field}: {number} is {word} {bound}")
    return number


# -- columns -------------------------------------------------------------------------------


def valid_date(col: Column) -> Column:
    """YYYY-MM-DD and in the calendar: the day is compared with the length of its month, since
    parsing a wrong date would raise and catch an exception per row."""
    first = F.concat(F.substring(col, 1, 7), F.lit("-01")).try_cast("date")
    return _sure(_DATE.column(col) & (F.substring(col, 9, 2).try_cast("int") <= F.day(F.last_day(first))))


def valid_category(col: Column, allowed: Iterable[str] = PRODUCT_TYPES) -> Column:
    return categories(allowed).column(col)


def valid_item_name(col: Column) -> Column:
    return ITEM_NAME.column(col)


def valid_guest_id(col: Column) -> Column:
    return GUEST_ID.column(col)


def valid_int(col: Column, low: int | None = None, high: int | None = None) -> Column:
    """Text that is an optional minus and digits, within the bounds."""
    stripped = F.regexp_replace(col, r"\A\s+|\s+\z", "")
    number = stripped.try_cast("decimal(38,0)")
    bounds = [number >= F.lit(low)] if low is not None else []
    bounds += [number <= F.lit(high)] if high is not None else []
    return _sure(reduce(lambda a, b: a & b, bounds, _INT.column(stripped)))
