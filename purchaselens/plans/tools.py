"""Checked entry to the questions about cohorts and similar items.

Callers that hold only strings (a command line, a web form, a chat) come in here: every value is
checked on the driver before any work, and a bad one is refused instead of answered with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.guards import (
    PRODUCT_TYPES, InvalidInput, check_category, check_date, check_int, check_item_name,
)
from ..operators import cohort, similarity
from ..sources import sinks


@dataclass(frozen=True)
class Data:
    """What the questions are asked of."""

    lines: DataFrame
    pairs: DataFrame | None = None
    index: similarity.ItemIndex | None = None
    export_folder: str | None = None


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    params: dict[str, str]  # name -> kind
    needs: tuple[str, ...] = ("lines",)


_COHORT = {"category": "category", "start": "date", "end": "date"}
_PAIR = {"cat_a": "category", "cat_b": "category", "start": "date", "end": "date"}


def _export(data: Data, category, start, end, name) -> DataFrame:
    guests = cohort.cohort_guests(data.lines, category, start, end)
    return sinks.export_segment(guests, name, data.export_folder)


TOOLS = {
    "cohort_stats": Tool(lambda d, **p: cohort.cohort_stats(d.lines, **p), _COHORT),
    "cohort_top_fragrances": Tool(
        lambda d, **p: cohort.cohort_top_fragrances(d.lines, **p), {**_COHORT, "n": "count"}
    ),
    "cohort_channel_mix": Tool(lambda d, **p: cohort.cohort_channel_mix(d.lines, **p), _COHORT),
    "cross_sell_similar": Tool(
        lambda d, **p: cohort.cross_sell_similar(d.lines, d.pairs, **p), _PAIR, ("lines", "pairs")
    ),
    "cross_sell_recommendation": Tool(
        lambda d, **p: cohort.cross_sell_recommendation(d.lines, d.pairs, **p),
        {**_PAIR, "threshold": "share"}, ("lines", "pairs"),
    ),
    "find_similar": Tool(
        lambda d, **p: similarity.find_similar_checked(d.index, **p),
        {"item": "item", "top_n": "count", "threshold": "share"}, ("index",),
    ),
    "export_cohort": Tool(_export, {**_COHORT, "name": "item"}, ("lines", "export_folder")),
}


def _share(value, field: str) -> float:
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise InvalidInput(f"{field}: {value!r} is no number") from None
    if not 0 <= number <= 1:
        raise InvalidInput(f"{field}: {number} is not between 0 and 1")
    return number


def run_tool(
    data: Data, name: str, params: dict[str, object], categories: Iterable[str] | None = PRODUCT_TYPES
) -> DataFrame:
    """Check every value, then ask; nothing runs if one is refused."""
    if name not in TOOLS:
        raise InvalidInput(f"unknown tool {name!r}; known: {', '.join(sorted(TOOLS))}")
    tool = TOOLS[name]
    if set(params) != set(tool.params):
        raise InvalidInput(f"{name} takes {sorted(tool.params)}, got {sorted(params)}")
    missing = [n for n in tool.needs if getattr(data, n) is None]
    if missing:
        raise InvalidInput(f"{name} needs {', '.join(missing)}")
    kinds = {
        "category": lambda v, field: check_category(v, categories, field),
        "date": check_date,
        "item": lambda v, field: check_item_name(v, field),
        "count": lambda v, field: check_int(v, field, low=1),
        "share": _share,
    }
    return tool.run(data, **{n: kinds[kind](params[n], n) for n, kind in tool.params.items()})
