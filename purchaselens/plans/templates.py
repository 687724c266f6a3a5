"""Named reports with checked text parameters, for callers that hold only strings."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.guards import PRODUCT_TYPES, InvalidInput, check_category, check_date, check_int
from ..operators import reports


@dataclass(frozen=True)
class Template:
    report: Callable[..., DataFrame]
    # Parameter name -> (argument of the report, kind of value).
    params: dict[str, tuple[str, str]]
    question: str


_RANGE = {"start_date": ("start", "date"), "end_date": ("end", "date")}

TEMPLATES = {
    "cross_sell_fragrance": Template(
        reports.cross_sell_exact,
        {"cat_a": ("cat_a", "category"), "cat_b": ("cat_b", "category"), **_RANGE},
        "Who bought A and B in exactly the same fragrance?",
    ),
    "category_affinity": Template(
        reports.category_affinity,
        {"category": ("category", "category"), **_RANGE},
        "What else do buyers of a category buy?",
    ),
    "fragrance_loyalty": Template(
        reports.fragrance_loyalty, _RANGE, "Who keeps one fragrance across product types?"
    ),
    "discount_impact": Template(
        reports.discount_impact, _RANGE, "How do discounted and full-price purchases differ?"
    ),
    "channel_performance": Template(
        reports.channel_performance, _RANGE, "What does each channel bring?"
    ),
    "repeat_buyers": Template(
        reports.repeat_buyers,
        {**_RANGE, "min_purchases": ("min_purchases", "count")},
        "Who buys often, how recently, for how much?",
    ),
    "fragrance_popularity": Template(
        reports.fragrance_popularity, _RANGE, "Which fragrances sell in each product type?"
    ),
    "market_basket": Template(
        reports.market_basket, _RANGE, "Which product types share a transaction?"
    ),
}


def run_template(
    transactions: DataFrame,
    name: str,
    params: dict[str, object],
    categories: Iterable[str] | None = PRODUCT_TYPES,
) -> DataFrame:
    """Check every parameter, then build the report; nothing runs if one is refused."""
    if name not in TEMPLATES:
        raise InvalidInput(f"unknown template {name!r}; known: {', '.join(sorted(TEMPLATES))}")
    template = TEMPLATES[name]
    missing = sorted(set(template.params) - set(params))
    extra = sorted(set(params) - set(template.params))
    if missing or extra:
        raise InvalidInput(f"template {name!r}: missing {missing}, unexpected {extra}")
    checks = {
        "category": lambda v, field: check_category(v, categories, field),
        "date": check_date,
        "count": lambda v, field: check_int(v, field, low=1),
    }
    arguments = {
        argument: checks[kind](params[field], field)
        for field, (argument, kind) in template.params.items()
    }
    return template.report(transactions, **arguments)
