"""Synthetic purchase lines with believable habits.

Every draw is a piece of a SHA-256 over (seed, purpose, id): a line comes out the same on
any cluster, in any partitioning and after any retry, and the same in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the sample: product types with their price ranges, fragrances, channels,
# discount rates and codes, and the first and last day.
PRICES = {
    "Body Lotion": (12.0, 16.0),
    "Laundry Soap": (14.0, 18.0),
    "Bath Bomb": (6.0, 9.0),
    "Body Butter": (14.0, 18.0),
    "Hand Soap": (8.0, 12.0),
    "Shower Oil": (12.0, 15.0),
    "Body Wash": (10.0, 14.0),
    "Sugar Scrub": (12.0, 16.0),
    "Candle": (16.0, 24.0),
    "Dryer Ball": (4.0, 6.0),
}
FRAGRANCES = (
    "Lavender", "Eucalyptus Mint", "Beach", "Coconut Cream", "Warm Vanilla",
    "Japanese Cherry Blossom", "Fresh Linen", "Peppermint", "Lemon Drop",
    "Brown Sugar Fig", "Grapefruit Mimosa", "Honeysuckle", "Rosemary Sage", "Unscented",
    "Mango Tango", "Cotton Candy",
)
CHANNELS = ("In-Store", "Online", "Mobile App", "Subscription")
DISCOUNT_RATES = (0.1, 0.15, 0.2, 0.25)
DISCOUNT_CODES = ("WELCOME10", "LOYALTY15", "BOGO20", "SEASONAL25", "VIP20")
FIRST_DAY, LAST_DAY = "2022-01-01", "2026-05-01"
PREFERRED_SHARE, CHANNEL_SHARE, DISCOUNT_SHARE = 0.7, 0.8, 0.2

# A SHA-256 is read as four numbers of 60 bits, each good for three draws of 20 bits or
# one of 40.
_SPAN = 1 << 20


def _number(hash_col: str, at: int) -> Column:
    return F.conv(F.substring(hash_col, 1 + 15 * at, 15), 16, 10).cast("bigint")


def _draw(number: str, slot: int) -> Column:
    """Slot 0, 1 or 2 of a 60-bit number as an integer below 2**20."""
    shifted = F.shiftright(F.col(number), 40 - 20 * slot) if slot < 2 else F.col(number)
    return shifted.bitwiseAND(F.lit(_SPAN - 1))


def _wide_draw(number: str) -> Column:
    """The upper 40 bits: room for more guests than 20 bits can tell apart."""
    return F.shiftright(F.col(number), 20)


def _pick(draw: Column, n: Column | int) -> Column:
    """0..n-1 from a draw."""
    return F.pmod(draw, F.lit(n) if isinstance(n, int) else n)


def _chance(draw: Column, share: float) -> Column:
    return draw < int(share * _SPAN)


def _choose(values: tuple, draw: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, _pick(draw, len(values)).cast("int"))


def _hash(seed: int, purpose: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}|{purpose}|"), key.cast("string")), 256)


def synthetic_lines(
    ids: DataFrame,
    n_guests: Column | int,
    id_col: str = "id",
    seed: int = 0,
    lines_per_order: int = 1,
) -> DataFrame:
    """One purchase line per row of ``ids`` (its key a non-negative whole number).

    Consecutive ids share an order, its guest, date and channel, if ``lines_per_order`` is
    above one. A guest has one to three preferred fragrances, used for 70 % of lines, and a
    primary channel, used for 80 % of orders; both follow from the guest number alone, so
    no guest table is joined.
    """
    n_guests = F.lit(n_guests) if isinstance(n_guests, int) else n_guests
    order_no = F.expr(f"`{id_col}` div {int(lines_per_order)}").cast("bigint")
    low = F.array(*[F.lit(p[0]) for p in PRICES.values()])
    width = F.array(*[F.lit(p[1] - p[0]) for p in PRICES.values()])
    days = F.datediff(F.lit(LAST_DAY).cast("date"), F.lit(FIRST_DAY).cast("date"))

    drawn = (
        ids.select(F.col(id_col).alias("line_no"), order_no.alias("order_no"))
        .withColumn("o", _hash(seed, "order", F.col("order_no")))
        .withColumn("l", _hash(seed, "line", F.col("line_no")))
        .withColumns(
            {
                "o0": _number("o", 0), "o1": _number("o", 1),
                "l0": _number("l", 0), "l1": _number("l", 1), "l2": _number("l", 2),
            }
        )
        .withColumn("guest_no", _pick(_wide_draw("o0"), n_guests) + 1)
        .withColumn("day", _pick(_draw("o0", 2), days + 1).cast("int"))
        .withColumn("g", _hash(seed, "guest", F.col("guest_no")))
        .withColumns({"g0": _number("g", 0), "g1": _number("g", 1)})
        .withColumn("kind", _pick(_draw("l0", 0), len(PRICES)).cast("int"))
    )
    # Preferred fragrances: a first position, and two steps that cannot meet it again.
    n = len(FRAGRANCES)
    first = _pick(_draw("g0", 1), n)
    second = F.pmod(first + 1 + _pick(_draw("g0", 2), n // 2 - 1), F.lit(n))
    third = F.pmod(first + n // 2 + _pick(_draw("g1", 0), n // 2), F.lit(n))
    preferred = F.get(
        F.array(first, second, third),
        _pick(_draw("l0", 2), _pick(_draw("g0", 0), 3) + 1).cast("int"),
    )
    scent = F.when(_chance(_draw("l0", 1), PREFERRED_SHARE), preferred).otherwise(
        _pick(_draw("l1", 0), n)
    )
    channel = F.when(
        _chance(_draw("o1", 0), CHANNEL_SHARE), _pick(_draw("g1", 1), len(CHANNELS))
    ).otherwise(_pick(_draw("o1", 1), len(CHANNELS)))
    price = F.floor(
        (F.get(low, F.col("kind")) + F.get(width, F.col("kind")) * _draw("l1", 1) / F.lit(float(_SPAN)))
        * 100 + 0.5
    ) / F.lit(100.0)
    discounted = _chance(_draw("l1", 2), DISCOUNT_SHARE)
    discount = F.floor(F.col("price") * _choose(DISCOUNT_RATES, _draw("l2", 0)) * 100 + 0.5) / F.lit(
        100.0
    )
    date = F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("day"))
    return drawn.withColumn("price", price).select(
        F.concat(
            F.lit("TX-"), F.date_format(date, "yyyyMMdd"), F.lit("-"),
            _padded(F.col("order_no"), 6),
        ).alias("transaction_id"),
        F.concat(F.lit("GUEST-"), _padded(F.col("guest_no"), 5)).alias("guest_id"),
        date.alias("transaction_date"),
        F.get(F.array(*[F.lit(k) for k in PRICES]), F.col("kind")).alias("product_type"),
        F.get(F.array(*[F.lit(f) for f in FRAGRANCES]), scent.cast("int")).alias("fragrance"),
        "price",
        F.when(discounted, discount).otherwise(0.0).alias("discount_amount"),
        F.when(discounted, _choose(DISCOUNT_CODES, _draw("l2", 1))).otherwise("").alias(
            "discount_code"
        ),
        F.get(F.array(*[F.lit(c) for c in CHANNELS]), channel.cast("int")).alias("channel"),
    )


def _padded(number: Column, width: int) -> Column:
    """Zero-padded to at least ``width`` digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(text))), text)


def synthetic_transactions(
    spark: SparkSession,
    n_rows: int = 50_000,
    n_guests: int = 5_000,
    lines_per_order: int = 1,
    seed: int = 0,
) -> DataFrame:
    return synthetic_lines(spark.range(n_rows), n_guests, "id", seed, lines_per_order)
