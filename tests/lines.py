"""Small purchase tables and what plain Python makes of them."""

from __future__ import annotations

import datetime
import random

from purchaselens.schema import TRANSACTIONS

D = datetime.date


def frame(spark, rows, parts=None):
    df = spark.createDataFrame(rows, TRANSACTIONS)
    return df.repartition(parts) if parts else df


def line(tx, guest, day, kind, scent, price=14.0, discount=0.0, code=None, channel="Online"):
    return (tx, guest, D.fromisoformat(day), kind, scent, price, discount, code, channel)


def random_lines(n=400, guests=12, seed=1, hot=0.34):
    """Lines with NULLs, empties and repeated orders; one guest holds a third of them."""
    rng = random.Random(seed)
    kinds = ["Body Lotion", "Laundry Soap", "Candle", "Body Wash"]
    scents = ["Lavender", "Beach", "Lemon Drop", "Fresh Linen", "Honey", None, ""]
    rows = []
    for _ in range(n):
        guest = "HOT" if rng.random() < hot else rng.choice([f"G{i}" for i in range(guests)] + [None])
        rows.append(
            (
                "T-HOT" if rng.random() < hot else rng.choice([f"T{i}" for i in range(n // 3)] + [None]),
                guest,
                D(2025, 1, 1) + datetime.timedelta(days=rng.randrange(120)),
                rng.choice(kinds),
                rng.choice(scents),
                rng.randrange(400, 2400) / 100,
                rng.choice([None, 0.0, 1.25, 2.5]),
                rng.choice([None, "", "VIP20"]),
                rng.choice(["Online", "In-Store", None]),
            )
        )
    return rows


PAIRS = [("Lavender", "Beach", 0.7), ("Beach", "Lavender", 0.7), ("Beach", "Honey", 0.65),
         ("Honey", "Beach", 0.65), ("Lemon Drop", "Unsold", 0.9), ("Unsold", "Lemon Drop", 0.9)]


def pair_frame(spark, pairs=PAIRS):
    return spark.createDataFrame(pairs, "a string, b string, similarity double")
