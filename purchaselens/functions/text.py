"""How much scent vocabulary a note profile holds, and whether it is mere advertising."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default scent vocabulary. Scores depend on exactly these terms.
SCENT_TERMS = (
    "rose", "jasmine", "lavender", "magnolia", "lily", "peony", "honeysuckle", "violet", "iris",
    "tuberose",
    "neroli", "ylang", "gardenia", "lilac", "freesia", "carnation", "hibiscus", "orchid",
    "cherry blossom",
    "sakura", "blossom", "petal", "petals", "floral", "bouquet",
    "lemon", "lime", "orange", "grapefruit", "bergamot", "mandarin", "tangerine", "yuzu",
    "citron", "citrus",
    "zest", "rind",
    "aquatic", "ocean", "sea", "salt", "marine", "ozone", "ozonic", "aldehyde", "aldehydes",
    "cotton", "linen",
    "clean", "crisp", "dewy", "morning", "breeze", "air", "airy",
    "sandalwood", "cedar", "cedarwood", "oud", "patchouli", "vetiver", "amber", "musk",
    "leather", "smoke",
    "smoky", "wood", "woody", "moss", "oakmoss", "earthy", "balsam", "fir", "pine",
    "vanilla", "caramel", "sugar", "sugary", "honey", "honeyed", "chocolate", "cocoa", "coffee",
    "almond",
    "marzipan", "cinnamon", "spice", "spicy", "nutmeg", "clove", "tonka", "praline", "bakery",
    "cream", "creamy",
    "buttercream", "syrup",
    "eucalyptus", "mint", "peppermint", "spearmint", "menthol", "rosemary", "sage", "thyme",
    "basil", "tea",
    "matcha", "chamomile", "verbena", "green", "grass", "leaf", "leaves", "fern", "botanical",
    "herbal", "aloe",
    "clover",
    "apple", "pear", "peach", "apricot", "plum", "berry", "strawberry", "raspberry",
    "blackberry", "blueberry",
    "currant", "cherry", "fig", "mango", "pineapple", "coconut", "guava", "passionfruit",
    "passion", "melon",
    "watermelon", "tropical", "juicy", "fruit", "fruity",
    "tart", "sweet", "bitter", "warm", "cool", "cooling", "fresh", "soft", "powdery", "rich",
    "deep", "light",
    "bright", "milky",
)

# Words of advertising tone.
TONE_WORDS = (
    "viral", "bestseller", "trending", "tiktok", "instagram", "luxury",
    "luxurious", "premium", "exclusive", "limited", "elite",
    "confidence", "energy", "unforgettable", "iconic", "signature",
    "celebrity", "influencer", "must-have", "obsession", "addictive",
    "elegant", "feminine", "masculine",
    "amazing", "incredible", "stunning", "perfect",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a literal phrase."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(phrase)))
    return (removed / F.lit(float(len(phrase)))).cast("int")


def vocabulary_score(text: Column, terms: Iterable[str] = SCENT_TERMS) -> Column:
    """Share of vocabulary in a text, between 0 and 1.

    Words are the runs of a-z in the lower-cased text. A term of several words counts each
    time it occurs as a phrase, on top of whatever its single words score. Blank or NULL
    text and text without words score 0.
    """
    terms = list(terms)
    words = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]

    def score(lower: Column, tokens: Column) -> Column:
        # A long IN list over literals becomes a hash lookup.
        hits = F.size(F.filter(tokens, lambda t: t.isin(words))) if words else F.lit(0)
        hits = reduce(lambda total, p: total + _occurrences(lower, p), phrases, hits)
        share = hits / F.size(tokens).cast("double")
        return F.when(F.size(tokens) > 0, F.least(F.lit(1.0), share))

    found = _let(
        F.lower(text),
        lambda low: _let(
            F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda tokens: score(low, tokens)
        ),
    )
    return F.coalesce(found, F.lit(0.0))


def fluff_flag(
    text: Column,
    threshold: float = 0.25,
    terms: Iterable[str] = SCENT_TERMS,
    tone_words: Iterable[str] = TONE_WORDS,
) -> Column:
    """True for a blank text, or one that is poor in vocabulary and has a tone word in it."""
    tone_words = list(tone_words)
    tone = _let(
        F.lower(text),
        lambda low: reduce(
            lambda seen, w: seen | F.contains(low, F.lit(w)), tone_words, F.lit(False)
        ),
    )
    blank = text.isNull() | ~text.rlike(r"\S")
    # The tone test is a plain substring search, so it goes first: a text that fails it is
    # never split into words.
    return F.when(blank, True).otherwise(tone & (vocabulary_score(text, terms) < threshold))
