"""Which profile texts may be embedded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def score_profiles(
    df: DataFrame,
    text_col: str = "notes",
    threshold: float = 0.25,
    terms: Iterable[str] = tx.SCENT_TERMS,
    tone_words: Iterable[str] = tx.TONE_WORDS,
) -> DataFrame:
    """Add ``vocabulary_score`` and ``is_fluff``."""
    text = F.col(text_col)
    return df.withColumn("vocabulary_score", tx.vocabulary_score(text, terms)).withColumn(
        "is_fluff", tx.fluff_flag(text, threshold, terms, tone_words)
    )


def route_profiles(
    df: DataFrame,
    text_col: str = "notes",
    threshold: float = 0.25,
    terms: Iterable[str] = tx.SCENT_TERMS,
    tone_words: Iterable[str] = tx.TONE_WORDS,
) -> DataFrame:
    """Add ``route``: "review" for fluff, "accepted" for the rest; every text is scored once."""
    flag = tx.fluff_flag(F.col(text_col), threshold, terms, tone_words)
    return df.withColumn("route", F.when(flag, "review").otherwise("accepted"))


def quarantine_profiles(
    df: DataFrame,
    text_col: str = "notes",
    threshold: float = 0.25,
    terms: Iterable[str] = tx.SCENT_TERMS,
    tone_words: Iterable[str] = tx.TONE_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, review): every row goes to exactly one of the two."""
    flag = tx.fluff_flag(F.col(text_col), threshold, terms, tone_words)
    return df.filter(~flag), df.filter(flag)
