"""Vocabulary scores and advertising flags of whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from purchaselens.operators import quality as q

from .tables import read, sql

# Words and phrases that occur in the supplied prose, in place of scent terms; and common
# word parts in place of advertising words.
TERMS = ("the", "that", "and", "une", "le", "les", "der", "und", "los", "que", "in the", "le un")
TONE = ("ther", "ion", "ung")
THRESHOLD = 0.06


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def scored(table, key):
    words = [t for t in TERMS if " " not in t]
    phrases = " + ".join(
        f"(length(low) - length(replace(low, '{p}', ''))) // {len(p)}" for p in TERMS if " " in p
    )
    tone = " OR ".join(f"contains(low, '{w}')" for w in TONE)
    return f"""tokens AS (
  SELECT {key}, text, lower(text) AS low, regexp_extract_all(lower(text), '[a-z]+') AS words
  FROM {table})""", f"""scored AS (
  SELECT {key}, text,
         CASE WHEN text IS NULL OR len(words) = 0 THEN CAST(0 AS DOUBLE)
              ELSE LEAST(CAST(1 AS DOUBLE),
                (len(list_filter(words, lambda w: list_contains({_list(words)}, w))) + {phrases})
                / CAST(len(words) AS DOUBLE)) END AS score,
         COALESCE({tone}, FALSE) AS tone FROM tokens)""", f"""flagged AS (
  SELECT {key}, score, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN TRUE
                     ELSE score < {THRESHOLD} AND tone END AS fluff FROM scored)"""


def vocabulary_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return q.score_profiles(docs, "text", THRESHOLD, TERMS, TONE).select(
        "doc_id", F.round("vocabulary_score", 9).alias("vocabulary_score")
    )


def fluff_flag(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").withColumn(
        "key", F.concat_ws("-", "conv_id", "turn")
    )
    return q.score_profiles(turns, "text", THRESHOLD, TERMS, TONE).select("key", "is_fluff")


def quarantine_profiles(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return q.route_profiles(docs, "text", THRESHOLD, TERMS, TONE).select("doc_id", "route")


TURNS = "(SELECT conv_id || '-' || turn AS key, text FROM conversations)"

QUERIES = {
    "vocabulary_score": (
        vocabulary_score,
        sql(*scored("documents", "doc_id"),
            select="SELECT doc_id, ROUND(score, 9) AS vocabulary_score FROM scored"),
    ),
    "fluff_flag": (
        fluff_flag,
        sql(*scored(TURNS, "key"), select="SELECT key, fluff AS is_fluff FROM flagged"),
    ),
    "quarantine_profiles": (
        quarantine_profiles,
        sql(*scored("documents", "doc_id"), select="""
SELECT doc_id, CASE WHEN fluff THEN 'review' ELSE 'accepted' END AS route FROM flagged"""),
    ),
}
