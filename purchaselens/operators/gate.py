"""May a recommendation be made on this evidence?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that promise a result instead of proposing a test, in the order in
# which they are looked for.
PROMISES = (
    "will increase",
    "will boost",
    "will drive",
    "guarantees",
    "guaranteed",
    "100%",
)

# Fixed values: (confidence, least overlap, least similarity threshold), best first.
CONFIDENCE = (("high", 50, 0.7), ("medium", 20, 0.6))

OPTIONAL = {
    "similarity_threshold": "double",
    "baseline_rate": "double",
    "lift": "double",
    "recommendation": "string",
    "fragrance_pairs": "array<struct<a:string,b:string>>",
}


def _first_promise(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(p)), F.lit(p)) for p in PROMISES])


def recommendation_gate(evidence: DataFrame) -> DataFrame:
    """Judge each row of evidence; adds confidence, allowed_to_recommend and reason.

    Needs cohort_id and overlap_count; the other evidence columns are taken as NULL where
    they are missing. Rules apply in order: no overlap, no recorded threshold, a lift
    without a baseline, wording that promises a result. What passes is graded by overlap
    and threshold.
    """
    for name, kind in OPTIONAL.items():
        if name not in evidence.columns:
            evidence = evidence.withColumn(name, F.lit(None).cast(kind))
    overlap = F.coalesce(F.col("overlap_count"), F.lit(0)).cast("bigint")
    threshold = F.col("similarity_threshold")
    promise = _first_promise(F.col("recommendation"))

    refusals: list[tuple[Column, Column]] = [
        (
            overlap <= 0,
            F.lit("no overlap in the cohort, so there is nothing to recommend; try a wider "
                  "date range, a lower threshold or a lookalike hypothesis"),
        ),
        (
            threshold.isNull(),
            F.lit("similarity_threshold was not recorded, so the cohort cannot be judged"),
        ),
        (
            F.col("lift").isNotNull() & F.col("baseline_rate").isNull(),
            F.lit("a lift is claimed without its baseline_rate and cannot be checked"),
        ),
        (
            promise.isNotNull(),
            F.concat(
                F.lit("the recommendation makes a promise ('"), promise,
                F.lit("'); state it as a hypothesis to test"),
            ),
        ),
    ]
    refused = F.coalesce(*[F.when(rule, why) for rule, why in refusals])
    grade = reduce(
        lambda rest, rung: F.when(
            (overlap >= rung[1]) & (threshold >= rung[2]), rung[0]
        ).otherwise(rest),
        reversed(CONFIDENCE),
        F.lit("low"),
    )
    allowed = refused.isNull()
    confidence = F.when(allowed, grade).otherwise("none")
    passed = F.concat(
        F.lit("evidence accepted: overlap "), overlap.cast("string"),
        F.lit(", threshold "), threshold.cast("string"), F.lit(", confidence "), grade,
    )
    return (
        evidence.withColumn("overlap_count", overlap)
        .withColumn("confidence", confidence)
        .withColumn("allowed_to_recommend", allowed)
        .withColumn("reason", F.coalesce(refused, passed))
    )
