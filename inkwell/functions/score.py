"""Scores of answers before and after optimization, read from a judge's JSON; bands and savings for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsontext import int_field, object_text, string_field

DIMENSIONS = ("relevance", "density", "clarity")
#: Least gain in percent of each verdict, and the last verdict.
VERDICTS = ((20, "显著提升"), (5, "轻微提升"), (-5, "无明显变化"))
WORSE = "优化后变差"


def java_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + F.lit(0.5))


def average(*scores: Column) -> Column:
    total = scores[0]
    for s in scores[1:]:
        total = total + s
    return java_round(total / F.lit(float(len(scores)))).cast("int")


def efficiency_gain(score_before: Column, score_after: Column, tokens_before: Column, tokens_after: Column) -> Column:
    """Change of score per token, in percent with two decimals; 0 where there was nothing per token before."""
    per = lambda s, t: F.when(t > 0, s.cast("double") / t).otherwise(F.lit(0.0))
    before, after = per(score_before, tokens_before), per(score_after, tokens_after)
    return F.when(before > 0, java_round((after - before) / F.when(before > 0, before) * 10000.0) / 100.0).otherwise(F.lit(0.0))


def verdict(gain: Column) -> Column:
    out = F.when(gain >= VERDICTS[0][0], VERDICTS[0][1])
    for least, label in VERDICTS[1:]:
        out = out.when(gain >= least, label)
    return out.otherwise(WORSE)


def compression_rate(original: Column, final: Column) -> Column:
    """Share of tokens saved in percent with one decimal; may be negative."""
    return F.when(original > 0, java_round((F.lit(1.0) - final.cast("double") / F.when(original > 0, original)) * 1000.0) / 10.0).otherwise(F.lit(0.0))


def saving_percent(before: Column, after: Column) -> Column:
    """Whole percent of tokens saved, 0 if there were none."""
    return F.when(before > 0, java_round((before - after) / F.when(before > 0, before).cast("double") * 100.0)).otherwise(0).cast("int")


def saved(original: Column, final: Column) -> Column:
    """Tokens saved, not below zero."""
    return F.greatest(F.lit(0), original - final)


def badge(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 5, "mid").otherwise("low")


def bar(score: Column) -> Column:
    return F.when(score >= 7, "high").when(score >= 5, "mid").otherwise("low")


def score_quality(df: DataFrame, judge_col: str = "score_json", before_col: str = "tokens_before", after_col: str = "tokens_after") -> DataFrame:
    """df with the judge's six scores, their averages, the summary, the efficiency gain and the verdict.

    The judge's answer has fields like relevanceBefore and clarityAfter, and naturalSummary.
    """
    body = "_body"
    while body in {c.lower() for c in df.columns}:
        body = f"_{body}"
    df = df.withColumn(body, object_text(F.col(f"`{judge_col}`")))
    scores = {f"{d}_score_{side}": int_field(F.col(body), f"{d}{side.title()}") for d in DIMENSIONS for side in ("before", "after")}
    df = df.withColumns(scores | {"natural_summary": string_field(F.col(body), "naturalSummary")}).drop(body)
    mean = lambda side: average(*(F.col(f"{d}_score_{side}") for d in DIMENSIONS))
    df = df.withColumns({"original_score": mean("before"), "optimized_score": mean("after")})
    gain = efficiency_gain(F.col("original_score"), F.col("optimized_score"), F.col(before_col), F.col(after_col))
    return df.withColumn("optimization_score", gain).withColumn("verdict", verdict(F.col("optimization_score")))
