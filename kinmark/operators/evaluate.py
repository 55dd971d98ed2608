"""Measures of predictions and of candidates against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(predicted: Column, true: Column) -> Column:
    """F0.5 of two id sets: both empty 1, one empty or nothing shared 0."""
    p = F.array_distinct(F.coalesce(predicted, F.array().cast("array<string>")))
    t = F.array_distinct(F.coalesce(true, F.array().cast("array<string>")))
    shared = F.size(F.array_intersect(p, t))
    precision, recall = shared / F.size(p), shared / F.size(t)
    return (
        F.when(F.size(t) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0))
        .when((F.size(p) == 0) | (shared == 0), 0.0)
        .otherwise(1.25 * precision * recall / (0.25 * precision + recall))
    )


def f05_per_entity(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``(s1_id, f05)`` for every record of the truth; one without a prediction predicts nothing."""
    return truth.join(predicted.select("s1_id", "matched_ids"), "s1_id", "left").select(
        "s1_id", f05(F.col("matched_ids"), F.col("matches")).alias("f05")
    )


def macro_f05(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    return f05_per_entity(predicted, truth).agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("macro_f05"))


def blocking_metrics(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: records, true and retained matches, recall, and how many candidates a record has."""
    counts = candidates.groupBy("s1_id").agg(F.count("*").alias("n"))
    kept = (
        truth.select("s1_id", F.explode("matches").alias("cand_id"))
        .join(candidates.select("s1_id", "cand_id"), ["s1_id", "cand_id"])
        .groupBy("s1_id")
        .agg(F.count("*").alias("kept"))
    )
    rows = (
        truth.select("s1_id", F.size("matches").alias("true"))
        .join(counts, "s1_id", "left")
        .join(kept, "s1_id", "left")
        .select("true", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    )
    zero = F.lit(0.0)
    total = rows.agg(
        F.count("*").cast("double").alias("num_s1"),
        F.coalesce(F.sum("true").cast("double"), zero).alias("total_true_matches"),
        F.coalesce(F.sum("kept").cast("double"), zero).alias("retained_true_matches"),
        F.coalesce(F.sum("n").cast("double"), zero).alias("total_candidates"),
        F.coalesce(F.avg("n"), zero).alias("avg_candidates"),
        F.coalesce(F.median("n").cast("double"), zero).alias("median_candidates"),
        F.coalesce(F.min("n").cast("double"), zero).alias("min_candidates"),
        F.coalesce(F.max("n").cast("double"), zero).alias("max_candidates"),
    )
    recall = F.when(F.col("total_true_matches") > 0, F.col("retained_true_matches") / F.col("total_true_matches")).otherwise(0.0)
    return total.withColumn("blocking_recall", recall).withColumn("blocking_recall_pct", F.col("blocking_recall") * 100)


def search_space(candidates: DataFrame, n_s1: int, n_targets: int, baseline_candidates: int, baseline_recall: float, recall: float) -> DataFrame:
    """Reduction against all pairs, growth against an earlier blocking, and the change of its recall."""
    return candidates.agg(F.count("*").cast("double").alias("candidates")).select(
        "candidates",
        (100.0 * (1.0 - F.col("candidates") / (float(n_s1) * float(n_targets)))).alias("reduction_pct"),
        (F.col("candidates") / float(baseline_candidates)).alias("candidate_growth"),
        F.lit(recall - baseline_recall).alias("recall_change"),
    )


def pair_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Pairwise precision (1 without predictions), recall (0 without matches) and the share of records without
    a match that are left alone (1 if there are none)."""
    rows = truth.join(predicted, "s1_id", "left").select(
        F.size(F.coalesce("matched_ids", F.array().cast("array<string>"))).alias("p"),
        F.size("matches").alias("t"),
        F.size(F.array_intersect(F.coalesce("matched_ids", F.array().cast("array<string>")), F.col("matches"))).alias("tp"),
    )
    sums = rows.agg(
        F.sum("tp").alias("tp"),
        F.sum("p").alias("p"),
        F.sum("t").alias("t"),
        F.sum(F.when(F.col("t") == 0, 1).otherwise(0)).alias("single"),
        F.sum(F.when((F.col("t") == 0) & (F.col("p") == 0), 1).otherwise(0)).alias("left_alone"),
    )
    return sums.select(
        F.when(F.col("p") > 0, F.col("tp") / F.col("p")).otherwise(1.0).alias("pair_precision"),
        F.when(F.col("t") > 0, F.col("tp") / F.col("t")).otherwise(0.0).alias("pair_recall"),
        F.when(F.col("single") > 0, F.col("left_alone") / F.col("single")).otherwise(1.0).alias("singleton_accuracy"),
    )
