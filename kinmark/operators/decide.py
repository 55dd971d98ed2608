"""Decision rules over scored pairs ``(s1_id, cand_id, prob)``, and their grid searches."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(order: list, *partition: str) -> Window:
    return Window.partitionBy("s1_id", *partition).orderBy(*order)


def _first_k(pairs: DataFrame, k: int | None, order: list | None = None) -> DataFrame:
    if k is None:
        return pairs
    order = order or [F.col("prob").desc(), F.col("cand_id")]
    return pairs.withColumn("__rn", F.row_number().over(_by(order))).where(F.col("__rn") <= k).drop("__rn")


def within_margin(scored: DataFrame, threshold: float = 0.985, margin: float = 0.005, k: int | None = 7) -> DataFrame:
    """Pairs at the threshold or above, no further than ``margin`` below the record's best, the best ``k``."""
    best = F.max("prob").over(Window.partitionBy("s1_id"))
    near = scored.withColumn("__best", best).where((F.col("prob") >= threshold) & (F.col("prob") >= F.col("__best") - margin))
    return _first_k(near.drop("__best"), k)


def over_threshold(scored: DataFrame, threshold: float = 0.70, k: int | None = None) -> DataFrame:
    return _first_k(scored.where(F.col("prob") >= threshold), k)


def first_by_rank(scored: DataFrame, threshold: float, k: int) -> DataFrame:
    """The first ``k`` over the threshold in the order of their blocking ``rank``, not of their score."""
    return _first_k(scored.where(F.col("prob") >= threshold), k, [F.col("rank"), F.col("cand_id")])


def without_conflicts(scored: DataFrame, threshold: float, margin: float, k: int | None) -> DataFrame:
    """The margin rule over pairs whose house numbers do not conflict (``addr_house_num_conflict``); the margin is
    taken from the best of all pairs."""
    best = F.max("prob").over(Window.partitionBy("s1_id"))
    near = scored.withColumn("__best", best).where(
        (F.col("prob") >= threshold) & (F.col("prob") >= F.col("__best") - margin) & (F.col("addr_house_num_conflict") != 1.0)
    )
    return _first_k(near.drop("__best"), k)


def with_min_name(scored: DataFrame, threshold: float, min_name_jw: float, k: int | None) -> DataFrame:
    return _first_k(scored.where((F.col("prob") >= threshold) & (F.col("name_jaro_winkler") >= min_name_jw)), k)


def per_source(scored: DataFrame, threshold: float, sure: float = 0.98, per: int = 2) -> DataFrame:
    """Up to ``per`` pairs of each source: its best, and further ones from ``sure`` on."""
    valid = scored.where(F.col("prob") >= threshold).withColumn("__s3", F.col("cand_id").startswith("S3-"))
    order = [F.col("prob").desc(), F.col("cand_id")]
    ranked = valid.withColumn("__rn", F.row_number().over(_by(order, "__s3")))
    return ranked.where((F.col("__rn") <= per) & ((F.col("__rn") == 1) | (F.col("prob") >= sure))).drop("__rn", "__s3")


def predictions(pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """``(s1_id, matched_ids)`` for every record of ``s1``: its accepted ids sorted, or none."""
    return (
        s1.select("s1_id")
        .join(pairs.select("s1_id", "cand_id"), "s1_id", "left")
        .groupBy("s1_id")
        .agg(F.array_sort(F.collect_set("cand_id")).alias("matched_ids"))
    )


# -- grid search ----------------------------------------------------------------------------------

THRESHOLDS = tuple(round(0.70 + 0.01 * i, 2) for i in range(30))
RULE_THRESHOLDS = (0.95, 0.96, 0.97, 0.975, 0.98, 0.985)
RULE_MARGINS = (0.008, 0.010, 0.015, 0.020)
KS = (4, 5, 6, None)


def grid_scores(
    scored: DataFrame,
    truth: DataFrame,
    thresholds: Iterable[float],
    margins: Iterable[float | None],
    ks: Iterable[int | None],
) -> DataFrame:
    """Macro F0.5 of every point of the grid: ``(point, threshold, margin, k, macro_f05)``.

    Every pair is ranked once within its record; a point of the grid keeps a pair by comparisons alone, as
    the pairs that it keeps are always the record's first ones. So the grid multiplies rows of the truth
    by its points only after each record's pairs are one row.
    """
    spark = scored.sparkSession
    points = [(i, t, m, k) for i, (t, m, k) in enumerate(product(thresholds, margins, ks))]
    grid = spark.createDataFrame(points, "point int, threshold double, margin double, k int")
    ranked = scored.withColumn("__rn", F.row_number().over(_by([F.col("prob").desc(), F.col("cand_id")])))
    rows = ranked.groupBy("s1_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__rn").alias("rn"), F.col("prob").alias("p"), F.col("cand_id").alias("id")))).alias("pairs"),
        F.max("prob").alias("best"),
    )
    per_record = truth.select("s1_id", "matches").join(rows, "s1_id", "left").crossJoin(F.broadcast(grid))
    kept = F.filter(
        F.coalesce("pairs", F.array().cast("array<struct<rn:int,p:double,id:string>>")),
        lambda x: (x["p"] >= F.col("threshold"))
        & (F.col("margin").isNull() | (x["p"] >= F.col("best") - F.col("margin")))
        & (F.col("k").isNull() | (x["rn"] <= F.col("k"))),
    )
    from kinmark.operators.evaluate import f05

    scored_points = per_record.withColumn("f", f05(F.transform(kept, lambda x: x["id"]), F.col("matches")))
    return scored_points.groupBy("point", "threshold", "margin", "k").agg(F.avg("f").alias("macro_f05"))


def best_point(grid: DataFrame) -> DataFrame:
    """The point of the highest score, the first of equals in the order of the grid."""
    return grid.orderBy(F.col("macro_f05").desc(), F.col("point")).limit(1)


def grid_threshold(scored: DataFrame, truth: DataFrame, thresholds=THRESHOLDS, ks=KS) -> DataFrame:
    return best_point(grid_scores(scored, truth, thresholds, [None], ks))


def grid_decision(scored: DataFrame, truth: DataFrame, thresholds=RULE_THRESHOLDS, margins=RULE_MARGINS, ks=KS) -> DataFrame:
    return best_point(grid_scores(scored, truth, thresholds, margins, ks))
