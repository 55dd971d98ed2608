"""Ranking candidates by shared tokens, before any expensive feature is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmark.operators.blocking import any_unknown, packed_sides
from kinmark.operators.packed import Want
from kinmark.params import LinkParams


def top(ranked: DataFrame, n: int, weight: str = "weight") -> DataFrame:
    """The first ``n`` candidates of every record by weight, ties by id, with their ``rank``."""
    order = Window.partitionBy("s1_id").orderBy(F.col(weight).desc(), F.col("cand_id"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def rank_by_overlap(candidates: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """Weight: two for every distinct name token that both hold, one for every address token. Tokens above
    their caps count as well, so weights come from the token arrays and need no second token join."""
    left = entities.select(F.col("entity_id").alias("s1_id"), F.col("name_toks").alias("n1"), F.col("addr_toks").alias("a1"))
    right = entities.select(F.col("entity_id").alias("cand_id"), F.col("name_toks").alias("n2"), F.col("addr_toks").alias("a2"))
    weighed = (
        candidates.join(left, "s1_id")
        .join(right, "cand_id")
        .select("s1_id", "cand_id", (2 * _shared(F.col("n1"), F.col("n2")) + _shared(F.col("a1"), F.col("a2"))).alias("weight"))
    )
    return top(weighed, n)


def rank_by_counter(entities: DataFrame, params: LinkParams, n: int, repeated: bool) -> DataFrame:
    """Weight: two for a name token, one for any other, of the tokens under their caps; with ``repeated`` a
    token counts as often as the record holds it. Pairs are found and weighed in one step."""
    has_unknown = params.partitioning == "country" and any_unknown(entities)
    return rank_sides_by_counter(entities.where("role = 'S1'"), entities.where("role <> 'S1'"), params, n, repeated, has_unknown)


def rank_sides_by_counter(
    s1: DataFrame, others: DataFrame, params: LinkParams, n: int, repeated: bool, has_unknown: bool = False
) -> DataFrame:
    """:func:`rank_by_counter` for S1 records and targets apart, prepared or raw."""
    ranked = top(packed_sides(s1, others, params, Want("counter", n, repeated), has_unknown=has_unknown), n)
    return ranked.where("s1_id <> cand_id") if params.exclude_self else ranked


def rank_sides_by_overlap(s1: DataFrame, others: DataFrame, params: LinkParams, n: int) -> DataFrame:
    """:func:`rank_by_overlap` of the candidates of S1 records and targets, prepared or raw, of known countries: where
    pairs are found they are weighed, and only the first ``n`` of a record in a block of targets leave it."""
    if params.fallback_limit is not None:
        raise ValueError("a limited fallback orders targets over all blocks")
    return top(packed_sides(s1, others, params, Want("overlap", n)), n)
