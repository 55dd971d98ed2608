"""Pairwise features. What compares letters or sets comes from one Arrow function, the rest from built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmark.functions import similarity as sim
from kinmark.functions.fixed_values import FEATURE_NAMES, NOT_IN_28, UNKNOWN_COUNTRY
from kinmark.functions.pairs import COMPARED, compared
from kinmark.functions.text import soundex
from kinmark.workers import let_workers_import

_COLUMNS = ("n", "a", "c")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in COMPARED]))
def _compared(n1: pd.Series, n2: pd.Series, a1: pd.Series, a2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(compared(*(x.tolist() for x in (n1, n2, a1, a2))).T, columns=list(COMPARED))


def pair_rows(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """Candidates with the texts of both records, suffixed 1 and 2; tokens are made of them where they are compared."""
    sides = []
    for id_name, k in (("s1_id", "1"), ("cand_id", "2")):
        sides.append(
            entities.select(
                F.col("entity_id").alias(id_name),
                *[F.col(c).alias(f"{c}{k}") for c in _COLUMNS],
                soundex(F.element_at(F.split("n", " "), 1)).alias(f"sx{k}"),
            )
        )
    return candidates.join(sides[0], "s1_id").join(sides[1], "cand_id")


def with_features(pairs: DataFrame) -> DataFrame:
    """``pairs`` plus the 33 features and ``name_len_diff``."""
    n1, n2, a1, a2 = (F.col(c) for c in ("n1", "n2", "a1", "a2"))
    let_workers_import(pairs.sparkSession)
    texts = pairs.withColumn("__t", _compared(n1, n2, a1, a2))
    jw, ajw = F.col("__t.name_jaro_winkler"), F.col("__t.addr_jaro_winkler")
    columns = {
        **{name: F.col(f"__t.{name}") for name in COMPARED},
        "name_exact_match": _flag((n1 != "") & (n1 == n2)),
        "name_len_ratio": sim.length_ratio(n1, n2),
        "name_prefix_match": _flag(
            (n1 != "") & (n2 != "") & (n1.startswith(F.substring(n2, 1, 4)) | n2.startswith(F.substring(n1, 1, 4)))
        ),
        "name_soundex_match": _flag((F.col("sx1") != "") & (F.col("sx1") == F.col("sx2"))),
        "addr_null": _flag(a2 == ""),
        "addr_exact_match": _flag((a1 != "") & (a1 == a2)),
        "addr_len_ratio": sim.length_ratio(a1, a2),
        "joint_name_addr_sim": F.when(a2 != "", (jw + ajw) / 2).otherwise(jw),
        "harmonic_mean_jw": F.when((a2 != "") & (jw + ajw > 0), 2 * jw * ajw / (jw + ajw)).otherwise(jw),
        "country_match": _flag(
            (F.col("c1") == F.col("c2")) | (F.col("c1") == UNKNOWN_COUNTRY) | (F.col("c2") == UNKNOWN_COUNTRY)
        ),
        "is_source3": _flag(F.col("cand_id").startswith("S3-")),
        "name_len_diff": F.abs(F.length(n1) - F.length(n2)).cast("double"),
    }
    return texts.withColumns(columns).drop("__t")


BASELINE_20 = (
    "name_exact_match", "name_jaccard", "name_ngram_jaccard_3", "name_edit_sim", "name_token_sort_sim", "name_jaro_winkler",
    "name_len_ratio", "name_len_diff", "name_acronym_match", "name_prefix_match", "addr_null", "addr_exact_match",
    "addr_jaccard", "addr_edit_sim", "addr_jaro_winkler", "addr_house_num_match", "addr_shingle_overlap_count",
    "addr_len_ratio", "joint_name_addr_sim", "country_match",
)
FEATURES_28 = tuple(f for f in FEATURE_NAMES if f not in NOT_IN_28)


def pair_features(candidates: DataFrame, entities: DataFrame, names: tuple[str, ...] = FEATURE_NAMES) -> DataFrame:
    """``(s1_id, cand_id)`` and the named features of every candidate pair, or further columns of ``candidates``."""
    return with_features(pair_rows(candidates, entities)).select("s1_id", "cand_id", *names)
