"""Training pairs, the boosted-tree classifier and its artifact."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmark.functions.fixed_values import FEATURE_NAMES


@dataclass(frozen=True)
class BoostParams:
    """Spark's trees have no L1 and L2 terms and no smallest child weight; the nearest is a smallest node."""

    rounds: int = 300
    depth: int = 5
    rate: float = 0.04
    row_share: float = 0.88
    feature_share: float = 0.88
    min_node: int = 3
    seed: int = 42


def head_split(truth: DataFrame, order: DataFrame, val_share: float) -> tuple[DataFrame, DataFrame]:
    """The first ``int(n * (1 - val_share))`` records by ``ordinal``, and the rest.

    ``order`` maps ``s1_id`` to a unique ``ordinal``. The border is the exact ordinal at that rank, found
    from counts alone.
    """
    placed = truth.join(order.select("s1_id", "ordinal"), "s1_id")
    n = placed.count()
    k = int(n * (1 - val_share))
    if k == 0:
        return placed.where("false").drop("ordinal"), placed.drop("ordinal")
    border = placed.select("ordinal").orderBy("ordinal").offset(k - 1).limit(1).first()["ordinal"]
    return placed.where(F.col("ordinal") <= border).drop("ordinal"), placed.where(F.col("ordinal") > border).drop("ordinal")


def first_records(entities: DataFrame, n: int) -> DataFrame:
    """All targets, and of S1 the first ``n`` records by ``ordinal``; the border is found as in :func:`head_split`."""
    s1 = F.col("role") == "S1"
    if n <= 0:
        return entities.where(~s1)
    border = entities.where(s1).select("ordinal").orderBy("ordinal").offset(n - 1).limit(1).first()
    return entities if border is None else entities.where(~s1 | (F.col("ordinal") <= border["ordinal"]))


def bounded_background(targets: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """The targets that ``needed`` (``cand_id``) names, and the first ``n`` others by ``ordinal`` (ties by id)."""
    wanted = needed.select(F.col("cand_id").alias("entity_id")).distinct()
    others = targets.join(wanted, "entity_id", "left_anti").orderBy("ordinal", "entity_id").limit(n)
    return targets.join(wanted, "entity_id", "left_semi").unionByName(others)


def training_pairs(candidates: DataFrame, truth: DataFrame, targets: DataFrame, negatives: int = 10) -> DataFrame:
    """``(s1_id, cand_id, label)``: every true match among the targets, blocked or not, and the first
    ``negatives`` other candidates of each record (by ``rank`` where there is one, then id)."""
    true = truth.select("s1_id", F.explode("matches").alias("cand_id"))
    positives = true.join(targets.select(F.col("entity_id").alias("cand_id")), "cand_id", "left_semi").select("s1_id", "cand_id")
    wrong = candidates.join(truth.select("s1_id"), "s1_id", "left_semi").join(true, ["s1_id", "cand_id"], "left_anti")
    order = [F.col("rank"), F.col("cand_id")] if "rank" in candidates.columns else [F.col("cand_id")]
    hard = wrong.withColumn("__rn", F.row_number().over(Window.partitionBy("s1_id").orderBy(*order)))
    return positives.withColumn("label", F.lit(1)).unionByName(
        hard.where(F.col("__rn") <= negatives).select("s1_id", "cand_id", F.lit(0).alias("label"))
    )


def fit(features: DataFrame, params: BoostParams | None = None, names: tuple[str, ...] = FEATURE_NAMES) -> PipelineModel:
    params = params or BoostParams()
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        maxIter=params.rounds,
        maxDepth=params.depth,
        stepSize=params.rate,
        subsamplingRate=params.row_share,
        featureSubsetStrategy=str(params.feature_share),
        minInstancesPerNode=params.min_node,
        seed=params.seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="features"), trees]).fit(features)


def score(model: PipelineModel, features: DataFrame) -> DataFrame:
    """``features`` with ``prob``, the probability of a match."""
    scored = model.transform(features).withColumn("prob", vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def save_model(
    model: PipelineModel, path: str, names: tuple[str, ...], config: dict, metrics: dict, wanted_f05: float | None = None, tolerance: float = 0.005
) -> None:
    """Write the model beside its configuration; refuses an existing path, and a score off the one wanted."""
    if wanted_f05 is not None and abs(metrics["macro_f05"] - wanted_f05) > tolerance:
        raise ValueError(f"macro F0.5 {metrics['macro_f05']:.4f} is not within {tolerance} of {wanted_f05}")
    spark = _session()
    model.write().save(path)
    sidecar = json.dumps({"feature_names": list(names), "feature_count": len(names), "config": config, "metrics": metrics})
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.text(f"{path}/sidecar")


def load_model(path: str, names: tuple[str, ...] = FEATURE_NAMES, config: dict | None = None) -> tuple[PipelineModel, dict]:
    """Model and sidecar; fails if the features or the given configuration are not those it was made with."""
    sidecar = json.loads(_session().read.text(f"{path}/sidecar").first()["value"])
    if tuple(sidecar["feature_names"]) != tuple(names) or sidecar["feature_count"] != len(names):
        raise ValueError("the model was made for other features")
    for key, value in (config or {}).items():
        if sidecar["config"].get(key) != value:
            raise ValueError(f"the model was made with {key}={sidecar['config'].get(key)!r}, not {value!r}")
    return PipelineModel.load(path), sidecar


def params_dict(params) -> dict:
    return asdict(params)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()
