"""A whole linkage run, from entities to decisions: training with evaluation, and inference."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.functions.fixed_values import FEATURE_NAMES
from kinmark.operators import decide, evaluate, training
from kinmark.operators.blocking import block
from kinmark.operators.features import pair_features
from kinmark.operators.ranking import rank_by_overlap
from kinmark.params import DEFAULT, LinkParams
from kinmark.sources import sinks
from kinmark.sources.entities import prepare


def s1_ids(entities: DataFrame) -> DataFrame:
    return entities.where("role = 'S1'").select(F.col("entity_id").alias("s1_id"))


def candidates(prepared: DataFrame, params: LinkParams = DEFAULT) -> DataFrame:
    """Blocked and ranked candidates."""
    return rank_by_overlap(block(prepared, params), prepared, params.top_n)


def train(
    entities: DataFrame,
    truth: DataFrame,
    params: LinkParams = DEFAULT,
    boost: training.BoostParams | None = None,
    val_share: float = 0.3,
    negatives: int = 10,
) -> tuple[PipelineModel, dict]:
    """Fit on the first records of the truth, choose the decision rule on the rest by grid search.

    Probabilities of another learner are on another scale, so thresholds are searched, never taken over.
    Returns the model and ``threshold, margin, k, macro_f05`` with the pairwise measures of the best rule.
    """
    prepared = prepare(entities, params).persist()
    order = prepared.where("role = 'S1'").select(F.col("entity_id").alias("s1_id"), "ordinal")
    head, tail = training.head_split(truth, order, val_share)
    ranked = candidates(prepared, params).persist()
    pairs = training.training_pairs(ranked, head, prepared.where("role <> 'S1'"), negatives)
    pairs.persist()
    # the learner passes over its rows many times
    labelled = pair_features(pairs.select("s1_id", "cand_id"), prepared).join(pairs, ["s1_id", "cand_id"]).persist()
    model = training.fit(labelled, boost)
    held = ranked.join(tail.select("s1_id"), "s1_id", "left_semi")
    scored = training.score(model, pair_features(held.select("s1_id", "cand_id"), prepared)).select("s1_id", "cand_id", "prob").persist()
    grid = decide.grid_scores(scored, tail, [round(0.05 * i, 2) for i in range(1, 20)], decide.RULE_MARGINS, decide.KS)
    best = decide.best_point(grid).first()
    accepted = decide.within_margin(scored, best["threshold"], best["margin"], best["k"])
    measures = evaluate.pair_metrics(decide.predictions(accepted, tail), tail).first()
    for df in (prepared, ranked, pairs, labelled, scored):
        df.unpersist()
    return model, {"threshold": best["threshold"], "margin": best["margin"], "k": best["k"], "macro_f05": best["macro_f05"], **measures.asDict()}


def infer(entities: DataFrame, model: PipelineModel, params: LinkParams = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates and, for every S1 record, its accepted matches. Prepared records are kept while the
    caller works with the results; :func:`publish` stores both before anything reads them twice."""
    prepared = prepare(entities, params).persist()
    ranked = candidates(prepared, params)
    scored = training.score(model, pair_features(ranked.select("s1_id", "cand_id"), prepared, FEATURE_NAMES))
    accepted = decide.within_margin(scored, params.threshold, params.margin, params.max_matches)
    return ranked, decide.predictions(accepted, s1_ids(entities))


RESULTS = ("candidate_pairs", "matching_results")


def publish(ranked: DataFrame | None, matches: DataFrame, entities: DataFrame, out: str) -> dict:
    """Store both results once, verify what was stored, then publish both together.

    They are written under ``out/_pending``, verified from there, and only then moved to their names; where a check
    fails nothing is published. An existing result is never overwritten: it raises an error before any work.
    Without ``ranked`` only the matches are stored.
    """
    spark = entities.sparkSession
    files = sinks.FileMoves(spark, out)
    results = RESULTS if ranked is not None else RESULTS[1:]
    for name in results:
        if files.exists(name):
            raise FileExistsError(f"{out}/{name} exists")
    ids = s1_ids(entities)
    files.remove("_pending")  # of an interrupted run
    if ranked is not None:
        sinks.write_tsv(sinks.candidate_lines(ranked, ids, ranked=True), f"{out}/_pending/{RESULTS[0]}")
    sinks.write_tsv(sinks.match_lines(matches, ids), f"{out}/_pending/{RESULTS[1]}")
    reports = {}
    for name in results:
        written = spark.read.csv(f"{out}/_pending/{name}", sep="\t", header=True, schema="source1_entity_id string, ids string")
        reports[name] = sinks.verify_lines(written, ids).first().asDict()
    for name, report in reports.items():
        if report["missing_ids"] or report["duplicate_rows"] or report["unexpected_ids"]:
            files.remove("_pending")
            raise ValueError(f"{name}: {report}")
    for name in results:
        files.move(f"_pending/{name}", name)
    files.remove("_pending")
    return reports


def config_of(params: LinkParams) -> dict:
    return asdict(params)
