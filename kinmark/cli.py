"""Command line of whole linkage runs: ``python -m kinmark.cli {train,infer,block} ...``.

Sources are tab-separated files with a header. Results are folders; an existing one is never overwritten. Every
command prints one JSON line about its run.
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinmark.functions.fixed_values import FEATURE_NAMES
from kinmark.operators import evaluate, training
from kinmark.operators.blocking import block
from kinmark.params import DEFAULT, LinkParams
from kinmark.plans import linkage
from kinmark.sources import entities as src
from kinmark.sources import sinks

CAPS = ("name_cap", "word_cap", "shingle_cap", "ngram_cap")


def _given_caps(args: argparse.Namespace) -> dict[str, int]:
    return {cap: value for cap in CAPS if (value := getattr(args, cap)) is not None}


def _sources(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return src.read_sources(spark, {"S1": args.s1, "S2": args.s2, "S3": args.s3})


def run_train(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Fit on the first records of S1, search the decision rule on the later ones of them, store the model."""
    if sinks.FileMoves(spark, args.model).exists("metadata"):
        raise FileExistsError(f"{args.model} exists")
    params = DEFAULT.with_(**_given_caps(args))
    kept = training.first_records(_sources(spark, args), args.records)
    truth = src.read_ground_truth(spark, args.truth).join(linkage.s1_ids(kept), "s1_id", "left_semi")
    model, best = linkage.train(kept, truth, params, training.BoostParams(rounds=args.rounds), args.val_share)
    training.save_model(model, args.model, FEATURE_NAMES, linkage.config_of(params), best)
    return best


def run_infer(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Candidates and matches by a stored model, with the caps and the rule it was trained with where none are given."""
    model, sidecar = training.load_model(args.model)
    config, rule = sidecar["config"], sidecar["metrics"]
    params = LinkParams(**(config | {"countries": tuple(config["countries"])} | _given_caps(args))).with_(
        threshold=rule["threshold"] if args.threshold is None else args.threshold, margin=rule["margin"], max_matches=rule["k"]
    )
    entities = _sources(spark, args)
    ranked, matches = linkage.infer(entities, model, params)
    return linkage.publish(None if args.matching_only else ranked, matches, entities, args.out)


def run_block(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Candidate lines of every record; with a truth, the blocking measures of what was stored."""
    params = DEFAULT.with_(**_given_caps(args))
    prepared = src.prepare(_sources(spark, args), params).persist()
    lines = sinks.candidate_lines(block(prepared, params), linkage.s1_ids(prepared))
    ids = F.col("candidate_entity_ids")
    counters = Observation("blocking")
    observed = lines.observe(
        counters,
        F.count("*").alias("records"),
        F.count_if(ids != "").alias("records_with_candidates"),
        F.sum(F.when(ids == "", 0).otherwise(F.size(F.split(ids, ",")))).alias("candidates"),
    )
    began = time.monotonic()
    sinks.write_tsv(observed, args.out)
    seconds = time.monotonic() - began
    prepared.unpersist()
    report = counters.get | {"seconds": round(seconds, 3), "records_per_second": round(counters.get["records"] / seconds, 3)}
    if args.truth:
        stored = src.read_tsv(spark, args.out, "source1_entity_id string, candidate_entity_ids string")
        found = stored.where(ids != "").select(F.col("source1_entity_id").alias("s1_id"), F.explode(F.split(ids, ",")).alias("cand_id"))
        report |= evaluate.blocking_metrics(found, src.read_ground_truth(spark, args.truth)).first().asDict()
    return report


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinmark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    made = {}
    for name, run in (("train", run_train), ("infer", run_infer), ("block", run_block)):
        made[name] = commands.add_parser(name, help=run.__doc__)
        made[name].set_defaults(run=run)
        for source in ("s1", "s2", "s3"):
            made[name].add_argument(f"--{source}", required=True, help="tab-separated records")
        for cap in CAPS:
            made[name].add_argument("--" + cap.replace("_", "-"), type=int, help=f"largest number of postings (default {getattr(DEFAULT, cap)})")
    made["train"].add_argument("--truth", required=True)
    made["train"].add_argument("--model", required=True, help="folder to store the model in")
    made["train"].add_argument("--records", type=int, default=20_000, help="how many records of S1 to learn from, in the order of the file")
    made["train"].add_argument("--val-share", type=float, default=0.2)
    made["train"].add_argument("--rounds", type=int, default=training.BoostParams.rounds)
    made["infer"].add_argument("--model", required=True)
    made["infer"].add_argument("--out", required=True)
    made["infer"].add_argument("--threshold", type=float)
    made["infer"].add_argument("--matching-only", action="store_true", help="store the matches without the candidates")
    made["block"].add_argument("--truth")
    made["block"].add_argument("--out", required=True)
    return top


def main(argv: Sequence[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"kinmark {args.command}").getOrCreate()
    report = args.run(spark, args)
    print(json.dumps(report))
    return report


if __name__ == "__main__":
    main()
