"""The linkage queries that the entry module registers, over the synthetic tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmark.functions import text, tokens
from kinmark.functions.fixed_values import FEATURE_NAMES
from kinmark.operators import blocking, decide, evaluate, features, packed, ranking, training
from kinmark.params import BACKGROUND, DEFAULT, TIGHT, TINY, LinkParams
from kinmark.plans import linkage
from kinmark.sources import entities as src
from kinmark.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
FALLBACK_8 = TINY.with_(fallback_limit=8)
RAW = {"address_form": "raw"}
FIXED = {"partitioning": "fixed", "countries": ("FR", "EN")}
WHOLE = {"partitioning": "none"}
#: Trees of ``gbt_scores``; each costs several passes, so the query trains fewer than a real run's 300.
GBT_ROUNDS = 20


def _sides(rows: DataFrame, params: LinkParams) -> tuple[DataFrame, DataFrame]:
    """S1 records and targets of raw ``rows``, each prepared apart, so that neither is tokenised for the other."""
    return tuple(src.prepare(rows.where(f"role {op} 'S1'"), params, src.BLOCKED) for op in ("=", "<>"))


def _raw(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S1 records and targets, to be tokenised where they are packed."""
    return rows.where("role = 'S1'"), rows.where("role <> 'S1'")


def _some_unknown(rows: DataFrame, params: LinkParams) -> bool:
    """Whether a raw record lacks its country; each country is normalised once."""
    countries = rows.select("country").distinct().select(text.normalize_country("country").alias("c"))
    return params.partitioning == "country" and blocking.any_unknown(countries)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared pages, whose short names and addresses are compared pair by pair."""
    return src.prepare(src.page_entities(spark, sf), DEFAULT)


def _joined(array: Column, by: str = " ") -> Column:
    return F.array_join(array, by)


# -- normalisation and tokens ---------------------------------------------------------------------


def norm_text(spark, sf):
    return src.document_entities(spark, sf).select(
        "entity_id", text.normalize_text("business_name").alias("name"), text.normalize_text("business_address").alias("address")
    )


def norm_address(spark, sf):
    return src.document_entities(spark, sf).select("entity_id", text.standardize_address_text("business_address").alias("address"))


def norm_country(spark, sf):
    return src.with_some_unknown(src.document_entities(spark, sf)).select("entity_id", text.normalize_country("country").alias("country"))


def country_partitions(spark, sf):
    return norm_country(spark, sf).select("country").distinct()


def _token_query(spark, sf, column: str, name: str = "tokens"):
    rows = src.prepare(src.document_entities(spark, sf), DEFAULT, ("entity_id", column))
    return rows.select("entity_id", _joined(F.col(column)).alias(name))


def address_shingles(spark, sf):
    rows = src.prepare(src.part_entities(spark, sf), DEFAULT)
    return rows.select("entity_id", _joined(F.filter("feat_addr_toks", lambda t: t.startswith("sh_"))).alias("shingles"))


def soundex_codes(spark, sf):
    first = F.element_at(F.split(text.normalize_text("business_name"), " "), 1)
    return src.document_entities(spark, sf).select("entity_id", text.soundex(first).alias("code"))


# -- blocking and ranking -------------------------------------------------------------------------


def token_counts(spark, sf):
    targets = blocking.with_part(_sides(src.document_entities(spark, sf), DEFAULT)[1], DEFAULT, False)
    return blocking.token_counts(blocking.token_rows(targets, DEFAULT, "cand_id"))


def _capped_tokens(spark, sf, params: LinkParams):
    return blocking.capped_tokens(token_counts(spark, sf), params)


def _candidates(spark, sf, params: LinkParams, kinds=None):
    rows = src.document_entities(spark, sf)
    return blocking.block_sides(*(_raw(rows) if params.fallback_limit is None else _sides(rows, params)), params, kinds)


def _unknown_pass(spark, sf, params: LinkParams):
    rows = src.with_some_unknown(src.document_entities(spark, sf))
    return blocking.block_sides(*_raw(rows), params, has_unknown=_some_unknown(rows, params))


def _ranked(spark, sf, params: LinkParams = DEFAULT, n: int = 60):
    return ranking.rank_sides_by_overlap(*_raw(src.document_entities(spark, sf)), params, n)


def _counter_ranked(spark, sf, params: LinkParams, n: int, repeated: bool):
    rows = src.document_entities(spark, sf)
    ranked = ranking.rank_sides_by_counter(*_raw(rows), params, n, repeated, _some_unknown(rows, params))
    return ranked.select("s1_id", "cand_id", "weight", "rank")


# -- features -------------------------------------------------------------------------------------


def _ranked_pages(spark, sf, n: int = 60):
    raw = src.page_entities(spark, sf)
    if not _some_unknown(raw, DEFAULT):
        return ranking.rank_sides_by_overlap(*_raw(raw), DEFAULT, n)
    # records of several passes are weighed over all of them
    rows = pages(spark, sf)
    return ranking.rank_by_overlap(blocking.block(rows, DEFAULT, has_unknown=True), rows, n)


def _features(spark, sf, names):
    found = features.pair_features(_ranked_pages(spark, sf).select("s1_id", "cand_id"), pages(spark, sf), tuple(names))
    return found.select("s1_id", "cand_id", *[F.round(c, 9).alias(c) for c in names])


def feat_house_numbers(spark, sf):
    names = ("addr_house_num_match", "addr_house_num_conflict", "addr_house_num_overlap_count")
    rows = src.prepare(src.part_entities(spark, sf), TIGHT)
    ranked = ranking.rank_by_overlap(blocking.block(rows, TIGHT, has_unknown=False), rows, 20)
    found = features.pair_features(ranked.select("s1_id", "cand_id"), rows, names)
    return found.select("s1_id", "cand_id", *[F.round(c, 9).alias(c) for c in names])


_SETS = {
    "feat_name_sets": (
        "name_exact_match", "name_jaccard", "name_containment", "name_ngram_jaccard_3", "name_ngram_jaccard_4",
        "name_acronym_match", "name_prefix_match", "name_soundex_match", "name_len_ratio",
    ),
    "feat_name_edit": ("name_edit_sim", "name_token_sort_sim"),
    "feat_name_jw": ("name_jaro_winkler", "joint_name_addr_sim", "harmonic_mean_jw"),
    "feat_lcs": ("name_lcs_ratio",),
    "feat_addr_sets": (
        "addr_null", "addr_exact_match", "addr_jaccard", "addr_containment", "addr_word_jaccard", "addr_word_containment",
        "addr_edit_sim", "addr_jaro_winkler", "addr_shingle_overlap_count", "addr_len_ratio",
    ),
    "feat_cross": (
        "name_in_addr_cross_match", "addr_in_name_cross_match", "shared_tokens_total_count", "country_match", "is_source3",
    ),
    "features_33": FEATURE_NAMES,
    "features_28": features.FEATURES_28,
    "features_20": features.BASELINE_20,
}


# -- decisions and evaluation ---------------------------------------------------------------------


def scored(spark, sf, n: int = 60) -> DataFrame:
    """Ranked pairs with a score that needs no model: the joint similarity of name and address."""
    found = features.with_features(features.pair_rows(_ranked_pages(spark, sf, n), pages(spark, sf)))
    return found.select(
        "s1_id", "cand_id", "rank", F.round("joint_name_addr_sim", 9).alias("prob"), "addr_house_num_conflict",
        F.round("name_jaro_winkler", 9).alias("name_jaro_winkler"),
    )


def truth(spark, sf) -> DataFrame:
    return src.silver_truth(src.page_entities(spark, sf))


def _rule(spark, sf, rule):
    return rule(scored(spark, sf)).select("s1_id", "cand_id", "prob")


_RULES = {
    "decide_tau_delta_k": lambda s: decide.within_margin(s, 0.75, 0.05, 7),
    "decide_threshold_only": lambda s: decide.over_threshold(s, 0.7),
    "decide_threshold_topk": lambda s: decide.over_threshold(s, 0.7, 5),
    "decide_rank_order_topk": lambda s: decide.first_by_rank(s, 0.7, 4),
    "decide_conflict_filter": lambda s: decide.without_conflicts(s, 0.7, 0.05, 6),
    "decide_source_partition": lambda s: decide.per_source(s, 0.7),
    "decide_min_name_jw": lambda s: decide.with_min_name(s, 0.7, 0.8, 5),
}


def _predicted(spark, sf) -> DataFrame:
    return decide.predictions(decide.over_threshold(scored(spark, sf), 0.7, 5), truth(spark, sf))


def ground_truth(spark, sf):
    return truth(spark, sf).select("s1_id", _joined(F.col("matches"), ",").alias("matches"))


def macro_f05(spark, sf):
    return evaluate.macro_f05(_predicted(spark, sf), truth(spark, sf)).select(F.round("macro_f05", 9).alias("macro_f05"))


def f05_per_entity(spark, sf):
    return evaluate.f05_per_entity(_predicted(spark, sf), truth(spark, sf)).select("s1_id", F.round("f05", 9).alias("f05"))


def pair_metrics(spark, sf):
    return evaluate.pair_metrics(_predicted(spark, sf), truth(spark, sf))


def blocking_metrics(spark, sf):
    return evaluate.blocking_metrics(blocking.block(pages(spark, sf), DEFAULT), truth(spark, sf))


def search_space_reduction(spark, sf):
    rows = src.document_entities(spark, sf)
    sides = rows.agg(F.sum(F.when(F.col("role") == "S1", 1).otherwise(0)).alias("a"), F.count("*").alias("n")).first()
    return evaluate.search_space(_candidates(spark, sf, TIGHT), sides["a"], sides["n"] - sides["a"], 100_000, 0.9, 0.95)


def _grid_row(found: DataFrame) -> DataFrame:
    return found.select("point", "threshold", "margin", "k", F.round("macro_f05", 9).alias("macro_f05"))


def grid_threshold(spark, sf):
    return _grid_row(decide.grid_threshold(scored(spark, sf), truth(spark, sf)))


def grid_decision(spark, sf):
    return _grid_row(decide.grid_decision(scored(spark, sf), truth(spark, sf), (0.70, 0.75, 0.80, 0.85, 0.90, 0.95)))


def background_scan(spark, sf):
    """The targets that the truth names, and the first ``BACKGROUND`` others."""
    targets = src.page_entities(spark, sf).where("role <> 'S1'")
    needed = truth(spark, sf).select(F.explode("matches").alias("cand_id"))
    return training.bounded_background(targets, needed, BACKGROUND).select("entity_id")


def _training_pairs(spark, sf, ranked: DataFrame) -> DataFrame:
    rows = src.page_entities(spark, sf)
    order = rows.where("role = 'S1'").select(F.col("entity_id").alias("s1_id"), "ordinal")
    head, _ = training.head_split(truth(spark, sf), order, 0.3)
    return training.training_pairs(ranked, head, rows.where("role <> 'S1'"))


def training_pairs(spark, sf):
    return _training_pairs(spark, sf, _ranked_pages(spark, sf))


def gbt_scores(spark, sf):
    """A model over the training pairs, and its scores of all ranked candidates. ``GBT_ROUNDS`` trees. The ranking is made
    once, and kept while the caller works with the scores."""
    rows = pages(spark, sf)
    ranked = _ranked_pages(spark, sf).persist()
    labelled = features.pair_features(_training_pairs(spark, sf, ranked), rows, ("label", *FEATURE_NAMES)).persist()
    model = training.fit(labelled, training.BoostParams(rounds=GBT_ROUNDS))
    labelled.unpersist()
    found = features.pair_features(ranked.select("s1_id", "cand_id"), rows)
    return training.score(model, found).select("s1_id", "cand_id", "prob")


# -- results --------------------------------------------------------------------------------------


def matching_results(spark, sf):
    return sinks.match_lines(_predicted(spark, sf), truth(spark, sf))


def _candidate_pairs(spark, sf, params: LinkParams):
    found = blocking.packed_sides(*_raw(src.document_entities(spark, sf)), params, packed.Want("lines"))
    return found.select(F.col("s1_id").alias("source1_entity_id"), F.col("ids").alias("candidate_entity_ids"))


def _candidate_pairs_ranked(spark, sf, params: LinkParams):
    return sinks.candidate_lines(_ranked(spark, sf, params), linkage.s1_ids(src.document_entities(spark, sf)), ranked=True)


def verify_output(spark, sf):
    """A result file with planted faults: a tenth of the lines missing, a tenth twice, one unknown."""
    ids = linkage.s1_ids(src.document_entities(spark, sf))
    number = F.substring("s1_id", 4, 20).cast("long") % 10
    written = (
        ids.where(number != 3)
        .unionByName(ids.where(number == 4))
        .unionByName(spark.createDataFrame([("S1-x",)], "s1_id string"))
        .withColumnRenamed("s1_id", "source1_entity_id")
    )
    return sinks.verify_lines(written, ids)


def stream_candidates(spark, sf):
    """The S1 records as a stream of files, scored batch by batch against the other records."""
    from kinmark.streaming.demo import stream_documents

    return stream_documents(spark, sf)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "name_tokens": partial(_token_query, column="feat_name_toks"),
        "address_tokens": partial(_token_query, column="feat_addr_toks"),
        "name_ngrams": partial(_token_query, column="ngrams", name="ngrams"),
        "candidates_union": partial(_candidates, params=DEFAULT),
        "candidates_capped": partial(_candidates, params=TIGHT),
        "candidates_fallback": partial(_candidates, params=TINY),
        "candidates_fallback_first8": partial(_candidates, params=FALLBACK_8),
        "rank_overlap_top60": lambda spark, sf: _ranked(spark, sf).select("s1_id", "cand_id", "weight", "rank"),
    }
    # with the default caps, and as an extra with small ones
    for end, params in (("", DEFAULT), ("_tight", TIGHT)):
        alone = params if not end else params.with_(fallback=False)
        out |= {
            f"block_name{end}": partial(_candidates, params=alone, kinds=("name",)),
            f"block_addr{end}": partial(_candidates, params=alone, kinds=("word", "num", "shingle")),
            f"block_ngram{end}": partial(_candidates, params=alone, kinds=("ngram",)),
            f"capped_tokens{end}": partial(_capped_tokens, params=params),
            f"candidates_raw_addr{end}": partial(_candidates, params=params.with_(**RAW)),
            f"candidates_unknown_pass{end}": partial(_unknown_pass, params=params),
            f"candidates_fixed_countries{end}": partial(_candidates, params=params.with_(**FIXED)),
            f"candidates_no_partition{end}": partial(_candidates, params=params.with_(**WHOLE)),
            f"rank_counter_list_top50{end}": partial(_counter_ranked, params=params, n=50, repeated=True),
            f"rank_counter_set_top8{end}": partial(_counter_ranked, params=params, n=8, repeated=False),
        }
    for end, params in (("", DEFAULT), ("_tiny", TINY)):
        out[f"candidate_pairs_tsv{end}"] = partial(_candidate_pairs, params=params)
        out[f"candidate_pairs_ranked{end}"] = partial(_candidate_pairs_ranked, params=params)
    for f in (
        norm_text, norm_address, norm_country, country_partitions, address_shingles, soundex_codes, token_counts,
        feat_house_numbers, ground_truth, macro_f05, f05_per_entity,
        pair_metrics, blocking_metrics, search_space_reduction, grid_threshold, grid_decision, background_scan, training_pairs,
        gbt_scores, matching_results, verify_output, stream_candidates,
    ):
        out[f.__name__] = f
    out |= {name: partial(_features, names=names) for name, names in _SETS.items()}
    out |= {name: partial(_rule, rule=rule) for name, rule in _RULES.items()}
    return out
