"""pairs are compared many at a time, with the values of the rules for one pair."""

from __future__ import annotations

import random

import numpy as np

from kinmark.functions import pairs, similarity
from kinmark.operators import features
from kinmark.params import DEFAULT
from kinmark.sources.entities import prepare


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_alignments_are_those_of_single_pairs():
    rng, left, right = random.Random(5), [], []
    for _ in range(400):
        letters = rng.choice(["ab", "abcdefg h", "aé漢b"])
        left.append("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 20, 63, 64, 65, 140]))))
        other = list(left[-1]) if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 64, 70, 130]))]
        for _ in range(rng.randrange(5)):
            other.insert(rng.randrange(len(other) + 1), rng.choice(letters))
            other.pop(rng.randrange(len(other)))
        right.append("".join(other))
    edits, common, jw = pairs.aligned(left, right)
    assert edits.tolist() == [_edits(a, b) for a, b in zip(left, right)]
    assert common.tolist() == [similarity.common_subsequence(a, b) for a, b in zip(left, right)]
    assert jw.tolist() == [similarity.jaro_winkler(a, b) for a, b in zip(left, right)]
    assert pairs.compared([], [], [], []).shape == (len(pairs.COMPARED), 0)
    assert np.isfinite(pairs.compared(left, right, right, left)).all()


def test_pairs_keep_their_columns_and_meet_no_interpreted_sets(spark):
    raw = spark.createDataFrame(
        [("S1", "S1-0", "A B Cedar", "12 high st", "fr", 0), ("S2", "S2-1", "Cedar A.B.", "12 High Street", "FR", 1)],
        "role string, entity_id string, business_name string, business_address string, country string, ordinal long",
    )
    found = features.pair_features(spark.createDataFrame([("S1-0", "S2-1", 1)], "s1_id string, cand_id string, label int"), prepare(raw, DEFAULT), ("label", "name_acronym_match", "name_token_sort_sim"))
    assert [tuple(r) for r in found.collect()] == [("S1-0", "S2-1", 1, 1.0, 1.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan and "array_intersect" not in plan
