"""Near copies by five-word shingles: the stage against brute force over all pairs."""

from __future__ import annotations

import random

import brute
import pytest

from kinmark.llm import shingles, simhash


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abdeiklnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def changed(rng: random.Random, text: list[str], times: int) -> str:
    out = list(text)
    for i in rng.sample(range(len(out)), times):
        out[i] = words(rng, 1)[0] + "q"
    return " ".join(out)


@pytest.mark.parametrize("block", [shingles.BLOCK, 500])  # 500: some three sets, so hot keys have many blocks
def test_stage_reaches_jaccard(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(3)
    rows, base = [], [words(rng, rng.randint(60, 260)) for _ in range(25)]
    for text in base:
        rows += [" ".join(text), changed(rng, text, max(1, len(text) // 45)), changed(rng, text, max(2, len(text) // 30))]
    hot = words(rng, 150)  # copies near the text, mostly not near each other
    rows += [changed(rng, hot, rng.randint(2, 6)) for _ in range(80)] + [" ".join(hot)] * 3
    rows += ["", None, "one two", "One  two", "one two three"]
    rows = list(enumerate(rows))
    want = brute.kept(rows)
    by_bits = set(brute.components([(i, brute.fingerprint(t)) for i, t in rows]).values())
    assert len(want) < len(by_bits) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert {r.doc_id for r in out.collect()} == want


def test_similar_is_inclusive():
    sets = [shingles.shingle_set(" ".join(map(str, range(n))).encode()) for n in (8, 9, 13)]
    assert shingles.similar(sets[0], sets[1])  # 4 of 5
    assert not shingles.similar(sets[0], sets[2])
