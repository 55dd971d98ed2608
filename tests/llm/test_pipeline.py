"""The pipeline on a planted corpus, stage by stage against brute force, and the entry module without it."""

from __future__ import annotations

import random

import brute
import sentencepiece

import corpus_pipeline
from kinmark.llm import queries, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abdeiklnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def corpus() -> tuple[list, list, list]:
    rng = random.Random(12)

    def prose(n: int) -> str:
        return " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(n))

    docs = [prose(rng.randint(6, 14)) for _ in range(160)]
    toxic = set(range(0, 160, 8))
    for i in toxic:
        words = docs[i].split()
        words[rng.randrange(len(words))] = "grumbling"
        docs[i] = " ".join(words)
    passage = prose(9)
    item = prose(5)
    for i in (41, 43, 45):
        docs[i] += "\n" + passage
    for i in (51, 53):
        docs[i] = docs[i][:200] + "\n" + item
    docs += [docs[61], docs[61], docs[63] + " End", None, "", "short"]
    return docs, sorted(toxic), [(1, item), (2, "nothing of this")]


def make(spark, folder):
    docs, toxic, items = corpus()
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, toxic, items


def test_every_stage(spark, tmp_path):
    rows, toxic, items = make(spark, tmp_path)
    docs, now = queries.table(spark, str(tmp_path), "documents"), {r[0]: r[1] for r in rows}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            want = {i: t for i, t in now.items() if i not in toxic}
        elif name == "simhash_near_dedup":
            groups = brute.components([(i, brute.fingerprint(t)) for i, t in now.items()])
            want = {i: now[i] for i in set(groups.values())}
        elif name == "substring_dedup":
            left = brute.without_repeats(list(now.items()), substring_dedup.sentences)
            want = {i: t for i, t in left.items() if t is None or t.strip(" ")}
            assert want != now
        elif name == "benchmark_decontamination":
            want = {i: t for i, t in now.items() if not brute.contamination(t, items)["contaminated"]}
            assert len(now) - len(want) == 1
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
            assert {i: r.ids for i, r in got.items()} == {i: library.encode(t or "", add_eos=True) for i, t in now.items()}
            break
        assert out.columns == columns
        assert {i: r.text for i, r in got.items()} == want
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
        docs, now = out, want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids for r in whole.collect()} == {i: r.ids for i, r in got.items()}


def test_empty_tables(spark, tmp_path):
    make(spark, tmp_path / "full")
    for name in ("documents", "labels", "benchmark"):
        queries.table(spark, str(tmp_path / "full"), name).where("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(21)
    pool = [sentence(rng, rng.randint(1, 12)) for _ in range(40)] + [sentence(rng, 60), sentence(rng, 40)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    runs = [" ".join(pool[k : k + 5]) for k in (0, 8, 20)]
    rows += [(100 + i, rng.choice(runs) + " " + rng.choice(pool) + "\n" + rng.choice(runs)) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == brute.without_repeats(rows, substring_dedup.sentences)


def test_near_copies_of_a_hot_text(spark):
    """A third of the rows are copies of one text, others near copies of it: one component, one row kept."""
    rng = random.Random(5)
    base = " ".join(sentence(rng, 12) for _ in range(30))
    near = [base.replace(w, w + "x", 1) for w in base.split()[:40]]
    rows = [(i, base) for i in range(60)] + [(100 + i, t) for i, t in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components([(i, brute.fingerprint(t)) for i, t in rows])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicate_components(df).collect()} == want
