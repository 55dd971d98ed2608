"""The main blocking queries keep what the default caps keep: a token of 30 records still gives its candidates."""

from __future__ import annotations

from random import Random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from kinmark.functions import text, tokens
from kinmark.operators import blocking, packed
from kinmark.params import DEFAULT
from kinmark.sources import entities as src


def test_main_queries_have_the_default_caps(spark, tmp_path):
    words = "walbert tirando mekolin sarufe dontaly prigam lostev"
    rows = [(i, f"{words} {i + 100000}\n{words} lane", "en", f"src{i % 3}", 10) for i in range(93)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = __spark_entry__.queries()
    for name in ("block_name", "block_ngram", "candidates_raw_addr", "candidates_unknown_pass", "candidates_no_partition", "candidates_fixed_countries"):
        assert run[name](spark, str(tmp_path)).count() == 31 * 62, name
    assert run["rank_counter_set_top8"](spark, str(tmp_path)).count() == 31 * 8
    assert run["rank_counter_list_top50"](spark, str(tmp_path)).count() == 31 * 50
    assert run["capped_tokens"](spark, str(tmp_path)).where("post_count = 62").count() > 0
    assert all(len(r.candidate_entity_ids.split(",")) == 62 for r in run["candidate_pairs_tsv"](spark, str(tmp_path)).collect())
    assert run["block_name_tight"](spark, str(tmp_path)).count() == 0
    assert {n + "_tight" for n in ("block_addr", "rank_counter_list_top50")} <= run.keys() & __spark_entry__.oracle_sql().keys()


def test_batches_of_records_say_what_the_columns_say(spark):
    """Whole records are tokenised in batches; lists of any record, odd ones included, are those of the expressions."""
    odd = ["", None, " nan ", "(null)", "7th_y", "7th y 021ST 0 00", "¾ ﬂ ø Kth", "A & B+C@D", "12 Main St, Blvd N", "inc", "a b", "प्राइवेट घर", "x\x00y　"]
    rows = [("S1", f"S1-{i}", a, b, a, i) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)]
    entities = spark.createDataFrame(
        rows, "role string, entity_id string, business_name string, business_address string, country string, ordinal long"
    )
    for form, n, a in (("standardized", "n", "a"), ("raw", "business_name", "business_address")):
        made = src.prepare(entities, DEFAULT.with_(address_form=form))
        said = made.select(
            F.col("n") == text.normalize_text("business_name"), F.col("a") == text.standardize_address_text("business_address"),
            F.col("c") == text.normalize_country("country"), F.col("name_toks") == tokens.name_tokens(n),
            F.col("addr_toks") == tokens.address_tokens(a), F.col("ngrams") == tokens.name_ngrams(n, 4),
            F.col("feat_name_toks") == tokens.name_tokens("n"), F.col("feat_addr_toks") == tokens.address_tokens("a"),
        )
        assert {tuple(r) for r in said.collect()} == {(True,) * 8}


def test_queries_over_documents_keep_no_lists(spark, tmp_path):
    """Lists of all documents, kept by every executor, had taken the room of the work."""
    rows = [(i, f"walbert {i}\nmekolin lane {i}", "en", f"src{i % 3}", 10) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("block_addr_tight", "candidates_raw_addr_tight", "rank_counter_list_top50_tight"):
        plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().withCachedData().toString()
        assert "InMemoryRelation" not in plan, name


def test_packed_postings_find_what_the_join_of_tokens_finds(spark):
    """Blocking without fallback shuffles compressed indexes, not a row for every token."""
    random = Random(3)
    words = [f"{a}{b}" for a in ("kelt", "mora", "of", "07", "zürich") for b in range(9)]
    rows = [
        (("S1", "S2", "S3")[i % 3], f"{'S1' if i % 3 == 0 else 'S2'}-{i % 80}", " ".join(random.choices(words, k=2)), " ".join(random.choices(words, k=i % 9)), "AB"[i % 2], i)
        for i in range(240)
    ]
    raw = spark.createDataFrame(
        rows, "role string, entity_id string, business_name string, business_address string, country string, ordinal long"
    )
    for params in (DEFAULT.with_(name_cap=9, word_cap=8, shingle_cap=2, ngram_cap=6), DEFAULT.with_(partitioning="none")):
        for kinds in (None, ("name",), ("word", "num", "shingle"), ("num",), ("ngram",)):
            params = params.with_(fallback=False)
            rows = src.prepare(raw, params)
            parted = blocking.with_part(rows, params, False)
            probes, postings = (blocking.token_rows(parted.where(w), params, i, kinds) for w, i in (("role = 'S1'", "s1_id"), ("role <> 'S1'", "cand_id")))
            counts = blocking.token_counts(postings)
            want = blocking._candidates(probes, postings, counts, parted, params).collect()
            plan = blocking.block(rows, params, kinds, False)
            assert sorted(plan.collect()) == sorted(want)
            assert "generate explode" not in plan._jdf.queryExecution().optimizedPlan().toString().lower()


def test_pairs_come_once_from_blocks_of_records(monkeypatch):
    random = Random(4)
    for cells in (1, 7, 50, 10_000):
        monkeypatch.setattr(packed, "_CELLS", cells)
        held = [sorted(random.sample(range(40), random.randint(1, 9))) for _ in range(12)]
        many = np.array([len(x) for x in held])
        asked = sorted((random.randrange(15), random.randrange(12)) for _ in range(60))
        s, code = (np.array(x) for x in zip(*asked))
        found = np.concatenate(list(packed._pairs(s, code, np.cumsum(many) - many, many, np.concatenate(held), 40)))
        assert sorted(found.tolist()) == sorted({a * 40 + t for a, c in asked for t in held[c]})
