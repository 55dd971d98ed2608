"""The linkage operators on the small cases that define them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinmark.functions import similarity as sim
from kinmark.functions import text, tokens
from kinmark.functions.fixed_values import FEATURE_NAMES
from kinmark.operators import blocking, decide, evaluate, features, ranking, training
from kinmark.params import DEFAULT
from kinmark.plans import linkage
from kinmark.sources import entities as src
from kinmark.sources import sinks
from kinmark.streaming import scoring


def values(spark, inputs, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.y for r in rows.select("i", make(F.col("v")).alias("y")).orderBy("i").collect()]


def entities(spark, rows):
    """``(id, name, address, country)``; the id's beginning is the role."""
    full = [(r[0][:2], *r, k) for k, r in enumerate(rows)]
    return spark.createDataFrame(
        full, "role string, entity_id string, business_name string, business_address string, country string, ordinal long"
    )


def test_normalize_text(spark):
    cases = {
        "Quillon Bakery Works Pvt Ltd": "quillon bakery works pvt ltd",
        "\t Fig & Thyme+Salt@Harbour ": "fig and thyme plus salt at harbour",
        "Morrow's Tool-Shed?! No. 88/4": "morrow s tool shed no 88 4",
        "Ångström Crêperie Žižkov": "angstrom creperie zizkov",
        "221st Row, 3rd gate, 42th x": "221 row 3 gate 42 x",
        None: "",
        "(null)": "null",
        "\tNone ": "",
        "7th_y": "7th y",
        "¾ ﬂ ø": "34 fl",
        "N/A": "n a",
        "प्राइवेट घर लिमिटेड": "private limited",
    }
    assert values(spark, cases, text.normalize_text) == list(cases.values())
    # not idempotent
    assert values(spark, ["(null)", "7th_y"], lambda c: text.normalize_text(text.normalize_text(c))) == ["", "7 y"]


def test_normalize_country(spark):
    cases = {" portugal": "PORTUGAL", "Côte d'Or": "COTE D OR", None: "UNKNOWN", "null": "UNKNOWN", "--": "UNKNOWN"}
    assert values(spark, cases, text.normalize_country) == list(cases.values())


def test_standardize_address(spark):
    assert values(spark, ["12 Main St, Apt 4", None], text.standardize_address_text) == ["12 main street apartment 4", ""]


def test_tokens(spark):
    names = values(spark, ["Harrow Fig Company Ltd", "K/9 Kennels LLC", "The Holdings Co", "", "(none)", "x y z"], tokens.name_tokens)
    assert names[0] == ["n_harrow", "n_fig"]
    assert names[1] == ["n_kennels", "n_acr_k9"] and names[2] == ["n_holdings"] and names[3] == [] and names[4] == ["n_none"]
    assert names[5] == ["n_acr_xyz"]
    found = values(spark, ["0406 Juniper Crescent, Old Quay, NJ", "00", "0077 q", ""], tokens.address_tokens)
    assert found[0] == ["num_406", "w_juniper", "w_crescent", "w_old", "w_quay", "sh_406_juniper", "sh_juniper_crescent", "sh_crescent_old", "sh_old_quay"]
    assert found[1] == [] and found[2] == ["num_77"] and found[3] == []
    assert values(spark, ["fig", "fi gsa", ""], tokens.name_ngrams) == [["ng_fig"], ["ng_figs", "ng_igsa"], []]


def test_soundex(spark):
    cases = {"ashcraft": "A226", "0abc": "1200", "00": "0000", "7eleven": "7415", "": "", "robert": "R163", "pfister": "P236"}
    assert values(spark, cases, text.soundex) == list(cases.values())


def test_text_similarities():
    def lcs(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert sim.common_subsequence(a, b) == lcs(a, b)
        assert 0 <= sim.jaro(a, b) <= sim.jaro_winkler(a, b) <= 1
    assert sim.jaro_winkler("", "") == 1.0 and sim.jaro_winkler("a", "") == 0.0 and sim.lcs_ratio("", "") == 0.0
    assert sim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611111)
    assert sim.jaro("dixon", "dicksonx") == pytest.approx(0.7666667)


def test_similarity_of_empty_texts(spark):
    one = spark.createDataFrame([("", "", "abc", ["a", "a", "b"], ["b"])], "a string, b string, c string, x array<string>, y array<string>")
    none = F.array().cast("array<string>")
    got = one.select(
        sim.edit_similarity(F.col("a"), F.col("b")),
        sim.token_sort_similarity(F.col("a"), F.col("b")),
        sim.jaccard(none, none),
        sim.containment(none, F.col("x")),
        sim.ngram_jaccard(F.col("a"), F.col("c")),
        sim.length_ratio(F.col("a"), F.col("b")),
        sim.edit_similarity(F.col("a"), F.col("c")),
        sim.jaccard(F.col("x"), F.col("y")),
        sim.containment(F.col("x"), F.col("y")),
    ).first()
    assert list(got) == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 1.0]


def found(spark, rows, params=DEFAULT):
    prepared = src.prepare(entities(spark, rows), params)
    return {(r.s1_id, r.cand_id) for r in blocking.block(prepared, params).collect()}


def test_blocking(spark):
    # an address alone is enough, whatever the names
    rows = [
        ("S1-1", "Velmora", "31 Heron Wharf, Port Ellery", "US"),
        ("S2-7", "Something Else", "31 Heron Wharf, Port Ellery, ME", "US"),
        ("S3-8", "Third Matter", "640 Copper Hill, Dunmere", "US"),
    ]
    assert found(spark, rows) == {("S1-1", "S2-7")}
    # countries are apart unless asked otherwise
    rows = [
        ("S1-1", "Norvek Glass", "5 Kiln Yard", "Norway"),
        ("S2-a", "Norvek Glass", "5 Kiln Yard", " norway"),
        ("S2-b", "Norvek Glass", "5 Kiln Yard", "Chile"),
    ]
    assert found(spark, rows) == {("S1-1", "S2-a")}
    assert len(found(spark, rows, DEFAULT.with_(partitioning="none"))) == 2
    assert found(spark, rows, DEFAULT.with_(partitioning="fixed", countries=("CHILE",))) == set()
    # an unknown country meets everything, in the pass over unknown countries
    assert len(found(spark, [*rows, ("S2-X", "Nothing", "Else", None)])) == 2
    # a name token, an address token and an n-gram each give a candidate, once
    rows = [
        ("S1-1", "Tamarind Optics", "12 Falcon Row", "US"),
        ("S2-1", "Tamarind Bricks", "8 Elder Gate", "US"),
        ("S2-2", "Plain Paper", "12 Falcon Row", "US"),
        ("S2-3", "Tamarindello", "77 Nowhere", "US"),
        ("S3-4", "Tamarind Optics", "12 Falcon Row", "US"),
    ]
    assert {c for _, c in found(spark, rows)} == {"S2-1", "S2-2", "S2-3", "S3-4"}
    nothing = [("S1-1", None, "", "US"), ("S2-0", "", None, "US"), ("S3-0", "null", "none", "US")]
    assert found(spark, nothing) == set()


def test_stored_index(spark, tmp_path):
    rows, _ = business(spark, 15)
    s1, others = (src.prepare(rows.where(f"role {op} 'S1'"), DEFAULT) for op in ("=", "<>"))
    path = str(tmp_path / "index")
    want = {tuple(r) for r in blocking.block(src.prepare(rows, DEFAULT), DEFAULT).collect()}
    index = blocking.store_index(others, DEFAULT, path)
    assert {tuple(r) for r in blocking.probe_index(s1, index, DEFAULT).collect()} == want
    # a lost part is made again, a finished one kept; other parameters and damage are errors
    sinks.FileMoves(spark, path).remove("counts")
    with pytest.raises(ValueError, match="not complete"):
        blocking.load_index(spark, DEFAULT, path)
    blocking.store_index(others.where("false"), DEFAULT, path)
    assert {tuple(r) for r in blocking.probe_index(s1, blocking.load_index(spark, DEFAULT, path), DEFAULT).collect()} == want
    with pytest.raises(ValueError, match="other parameters"):
        blocking.load_index(spark, DEFAULT.with_(name_cap=3), path)
    others.limit(1).select("entity_id").toDF("x").withColumn("post_count", F.lit(1)).write.mode("overwrite").parquet(f"{path}/counts")
    with pytest.raises(ValueError, match="damaged"):
        blocking.load_index(spark, DEFAULT, path)


def test_fallback_takes_the_rarest_token(spark):
    rows = [("S1-1", "Alpha Beta", "", "US")] + [(f"S2-{i}", "Alpha", "", "US") for i in range(4)] + [(f"S3-{i}", "Beta", "", "US") for i in range(3)]
    params = DEFAULT.with_(name_cap=2, ngram_cap=0)
    assert {c for _, c in found(spark, rows, params)} == {"S3-0", "S3-1", "S3-2"}
    assert {c for _, c in found(spark, rows, params.with_(fallback_limit=2))} == {"S3-0", "S3-1"}
    assert found(spark, rows, params.with_(fallback=False)) == set()


def test_ranking(spark):
    rows = [
        ("S1-1", "Alpha Alpha Beta", "7 Elm", "US"),
        ("S2-1", "Alpha Beta", "9 Oak", "US"),
        ("S2-2", "Beta", "7 Elm", "US"),
        ("S3-3", "Alpha", "", "US"),
    ]
    prepared = src.prepare(entities(spark, rows), DEFAULT)
    ranked = ranking.rank_by_overlap(blocking.block(prepared, DEFAULT), prepared, 2).orderBy("rank").collect()
    assert [(r.cand_id, r.weight) for r in ranked] == [("S2-2", 5), ("S2-1", 4)]
    plain = DEFAULT.with_(use_ngrams=False)
    lists = {r.cand_id: r.weight for r in ranking.rank_by_counter(prepared, plain, 9, True).collect()}
    sets = {r.cand_id: r.weight for r in ranking.rank_by_counter(prepared, plain, 9, False).collect()}
    assert lists == {"S2-1": 6, "S2-2": 5, "S3-3": 4} and sets == {"S2-1": 4, "S2-2": 5, "S3-3": 2}


def test_pair_features(spark):
    rows = [
        ("S1-1", "Osprey Timber Inc", "19 Quarry Rd, Millbeck", "US"),
        ("S2-1", "Osprey Timbers LLC", "19 Quarry Road, Millbeck", "US"),
        ("S1-2", None, None, None),
        ("S3-2", None, None, None),
    ]
    prepared = src.prepare(entities(spark, rows), DEFAULT)
    pairs = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S3-2")], "s1_id string, cand_id string")
    got = {r.s1_id: r.asDict() for r in features.pair_features(pairs, prepared).collect()}
    assert all(len(r) == 2 + 33 for r in got.values()) and tuple(got["S1-1"])[2:] == FEATURE_NAMES
    a, b = got["S1-1"], got["S1-2"]
    assert a["name_jaccard"] == pytest.approx(1 / 3) and a["name_containment"] == 0.5 and a["addr_exact_match"] == 1.0
    assert a["addr_house_num_match"] == 1.0 and a["is_source3"] == 0.0 and a["name_prefix_match"] == 1.0
    # "osprey timber inc" in "osprey timbers llc": all but "in" is common
    assert a["name_lcs_ratio"] == pytest.approx(2 * 15 / (17 + 18))
    assert b["addr_null"] == 1.0 and b["addr_house_num_match"] == 0.5 and b["name_edit_sim"] == 1.0 and b["name_lcs_ratio"] == 0.0
    assert b["name_jaro_winkler"] == 1.0 and b["addr_jaro_winkler"] == 0.0 and b["country_match"] == 1.0 and b["is_source3"] == 1.0


def test_decisions_and_scores(spark):
    scored = spark.createDataFrame(
        [("S1-a", "S2-p", 0.91), ("S1-a", "S3-q", 0.905), ("S1-a", "S2-r", 0.33), ("S1-b", "S3-s", 0.62), ("S1-c", "S2-t", 0.08)],
        "s1_id string, cand_id string, prob double",
    )
    truth = spark.createDataFrame([("S1-a", ["S2-p", "S3-q"]), ("S1-b", ["S3-s"]), ("S1-c", []), ("S1-d", ["S2-z"])], "s1_id string, matches array<string>")
    # at 0.6 a and b are right, c is right to be alone, d is missed: 3 of 4
    best = decide.grid_threshold(scored, truth, (0.05, 0.6, 0.91)).first()
    assert best.macro_f05 == pytest.approx(0.75) and best.threshold == 0.6
    kept = decide.within_margin(scored, 0.6, 0.001, 7)
    assert {(r.s1_id, r.cand_id) for r in kept.collect()} == {("S1-a", "S2-p"), ("S1-b", "S3-s")}
    assert decide.over_threshold(scored, 0.33).count() == 4
    predicted = decide.predictions(kept, truth)
    assert {r.s1_id: r.matched_ids for r in predicted.collect()} == {"S1-a": ["S2-p"], "S1-b": ["S3-s"], "S1-c": [], "S1-d": []}
    # a: precision 1, recall 1/2, F0.5 = 1.25 * 0.5 / (0.25 + 0.5) = 5/6
    assert evaluate.macro_f05(predicted, truth).first()[0] == pytest.approx((5 / 6 + 1 + 1 + 0) / 4)
    assert evaluate.macro_f05(predicted, truth.where("false")).first()[0] == 0.0
    # two of four predicted are right, two of three found: 1.25 * (1/2 * 2/3) / (1/8 + 2/3)
    cases = [([], [], 1.0), (["x"], [], 0.0), ([], ["x"], 0.0), (["x"], ["y"], 0.0), (["x", "y", "v", "w"], ["x", "y", "z"], 10 / 19)]
    df = spark.createDataFrame(cases, "p array<string>, t array<string>, f double")
    for r in df.select("f", evaluate.f05(F.col("p"), F.col("t")).alias("g")).collect():
        assert r.g == pytest.approx(r.f)


def test_blocking_metrics(spark):
    truth = spark.createDataFrame([("S1-a", ["S2-p"]), ("S1-b", []), ("S1-c", ["S2-q", "S3-r", "S3-s"]), ("S1-d", ["S2-t"])], "s1_id string, matches array<string>")
    cands = spark.createDataFrame(
        [("S1-a", "S2-p"), ("S1-a", "S2-x"), ("S1-a", "S2-y"), ("S1-a", "S2-z"), ("S1-b", "S2-x"), ("S1-c", "S3-r"), ("S1-c", "S3-s")],
        "s1_id string, cand_id string",
    )
    got = evaluate.blocking_metrics(cands, truth).first()
    assert (got.num_s1, got.total_true_matches, got.retained_true_matches, got.blocking_recall) == (4, 5, 3, 0.6)
    # candidates per record: 4, 1, 2, 0
    assert (got.avg_candidates, got.median_candidates, got.min_candidates, got.max_candidates) == (1.75, 1.5, 0, 4)
    empty = evaluate.blocking_metrics(cands.where("false"), truth.where("false")).first()
    assert all(v == 0 for v in empty)


def test_files_and_verification(spark, tmp_path):
    (tmp_path / "s1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t"a ""b"" c"\t\nS1-2\tnull\t\tUS\n')
    rows = src.read_tsv(spark, str(tmp_path / "s1.tsv")).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", "NA", 'a "b" c', ""), ("S1-2", "null", "", "US")]
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS3-2, S2-1,,S3-2\nS1-2\t\n")
    truth = src.read_ground_truth(spark, str(tmp_path / "gt.tsv"))
    assert {r.s1_id: r.matches for r in truth.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    lines = sinks.match_lines(truth.withColumnRenamed("matches", "matched_ids"), truth)
    sinks.write_tsv(lines, str(tmp_path / "out"), single_file=True)
    back = src.read_ground_truth(spark, str(tmp_path / "out"))
    assert {r.s1_id: r.matches for r in back.collect()} == {"S1-1": ["S2-1", "S3-2"], "S1-2": []}
    with pytest.raises(Exception, match="(?i)already exists"):
        sinks.write_tsv(lines, str(tmp_path / "out"))
    faulty = lines.where("source1_entity_id = 'S1-1'")
    report = sinks.verify_lines(faulty.unionByName(faulty).unionByName(faulty.withColumn("source1_entity_id", F.lit("S1-9"))), truth).first()
    assert tuple(report) == (2, 3, 1, 1, 1)


def business(spark, n=60):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeiklmnorstu") for _ in range(6)) for _ in range(200)]
    rows, truth = [], []
    for i in range(n):
        name, street = f"{rng.choice(words)} {rng.choice(words)} Inc", f"{rng.randint(1, 900)} {rng.choice(words)} St"
        rows.append((f"S1-{i}", name, street, "US"))
        if i % 3:
            rows.append((f"S2-{i}", name.replace("Inc", "LLC"), street.replace("St", "Street"), "US"))
        if i % 4 == 0:
            rows.append((f"S3-{i}", name.split()[0] + " " + rng.choice(words), street, "US"))
        truth.append((f"S1-{i}", [f"S2-{i}"] if i % 3 else []))
    return entities(spark, rows), spark.createDataFrame(truth, "s1_id string, matches array<string>")


def test_train_infer_publish(spark, tmp_path):
    rows, truth = business(spark)
    model, best = linkage.train(rows, truth, boost=training.BoostParams(rounds=2, depth=3), val_share=0.3)
    assert best["macro_f05"] > 0.8
    training.save_model(model, str(tmp_path / "m"), FEATURE_NAMES, {"top_n": 60}, best)
    again, sidecar = training.load_model(str(tmp_path / "m"), config={"top_n": 60})
    assert sidecar["feature_count"] == 33
    with pytest.raises(ValueError, match="top_n"):
        training.load_model(str(tmp_path / "m"), config={"top_n": 50})
    with pytest.raises(ValueError, match="within"):
        training.save_model(model, str(tmp_path / "n"), FEATURE_NAMES, {}, {"macro_f05": 0.1}, wanted_f05=0.96)
    params = DEFAULT.with_(threshold=best["threshold"], margin=best["margin"], max_matches=best["k"])
    ranked, matches = linkage.infer(rows, again, params)
    reports = linkage.publish(ranked, matches, rows, str(tmp_path / "out"))
    assert all(r["expected_rows"] == r["output_rows"] == 60 for r in reports.values())
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["candidate_pairs", "matching_results"]
    with pytest.raises(FileExistsError):
        linkage.publish(ranked, matches, rows, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="duplicate"):
        linkage.publish(ranked, matches.unionByName(matches), rows, str(tmp_path / "bad"))
    assert not any((tmp_path / "bad").iterdir())


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    rows, _ = business(spark, 20)
    s1 = rows.where("role = 'S1'").select("entity_id", "business_name", "business_address", "country")
    sinks.write_tsv(s1.limit(10), str(tmp_path / "in1"), single_file=True)
    index = blocking.store_index(src.prepare(rows.where("role <> 'S1'"), DEFAULT), DEFAULT, str(tmp_path / "index"))
    (tmp_path / "in").mkdir()

    def run():
        query = scoring.score_stream(scoring.stream_entities(spark, str(tmp_path / "in")), index, DEFAULT, str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination()

    first = next((tmp_path / "in1").glob("*.csv"))
    first.rename(tmp_path / "in" / "1.csv")
    run()
    done = {r.entity_id for r in src.read_tsv(spark, str(tmp_path / "in" / "1.csv")).collect()}
    rest = s1.where(~F.col("entity_id").isin(*done))
    sinks.write_tsv(rest, str(tmp_path / "in2"), single_file=True)
    next((tmp_path / "in2").glob("*.csv")).rename(tmp_path / "in" / "2.csv")
    run()
    prepared = src.prepare(rows, DEFAULT)
    want = {(r.s1_id, r.cand_id, r["rank"]) for r in linkage.candidates(prepared).collect()}
    got = [(r.s1_id, r.cand_id, r["rank"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
