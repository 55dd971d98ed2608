import json
import random

import pytest
from pyspark.sql import functions as F

from kinmark import cli
from kinmark.operators import training
from kinmark.sources import entities as src


def folder(tmp_path, n=40):
    rng = random.Random(9)
    words = ["".join(rng.choice("abdegiklmorstu") for _ in range(6)) for _ in range(120)]
    rows = {"s1": [], "s2": [], "s3": []}
    truth = []
    for i in range(n):
        name, street = f"{rng.choice(words)} {rng.choice(words)}", f"{rng.randint(1, 900)} {rng.choice(words)} St"
        rows["s1"].append((f"S1-{n - i}", name + " Inc", street, "US"))
        if i % 3:
            rows["s2"].append((f"S2-{i}", name + " LLC", street.replace("St", "Street"), "US"))
        rows["s3"].append((f"S3-{i}", name.split()[0] + " " + rng.choice(words), street, "US"))
        truth.append((f"S1-{n - i}", f"S2-{i}" if i % 3 else ""))
    header = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for source, lines in rows.items():
        (tmp_path / f"{source}.tsv").write_text(header + "".join("\t".join(line) + "\n" for line in lines))
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(t) + "\n" for t in truth))
    return [f"--{s}={tmp_path}/{s}.tsv" for s in rows], rows


def test_sources_keep_the_order_of_lines(spark, tmp_path):
    _, rows = folder(tmp_path)
    paths = {s.upper(): f"{tmp_path}/{s}.tsv" for s in rows}
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        read = src.read_sources(spark, paths).persist()
        for role, lines in (("S1", rows["s1"]), ("S3", rows["s3"])):
            got = [r.entity_id for r in read.where(F.col("role") == role).orderBy("ordinal").collect()]
            assert got == [line[0] for line in lines]
        first = training.first_records(read, 7)
        assert {r.entity_id for r in first.where("role = 'S1'").collect()} == {line[0] for line in rows["s1"][:7]}
        assert first.where("role <> 'S1'").count() == len(rows["s2"]) + len(rows["s3"])
        assert training.first_records(read, 1000).count() == read.count()
        assert training.first_records(read, 0).where("role = 'S1'").count() == 0
        read.unpersist()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


def test_bounded_background(spark):
    targets = spark.createDataFrame([(f"S2-{k}", k // 2) for k in range(8)], "entity_id string, ordinal long")
    needed = spark.createDataFrame([("S2-5",), ("S2-1",), ("S2-5",), ("S2-x",)], "cand_id string")
    got = sorted(r.entity_id for r in training.bounded_background(targets, needed, 3).collect())
    assert got == ["S2-0", "S2-1", "S2-2", "S2-3", "S2-5"]
    assert training.bounded_background(targets, needed.where("false"), 0).count() == 0


def test_commands(spark, tmp_path, capsys):
    sources, rows = folder(tmp_path)
    truth = f"--truth={tmp_path}/truth.tsv"
    report = cli.main(["block", *sources, truth, f"--out={tmp_path}/candidates"])
    assert json.loads(capsys.readouterr().out) == report
    assert report["records"] == 40 and report["candidates"] == report["total_candidates"] > 0
    assert report["blocking_recall"] == 1.0
    model = f"--model={tmp_path}/model"
    best = cli.main(["train", *sources, truth, model, "--records=30", "--val-share=0.4", "--rounds=2", "--name-cap=50"])
    assert best["macro_f05"] > 0.5
    with pytest.raises(FileExistsError):
        cli.main(["train", *sources, truth, model])
    done = cli.main(["infer", *sources, model, f"--out={tmp_path}/out", "--matching-only"])
    assert list(done) == ["matching_results"] and done["matching_results"]["output_rows"] == 40
    assert [x.name for x in (tmp_path / "out").iterdir()] == ["matching_results"]
    assert training.load_model(f"{tmp_path}/model")[1]["config"]["name_cap"] == 50
