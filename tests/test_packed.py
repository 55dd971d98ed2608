"""Fallback, lines and rankings from packed postings are those of the joins of tokens, which shuffled a row for each token."""

from __future__ import annotations

from random import Random

import pytest
from pyspark.sql import functions as F

from kinmark.operators import blocking, packed, ranking
from kinmark.params import DEFAULT
from kinmark.sources import entities as src
from kinmark.sources import sinks

CAPS = DEFAULT.with_(name_cap=5, word_cap=3, shingle_cap=2, ngram_cap=4)
_COLUMNS = "role string, entity_id string, business_name string, business_address string, country string, ordinal long"


@pytest.fixture(scope="module")
def raw(spark):
    random = Random(11)
    words = [f"{a}{b}" for a in ("kelt", "mora", "of", "07", "zürich") for b in range(5)]
    rows = [
        (role := ("S1", "S2", "S3")[i % 3], f"{role}-{i}", " ".join(random.choices(words, k=i % 4)), " ".join(random.choices(words, k=i % 11)), "AB"[i % 2], i)
        for i in range(210)
    ]
    return spark.createDataFrame(rows + rows[:12], _COLUMNS)


def _sides(rows):
    return rows.where("role = 'S1'"), rows.where("role <> 'S1'")


def _joined(rows, params, has_unknown):
    parted = blocking.with_part(src.prepare(rows, params), params, has_unknown)
    probes, postings = (blocking.token_rows(x, params, i) for x, i in zip(_sides(parted), ("s1_id", "cand_id")))
    return blocking._candidates(probes, postings, blocking.token_counts(postings), parted, params)


def test_fallback_is_decided_in_cells(spark, raw):
    some = raw.withColumn("country", F.when(F.col("ordinal") % 7 > 0, F.col("country")))
    for rows, params, has_unknown in (
        (raw, CAPS, False), (some, CAPS, True), (raw, CAPS.with_(partitioning="none", address_form="raw"), False),
        (raw, CAPS.with_(partitioning="fixed", countries=("B",)), False),
    ):
        want = sorted(_joined(rows, params, has_unknown).collect())
        without = blocking.block_sides(*_sides(rows), params.with_(fallback=False), has_unknown=has_unknown).count()
        assert without < len(want)
        for made in (rows, src.prepare(rows, params)):
            plan = blocking.block_sides(*_sides(made), params, has_unknown=has_unknown)
            assert sorted(plan.collect()) == want
            assert "token" not in plan._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_lines_and_rankings_are_made_in_cells(spark, raw, monkeypatch):
    rows = src.prepare(raw, CAPS)
    found = _joined(raw, CAPS, False)
    ids = raw.where("role = 'S1'").select(F.col("entity_id").alias("s1_id"))
    assert sorted(blocking.packed_sides(*_sides(raw), CAPS, packed.Want("lines")).collect()) == sorted(sinks.candidate_lines(found, ids).collect())
    want = sorted(ranking.rank_by_overlap(found, rows, 6).collect())
    plan = ranking.rank_sides_by_overlap(*_sides(raw), CAPS, 6)
    assert sorted(plan.collect()) == want
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_get_only_postings_they_share(spark, raw, monkeypatch):
    """Lines meet from several blocks of targets, and fallbacks are those of the joins, with many small blocks as well."""
    assert packed.shape(_sides(raw), packed.Want("lines"))[2] > 1
    for want in ("pairs", "lines"):
        monkeypatch.setattr(packed, "shape", lambda sides, want: (16, 7, 5))
        monkeypatch.setattr(blocking, "shape", lambda sides, want: (16, 7, 5))
        found = _joined(raw, CAPS, False)
        ids = raw.where("role = 'S1'").select(F.col("entity_id").alias("s1_id"))
        made = sorted(blocking.packed_sides(*_sides(raw), CAPS, packed.Want(want)).collect())
        assert made == sorted((found if want == "pairs" else sinks.candidate_lines(found, ids)).collect())


def test_settled_records_pass_on_no_fallback():
    """A record with a candidate in another bucket sends no token, and no posting of targets, to fall back on."""
    import numpy as np
    import pyarrow as pa

    def stretch(side, number, lists):
        held = packed._Lists()
        held.add(pa.RecordBatch.from_pydict({"part": ["A"] * len(lists), "id": [f"{side}{i}" for i in range(len(lists))], "tokens": lists}))
        return pa.Table.from_batches(packed._stretch(side, number, *held.ended(), 1, 1, False)).slice(0, 1)

    rows = pa.concat_tables([stretch("s", 0, [["w_often"], ["w_often"]]), stretch("t", 1, [["w_often"]] * 9)])
    for bits, held in ((None, {"s", "t"}), (np.packbits([1, 1]).tobytes(), set())):
        known = rows.append_column("settled", pa.array([bits, None], pa.binary()))
        assert {x[0] for x in packed._meet(known, 1, CAPS, packed.Want(), 1, 1)} == held


def test_sums_are_of_a_part_and_one_heavy_record_does_not_slow_others():
    """a record is summed against targets of its own part, and what is too large for single precision is its own matter."""
    import numpy as np
    import pyarrow as pa

    s_part, t_part = pa.array(["A"] * 5 + ["B"] * 4), pa.array(list("ABABABABAB"))
    many, targets = np.array([5, 2, 5, 1]), np.array([0, 2, 4, 6, 8, 2, 6, 1, 3, 5, 7, 9, 5])
    rows, codes = np.array([0, 1, 2, 3, 4, 0, 2, 5, 6, 7, 8, 6]), np.array([0] * 5 + [1] * 2 + [2] * 4 + [3])
    weights = np.array([2, 1, 1 << 25, 1, 2, 1, 1, 2, 2, 1, 1, 3])
    starts = np.cumsum(many) - many
    scores = packed._Scores(rows, codes, weights, starts, many, targets, np.arange(9), np.arange(10), s_part, t_part, 10)
    got, seen = np.zeros((9, 10)), []
    for lo, hi, columns, sums in scores.spans(0, 9):
        seen += range(lo, hi)
        assert {s_part[r].as_py() for r in range(lo, hi)} == {t_part[c].as_py() for c in columns.tolist()} and len(columns) == 5
        got[lo:hi, columns] = sums
    want = np.zeros((9, 10))
    for r, c, w in zip(rows, codes, weights):
        want[r, targets[starts[c] : starts[c] + many[c]]] += w
    assert seen == list(range(9)) and (got == want).all()
    assert all(part[3] for part in scores.parts) and 2 in scores.rest[1][0] and len(scores.rest[0][0]) + len(scores.rest[1][0]) == 2


def test_pairs_of_many_records_are_ranked_at_once():
    """chunks of pairs are put together before they are summed; none is lost, and their order stays."""
    import numpy as np

    chunks = [np.arange(lo, lo + 7) for lo in range(0, 70, 10)] + [np.zeros(0, np.int64)]
    got = list(packed._joined(iter(chunks), 25))
    assert [len(x) for x in got] == [21, 21, 7] and (np.concatenate(got) == np.concatenate(chunks)).all()


def test_stream_meets_packed_postings(spark, raw, tmp_path, monkeypatch):
    """a stored index holds no row for a token, and a batch shuffles none; what it gives stays that of the joins."""
    from kinmark.streaming import scoring

    s1, others = _sides(raw.dropDuplicates(["entity_id"]))
    some = [x.withColumn("country", F.when(F.col("ordinal") % 7 > 0, F.col("country"))) for x in (s1, others)]
    for k, (left, right, has_unknown) in enumerate(((s1, others, False), (*some, True))):
        index = blocking.store_index(right, CAPS, str(tmp_path / f"index{k}"), has_unknown)
        assert set(index.postings.columns) == {"side", "bucket", "stretch", "index"} and (index.targets is None) == (not has_unknown)
        rows = src.prepare(left.unionByName(right), CAPS)
        want = sorted(ranking.rank_by_overlap(_joined(left.unionByName(right), CAPS, has_unknown), rows, CAPS.top_n).collect())
        plan = scoring.batch_candidates(left, index, CAPS)
        assert sorted(plan.collect()) == want
        assert has_unknown or "token" not in plan._jdf.queryExecution().optimizedPlan().toString()
    few = CAPS.with_(fallback_limit=2)
    index = blocking.store_index(others, few, str(tmp_path / "few"))
    prepared = src.prepare(s1.unionByName(others), few)
    assert index.form is None and sorted(blocking.probe_index(s1, index, few).collect()) == sorted(blocking.block(prepared, few, has_unknown=False).collect())


def test_dense_chunks_of_lines_pass_as_bits():
    """half of all pairs take about a bit for each possible pair, few pairs take numbers, and both give the same lines."""
    import numpy as np
    import pyarrow as pa

    rng, s_ids, t_ids = np.random.default_rng(1), pa.array([f"S1-{k}" for k in range(200)]), pa.array([f"S2-{k}" for k in range(1000)])
    for share in (0.5, 0.01):
        i, j = np.nonzero(rng.random((200, 1000)) < share)
        partial = packed._partial(0, 0, i, j, t_ids)
        if share == 0.5:
            assert sum(map(len, partial["index"].to_pylist())) < 200 * 1000 / 8 * 1.5
        rows = pa.Table.from_batches([partial, packed._records_of(0, 0, s_ids, np.ones(200, np.int64))])
        for chunk in (0, 1):
            made = pa.Table.from_batches(packed._lines(rows.filter(pa.compute.equal(rows["chunk"], chunk)), packed.Want("lines"))).to_pylist()
            assert [x["s1_id"] for x in made] == s_ids.to_pylist()[128 * chunk : 128 * (chunk + 1)]
            for k, line in enumerate(made, 128 * chunk):
                assert line["ids"] == ",".join(sorted(f"S2-{x}" for x in j[i == k]))


def test_stream_shuffles_postings_of_a_batch_once(spark, raw, tmp_path, monkeypatch):
    """the look for records without candidates and the meeting of postings read the same shuffle."""
    from kinmark.streaming import scoring

    s1, others = _sides(raw.dropDuplicates(["entity_id"]))
    columns = ["entity_id", "business_name", "business_address", "country"]
    s1.select(columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    index, plans, made = blocking.store_index(others, CAPS, str(tmp_path / "index")), [], scoring.batch_candidates

    def noted(*args):
        found = made(*args)
        found.collect()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(scoring, "batch_candidates", noted)
    stream = spark.readStream.schema(src.ENTITY_SCHEMA).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, index, CAPS, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert len(plans) == 1 and "ReusedExchange" in plans[0].split("Initial Plan")[0]
