"""Every operator against its plain statement, on texts with all the awkward cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinmark.llm import (
    chat,
    common,
    decontamination,
    graph,
    quality,
    queries,
    sentencepiece_bpe,
    sharding,
    simhash,
    substring_dedup,
    toxicity,
    url_filter,
    warc,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `count` long, `fp` string"


def sentence(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("abdeiklnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def prose(rng: random.Random, n: int) -> str:
    return " ".join(sentence(rng, rng.randint(4, 14)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 12)) for _ in range(40)]
    texts = [None, "", " ", "\n\n", "One", "One two", "a b c", "ÀB Ç ß 日本 🎉 é", "x" * 3000, "word " * 700, "A|B # $5 <b>\n\nA|B # $5 <b>\n"]
    texts += base + base[:10] + [b + " Extra" for b in base[:10]] + [base[0].replace("a", "e", 1)]
    texts += ["\n".join([base[3]] * 4), base[5] + "\t" + base[6], base[7].upper()]
    return [(i, t, "en", "src", None if t is None else len(t), 3, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_quality_counts(docs, rows, empty):
    got = by_id(quality.score_quality(docs))
    for i, text, *_ in rows:
        want = brute.quality(text)
        assert {k: got[i][k] for k in want} == want, text
        for n in (5, 7, 10):
            assert got[i][f"dup_{n}gram_share"] == pytest.approx(brute.ngram_share(text or "", n)), text
        if want["base_failed"]:
            assert not got[i]["kept"]
    assert quality.score_quality(empty).count() == 0


def test_simhash_components(docs, rows, empty):
    got = by_id(simhash.near_duplicate_components(docs))
    prints = [(i, brute.fingerprint(t)) for i, t, *_ in rows]
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == dict(prints)
    assert {i: r["component_id"] for i, r in got.items()} == brute.components(prints)
    assert simhash.near_duplicate_components(empty).count() == 0


def test_simhash_keeps_one_of_each_group(spark, docs, rows):
    kept = simhash.drop_near_duplicates(docs.unionByName(docs.where("doc_id < 15")))
    assert kept.columns == docs.columns
    want = brute.kept([(i, t) for i, t, *_ in rows])  # by fingerprints or five-word shingles
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    nulls = spark.createDataFrame([(None, "a b c d e"), (None, "q r s t u"), (None, "a b c d e")], "doc_id long, text string")
    assert simhash.drop_near_duplicates(nulls).count() == 2


@pytest.mark.parametrize("bucket", [512, 2])
def test_simhash_links_lose_nothing(spark, monkeypatch, bucket):
    """Planted fingerprints at 0 to 4 bits, also where every bucket counts as hot."""
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(prints)[:12]:
        for bits in (1, 2, 2, 3, 4):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    reach = {r.node: r.component for r in graph.connected_components(found).collect()}
    want = brute.components([(s, s % 2**64) for s in signed])
    groups = {}
    for s in signed:
        groups.setdefault(reach.get(s, s), set()).add(s)
    wanted = {}
    for s, c in want.items():
        wanted.setdefault(c, set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 97]
    nearest, near = simhash.golay_tables()
    assert len(set(nearest.tolist())) == 2048
    fixed = words ^ nearest[simhash._syndrome(words)]
    assert not simhash._syndrome(fixed).any() and np.bitwise_count(words ^ fixed).max() <= 3
    codes = simhash.probe_codes(words)
    for bit in range(23):
        assert (codes == simhash.index_code(words ^ (1 << bit))[:, None]).any(axis=1).all()


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(40)] + [(7, 7), (900, 900), (100, 100)]
    edges += [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(3, 2), (2, 3)]
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "src long, dst long")
    assert {r.node: r.component for r in graph.connected_components(df).collect()} == brute.graph_components(edges)
    assert graph.connected_components(df.where("false")).count() == 0


def test_sharding_is_a_permutation(docs, rows, empty):
    got = sharding.assign_shards(docs, 4).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    again = sharding.assign_shards(docs.repartition(5), 4).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}
    assert sharding.assign_shards(empty, 4).count() == 0
    repeated = sharding.assign_shards(docs.unionByName(docs).unionByName(docs.where("doc_id = 3")), 4)
    assert repeated.select("shard", "slot").distinct().count() == 2 * len(rows) + 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 65537])
def test_feistel_round_trip(n):
    p = sharding.FeistelPermutation(n)
    out = p.forward(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert (p.backward(out) == np.arange(n)).all()


def test_write_shards_keeps_whole_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    place = {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs, 4).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == place
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_sentencepiece_equals_the_library(docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    got = by_id(sentencepiece_bpe.encode_documents(docs, queries.PIECE_MODEL))
    for i, text, *_ in rows:
        ids = library.encode(text or "", add_eos=True)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == brute.sha(library.decode(ids))
    assert sentencepiece_bpe.encode_documents(empty, queries.PIECE_MODEL).count() == 0


def test_sentencepiece_on_random_texts():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    model = sentencepiece_bpe.load_model(queries.PIECE_MODEL)
    rng = random.Random(1)
    for k in range(1500):
        text = "".join(rng.choice("aabbee  \t\n▁é日🎉thino<s>/0129.,İß\0") for _ in range(rng.randint(0, 40)))
        if k % 5 == 0:
            text = rng.choice("a =-e ") * rng.randint(1, 900) + text
        if k % 11 == 0:
            text += "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(300, 900)))
        ids = model.encode(text)
        assert ids == library.encode(text, add_eos=True), text
        assert model.decode(ids) == library.decode(ids), text
        loose = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        assert model.decode(loose) == library.decode(loose), loose


def test_decontamination(spark, docs, rows, empty, monkeypatch):
    rng = random.Random(2)
    long = rows[20][1].split()
    items = [(1, " ".join(long[2:25])), (2, "one TWO"), (3, ""), (4, None), (10, prose(rng, 4)), (5, " ".join(long[5:18])), (5, "日本 🎉"), (6, "word " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute.contamination(t, items) for i, t, *_ in rows}
    assert sum(w["contaminated"] for w in want.values()) > 3
    got = by_id(decontamination.contamination(docs, bench))
    assert {i: {k: got[i][k] for k in w} for i, w in want.items()} == want
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w["contaminated"]}
    # the same in many passes, with null ids, repeated documents and clashing names
    monkeypatch.setattr(decontamination, "PASS_KEYS", 7)
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 50)
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", 0)
    odd = docs.unionByName(docs.where("doc_id in (20, 3)")).withColumn("k", F.lit(1)).withColumn("__k0", F.lit("clash"))
    odd = odd.unionByName(odd.where("doc_id = 20").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" more"))))
    rows_want = sorted([(i, w["n_hit"], w["items_sha256"]) for i, w in want.items()] + [(i, want[i]["n_hit"], want[i]["items_sha256"]) for i in (20, 3)], key=str)
    none = brute.contamination(rows[20][1] + " more", items)
    rows_want += [(None, none["n_hit"], none["items_sha256"])] * 2
    got = [(r.doc_id, r.n_hit, r.items_sha256) for r in decontamination.contamination(odd, bench).collect()]
    assert sorted(got, key=str) == sorted(rows_want, key=str)
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w["contaminated"]} | ({None} if not none["contaminated"] else set())
    assert decontamination.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.where("false")).collect())


def test_substring_dedup(spark, empty):
    rng = random.Random(4)
    passage = " ".join(sentence(rng, rng.randint(5, 12)) for _ in range(8))
    long_passage = " ".join(sentence(rng, 70)[:-1].split())
    alone = [prose(rng, 6) for _ in range(8)]
    texts = [
        alone[0] + "\n" + passage + "\n" + alone[1],
        passage,
        alone[2] + " " + passage,
        alone[3],
        alone[4] + " " + long_passage + " " + alone[5],
        alone[6] + " " + long_passage + " " + alone[7],
        passage + "\n" + passage,
        "Yes. No. Yes. No.",
        "Yes. No. Yes. No.",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(substring_dedup.dedup_substrings(docs))
    assert got[0]["text"] == texts[0] and got[3]["text"] == texts[3] and got[4]["text"] == texts[4]
    assert got[1]["text"] == "" and got[6]["text"].strip() == ""
    assert got[2]["text"].strip() == alone[2]
    left = got[5]["text"]
    assert alone[6] in left and alone[7].split(" ", 3)[3] in left
    assert sum(w in left.split() for w in long_passage.split()) < 30
    assert got[7]["text"] == texts[7] and got[8]["text"] == texts[8]
    assert got[9]["text"] is None and got[10]["text"] == ""
    # no passage of enough words is left twice
    whole = substring_dedup.dedup_substrings(docs, keep_all_columns=True)
    assert whole.columns == docs.columns
    assert substring_dedup.repeated_spans(whole).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    twice = by_id(substring_dedup.dedup_substrings(docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0"))))
    assert twice[0]["text"] == texts[0]


def test_sentences_join_to_the_text(rows):
    rng = random.Random(8)
    for _, text, *_ in rows:
        assert "".join(substring_dedup.sentences(text or "")) == (text or "")
    for _ in range(300):
        text = "".join(rng.choice("ab .!?\n\t\"é") for _ in range(rng.randint(0, 80)))
        assert "".join(substring_dedup.sentences(text)) == text


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 8 == 0
        words = prose(rng, 3).split()
        if bad:
            words.insert(rng.randrange(len(words)), "grumbl" + rng.choice(["e", "ing", "er", "ous"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "grumbling again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = by_id(toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()))
    for i, _, bad in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    test = [(got[i]["predicted"], bad) for i, _, bad in labels if got[i]["held_out"]]
    assert sum(a == b for a, b in test) / len(test) > 0.97
    assert got[1000]["score"] == got[1001]["score"] < 0.5 and got[1002]["predicted"] == 1
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"] == 0}
    untaught = toxicity.train(docs, marks.where("false"))
    assert not any(r.predicted for r in toxicity.score(docs, untaught).collect())
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b<\\[n\\\\", "[+]", "<s>assistant\nx</s>", "", None, "\n", "<|im_start|>", "[n", "\\", "<", "[\\", "é🎉"]
    rng = random.Random(7)
    turns = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 7)):
            turns.append((conv, None if rng.random() < 0.1 else turn, rng.choice(["user", "assistant", "system", "to\nol", None, "[x]"]), rng.choice(odd)))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("size", F.lit(1)).repartition(3)
    out = chat.format_conversations(df).select(
        "conv_id", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("read"), chat.trained_text(F.col("segments")).alias("loss")
    )
    got = by_id(out, "conv_id")
    for conv in [None, *range(40)]:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert [(r["role"], r["text"]) for r in got[conv]["read"]] == [(r, x) for *_, r, x in own]
        assert got[conv]["loss"] == "".join(x for *_, r, x in own if r == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
        blocks = sum(a[2] != b[2] for a, b in zip(own, own[1:])) + 1
        assert got[conv]["formatted"].count("[INST]") + got[conv]["formatted"].count("<s>") == blocks
    assert chat.format_conversations(df.where("false")).count() == 0


def test_url_verdicts(spark):
    urls = ["http://a.example.com/en/x?q", "https://WWW.Example.COM/en/1#t", "http://example.com/fr/", "//x", None, "", "http://net/es/", "ftp://q.net/fr", "http://q.net/fr/a", "http://x.org/a", "http://", "a://b://c/d", "http://ex.com", "http://İ.com/x"]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = by_id(url_filter.judge_pages(pages, queries.URL_RULES), "page_id")
    for i, u in enumerate(urls):
        assert {k: got[i][k] for k in ("host", "path", "rule", "verdict")} == brute.judge(u), u
    assert url_filter.judge_pages(pages.where("false"), queries.URL_RULES).count() == 0


def test_url_aliases(spark):
    def page(canonical="", refresh=""):
        link = f'<LINK href="{canonical}" rel=canonical>' if canonical else ""
        meta = f"<meta http-equiv='Refresh' content='0; url={refresh}'>" if refresh else ""
        return f"<html>{link}{meta}<link rel=stylesheet href=/a.css></html>"

    rows = [
        (0, "http://q.net/es/1", page()),
        (1, "https://a.org/1", page("http://q.net/es/1/")),
        (2, "http://b.org/2", page(refresh="https://a.org/1#x")),
        (3, "http://b.org/dir/3", page("4")),
        (4, "http://b.org/dir/4", page("/2")),
        (5, "http://c.org/5", page("http://d.com/5")),
        (6, "http://e.org/6", page("http://c.org/5", "http://q.net/fr/")),
        (7, "http://f.org/7", page()),
        (8, "http://d.com/8", page("http://q.net/es/1")),
        (9, "http://g.org/9", None),
    ]
    pages = spark.createDataFrame(rows[:8] + rows[9:], "page_id long, url string, html string")
    got = {k: r["verdict"] for k, r in by_id(url_filter.judge_pages(pages, queries.URL_RULES), "page_id").items()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 9: "allow"}
    # an explicit allow in the group goes before its blocks; the page with the block rule stays blocked
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {k: r["verdict"] for k, r in by_id(url_filter.judge_pages(pages, queries.URL_RULES), "page_id").items()}
    assert got[0] == "block" and all(got[i] == "allow" for i in range(1, 10))
    moved = spark.createDataFrame([("http://f.org/7", "http://q.net/fr/z")], "src string, dst string")
    got = by_id(url_filter.judge_pages(pages, queries.URL_RULES, moved), "page_id")
    assert got[7]["verdict"] == "block" and got[7]["decided_by"] == "alias"


def test_warc_audit(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, f"http://x.org/{i}", prose(rng, 3)) for i in range(700)] + [(700, None, None), (701, "http://a\r\nb/", ""), (5, "dup", "dup")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    primary = common.cut(warc.encode_pages(pages, file_bytes=40_000))
    assert primary.select("file").distinct().count() > 3
    replica = common.cut(warc.with_faults(primary))
    assert warc.MerkleTree(primary).root() == warc.MerkleTree(primary.repartition(7)).root() != warc.MerkleTree(replica).root()
    got = [r.asDict() for r in warc.audit(primary, replica).collect()]
    assert len(got) == len(rows)
    for r in got:
        i = r["page_id"]
        want = "missing" if i % 211 == 5 else "altered" if i % 101 == 7 or i % 307 == 11 else "intact"
        assert r["status"] == want, i
    back = [r for r in warc.audit(replica, primary).collect() if r.status == "extra"]
    assert len(back) == sum(r["status"] == "missing" for r in got)
    assert all(r.status == "intact" for r in warc.audit(primary, primary).collect())
    assert warc.audit(primary.where("false"), primary.where("false")).count() == 0
    # files read back: offsets, ids and bodies
    one = primary.where(F.col("file") == primary.first()["file"]).orderBy("offset").collect()
    (tmp_path / "w.warc").write_bytes(b"".join(bytes(r.record) for r in one))
    read = warc.read_warc(spark, str(tmp_path / "w.warc")).orderBy("offset").collect()
    html = {(f"http://x.org/{i}", h.encode()) for i, _, h in rows[:700]}
    assert [r.offset for r in read] == [r.offset for r in one]
    assert all((r.uri, bytes(r.body)) in html for r in read if r.uri.startswith("http://x.org"))


def test_digest_of_chat_query(spark, tmp_path):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "assistant", "b")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = by_id(queries.op6_chat_format(spark, str(tmp_path)), "conv_id")
    assert set(got) == {1, -7} and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 1
    assert got[1]["turns_sha256"] == brute.sha("user\nhi\nassistant\n\nassistant\nb\n")
    assert got[-7]["loss_sha256"] == hashlib.sha256(b"</s>[INST] ok [/INST]").hexdigest()


def test_url_query_equals_its_sql_on_linking_pages(spark, tmp_path):
    """Chains, a loop, an allow within a group, any order of attributes, repeated rows, odd tags, long html."""
    import duckdb

    def refresh(to):
        return f'<META content="3; URL={to}" HTTP-EQUIV=refresh>'

    rows = [
        (0, "http://q.net/es/1", "<p>"),
        (1, "http://one.org/a", refresh("http://two.org/b")),
        (2, "http://two.org/b", "x" * 200_000 + "<link data-href='http://none.org/' href='http://three.org/c' rel='nofollow canonical'>"),
        (3, "http://three.org/c", refresh("'http://q.net/es/1'")),
        (4, "http://loop.org/1", refresh("/2")),
        (5, "http://loop.org/2", refresh("1")),
        (6, "http://loop.org/3", "<link rel=canonical href=//q.net/fr/?a=1&amp;b=2>" + refresh("http://shop.com/x")),
        (7, "http://shop.com/x", None),
        (8, "http://lone.org/", '<link rel="canonical"><meta http-equiv=refresh><link title="rel=canonical href=http://q.net/es/1" rel=icon>'),
        (9, "http://self.org/", "<link rel=canonical href='http://self.org/'>"),
        (10, None, refresh("http://q.net/es/1")),
        (1, "http://one.org/a", refresh("http://two.org/b")),
        (None, "http://loop.org/1#again", "<p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    out = queries.op8_url_filter(spark, str(tmp_path))
    got = sorted(((r.page_id, r.host, r.verdict, r.decided_by) for r in out.collect()), key=str)
    verdicts = {r.page_id: (r.verdict, r.decided_by) for r in out.collect() if r.page_id is not None}
    assert all(verdicts[i] == ("block", "alias") for i in (1, 2, 3)) and verdicts[0] == ("block", "rule")
    assert all(verdicts[i] == ("allow", "default") for i in (4, 5, 8, 9, 10))
    assert verdicts[6] == ("allow", "alias") and verdicts[7] == ("allow", "rule")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    sql = queries.oracle_sql()["op8_url_filter"]
    want = sorted(con.execute(f"SELECT page_id, host, verdict, decided_by FROM ({sql})").fetchall(), key=str)
    assert got == want
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in queries.URL_RULES], "host string, path string, verdict string")
    again = url_filter.judge_pages(pages, table)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_quality_verdict_and_collisions(spark, monkeypatch):
    rng = random.Random(31)
    lines = [prose(rng, 3) for _ in range(40)]
    long = "\n".join(lines)
    rows = [(0, long), (1, long + "\n" + "\n".join(lines[:8])), (2, " ".join([lines[0]] * 9)), (3, "few words"), (None, long), (0, long), (4, long + "\n" + lines[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit(1))
    got = {(r.doc_id, r.kept, r.base_failed) for r in quality.score_quality(docs).collect()}
    assert got == {(0, True, False), (1, False, False), (2, False, True), (3, False, True), (None, True, False), (4, True, False)}
    line = len("".join(lines[0].split()))
    share = {r.doc_id: r.dup_line_share for r in quality.score_quality(docs).collect()}[4]
    assert share == pytest.approx(line / (line + len("".join(long.split()))))
    # where hashes of different n-grams collide, words decide
    text = " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(60)).encode()
    want = quality.measure(text, quality.RepetitionRules())
    monkeypatch.setattr(quality, "_word_hashes", lambda numbers: np.ones(len(numbers), np.uint64))
    assert quality.measure(text, quality.RepetitionRules()) == want


def test_chat_folds_long_conversations(spark):
    turns = [(1, i, "user" if i % 7 else "assistant", f"t{i}") for i in range(997)] + [(2, i, "user", str(i)) for i in range(300)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = by_id(chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("read")), "conv_id")
    assert [(r["role"], r["text"]) for r in got[1]["read"]] == [t[2:] for t in turns[:997]]
    assert got[1]["formatted"].count("[INST]") == 143 and got[1]["formatted"].count("<s>") == 143
    assert got[2]["formatted"].startswith("[INST]user\n0[+]1[+]2") and got[2]["formatted"].count("[/INST]") == 1


def test_sentencepiece_on_long_texts_without_spaces():
    """Over 10,000 symbols of one word: scripts without spaces, Latin letters, runs of one character, real words."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    model = sentencepiece_bpe.load_model(queries.PIECE_MODEL)
    rng = random.Random(13)
    pieces = [t for t in model.surface if t.strip() and len(t) > 1 and " " not in t]
    texts = ["".join(rng.choice("日本語の文章中国一二三🎉é") for _ in range(12_000)), "".join(rng.choice("etaoinshrdlu") for _ in range(20_000))]
    texts += [c * 15_000 for c in "ax=- _0"] + ["ab" * 9_000, "".join(rng.choice(pieces) for _ in range(4_000))]
    texts += ["".join(rng.choice("=-_*#./ \t") * rng.randint(1, 70) for _ in range(600)), "".join(rng.choice("ACGT") for _ in range(15_000))]
    for text in texts:
        assert model.encode(text) == library.encode(text, add_eos=True), text[:60]
    for _ in range(600):
        text = "".join(rng.choice(pieces)[: rng.randint(1, 9)] * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(1, 60)))
        assert model.encode(text) == library.encode(text, add_eos=True), text


def test_sentencepiece_nulls_repeats_and_clashes(spark):
    rows = [(None, "a b", 1), (None, None, 2), (1, "a b", 3), (1, "a b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").withColumn("ids", F.lit("clash"))
    got = sorted((str(r.doc_id), r.n_tokens, len(r.ids)) for r in sentencepiece_bpe.encode_documents(docs, queries.PIECE_MODEL).collect())
    assert [g[0] for g in got] == ["1", "1", "None", "None"] and got[0] == got[1] and got[2][1:] == (1, 1) and all(g[1] == g[2] for g in got)


def test_substring_dedup_of_odd_tables(spark, monkeypatch):
    """Text ids, null ids, repeated rows, clashing names; with and without room for hashes that repeat."""
    rng = random.Random(41)
    passage, alone = prose(rng, 9), [prose(rng, 5) for _ in range(6)]
    rows = [(None, passage), (None, passage), ("a", alone[0] + "\n" + passage), ("b", passage), ("b", passage), ("c", alone[1]), ("d", None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"__k0": F.lit(1), "__K1": F.lit("x"), "spans": F.lit(2), "doc": F.lit(3)})
    for room in (0, 100_000):
        monkeypatch.setattr(substring_dedup, "HOT", room)
        got = [(r.doc_id, r.text) for r in substring_dedup.dedup_substrings(docs.repartition(2), keep_all_columns=True).collect()]
        want = [(None, passage)] * 2 + [(None, None), ("a", alone[0] + "\n"), ("b", ""), ("b", ""), ("c", alone[1]), ("d", None)]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_dedup_remembers_hot_hashes(spark):
    """Later batches of a task send a passage by document; one that comes before the known first still counts."""
    rng = random.Random(43)
    passage = prose(rng, 6)
    rows = [(i, prose(rng, 3) + "\n" + passage) for i in range(60)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.doc_id: r.text for r in substring_dedup.dedup_substrings(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute.without_repeats(rows, substring_dedup.sentences)


def test_ftrl_equals_scalar_statement():
    """The vectorised learner against the update rule written out for one coordinate at a time."""
    rng = random.Random(17)
    rows = [(np.array(sorted(rng.sample(range(60), rng.randint(0, 9))), dtype=np.int32), rng.randint(0, 1)) for _ in range(150)]
    params = toxicity.FtrlParams(bits=6, l1=0.3, l2=0.2, alpha=0.7, beta=0.9, epochs=3, max_share=0.2)
    bias, index, weight = toxicity.fit_ftrl(rows, params)
    assert dict(zip(index.tolist(), weight.tolist())) == pytest.approx(brute.ftrl(rows, params)[1]) and len(index) > 5
    assert bias == pytest.approx(brute.ftrl(rows, params)[0])


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(19)
    rows = [(i, prose(rng, 2) + (" vilesome" if i % 6 == 0 else "")) for i in range(300)]
    rows += [(None, "vilesome"), (6, "again vilesome"), (6, "again vilesome"), (12, None), (301, "calm words " * 30_000 + "vilesome")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("clash"), "__h": F.lit(1), "toxic": F.lit(9)})
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.repartition(5).unionByName(docs), labels)
    assert model.bias == again.bias and (model.index == again.index).all() and (model.weight == again.weight).all()
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and {r.predicted for r in got if r.doc_id is None} == {1}
    assert len({r.score for r in got if r.doc_id == 6}) <= 2
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 0
    # bounds of rows and of features together leave the rest of the sample out
    few = toxicity.train(docs, labels, toxicity.FtrlParams(sample_features=2_000))
    assert len(few.index) < len(model.index)


def test_merkle_tree_equals_plain_tree(spark):
    """Every hash of every level, up to the root, against a tree built from the definition."""
    rows = [(f, o * 9_000, f * 100 + o, f"record {f} {o}".encode()) for f in (0, 1, 5, 1 << 20, (3 << 20) + 1) for o in range(1, 8)]
    records = spark.createDataFrame(rows, "file long, offset long, page_id long, record binary").repartition(4)
    tree = warc.MerkleTree(records)
    level = {(f, o): hashlib.sha256(r).hexdigest() for f, o, _, r in rows}
    for k in range(warc.level_count()):
        if k:
            above: dict = {}
            for (a, b), h in sorted(level.items()):
                key = (a, b >> (14 if k == 1 else 4)) if k <= 3 else (a, 0) if k == 4 else (a >> 10, 0) if k <= 9 else (0, 0)
                above.setdefault(key, []).append(f"{a}:{b}:{h}")
            level = {key: hashlib.sha256("\n".join(c).encode()).hexdigest() for key, c in above.items()}
        assert {(r.a, r.b): r.hash for r in tree.levels[k].collect()} == level, k
    assert list(level) == [(0, 0)] and tree.root() == level[0, 0]
    got = {(r.file, r.offset): (r.sha256, r.length) for r in warc.audit(records, records).collect()}
    assert got == {(f, o): (hashlib.sha256(r).hexdigest(), len(r)) for f, o, _, r in rows}
    # one altered record: the descent reads its branch alone
    hurt = records.withColumn("record", F.when((F.col("file") == 5) & (F.col("offset") == 27_000), F.lit(b"x")).otherwise(F.col("record")))
    found = warc.differing_records(tree, warc.MerkleTree(hurt))
    assert [tuple(r) for r in found.collect()] == [(5, 27_000, "altered")]
    tree.drop()


def test_warc_damage_gives_rows(spark, tmp_path):
    import gzip

    good = warc.encode_record("http://x.org/", "urn:1", b"body one")
    bad_length = good.replace(b"Content-Length: 8", b"Content-Length: x")
    negative = good.replace(b"Content-Length: 8", b"Content-Length: -5")
    none = good.replace(b"Content-Length: 8\r\n", b"")

    def faults(data):
        return [(at, fault, body) for at, _, body, fault in warc.parse_records(data)]

    assert faults(b"") == [] and faults(good + good) == [(0, None, b"body one"), (len(good), None, b"body one")]
    for broken in (bad_length, negative, none):
        # after a bad length the body is lost bytes, and the next record is found
        assert [f for _, f, _ in faults(broken + good)] == ["length", "lost", None]
    assert [f for _, f, _ in faults(b"noise\n" + good)] == ["lost", None]
    assert faults(good[:-8])[0][1:] == ("body", b"body"[:4]) and faults(good[:30])[0][1] == "header"
    packed = gzip.compress(good) + gzip.compress(good)
    assert [f for _, f, _ in faults(packed)] == [None, None]
    assert [f for _, f, _ in faults(packed[:-20])][-1] == "gzip"
    (tmp_path / "a.warc.gz").write_bytes(packed[:-20])
    (tmp_path / "b.warc").write_bytes(bad_length + good)
    (tmp_path / "c.warc").write_bytes(b"")
    rows_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert {None, "length", "lost", "gzip"} <= {r.fault for r in read} and sum(r.fault is None for r in read) >= 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == min(int(rows_before), common.TEXT_BATCH_ROWS)


def test_warc_of_odd_pages(spark):
    pages = spark.createDataFrame([(None, "u", "a"), (None, "u", "a"), (7, None, None), (7, "x", "y" * 300_000)], "page_id long, url string, html string")
    pages = pages.withColumns({"file": F.lit("clash"), "offset": F.lit(1), "record": F.lit(2)})
    primary = common.cut(warc.encode_pages(pages, file_bytes=1000))
    got = warc.audit(primary, primary.withColumn("extra", F.lit(1))).collect()
    assert len(got) == 4 and {r.status for r in got} == {"intact"} and sorted(str(r.page_id) for r in got) == ["7", "7", "None", "None"]
