"""Near copies by word shingles: links between texts whose sets of five-word shingles reach Jaccard 0.8.

Candidates meet through minhashes, ``BANDS`` keys of ``ROWS`` minhashes each; a pair at similarity 0.8 shares no key
with a probability of (1 - 0.8^4)^30, about 1e-7. Equal sets are one row beforehand. Every key's sets are first
compared with one of them, its lead. Only keys whose sets then lie in several components go on: there the sets
outside the largest component meet all sets of the key, block by block. A task holds one block of a bounded number
of shingles as an index from shingle to set, streams the outer sets past it and puts out at most one link from each to
every component, so a large group of near copies costs rows in proportion to its members, never to its pairs.
Each link is decided by the two whole sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm.common import arrow_map, cut, raw_texts
from kinmark.llm.graph import connected_components

WORDS = 5
BANDS = 30
ROWS = 4
#: Shingles in a block of the second step; a block holds one set at least.
BLOCK = 1 << 16
#: Tasks over which the pairs of one lead are dealt at most.
SALTS = 64
_U = np.uint64
_FACTORS = np.random.default_rng(7).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_CHUNK = 1000


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a shorter text is one shingle, one without words none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=_U)
    n = len(found)
    joined = b" ".join(found)
    if n <= WORDS:
        return np.array([xxhash.xxh64_intdigest(joined, 5)], dtype=_U)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: n - WORDS + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 5) for a, b in zip(starts, ends[WORDS - 1 :].tolist(), strict=True)], dtype=_U))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets reach Jaccard 0.8; by whole numbers, 5 shared >= 4 united."""
    small, large = sorted((len(a), len(b)))
    if not small or 5 * small < 4 * large:
        return False
    shared = small + large - len(np.union1d(a, b))
    return 5 * shared >= 4 * (small + large - shared)


def minhashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(0, len(hashes), _CHUNK):
            x = hashes[k : k + _CHUNK]
            np.minimum(least, ((x ^ (x >> _U(29)))[None, :] * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, id_cols: list[str], fingerprint: Callable[[bytes], int], text_col: str = "text") -> DataFrame:
    """``id_cols``, ``fp`` (the signed ``fingerprint``), ``sid`` (a hash of the shingle set, null without words),
    ``bands`` and ``width`` (the size of the set) of every row."""

    def run(batch: pa.RecordBatch) -> dict:
        prints, sids, bands, width = [], [], [], []
        for t in raw_texts(batch, text_col):
            prints.append(fingerprint(t))
            found = shingle_set(t)
            if not len(found):
                sids.append(None), bands.append(None), width.append(0)
                continue
            least = minhashes(found)
            sids.append(xxhash.xxh64_intdigest(found.tobytes(), 3) - 2**63)
            bands.append(np.array([xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, len(least), ROWS)], dtype=_U).view(np.int64))
            width.append(len(found))
        return {
            **{c: batch.column(c) for c in id_cols},
            "fp": pa.array(np.array(prints, dtype=_U).view(np.int64)),
            "sid": pa.array(sids, pa.int64()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
            "width": pa.array(width, pa.int32()),
        }

    ids = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return arrow_map(docs.select(*id_cols, text_col), run, f"{ids}, fp long, sid long, bands array<long>, width int")


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lead of every row's bucket, of rows sorted by bucket and the lead first."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, sid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "sid"))
        new = np.r_[True, bucket[1:] != bucket[:-1]]
        lead = sid[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        if last is not None and last[0] == bucket[0]:
            lead[bucket == bucket[0]] = last[1]
        last = (bucket[-1], lead[-1])
        other = lead != sid
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[other]), "a": pa.array(lead[other]), "b": pa.array(sid[other])})


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from outer sets to sets of other components in the same block of a bucket; of several to one component
    the first. Rows are sorted by bucket and block, the block's own sets before the outer ones."""
    at, index = None, None
    sid, part, sets = [], [], []

    def built() -> tuple:
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        return flat[order], np.repeat(np.arange(len(sets)), sizes)[order], sizes, np.array(sid, np.int64), np.array(part, np.int64)

    for batch in batches:
        a, b = [], []
        columns = (batch.column(c).to_pylist() for c in ("bucket", "block", "outer", "sid", "part", "shingles"))
        for bucket, block, outer, s, p, raw in zip(*columns, strict=True):
            if (bucket, block) != at:
                at, index = (bucket, block), None
                sid, part, sets = [], [], []
            own = np.frombuffer(raw, dtype=_U)
            if not outer:
                sid.append(s), part.append(p), sets.append(own)
                continue
            if not sets:
                continue
            index = index or built()
            flat, owner, sizes, sids, parts = index
            first, last = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            times = last - first
            found = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            shared = np.bincount(owner[found], minlength=len(sizes))
            good = np.flatnonzero((5 * shared >= 4 * (sizes + len(own) - shared)) & (parts != p))
            good = good[np.unique(parts[good], return_index=True)[1]]
            a.append(np.minimum(sids[good], s)), b.append(np.maximum(sids[good], s))
        if a:
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def _texts(sids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``(sid, text)``: a text for each of the distinct ``sids``. ``docs``: doc_id, mark, text."""
    where = reps.join(sids, "sid", "left_semi").select("sid", F.col("doc_id").alias("__d"), F.col("mark").alias("__m"))
    return (
        docs.join(where, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("mark") == F.col("__m")))
        .groupBy("sid")
        .agg(F.first("text").alias("text"))
    )


def _checked(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose texts' shingle sets reach the similarity. ``docs``: doc_id, mark, text."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    texts = cut(_texts(ends, reps, docs))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    leads = salted.select("a", "salt").distinct().join(texts.select(F.col("sid").alias("a"), F.col("text").alias("ta")), "a")
    both = salted.join(texts.select(F.col("sid").alias("b"), F.col("text").alias("tb")), "b").join(leads, ["a", "salt"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # the rows of one lead mostly come together
        good, last, own = [], None, None
        for a, x, y in zip(batch.column("a").to_pylist(), raw_texts(batch, "ta"), raw_texts(batch, "tb"), strict=True):
            if a != last:
                last, own = a, shingle_set(x)
            good.append(similar(own, shingle_set(y)))
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return arrow_map(both.select("a", "b", "ta", "tb"), run, "a long, b long")


def _outer_links(members: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``(a, b)`` links that join different components of a bucket. ``members``: bucket, sid, part, width."""
    sizes = members.groupBy("bucket", "part").agg(F.count("*").alias("n"), F.sum("width").alias("width"))
    opened = (
        sizes.groupBy("bucket")
        .agg(F.count("*").alias("parts"), F.sum("n").alias("rows"), F.max(F.struct("n", "part")).alias("main"), F.ceil(F.sum("width") / BLOCK).alias("blocks"))
        .where("parts > 1 and rows > 2")  # of two sets one was the lead: they have been compared
        .select("bucket", "main.part", "blocks")
        .withColumnRenamed("part", "main")
    )
    dealt = cut(members.join(opened, "bucket").select("bucket", "sid", "part", "blocks", (F.col("part") != F.col("main")).alias("outer")))

    def run(batch: pa.RecordBatch) -> dict:
        return {"sid": batch.column("sid"), "shingles": pa.array([shingle_set(t).tobytes() for t in raw_texts(batch)], pa.binary())}

    sets = cut(arrow_map(_texts(dealt.select("sid").distinct(), reps, docs), run, "sid long, shingles binary"))
    own = dealt.select("bucket", F.pmod(F.xxhash64("sid"), "blocks").alias("block"), F.lit(False).alias("outer"), "sid", "part")
    passing = dealt.where("outer").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "outer", "sid", "part")
    return (
        own.unionByName(passing)
        .join(sets, "sid")
        .repartition("bucket", "block")
        .sortWithinPartitions("bucket", "block", "outer")
        .mapInArrow(_across, "a long, b long")
        .distinct()
    )


def similar_links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``(src, dst)`` edges between fingerprints of rows at Jaccard 0.8 or more, and of equal sets.

    ``rows`` holds ``doc_id, mark, fp`` and the columns of :func:`sketches`; ``docs`` holds ``doc_id, mark, text``.
    """
    rows = rows.where("sid is not null")
    reps = cut(
        rows.groupBy("sid")
        .agg(F.min(F.struct("fp", F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "bands", "width")).alias("r"), F.count("*").alias("n"))
        .select("sid", "n", "r.fp", "r.doc_id", "r.mark", "r.bands", "r.width")
    )
    fp_of = reps.select("sid", "fp")
    same = rows.select("sid", F.col("fp").alias("src")).join(fp_of.withColumnRenamed("fp", "dst"), "sid").where("src <> dst").select("src", "dst").distinct()
    led = cut(
        reps.select(F.explode("bands").alias("bucket"), "sid", "n")
        .repartition("bucket")
        .sortWithinPartitions("bucket", F.desc("n"), "sid")
        .mapInArrow(_leads, "bucket long, a long, b long")
    )
    first = cut(_checked(cut(led.select("a", "b").distinct()), reps, docs))
    part = connected_components(first, "a", "b").withColumnRenamed("node", "sid")
    members = led.select("bucket", F.col("b").alias("sid")).unionByName(led.select("bucket", F.col("a").alias("sid")).distinct())
    members = members.join(
        reps.select("sid", "width").join(part, "sid", "left").select("sid", F.coalesce("component", "sid").alias("part"), "width"), "sid"
    )
    found = first.unionByName(_outer_links(cut(members), reps, docs))
    ends = [fp_of.select(F.col("sid").alias(x), F.col("fp").alias(y)) for x, y in (("a", "src"), ("b", "dst"))]
    return cut(found.join(ends[0], "a").join(ends[1], "b").where("src <> dst").select("src", "dst").unionByName(same))
