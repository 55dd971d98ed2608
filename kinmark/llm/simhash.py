"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprints of 64 bits link at 2 or fewer differing bits. They are cut into three segments of 22, 21 and
21 bits. Two linked fingerprints differ in a pattern of errors over the segments of which, by the
pigeonhole principle, some pair (one segment, the next one in the ring) has no error in the first and at
most one in the second: errors (2,0,0) leave both others exact, errors (1,1,0) leave one exact segment
and one error in each other. So the key of a pair is the exact segment and the index of a codeword of the
binary Golay code [23,12,7] near the other one.

Every 23-bit word lies within 3 bits of exactly one codeword (the code is perfect): that codeword is the
word's one index key. A word with one error more lies within 4 bits of the same codeword, so the probe
keys of a word are all codewords within 4 bits: its own, and where its own is 3 away five more (the
octad-like words of weight 7 through its three error places). An index key meets a probe key for any two
words that differ in at most one bit.

Candidates of one key are verified by the number of differing bits. A key that holds more than
``BUCKET`` fingerprints is not expanded into pairs; its members join through midpoints instead: each
offers itself and its 64 one-bit neighbours, and two fingerprints within 2 bits always offer one word in
common. This is exact and linear in the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm import shingles
from kinmark.llm.common import arrow_map, cut, raw_texts, unused
from kinmark.llm.graph import connected_components

WORDS = 3
MAX_BITS = 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width
BUCKET = 512
_U = np.uint64
#: Generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
_GENERATOR = 0b101011100011


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text, as an unsigned number."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, found), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=_U)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(_U)[0])


def fingerprints(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and the signed 64-bit ``fp`` of every row; texts without words (or null) have 0."""

    def run(batch: pa.RecordBatch) -> dict:
        prints = np.array([fingerprint(t) for t in raw_texts(batch, text_col)], dtype=_U)
        return {**{c: batch.column(c) for c in id_cols}, "fp": pa.array(prints.view(np.int64))}

    ids = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return arrow_map(docs.select(*id_cols, text_col), run, f"{ids}, fp long")


# -- Golay code -----------------------------------------------------------------------------------


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, _GENERATOR << (bit - 11), 0)
    return rest


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error pattern of weight 3 or less, and the up to six patterns (-1: none) that
    lead to the codewords within 4 bits."""
    places = [1 << i for i in range(23)]
    light = [0, *places]
    light += [a | b for i, a in enumerate(places) for b in places[i + 1 :]]
    light += [a | b | c for i, a in enumerate(places) for j, b in enumerate(places[i + 1 :], i + 1) for c in places[j + 1 :]]
    light = np.array(light, dtype=np.int64)
    nearest = np.zeros(2048, dtype=np.int64)
    nearest[_syndrome(light)] = light
    four = np.array(
        [sum(places[k] for k in (i, j, m, q)) for i in range(23) for j in range(i) for m in range(j) for q in range(m)],
        dtype=np.int64,
    )
    of = _syndrome(four)
    near = np.full((2048, 6), -1, dtype=np.int64)
    near[:, 0] = nearest
    order = np.argsort(of, kind="stable")
    first = np.r_[True, of[order][1:] != of[order][:-1]]
    rank = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    near[of[order], 1 + rank] = four[order]
    return nearest, near


def index_code(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ golay_tables()[0][_syndrome(words)]) >> 11


def probe_codes(words: np.ndarray) -> np.ndarray:
    """12-bit indices of all codewords within 4 bits, six columns, -1 where there are fewer."""
    patterns = golay_tables()[1][_syndrome(words)]
    return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints: bucket, role (0 index, 1 probe) and position of the fingerprint."""
    parts = [((prints >> _U(s)) & _U((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    bucket, role, at = [], [], []
    n = np.arange(len(prints))
    for k in range(3):
        exact, other = parts[k], parts[(k + 1) % 3]
        base = (np.int64(k) << 34) | (exact << 12)
        bucket.append(base | index_code(other))
        role.append(np.zeros(len(n), np.int8))
        at.append(n)
        codes = probe_codes(other)
        rows, cols = np.nonzero(codes >= 0)
        bucket.append(base[rows] | codes[rows, cols])
        role.append(np.ones(len(rows), np.int8))
        at.append(rows)
    return np.concatenate(bucket), np.concatenate(role), np.concatenate(at)


# -- links ----------------------------------------------------------------------------------------


def _pairs_of_runs(bucket: np.ndarray, role: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs within equal buckets of sorted rows (index rows first); a hot bucket gives its members
    paired with themselves."""
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[starts[1:], len(bucket)]
    n_index = np.add.reduceat((role == 0).astype(np.int64), starts)
    n_probe = ends - starts - n_index
    hot = ends - starts > BUCKET
    if hot.any():
        member = np.repeat(hot, ends - starts)
        yield fp[member], fp[member]
    times = np.where(hot, 0, n_index * n_probe)
    live = np.flatnonzero(times)
    done = 0
    sums = np.cumsum(times[live])
    while done < len(live):
        base = sums[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(sums, base + 1_000_000, side="right")))
        run = live[done:upto]
        done = upto
        t = times[run]
        which = np.repeat(run, t)
        within = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        a = fp[starts[which] + within // n_probe[which]]
        b = fp[starts[which] + n_index[which] + within % n_probe[which]]
        apart = np.bitwise_count((a ^ b).view(_U))
        good = (apart <= MAX_BITS) & (apart > 0)
        yield a[good], b[good]


def links(prints: DataFrame) -> DataFrame:
    """``(src, dst)`` edges whose components are those of all fingerprints linked at 2 or fewer bits.

    ``prints`` holds distinct fingerprints in ``fp``. One shuffle by key; partitions are read as sorted
    streams, so that a task holds one bucket's rows up to ``BUCKET``, never more.
    """

    def emit(batch: pa.RecordBatch) -> dict:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        bucket, role, at = keys_of(fp.view(_U))
        return {"bucket": pa.array(bucket), "role": pa.array(role), "fp": pa.array(fp[at])}

    keyed = arrow_map(prints.select("fp"), emit, "bucket long, role byte, fp long")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64)]
        burning = None  # a hot bucket whose earlier rows are already out

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            edges = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            return pa.RecordBatch.from_pydict({"src": pa.array(edges[0]), "dst": pa.array(edges[1])})

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "role", "fp")]
            rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            if burning is not None:
                still = rows[0] == burning
                if still.any():
                    yield out(rows[2][still], rows[2][still])
                    rows = [r[~still] for r in rows]
                if len(rows[0]):
                    burning = None
            if not len(rows[0]):
                held = rows
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            ready, held = [r[:last] for r in rows], [r[last:] for r in rows]
            if len(held[0]) > BUCKET:
                burning = int(held[0][-1])
                yield out(held[2], held[2])
                held = [h[:0] for h in held]
            if last:
                for a, b in _pairs_of_runs(*ready):
                    if len(a):
                        yield out(a, b)
        if len(held[0]):
            for a, b in _pairs_of_runs(*held):
                if len(a):
                    yield out(a, b)

    found = cut(
        keyed.repartition("bucket")
        .sortWithinPartitions("bucket", "role")
        .mapInArrow(verify, "src long, dst long")
        .distinct()
    )
    hot = found.where("src = dst").select(F.col("src").alias("fp"))
    midpoints = hot.select(
        "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))).alias("dst")
    )
    return found.where("src <> dst").unionByName(midpoints.select(F.col("fp").alias("src"), "dst"))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; ``component_id`` is the smallest id reachable over links
    (its own included).

    Texts without words share fingerprint 0 and link like any other. Repeated rows are rows of their own
    with one component. Null ids take part but never name a component unless all ids of it are null.
    Equal fingerprints are gathered into one row before any candidate search.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]))
    return prints.join(_components(prints), "fp").select("doc_id", "fp", "component_id")


def _components(prints: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct fingerprint; ``root`` is the component's smallest one.
    ``more`` holds further edges between fingerprints."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(distinct) if more is None else links(distinct).unionByName(more)
    reach = connected_components(edges).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = cut(distinct.join(reach, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return cut(rooted.join(named, "root").select("fp", "root", "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` of which each component keeps one: the row of its smallest id (null ids last; of several
    rows of that id, the one whose text has the smallest checksum). All columns stay as they were, whatever their
    names.

    Texts link at 2 or fewer differing bits of their fingerprints, or at Jaccard 0.8 of their five-word shingles.
    Null texts and texts without words have one fingerprint and no shingles, so one of them stays; of rows repeated
    with id and text one stays; texts of any length are read whole; an empty table stays empty.
    """
    id_, mark = F.col(id_col), F.coalesce(F.xxhash64(text_col), F.lit(0))
    narrow = docs.select(id_.alias("doc_id"), mark.alias("mark"), F.col(text_col).alias("text"))
    keyed = cut(shingles.sketches(narrow, ["doc_id", "mark"], fingerprint))
    more = shingles.similar_links(keyed, narrow)
    chosen = cut(
        keyed.join(_components(keyed.select("doc_id", "fp"), more).select("fp", "root"), "fp")
        .groupBy("root")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
        .select("first.doc_id", "first.mark")
    )
    key, first = unused(docs.columns, 2)
    kept = docs.withColumn(key, F.struct(id_.alias("doc_id"), mark.alias("mark"))).join(
        chosen.select(F.struct("doc_id", "mark").alias(first)), F.col(key).eqNullSafe(F.col(first)), "left_semi"
    )
    unique = keyed.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    if not unique:  # rows repeated with id and text: one of each stays
        kept = kept.dropDuplicates([key])
    return kept.drop(key)
