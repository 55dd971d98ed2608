"""Benchmark decontamination by a prefix-filtered set join with exact containment.

Every window of a benchmark item (13 consecutive words, or all words of a shorter item) must occur in a
document word for word. Its shingles are ordered by how often the documents hold them; the rarest alone
is its necessary prefix, for containment of the whole window leaves no shingle that may be missing. A
document position joins a window only through that shingle, in a shuffle by its hash; the window must then
fit between the ends of the document at that offset, and is compared word by word.

Documents are read twice, once to count the benchmark's shingles and once for the positions of prefixes with
the few words around each. Windows, items and counts stay tables. What every task receives are the hashes
of at most ``PASS_KEYS`` shingles; a benchmark with more of them takes further passes of the same kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmark.llm.common import cut, drop_table, raw_texts, small_batches, unused

WINDOW = 13
SHINGLE = 3
#: Shingle hashes that one pass hands to every task, 8 bytes each.
PASS_KEYS = 2_000_000
#: Words looked at together.
BLOCK_WORDS = 400_000
#: Keys of contaminated documents up to which the filter is a broadcast join; beyond, both sides are shuffled.
BROADCAST_KEYS = 200_000
_U = np.uint64
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased, runs of 0-9, a-z and characters beyond ASCII."""
    return text.translate(_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    table = {w: digest(w, 11) for w in dict.fromkeys(words)}
    return np.fromiter(map(table.__getitem__, words), _U, len(words))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on."""
    n = max(0, len(words) - width + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, width, dtype=_U)
        for k in range(width):
            out = (out ^ words[k : n + k]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(29)
    return out.view(np.int64)


def blocks_of(split: list[list[bytes]], limit: int = BLOCK_WORDS) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Runs of texts with at most ``limit`` words together, or a single longer text, and the first text of each."""
    first, block, size = 0, [], 0
    for i, words in enumerate(split):
        if block and size + len(words) > limit:
            yield first, block
            first, block, size = i, [], 0
        block.append(words)
        size += len(words)
    if block:
        yield first, block


class Keys:
    """Shingle hashes to look for, by width."""

    def __init__(self, width: np.ndarray, hashes: np.ndarray):
        self.by_width = {}
        for w in np.unique(width).tolist():
            own = np.sort(hashes[width == w])
            near = np.zeros(1 << 22, dtype=bool)
            near[(own.view(_U) >> _U(42)).astype(np.int64)] = True
            self.by_width[w] = own, near

    def places(self, split: list[list[bytes]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For every width: the places in the flat words of a block where a key begins, and which key of the width."""
        flat = word_hashes([w for words in split for w in words])
        ends = np.cumsum([len(words) for words in split])
        for w, (own, near) in self.by_width.items():
            hashes = shingle_hashes(flat, w)
            at = np.flatnonzero(near[(hashes.view(_U) >> _U(42)).astype(np.int64)])
            # within one text
            at = at[at + w <= ends[np.searchsorted(ends, at, side="right")]]
            key = np.minimum(np.searchsorted(own, hashes[at]), len(own) - 1)
            hit = own[key] == hashes[at]
            yield w, at[hit], key[hit]


def _passes(keys: DataFrame) -> Iterator[Keys]:
    """Distinct ``(w, h)`` in parts of about ``PASS_KEYS``; one empty part where there are none."""
    parts = max(1, math.ceil(keys.count() / PASS_KEYS))
    for p in range(parts):
        part = keys.where(F.pmod("h", F.lit(parts)) == p).toPandas()
        yield Keys(part["w"].to_numpy(), part["h"].to_numpy())


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item, words, l, w, shingles)``: every window of every item, its words joined by spaces, their number, and
    the hashes of its shingles of ``w`` words in order."""
    small_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), raw_texts(batch), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                width = min(SHINGLE, size)
                if not size:
                    continue
                hashes = shingle_hashes(word_hashes(words), width)
                for lo in range(0, len(words) - size + 1, 2000):
                    at = range(lo, min(lo + 2000, len(words) - size + 1))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item": pa.array([item] * len(at), pa.string()),
                            "words": pa.array([b" ".join(words[k : k + size]).decode() for k in at], pa.string()),
                            "l": pa.array([size] * len(at), pa.int32()),
                            "w": pa.array([width] * len(at), pa.int32()),
                            "shingles": pa.array([hashes[k : k + size - width + 1] for k in at], pa.list_(pa.int64())),
                        }
                    )

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(run, "item string, words string, l int, w int, shingles array<long>")


def shingle_counts(docs: DataFrame, keys: DataFrame, text_col: str = "text") -> DataFrame:
    """``(w, h, n)``: how often the documents hold each of the distinct shingles ``keys`` that they hold at all."""
    parts = []
    for part in _passes(keys):

        def count(batches: Iterator[pa.RecordBatch], part: Keys = part) -> Iterator[pa.RecordBatch]:
            total = {w: np.zeros(len(own), dtype=np.int64) for w, (own, _) in part.by_width.items()}
            for batch in batches:
                for _, split in blocks_of([words_of(t) for t in raw_texts(batch, text_col)]):
                    for w, _, key in part.places(split):
                        total[w] += np.bincount(key, minlength=len(total[w]))
            for w, n in total.items():
                held = np.flatnonzero(n)
                for k in range(0, len(held), 100_000):
                    at = held[k : k + 100_000]
                    columns = {"w": pa.array(np.full(len(at), w, np.int32)), "h": pa.array(part.by_width[w][0][at]), "n": pa.array(n[at])}
                    yield pa.RecordBatch.from_pydict(columns)

        parts.append(docs.select(text_col).mapInArrow(count, "w int, h long, n long"))
    return reduce(DataFrame.unionByName, parts).groupBy("w", "h").agg(F.sum("n").alias("n"))


def prefixes(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """``(words, l, w, offset, h)``: the rarest shingle of each window, the first of equals. A window with a shingle that
    no document holds can occur nowhere and is left out."""
    shingles = distinct.select("words", "l", "w", F.posexplode("shingles").alias("offset", "h"))
    rate = F.coalesce("n", F.lit(0))
    rarest = (
        shingles.join(counts, ["w", "h"], "left")
        .groupBy("words", "l", "w")
        .agg(F.min(F.struct(rate.alias("n"), "offset", "h")).alias("p"))
    )
    return rarest.where("p.n > 0").select("words", "l", "w", "p.offset", "p.h")


def places(docs: DataFrame, keys: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """``(k, n_words, w, h, places)``: for every row of ``docs`` (``k``, text) and each of the distinct shingles ``keys`` that
    it holds, the places where it begins, each with the words around that a window could reach. One row of ``w`` 0
    for every row of ``docs`` has its number of words."""
    reach = window - 1
    key_type = docs.schema["k"].dataType.simpleString()
    schema = f"k {key_type}, n_words long, w int, h long, places array<struct<at:int,left:int,near:string>>"
    place_type = pa.list_(pa.struct([("at", pa.int32()), ("left", pa.int32()), ("near", pa.string())]))
    parts = []
    small_batches(docs.sparkSession)
    for number, part in enumerate(_passes(keys)):

        def run(batches: Iterator[pa.RecordBatch], part: Keys = part, count: bool = number == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, split in blocks_of([words_of(t) for t in raw_texts(batch, text_col)]):
                    if count:
                        n = len(split)
                        yield pa.RecordBatch.from_pydict(
                            {
                                "k": batch.column("k").slice(first, n),
                                "n_words": pa.array([len(words) for words in split], pa.int64()),
                                "w": pa.array(np.zeros(n, np.int32)),
                                "h": pa.array(np.zeros(n, np.int64)),
                                "places": pa.array([[]] * n, place_type),
                            }
                        )
                    starts = np.r_[0, np.cumsum([len(words) for words in split])]
                    for w, at, key in part.places(split):
                        doc = np.searchsorted(starts, at, side="right") - 1
                        order = np.lexsort((at, key, doc))
                        doc, key, at = doc[order], key[order], (at - starts[doc])[order]
                        edges = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0), True]) if len(at) else []
                        for lo in range(0, max(0, len(edges) - 1), 1000):
                            runs = edges[lo : lo + 1001]
                            rows = doc[runs[:-1]]
                            found = [_near(split[d], at[a:b].tolist(), w, reach) for d, (a, b) in zip(rows.tolist(), pairwise(runs.tolist()))]
                            yield pa.RecordBatch.from_pydict(
                                {
                                    "k": batch.column("k").take(pa.array(rows + first)),
                                    "n_words": pa.array([len(split[d]) for d in rows.tolist()], pa.int64()),
                                    "w": pa.array(np.full(len(rows), w, np.int32)),
                                    "h": pa.array(part.by_width[w][0][key[runs[:-1]]]),
                                    "places": pa.array(found, place_type),
                                }
                            )

        parts.append(docs.select("k", text_col).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def _near(words: list[bytes], at: list[int], width: int, reach: int) -> list[dict]:
    out = []
    for a in at:
        lo = max(0, a - reach)
        out.append({"at": a, "left": a - lo, "near": b" ".join(words[lo : a + width + reach]).decode()})
    return out


def verified(found: DataFrame, rarest: DataFrame) -> DataFrame:
    """``(k, n_words, words, l, begins)``: the windows that occur in a document, and where, compared word by word."""

    def begin(x: Column) -> Column:
        return x["left"] - F.col("offset")

    def same(x: Column) -> Column:
        here = F.slice(F.split(x["near"], " "), F.greatest(begin(x), F.lit(0)) + 1, F.col("l"))
        return (begin(x) >= 0) & (F.array_join(here, " ") == F.col("words"))

    begins = F.transform(F.filter("places", same), lambda x: x["at"] - F.col("offset"))
    joined = found.join(rarest, ["w", "h"]).select("k", "n_words", "words", "l", begins.alias("begins"))
    return joined.where(F.size("begins") > 0)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(k, n_words)`` for every row of ``docs`` (``k``, text), and ``(k, n_words, n_hit, items)`` for every ``k`` in which a
    window occurs; rows of one ``k`` have one text. ``items`` are the ids as text, sorted."""
    every = cut(windows(benchmark, window))
    distinct = cut(every.groupBy("words", "l", "w").agg(F.first("shingles").alias("shingles")))
    keys = cut(distinct.select("w", F.explode("shingles").alias("h")).distinct())
    counts = cut(shingle_counts(docs, keys, text_col))
    rarest = cut(prefixes(distinct, counts))
    prefix_keys = cut(rarest.select("w", "h").distinct())
    placed = cut(places(docs, prefix_keys, window, text_col))
    sure = cut(verified(placed.where("w > 0"), rarest))
    runs = sure.select("k", "n_words", "l", F.explode("begins").alias("b")).distinct()
    end = F.lit(0).cast("long")
    covered = F.aggregate(
        F.sort_array(F.collect_list(F.struct("b", "l"))),
        F.struct(end.alias("end"), end.alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], (x["b"] + x["l"]).cast("long")).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["b"] + x["l"] - F.greatest(acc["end"], x["b"]))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    lengths = runs.groupBy("k", "n_words").agg(covered.alias("n_hit"))
    named = sure.select("k", "words").distinct().join(every.select("words", "item").distinct(), "words")
    items = named.groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = cut(lengths.join(items, "k"))
    for table in (every, distinct, keys, counts, rarest, prefix_keys, sure):
        drop_table(table)
    return placed.where("w = 0").select("k", "n_words"), out


def _key(text_col: str) -> Column:
    """Rows of one id and one text share a key; a null id is an id of its own."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"))


_CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    Null and empty texts have no words and no hits; items without words are never found; an item id of
    null reads as the empty string. Repeated documents each get their row; repeated item ids count once.
    Texts and items of any length are compared whole. An empty benchmark leaves every document clean; an
    empty table gives an empty result. Other columns, whatever their names, are ignored.
    """
    every, found = hits(docs.select(_key(text_col).alias("k"), F.col(text_col).alias("text")), benchmark, window)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return (
        every.join(found.drop("n_words"), "k", "left")
        .select(
            F.col("k.id").alias("doc_id"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items).cast("long").alias("n_items"),
            F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", F.expr(_CONTAMINATED))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns as they were, whatever their names. Null and empty
    texts stay; repeated rows go or stay together; an empty benchmark removes nothing."""
    name = unused(docs.columns, 1)[0]
    keyed = docs.withColumn(name, _key(text_col))
    _, found = hits(keyed.select(F.col(name).alias("k"), F.col(text_col).alias("text")), benchmark, window)
    bad = cut(found.where(_CONTAMINATED).select(F.col("k").alias(name)))
    few = bad.count() <= BROADCAST_KEYS
    return keyed.join(F.broadcast(bad) if few else bad, name, "left_anti").drop(name)
