"""Substring dedup over sliding sentence spans.

A text is cut into sentences (see :func:`sentences`). From every sentence on, the shortest run of at least
``MIN_SENTENCES`` sentences and ``MIN_WORDS`` words is a span, and so is the shortest such run up to every
sentence; the words of a span are hashed. Spans of all documents meet by hash in one shuffle; every span
that is not the first of its hash (by document id, then place) is repeated, and all sentences inside a
repeated span are removed. Any run of sentences that two texts share and that has ``MIN_WORDS`` words is
thereby covered from its first sentence to its last.

Before the shuffle each batch keeps one row per hash, the first: later ones of the batch are repeated
already and travel by document instead of by hash. A task also remembers the first place of hashes that
repeat (up to ``HOT`` of them), over all its batches: what comes later than that place is repeated as
well. A passage that a third of all documents hold thus reaches the task of its hash a few times per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from kinmark.llm.common import arrow_map, cut, small_batches, unused

MIN_WORDS = 20
MIN_SENTENCES = 2
#: Words from which on a sentence is cut further, at places that its words alone decide.
LONG_SENTENCE = 16
#: Repeated hashes whose first place a task remembers.
HOT = 100_000
#: A sentence with the space behind it: up to end marks and white space, or a line end.
_SENTENCE = re.compile(r"[^\n]*?[.!?…。！？][\"'”’)\]]*(?:[^\S\n]+|\n\s*|$)|[^\n]*(?:\n\s*|$)")
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 2**64)


def sentences(text: str) -> list[str]:
    """Pieces of ``text`` whose concatenation is ``text``: sentences with the space behind them; one of more
    than ``LONG_SENTENCE`` words is cut after words that start a low hash with their successor, so that
    equal passages are cut alike wherever they stand."""
    out = []
    for piece in _SENTENCE.findall(text):
        if not piece:
            continue
        if len(piece) > 4 * LONG_SENTENCE and len(piece.split()) > LONG_SENTENCE:
            out += _content_cuts(piece)
        else:
            out.append(piece)
    return out


_TOKEN = re.compile(r"\s*\S+\s*")


def _content_cuts(piece: str) -> list[str]:
    tokens = _TOKEN.findall(piece)
    bare = [t.strip() for t in tokens]
    hashes = [xxhash.xxh32_intdigest(f"{a} {b}") for a, b in zip(bare, bare[1:])]
    out, start = [], 0
    for i in range(len(hashes)):
        lo, hi = max(0, i - 4), min(len(hashes), i + 5)
        if hashes[i] == min(hashes[lo:hi]) and lo == i - 4 and hi == i + 5:
            out.append("".join(tokens[start : i + 1]))
            start = i + 1
    out.append("".join(tokens[start:]))
    return out


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and number of sentences of every span of a text."""
    words = [s.split() for s in sentences(text)]
    n = len(words)
    none = np.empty(0, np.int64)
    if n < MIN_SENTENCES:
        return none, none, none
    counts = np.fromiter(map(len, words), np.int64, n)
    total = np.r_[0, np.cumsum(counts)]
    if total[-1] < MIN_WORDS:
        return none, none, none
    index = np.arange(n)
    # shortest runs from each sentence, and up to each sentence
    end = np.maximum(np.searchsorted(total, total[:-1] + MIN_WORDS), index + MIN_SENTENCES)
    forward = end <= n
    begin = np.minimum(np.searchsorted(total, total[1:] - MIN_WORDS, side="right") - 1, index + 1 - MIN_SENTENCES)
    backward = (begin >= 0) & (total[1:] >= MIN_WORDS)
    runs = np.unique(
        np.concatenate(
            [np.stack([index[forward], end[forward]], 1), np.stack([begin[backward], index[backward] + 1], 1)]
        ),
        axis=0,
    )
    h = np.array([xxhash.xxh64_intdigest(" ".join(w), 7) for w in words], dtype=_U)
    h[counts == 0] = 0
    with np.errstate(over="ignore"):
        # sum of h[k] * P^(end-k), by prefix sums of h[k] * P^-k; empty sentences count for nothing
        place = np.cumsum(counts > 0)
        top = int(place[-1]) + 1
        up, down = _powers(top)
        prefix = np.r_[_U(0), np.cumsum(h * down[place])]
        last = place[runs[:, 1] - 1]
        value = (prefix[runs[:, 1]] - prefix[runs[:, 0]]) * up[last]
        value = (value ^ (value >> _U(32))) * _U(0xD6E8FEB86659FD93)
        value ^= value >> _U(32)
    return value.view(np.int64), runs[:, 0], runs[:, 1] - runs[:, 0]


_cached: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _cached or len(_cached[0]) < n + 1:
        size = max(4096, 2 * n)
        with np.errstate(over="ignore"):
            _cached[:] = [np.cumprod(np.r_[_U(1), np.full(size, p, dtype=_U)]) for p in (_P, _P_INVERSE)]
    return _cached[0], _cached[1]


class _Known:
    """First places of hashes that a task has seen repeated: sorted hashes, and id, place and length of each."""

    def __init__(self):
        self.hashes = np.empty(0, np.int64)
        self.first = [np.empty(0, np.int64) for _ in range(3)]

    def later(self, hashes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
        """Which rows come after the place known for their hash; where one comes before, it is the known one now."""
        out = np.zeros(len(hashes), dtype=bool)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        at, mine = at[hit], [c[hit] for c in columns]
        order = _compare(mine, [f[at] for f in self.first])
        out[hit] = order > 0
        less = order < 0
        for f, m in zip(self.first, mine, strict=True):
            f[at[less]] = m[less]
        return out

    def add(self, hashes: np.ndarray, columns: list[np.ndarray]) -> None:
        """Remember more hashes, distinct and sorted, while there is room."""
        room = HOT - len(self.hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = np.flatnonzero(self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), bool))[:room]
        if len(new):
            both = np.concatenate([self.hashes, hashes[new]])
            order = np.argsort(both, kind="stable")
            self.hashes = both[order]
            self.first = [np.concatenate([f, c[new]])[order] for f, c in zip(self.first, columns, strict=True)]


def _compare(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """-1, 0 or 1 for each row of several columns, the first column deciding first."""
    out = np.zeros(len(a[0]), dtype=np.int8)
    for x, y in zip(a, b, strict=True):
        out = np.where(out != 0, out, np.sign((x > y).astype(np.int8) - (x < y).astype(np.int8)))
    return out


def _doc_number(docs: DataFrame):
    """The id as a number that orders documents: null as the smallest, ids that are no whole numbers by checksum."""
    kind = docs.schema["doc_id"].dataType
    number = F.col("doc_id").cast("long") if isinstance(kind, IntegralType) else F.xxhash64(F.col("doc_id").cast("string"))
    return F.when(F.col("doc_id").isNull(), F.lit(-(2**63))).otherwise(number)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, mark, spans)``: per document with repeated text, its repeated spans packed as
    ``first sentence << 32 | sentences``. ``doc`` is the id as a number, ``mark`` a checksum of the text that
    tells rows of one id apart."""
    narrow = docs.select(_doc_number(docs).alias("doc"), _mark().alias("mark"), "text")
    small_batches(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_here = _Known()
        for batch in batches:
            doc = batch.column("doc").to_numpy(zero_copy_only=False)
            mark = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
            found = [spans(t) if t else None for t in batch.column("text").to_pylist()]
            sizes = np.array([len(f[0]) if f else 0 for f in found], dtype=np.int64)
            if not sizes.sum():
                continue
            hashes, first, length = (np.concatenate([f[k] for f in found if f]) for k in range(3))
            del found
            columns = [np.repeat(doc, sizes), (np.repeat(mark, sizes) << 32) | first, length]
            order = np.lexsort((*reversed(columns), hashes))
            hashes, columns = hashes[order], [c[order] for c in columns]
            new = np.r_[True, hashes[1:] != hashes[:-1]]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            again = np.zeros(len(new), dtype=bool)
            for c in columns:
                again |= c != c[lead]
            keep = new | again  # not the first once more, from a repeated row
            hot = np.unique(lead[again])
            again |= known_here.later(hashes, columns)
            known_here.add(hashes[hot], [c[hot] for c in columns])
            deal = np.where(again, columns[0], hashes)
            yield pa.RecordBatch.from_pydict(
                {
                    "deal": pa.array(deal[keep]),
                    "known": pa.array(again[keep]),
                    "doc": pa.array(columns[0][keep]),
                    "place": pa.array(columns[1][keep]),
                    "n": pa.array(columns[2][keep]),
                }
            )

    keyed = narrow.mapInArrow(emit, "deal long, known boolean, doc long, place long, n long")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # hash and first row of the hash at hand
        for batch in batches:
            deal, known, *columns = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("deal", "known", "doc", "place", "n"))
            out = known.copy()
            rest = np.flatnonzero(~known)
            if len(rest):
                h, mine = deal[rest], [c[rest] for c in columns]
                new = np.r_[True, h[1:] != h[:-1]]
                lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                leads = [m[lead] for m in mine]
                if last is not None and h[0] == last[0]:
                    carried = h == h[0]
                    for own, before in zip(leads, last[1], strict=True):
                        own[carried] = before
                out[rest] = _compare(mine, leads) != 0
                last = (h[-1], [own[-1] for own in leads])
            if out.any():
                yield pa.RecordBatch.from_pydict({c: pa.array(x[out]) for c, x in zip(("doc", "place", "n"), columns, strict=True)})

    return (
        keyed.repartition("deal", "known")
        .sortWithinPartitions("known", "deal", "doc", "place", "n")
        .mapInArrow(resolve, "doc long, place long, n long")
        .groupBy("doc", F.expr("shiftright(place, 32)").cast("int").alias("mark"))
        .agg(F.collect_set(F.expr("shiftleft(place, 32) | n")).alias("spans"))
    )


def _mark():
    return (F.xxhash64("text") % (2**31)).cast("int")


def dedup_substrings(docs: DataFrame, keep_all_columns: bool = False) -> DataFrame:
    """Remove repeated passages from ``text``.

    Returns every row: ``(doc_id, text, n_sentences, n_removed, n_words_removed)``, or with
    ``keep_all_columns`` the columns of ``docs`` with ``text`` (and ``n_chars``, where there is one)
    renewed. The first occurrence of a passage stays: the one of smallest document id, then place; ids that
    are no whole numbers go by their checksum. Null and empty texts stay as they are; a null id comes first.
    Rows equal in id and text count as one occurrence and stay alike. Texts and runs of sentences of any
    length are compared whole. Other columns may have any names; an empty table gives an empty result.
    """
    found = cut(repeated_spans(docs)).select(F.struct(F.col("doc").alias("d"), F.col("mark").alias("m")).alias("k"), F.col("spans").alias("s"))
    columns = docs.columns
    names = unused(columns, 2)
    keyed = docs.withColumn(names[0], F.struct(_doc_number(docs).alias("d"), _mark().alias("m")))
    joined = keyed.join(found.toDF(names[0], names[1]), names[0], "left").drop(names[0])

    def remove(batch: pa.RecordBatch) -> dict:
        texts, total, gone, words = [], [], [], []
        for text, packed in zip(batch.column("text").to_pylist(), batch.column(names[1]).to_pylist(), strict=True):
            pieces = sentences(text) if text else []
            total.append(len(pieces))
            if not packed:
                texts.append(text)
                gone.append(0)
                words.append(0)
                continue
            drop = np.zeros(len(pieces) + 1, dtype=np.int64)
            at = np.array(packed, dtype=np.int64)
            np.add.at(drop, at >> 32, 1)
            np.add.at(drop, (at >> 32) + (at & 0xFFFFFFFF), -1)
            out = np.cumsum(drop[:-1]) > 0
            texts.append("".join([p for p, o in zip(pieces, out, strict=True) if not o]))
            gone.append(int(out.sum()))
            words.append(sum(len(p.split()) for p, o in zip(pieces, out, strict=True) if o))
        if keep_all_columns:
            same = {c: batch.column(c) for c in columns}
            same["text"] = pa.array(texts, batch.schema.field("text").type)
            if "n_chars" in same:
                kind = batch.schema.field("n_chars").type
                lengths = [None if t is None else len(t) for t in texts]
                kept = batch.column("n_chars").to_pylist()
                same["n_chars"] = pa.array([n if g else k for n, k, g in zip(lengths, kept, gone, strict=True)], kind)
            return same
        return {
            "doc_id": batch.column("doc_id"),
            "text": pa.array(texts, pa.string()),
            "n_sentences": pa.array(total, pa.int64()),
            "n_removed": pa.array(gone, pa.int64()),
            "n_words_removed": pa.array(words, pa.int64()),
        }

    if keep_all_columns:
        return arrow_map(joined, remove, docs.schema)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(
        joined.select("doc_id", "text", names[1]),
        remove,
        f"doc_id {id_type}, text string, n_sentences long, n_removed long, n_words_removed long",
    )
