"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words of a text with their beginnings of 3 to 6 characters (inflected forms
share them), word pairs, and pairs with one word between. Training runs over a bounded sample of
labelled rows, chosen by a hash of the id; per-coordinate rates and an L1 term leave a few thousand
weights, which the scoring tasks receive as one small closure. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.llm.common import arrow_map, blocks, claim, small_batches, texts

_U = np.uint64
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class FtrlParams:
    """``sample_rows`` bounds the labelled rows that training reads, ``sample_features`` their features together:
    rows beyond, in the order of the ids' hashes, are left out. Features in more than ``max_share`` of the
    sample or in fewer than ``min_rows`` rows are left out. ``l1``, ``alpha`` and ``prefixes`` were chosen by
    folds of training rows."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    epochs: int = 10
    max_share: float = 0.30
    min_rows: int = 2
    prefixes: tuple[int, ...] = (3, 4, 5, 6)
    sample_rows: int = 20_000
    sample_features: int = 30_000_000


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    prefixes: tuple[int, ...]
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits, dtype=np.float32)
        table[self.index] = self.weight
        return table


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
        return x ^ (x >> _U(29))


class Features:
    """Hashed feature numbers of texts, a block of texts at a time; the words met are kept, up to a bound."""

    KEEP = 200_000
    BLOCK_CHARS = 1_000_000

    def __init__(self, bits: int, prefixes: tuple[int, ...], weights: np.ndarray | None = None):
        self.bits, self.mask, self.prefixes, self.weights = bits, _U((1 << bits) - 1), prefixes, weights
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.hashes = np.empty(0, dtype=_U)
        self.singles = np.empty((0, 1 + len(self.prefixes)), dtype=np.int32)

    def _learn(self, new: list[str]) -> None:
        digest = xxhash.xxh64_intdigest
        keys = np.zeros((len(new), 1 + len(self.prefixes)), dtype=_U)
        keys[:, 0] = [digest(w, 1) for w in new]
        long = np.fromiter(map(len, new), np.int64, len(new))
        for c, k in enumerate(self.prefixes, 1):
            keys[:, c] = [digest(w[:k], 10 + k) for w in new]
        found = (_mix(keys) & self.mask).astype(np.int32)
        for c, k in enumerate(self.prefixes, 1):
            found[long < k, c] = -1
        if self.weights is not None:
            found[self.weights[found] == 0] = -1
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new)), strict=True))
        self.hashes = np.concatenate([self.hashes, keys[:, 0]])
        self.singles = np.concatenate([self.singles, found])

    def of(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature number of every distinct feature of every text, in order; with weights given, only
        of features that have one."""
        split = [_WORD.findall(t.lower()) for t in all_texts]
        flat = [w for words in split for w in words]
        if len(self.words) > self.KEEP:
            self._forget()
        at = np.fromiter(map(self.words.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([flat[i] for i in missing])))
            at[missing] = [self.words[flat[i]] for i in missing]
        doc = np.repeat(np.arange(len(split)), [len(w) for w in split])
        distinct = np.unique((doc << 32) | at)
        single = self.singles[distinct & 0xFFFFFFFF].astype(np.int64)
        rows, cols = np.nonzero(single >= 0)
        parts = [((distinct[rows] >> 32) << self.bits) | single[rows, cols]]
        h = self.hashes[at]
        with np.errstate(over="ignore"):
            for gap in (1, 2):
                if len(h) > gap:
                    pair = (_mix(h[:-gap] * _U(2 * gap + 1) + h[gap:]) & self.mask).astype(np.int64)
                    use = doc[:-gap] == doc[gap:]
                    if self.weights is not None:
                        use &= self.weights[pair] != 0
                    parts.append((doc[:-gap][use] << self.bits) | pair[use])
        both = np.unique(np.concatenate(parts))
        return both >> self.bits, both & ((1 << self.bits) - 1)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], params: FtrlParams) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, feature numbers and weights after ``params.epochs`` passes in the order given."""
    size = 1 << params.bits
    seen = np.zeros(size, dtype=np.int64)
    for f, _ in rows:
        seen[f] += 1
    use = (seen >= params.min_rows) & (seen <= max(params.min_rows, params.max_share * len(rows)))
    kept = [(f[use[f]], y) for f, y in rows]
    z, n, zb, nb = np.zeros(size), np.zeros(size), 0.0, 0.0
    a, b, l1, l2 = params.alpha, params.beta, params.l1, params.l2

    def solve(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((b + np.sqrt(ni)) / a + l2))

    for _ in range(params.epochs):
        for f, y in kept:
            zi, ni = z[f], n[f]
            w, wb = solve(zi, ni), -zb / ((b + nb**0.5) / a)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + wb, -35, 35)))
            g = p - y
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / a * w
            n[f] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / a * wb
            nb += g * g
    weights = solve(z, n)
    index = np.flatnonzero(weights)
    return -zb / ((b + nb**0.5) / a), index, weights[index]


def held_out(doc_id: str = "doc_id"):
    """Rows that training may not read: crc32 of the id as text leaves no rest by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams | None = None) -> ToxicityModel:
    """Fit on labelled rows that are not held out.

    The sample is the ``sample_rows`` labelled ids of smallest hash (all, where there are fewer), one text for
    each: of several rows of an id, the one whose text has the smallest checksum. An id labelled twice counts
    as toxic if any label says so; null labels and null ids are left out; null texts count as empty. Without
    any row the model scores every text just under one half. Other columns are ignored.
    """
    params = params or FtrlParams()
    small_batches(docs.sparkSession)
    sample = (
        labels.where("toxic is not null and doc_id is not null")
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("__y"))
        .withColumn("__h", F.xxhash64("doc_id"))
        .orderBy("__h", "doc_id")
        .limit(params.sample_rows)
    )
    text = F.coalesce("text", F.lit(""))
    rows = (
        docs.select("doc_id", text.alias("text"))
        .join(F.broadcast(sample), "doc_id")  # sample_rows rows of three numbers at most
        .groupBy("doc_id", "__h", "__y")
        .agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text"))["text"].alias("text"))
    )
    bits, prefixes, most = params.bits, params.prefixes, params.sample_features

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(bits, prefixes)
        for batch in batches:
            found = []
            for block in blocks(texts(batch), Features.BLOCK_CHARS):
                doc, feature = features.of(block)
                edges = np.searchsorted(doc, np.arange(len(block) + 1))
                feature = feature.astype(np.int32)
                found += [feature[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_pydict(
                {"__h": batch.column("__h"), "doc_id": batch.column("doc_id"), "__y": batch.column("__y"), "f": pa.array(found, pa.binary())}
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for batch in batches:
            for f, y in zip(batch.column("f").to_pylist(), batch.column("__y").to_pylist(), strict=True):
                held += len(f) // 4
                if held <= most:
                    got.append((np.frombuffer(f, dtype=np.int32), y))
        if got:
            bias, index, weight = fit_ftrl(got, params)
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(np.r_[-1, index], pa.int32()), "w": pa.array(np.r_[bias, weight], pa.float64())}
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    # FTRL is sequential: one task learns, from at most sample_rows rows of sample_features features
    learnt = (
        rows.mapInArrow(featurise, f"__h long, doc_id {id_type}, __y int, f binary")
        .repartition(1)
        .sortWithinPartitions("__h", "doc_id")
        .mapInArrow(learn, "i int, w double")
        .toPandas()
    )
    own = learnt["i"].to_numpy()
    bias = float(learnt["w"][own == -1].iloc[0]) if len(learnt) else -0.01
    rest = learnt[own >= 0]
    return ToxicityModel(bits, prefixes, bias, rest["i"].to_numpy(), rest["w"].to_numpy(dtype=np.float32))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` for every row; an empty or null text scores by the bias alone.

    Only the text is read, whole. Repeated rows get equal scores; null ids pass through; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    scorer = make_scorer(model)

    def run(batch: pa.RecordBatch) -> dict:
        scores = scorer(texts(batch, text_col))
        return {
            "doc_id": batch.column(id_col),
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array((scores >= 0.5).astype(np.int32)),
        }

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {id_type}, score double, predicted int")


def make_scorer(model: ToxicityModel):
    key = ("toxicity", hash((model.bits, model.bias, model.index.tobytes(), model.weight.tobytes())))

    def make() -> Features:
        return Features(model.bits, model.prefixes, model.dense())

    def scores(all_texts: list[str]) -> np.ndarray:
        features = claim(key, make)
        margins = []
        for block in blocks(all_texts, Features.BLOCK_CHARS):
            doc, feature = features.of(block)
            margins.append(np.bincount(doc, weights=features.weights[feature], minlength=len(block)))
        return 1.0 / (1.0 + np.exp(-np.clip(model.bias + np.concatenate(margins), -35, 35)))

    return scores


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score stays under one half, all columns as they were, whatever their names. Null and
    empty texts score by the bias alone; repeated rows go or stay together; an empty table stays empty."""
    scorer = make_scorer(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer(texts(batch, text_col)) < 0.5))

    return arrow_map(docs, run, docs.schema)
