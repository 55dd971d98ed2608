"""Repetition coverage: how much of a text lies inside repeated n-grams and repeated lines.

Every word has a 64-bit hash; the rolling hash of the n words from each place on grows out of that of n - 1
words by one multiplication and one addition, so one pass over the lengths serves all of them. N-grams of
equal hash are compared word by word with the first of them; should two differ, the n-grams of that length
are told apart by their words alone, so counts are exact. All in numpy, one text at a time and linear in
memory. A character counts once per length, however many repeated n-grams cover it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinmark.llm.common import arrow_map, raw_texts

_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_TAIL = bytes(c for c in range(256) if c & 0xC0 != 0x80)  # all bytes but UTF-8 continuation bytes


@dataclass(frozen=True)
class RepetitionRules:
    """Largest share of a text's word characters that may lie in n-grams (by length) occurring twice or
    more, and in lines equal to an earlier line."""

    ngram_limits: tuple[tuple[int, float], ...] = ((5, 0.15), (7, 0.13), (10, 0.10))
    line_limit: float = 0.20
    min_words: int = 50


_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so that no word loses bits as it rolls on


def _word_hashes(numbers: np.ndarray) -> np.ndarray:
    """A hash for every word, from the number that its text has within the document."""
    with np.errstate(over="ignore"):
        x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))


def _roll(hashes: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n words from those of n - 1 words and the hashes of single words."""
    with np.errstate(over="ignore"):
        return hashes[: len(words) - n + 1] * _FACTOR + words[n - 1 :]


def _repeated(hashes: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Mask of the places whose n words stand at another place, too."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return np.zeros(len(hashes), dtype=bool)
    left, right = order[:-1][same], order[1:][same]
    if any((numbers[left + k] != numbers[right + k]).any() for k in range(n)):
        windows = np.lib.stride_tricks.sliding_window_view(numbers, n)
        _, kind, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        return times[kind.ravel()] > 1
    out = np.zeros(len(hashes), dtype=bool)
    out[left] = out[right] = True
    return out


def _covered(repeated: np.ndarray, n: int, size: int) -> np.ndarray:
    """Mask of the words inside any of the n-grams at the places marked."""
    steps = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(repeated)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + n, -1)
    return np.cumsum(steps[:size]) > 0


def measure(text: bytes, rules: RepetitionRules) -> dict:
    """Counts and shares of one text."""
    words = text.split()
    n = len(words)
    bare = text.translate(None, _SPACES)
    word_chars = len(bare) - len(bare.translate(None, _NOT_TAIL))
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    n_dup_lines, dup_line_bytes = 0, 0
    for line in text.split(b"\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_bytes += len(b"".join(line.split()))
        elif line.strip():
            seen.add(line)
    out = {
        "n_words": n,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": 0,
        "dup_line_share": dup_line_bytes / max(1, len(bare)),
    }
    lengths = [k for k, _ in rules.ngram_limits]
    shares = dict.fromkeys(lengths, 0.0)
    if n >= 3:
        first: dict[bytes, int] = {}
        base = np.array([first.setdefault(w, len(first)) for w in words], dtype=np.int64)
        if len(first) < n:
            sizes = np.array([len(w) for w in words], dtype=np.int64)
            singles = hashes = _word_hashes(base)
            for k in range(2, max([3, *lengths]) + 1):
                if n < k:
                    break
                hashes = _roll(hashes, singles, k)
                if k != 3 and k not in shares:
                    continue
                repeated = _repeated(hashes, base, k)
                if not repeated.any():
                    break  # so no longer n-gram repeats either
                inside = _covered(repeated, k, n)
                if k == 3:
                    out["n_repeat_words"] = int(inside.sum())
                if k in shares:
                    shares[k] = float(sizes[inside].sum() / max(1, len(bare)))
    for k in lengths:
        out[f"dup_{k}gram_share"] = shares[k]
    out["base_failed"] = n < rules.min_words or 100 * out["n_repeat_words"] > 50 * n
    out["kept"] = (
        not out["base_failed"]
        and out["dup_line_share"] <= rules.line_limit
        and all(shares[k] <= limit for k, limit in rules.ngram_limits)
    )
    return out


def score_quality(
    docs: DataFrame,
    rules: RepetitionRules | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs`` with counts, shares of characters inside repeated n-grams and lines,
    ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Texts of any length are measured whole. Repeated
    rows get equal results; null ids pass through; other columns, whatever their names, are ignored; an empty
    table gives an empty result.
    """
    rules = rules or RepetitionRules()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_share", *(f"dup_{k}gram_share" for k, _ in rules.ngram_limits)]
    flags = ["base_failed", "kept"]

    def run(batch: pa.RecordBatch) -> dict:
        rows = [measure(t, rules) for t in raw_texts(batch, text_col)]
        kinds = dict.fromkeys(longs, pa.int64()) | dict.fromkeys(shares, pa.float64()) | dict.fromkeys(flags, pa.bool_())
        return {"doc_id": batch.column(id_col)} | {c: pa.array([r[c] for r in rows], kinds[c]) for c in longs + flags + shares}

    id_type = docs.schema[id_col].dataType.simpleString()
    fields = [f"{c} long" for c in longs] + [f"{c} boolean" for c in flags] + [f"{c} double" for c in shares]
    return arrow_map(docs.select(id_col, text_col), run, f"doc_id {id_type}, " + ", ".join(fields))
