"""Texts and tokens of whole records, made in Arrow batches by the rules that ``text`` and ``tokens`` state as columns.

A record of some thousand words costs those expressions, interpreted word by word, over ten times as much.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa

from kinmark.functions.fixed_values import (
    ADDR_STOPWORDS,
    INDIC_KEYWORDS,
    LEGAL_STOPWORDS,
    NULL_WORDS,
    STREET_ABBREVIATIONS,
    UNKNOWN_COUNTRY,
)

_SPACE = " \t\n\x0b\x0c\r" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_ORDINAL = re.compile(r"\b(\d+)(?:st|nd|rd|th)\b", re.ASCII)
_INDIC = re.compile("[\u0900-\u097f]")
_WORDS = {i: " " for i in range(128) if not chr(i).isalnum()}
#: Rows that are lists of Python strings at a time.
_ROWS = 256


def normal_text(value: str | None) -> str:
    """Words of ``text.normalize_text``, with spaces between them and none around."""
    t = (value or "").strip(_SPACE)
    if len(t) < 8 and t.lower() in NULL_WORDS:
        return ""
    if not t.isascii():
        if _INDIC.search(t):
            for word, latin in INDIC_KEYWORDS.items():
                t = t.replace(word, f" {latin} ")
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    t = t.lower().replace("&", " and ").replace("+", " plus ").replace("@", " at ")
    if any(d in t for d in "0123456789"):
        t = _ORDINAL.sub(r"\1", t)
    return t.translate(_WORDS).strip(" ")


def normal_words(value: str | None) -> list[str]:
    """Words of ``text.normalize_text``."""
    return normal_text(value).split()


def again(parts: list[str]) -> list[str]:
    """Words of the normalisation of an already normalised text."""
    if len(parts) == 1 and parts[0] in NULL_WORDS:
        return []
    return [x if x.isalpha() else _ORDINAL.sub(r"\1", x) for x in parts]


def name_tokens(parts: list[str]) -> list[str]:
    found = ["n_" + w for w in parts if len(w) >= 2 and w not in LEGAL_STOPWORDS]
    if len(parts) >= 2:
        short = "".join([w for w in parts if len(w) <= 2])
        if len(short) >= 2 and short not in LEGAL_STOPWORDS:
            found.append("n_acr_" + short)
    return found or (["n_" + max(parts, key=len)] if parts else [])


def address_tokens(parts: list[str]) -> list[str]:
    kept, out = [], []
    for w in parts:
        if w.isdigit():
            if w := w.lstrip("0"):
                kept.append(w)
                out.append("num_" + w)
        elif len(w) >= 3 and w not in ADDR_STOPWORDS:
            kept.append(w)
            out.append("w_" + w)
    out += ["sh_" + a + "_" + b for a, b in zip(kept, kept[1:])]
    return out


def name_ngrams(parts: list[str], n: int) -> list[str]:
    bare = "".join(parts)
    if len(bare) < n:
        return ["ng_" + bare] if bare else []
    return ["ng_" + bare[i : i + n] for i in range(len(bare) - n + 1)]


def prepared(name: str | None, address: str | None, country: str | None, raw: bool, n: int, wanted: set[str]) -> dict:
    """The ``wanted`` columns that ``entities.prepare`` adds, of one record; ``raw``: tokens of the texts as they are."""
    out: dict = {"c": " ".join(normal_words(country)).upper() or UNKNOWN_COUNTRY}
    if wanted & {"n", "name_toks", "ngrams", "feat_name_toks"}:
        plain = normal_words(name)
        parts = plain if raw else again(plain)
        out |= {"n": " ".join(plain), "name_toks": name_tokens(parts)}
        if "ngrams" in wanted:
            out["ngrams"] = name_ngrams(parts, n)
        if "feat_name_toks" in wanted:
            out["feat_name_toks"] = name_tokens(again(plain))
    if wanted & {"a", "addr_toks", "feat_addr_toks"}:
        plain = normal_words(address)
        full = [STREET_ABBREVIATIONS.get(w, w) for w in plain]
        # an abbreviation may stand for several words
        full = " ".join(full).split(" ") if full else []
        out |= {"a": " ".join(full), "addr_toks": address_tokens(plain if raw else again(full))}
        if "feat_addr_toks" in wanted:
            out["feat_addr_toks"] = address_tokens(again(full))
    return out


def _lists(rows: list[list[str]]) -> pa.Array:
    offsets, flat = [0], []
    for row in rows:
        flat += row
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.string()))


def prepare_batches(passed: list[str], made: list[str], raw: bool, n: int):
    """A function for ``mapInArrow``: the columns ``passed`` as they are, then the columns ``made``."""
    wanted = set(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                part = batch.slice(start, _ROWS)
                texts = [part.column(x).to_pylist() for x in ("business_name", "business_address", "country")]
                rows = [prepared(*x, raw, n, wanted) for x in zip(*texts)]
                columns = [part.column(x) for x in passed]
                for x in made:
                    values = [r[x] for r in rows]
                    columns.append(pa.array(values, pa.string()) if x in ("n", "a", "c") else _lists(values))
                yield pa.RecordBatch.from_arrays(columns, [*passed, *made])

    return run
