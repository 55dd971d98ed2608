"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmark.functions.fixed_values import INDIC_KEYWORDS, NULL_WORDS, STREET_ABBREVIATIONS, UNKNOWN_COUNTRY

_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value computed once: a lambda variable stands for it wherever the body uses it, where plain
    nesting would repeat the whole expression at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_column(c), f"^{_SPACE}|{_SPACE}$", "")


def safe_str(c: Column | str) -> Column:
    """Stripped text; null and the words for null become empty."""
    return let(
        strip(F.coalesce(_column(c), F.lit(""))), lambda t: F.when(F.lower(t).isin(*NULL_WORDS), "").otherwise(t)
    )


@lru_cache(maxsize=1)
def _ascii_images() -> tuple[str, str, dict[str, str]]:
    """Code points whose compatibility decomposition has one ASCII character, these characters, and those with
    several; everything else beyond ASCII has none."""
    single, images, several = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        image = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if x < "\x80")
        if len(image) == 1:
            single.append(chr(code))
            images.append(image)
        elif image:
            several[chr(code)] = image
    return "".join(single), "".join(images), several


@lru_cache(maxsize=4)
def _map_sql(pairs: tuple[tuple[str, str], ...]) -> str:
    """A literal map as SQL: one expression to parse instead of a literal to build for every entry."""
    quoted = ["'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in pairs for x in pair]
    return f"map({', '.join(quoted)})"


def to_ascii(c: Column) -> Column:
    """Compatibility decomposition, then ASCII alone. Text that is ASCII already skips all of it."""
    return let(c, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), _to_ascii(t)).otherwise(t))


def _to_ascii(c: Column) -> Column:
    single, images, several = _ascii_images()
    table = F.expr(_map_sql(tuple(several.items())))
    expanded = F.array_join(
        F.transform(F.regexp_extract_all(c, F.lit(r"(?s)."), F.lit(0)), lambda x: F.coalesce(F.element_at(table, x), x)), ""
    )
    wide = F.when(c.rlike("[" + "".join(several) + "]"), expanded).otherwise(c)
    return F.regexp_replace(F.translate(wide, single, images), r"[^\x00-\x7F]", "")


def normalize_text(c: Column | str) -> Column:
    """Lower-case ASCII words joined by single spaces. Not idempotent: ``(nan)`` gives ``nan``, which gives nothing."""
    text = F.lower(to_ascii(let(safe_str(c), lambda t: F.when(t.rlike(r"[\x{0900}-\x{097F}]"), _indic(t)).otherwise(t))))
    for symbol, word in (("&", " and "), ("+", " plus "), ("@", " at ")):
        text = swap(text, symbol, word)
    text = F.regexp_replace(text, r"\b(\d+)(?:st|nd|rd|th)\b", "$1")
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def _indic(text: Column) -> Column:
    for word, latin in INDIC_KEYWORDS.items():
        text = swap(text, word, f" {latin} ")
    return text


def words(normalized: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(normalized, " "), lambda w: w != "")


def expand_abbreviations(normalized: Column) -> Column:
    """Street abbreviations of an already normalised address written out."""
    table = F.expr(_map_sql(tuple(STREET_ABBREVIATIONS.items())))
    return F.array_join(F.transform(words(normalized), lambda w: F.coalesce(F.element_at(table, w), w)), " ")


def standardize_address_text(c: Column | str) -> Column:
    return expand_abbreviations(normalize_text(c))


def normalize_country(c: Column | str) -> Column:
    """Upper-case country; ``UNKNOWN`` where nothing is left."""
    return let(F.upper(normalize_text(c)), lambda n: F.when(n == "", UNKNOWN_COUNTRY).otherwise(n))


def soundex(word: Column | str) -> Column:
    """Four-character code in which vowels, h, w, y and digits all end a run of one digit."""
    return let(F.upper(_column(word)), _soundex)


def _soundex(w: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    groups = {"BFPV": "1", "CGJKQSXZ": "2", "DT": "3", "L": "4", "MN": "5", "R": "6"}
    digit = {x: d for group, d in groups.items() for x in group}
    coded = F.translate(w, letters + "0123456789", "".join(digit.get(x, "0") for x in letters) + "0" * 10)
    for d in "123456":
        coded = F.regexp_replace(coded, f"{d}+", d)
    tail = F.regexp_replace(F.substring(coded, F.lit(2), F.length(coded)), "0", "")
    first = F.substring(w, 1, 1)
    code = F.concat(F.when(first == "0", "").otherwise(first), tail)
    return F.when(w == "", "").otherwise(F.rpad(F.substring(code, 1, 4), 4, "0"))


def char_ngrams(c: Column, n: int) -> Column:
    """All n-grams of a text in order; a shorter text is its own, an empty one has none."""
    return let(
        c,
        lambda t: F.when(t == "", F.array().cast("array<string>"))
        .when(F.length(t) < n, F.array(t))
        .otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))),
    )
