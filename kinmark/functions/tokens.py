"""Blocking tokens as array columns. Every token carries its kind in its prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmark.functions.fixed_values import ADDR_STOPWORDS, LEGAL_STOPWORDS
from kinmark.functions.text import char_ngrams, let, normalize_text, words


def _in(word: Column, values: frozenset[str]) -> Column:
    """A look-up in a hash set, made once per task."""
    return word.isin(*sorted(values))


def name_tokens(name: Column | str, min_length: int = 2) -> Column:
    """``n_`` words that are no legal form, ``n_acr_`` of all short words of a name of several, or else the first
    of the longest words. A list: repeated words repeat."""
    return let(words(normalize_text(name)), lambda parts: name_tokens_of(parts, min_length))


def name_tokens_of(parts: Column, min_length: int = 2) -> Column:
    plain = F.transform(
        F.filter(parts, lambda w: (F.length(w) >= min_length) & ~_in(w, LEGAL_STOPWORDS)),
        lambda w: F.concat(F.lit("n_"), w),
    )
    short = F.array_join(F.filter(parts, lambda w: F.length(w) <= 2), "")
    acronym = let(
        short,
        lambda x: F.when(
            (F.size(parts) >= 2) & (F.length(x) >= 2) & ~_in(x, LEGAL_STOPWORDS),
            F.array(F.concat(F.lit("n_acr_"), x)),
        ).otherwise(F.array().cast("array<string>")),
    )
    longest = F.array_max(F.transform(parts, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    return let(
        F.concat(plain, acronym),
        lambda found: F.when((F.size(found) > 0) | (F.size(parts) == 0), found).otherwise(
            F.array(F.concat(F.lit("n_"), longest))
        ),
    )


def address_parts(parts: Column) -> Column:
    """Words of an address that count: numbers without leading zeros, and words of three letters that say something."""
    kept = F.transform(
        parts,
        lambda w: F.when(w.rlike("^[0-9]+$"), F.ltrim(w, F.lit("0"))).when(
            (F.length(w) >= 3) & ~_in(w, ADDR_STOPWORDS), w
        ),
    )
    return F.filter(kept, lambda w: w.isNotNull() & (w != ""))


def address_tokens(address: Column | str) -> Column:
    """``num_`` and ``w_`` tokens, then ``sh_`` of each two that follow one another. A list: repeats stay."""
    return let(address_parts(words(normalize_text(address))), address_tokens_of)


def address_tokens_of(kept: Column) -> Column:
    single = F.transform(
        kept, lambda w: F.concat(F.when(w.rlike("^[0-9]+$"), F.lit("num_")).otherwise(F.lit("w_")), w)
    )
    size = F.size(kept)
    pairs = F.when(
        size >= 2,
        F.zip_with(
            F.slice(kept, F.lit(1), size - 1),
            F.slice(kept, F.lit(2), size - 1),
            lambda a, b: F.concat(F.lit("sh_"), a, F.lit("_"), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(single, pairs)


def name_ngrams(name: Column | str, n: int = 4) -> Column:
    """``ng_`` of every run of ``n`` characters of the name without its spaces."""
    bare = F.replace(normalize_text(name), F.lit(" "), F.lit(""))
    return F.transform(char_ngrams(bare, n), lambda g: F.concat(F.lit("ng_"), g))


def token_kind(token: Column) -> Column:
    return (
        F.when(token.startswith("ng_"), "ngram")
        .when(token.startswith("n_"), "name")
        .when(token.startswith("num_"), "num")
        .when(token.startswith("sh_"), "shingle")
        .otherwise("word")
    )


def house_numbers(address_token_array: Column) -> Column:
    """Distinct numbers among address tokens."""
    return F.array_distinct(
        F.transform(F.filter(address_token_array, lambda t: t.startswith("num_")), lambda t: F.substring(t, 5, 2**31 - 1))
    )
