"""Parameters of a linkage run, in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class LinkParams:
    """Caps bound the postings a token of each kind may have (inclusive). ``partitioning`` is ``country`` (with a
    pass over everything, if some record's country is unknown), ``fixed`` (only ``countries``) or ``none``.
    ``address_form`` decides whether blocking sees the plain or the abbreviation-expanded address."""

    name_cap: int = 2000
    word_cap: int = 1500
    shingle_cap: int = 4000
    ngram_cap: int = 200
    use_ngrams: bool = True
    ngram_size: int = 4
    address_form: str = "standardized"
    partitioning: str = "country"
    countries: tuple[str, ...] = ()
    exclude_self: bool = True
    fallback: bool = True
    fallback_limit: int | None = None
    top_n: int = 60
    threshold: float = 0.985
    margin: float = 0.005
    max_matches: int | None = 7

    def caps(self) -> dict[str, int]:
        return {
            "name": self.name_cap,
            "word": self.word_cap,
            "num": self.shingle_cap,
            "shingle": self.shingle_cap,
            "ngram": self.ngram_cap,
        }

    def with_(self, **changes) -> LinkParams:
        return replace(self, **changes)


DEFAULT = LinkParams()
TIGHT = DEFAULT.with_(name_cap=20, word_cap=15, shingle_cap=40, ngram_cap=10)
TINY = DEFAULT.with_(name_cap=4, word_cap=3, shingle_cap=8, ngram_cap=2)
#: How many targets without a true match the query ``background_scan`` keeps beside those with one.
BACKGROUND = 20
