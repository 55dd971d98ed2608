"""Similarities of many pairs of texts at once, by the rules that ``similarity`` and ``tokens`` state for one. Alignments of
a pair are steps over the bits of whole words, taken for thousands of pairs together; sets are made once for a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from kinmark.functions import records as rules

#: Pairs at a time, and the characters of all of them in a group.
_PAIRS, _CELLS = 4096, 1 << 19
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def _matrix(texts: list[str]) -> np.ndarray:
    """Code points of a text in a row, then zeros."""
    held = np.array(texts, np.str_)
    out = held.view(np.uint32).reshape(len(texts), -1)
    return out.astype(np.uint8) if out.max(initial=0) < 256 else out


def _bits(flags: np.ndarray, words: int) -> np.ndarray:
    """Flags of a row as 64-bit words, the first flag lowest; a word of all rows is a row."""
    out = np.zeros((len(flags), 8 * words), np.uint8)
    packed = np.packbits(flags, axis=1, bitorder="little")
    out[:, : packed.shape[1]] = packed
    return np.ascontiguousarray(out.view("<u8").T)


def _flags(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits.T).view(np.uint8), axis=1, count=n, bitorder="little").astype(bool)


def _below(ends: np.ndarray, words: int) -> np.ndarray:
    """Words whose bits under ``ends`` are set."""
    left = np.clip(ends - 64 * np.arange(words)[:, None], 0, 64)
    return np.where(left == 64, _ALL, (_ONE << np.minimum(left, 63).astype(np.uint64)) - _ONE)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of numbers of several words."""
    out, carry = a + b, None
    for w in range(len(a)):
        over = out[w] < a[w]
        if carry is not None:
            out[w] += carry
            over |= out[w] < carry
        carry = over.astype(np.uint64)
    return out


def _shifted(a: np.ndarray) -> np.ndarray:
    out = a << _ONE
    out[1:] |= a[:-1] >> np.uint64(63)
    return out


def _grouped(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of like size together, so that no long text widens many short ones."""
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        to = min(at + _PAIRS, len(order))
        while to - at > 1 and (to - at) * sizes[order[to - 1]] > _CELLS:
            to = at + (to - at) // 2
        yield order[at:to]
        at = to


def aligned(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every pair the edit distance, the length of the longest common subsequence, and Jaro-Winkler."""
    sizes = np.array([(len(a), len(b)) for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    edits, common = sizes.max(axis=1, initial=0), np.zeros(len(sizes), np.int64)
    jw = np.zeros(len(sizes))
    same = np.array([a == b for a, b in zip(left, right, strict=True)], bool)
    edits[same], common[same], jw[same] = 0, sizes[same, 0], 1.0
    other = np.flatnonzero(~same & (sizes.min(axis=1) > 0))
    for group in _grouped(sizes[other].max(axis=1)):
        own = other[group]
        a, b = (_matrix([x[i] for i in own.tolist()]) for x in (left, right))
        edits[own], common[own], jw[own] = _aligned(a, b, sizes[own, 0], sizes[own, 1])
    return edits, common, jw


def _aligned(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of different texts, none of them empty. ``b`` lies in the bits, ``a`` is passed over."""
    words, rows = (b.shape[1] + 63) // 64, np.arange(len(b))
    inside = np.arange(b.shape[1]) < m[:, None]
    full = _bits(inside, words)
    last, bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    up, down, edits = np.full_like(full, _ALL), np.zeros_like(full), m.copy()
    uncommon, unmatched = full.copy(), full.copy()
    reach, matched = np.maximum(n, m) // 2 - 1, np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        on = i < n
        equal = _bits((b == a[:, i : i + 1]) & inside & on[:, None], words)
        # Myers: steps of the table's columns
        across = (_plus(equal & up, up) ^ up) | equal | down
        rise, fall = down | ~(across | up), across & up
        steps = (rise[last, rows] >> bit & _ONE).astype(np.int64) - (fall[last, rows] >> bit & _ONE).astype(np.int64)
        edits += np.where(on, steps, 0)
        rise, fall = _shifted(rise), _shifted(fall)
        rise[0] |= _ONE
        up, down = fall | ~(across | rise), rise & across
        hit = uncommon & equal
        uncommon = (_plus(uncommon, hit) | (uncommon & ~hit)) & full
        # Jaro: the first free equal character within reach
        free = equal & unmatched & _below(i + reach + 1, words) & ~_below(i - reach, words)
        for w in range(words):
            first = free[w] & (~free[w] + _ONE)
            if w:
                first[matched[:, i]] = 0
            unmatched[w] &= ~first
            matched[:, i] |= first > 0
    common = m - np.bitwise_count(uncommon).sum(axis=0).astype(np.int64)
    many = matched.sum(axis=1)
    moved = a[matched] != b[_flags(full & ~unmatched, b.shape[1])]
    swaps = np.bincount(np.repeat(rows, many), moved, minlength=len(rows)).astype(np.int64) // 2
    k = np.maximum(many, 1)
    jaro = np.where(many > 0, (many / n + many / m + (many - swaps) / k) / 3.0, 0.0)
    width = min(4, a.shape[1], b.shape[1])
    ahead = (a[:, :width] == b[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
    prefix = np.logical_and.accumulate(ahead, axis=1).sum(axis=1)
    return edits, common, np.where((jaro < 0.7) | (jaro == 1.0), jaro, jaro + prefix * 0.1 * (1.0 - jaro))


# -- sets -----------------------------------------------------------------------------------------


def _grams(text: str, n: int) -> frozenset[str]:
    if len(text) < n:
        return frozenset([text] if text else [])
    return frozenset([text[i : i + n] for i in range(len(text) - n + 1)])


def _name(text: str) -> tuple:
    """Of a normalised name: tokens, acronyms, n-grams of 3 and 4, its words in order, long words."""
    words = text.split()
    tokens = frozenset(rules.name_tokens(rules.again(words)))
    acronyms = frozenset([t for t in tokens if t.startswith("n_acr_")])
    return tokens, acronyms, _grams(text, 3), _grams(text, 4), " ".join(sorted(words)), [w for w in words if len(w) >= 4]


def _address(text: str) -> tuple:
    """Of a standardised address: tokens, words, numbers, shingles, long words."""
    words = text.split()
    tokens = frozenset(rules.address_tokens(rules.again(words)))
    return tokens, *(frozenset([t for t in tokens if t.startswith(x)]) for x in ("w_", "num_", "sh_")), [w for w in words if len(w) >= 4]


def _jaccard(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where((n == 0) | (m == 0), 0.0, shared / np.maximum(n + m - shared, 1))


def _containment(shared: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    least = np.minimum(n, m)
    return np.where(least == 0, 0.0, shared / np.maximum(least, 1))


def _edit_similarity(edits: np.ndarray, longer: np.ndarray) -> np.ndarray:
    return np.where(longer == 0, 1.0, 1.0 - edits / np.maximum(longer, 1))


#: What :func:`compared` gives, in this order.
COMPARED = (
    "name_jaccard", "name_containment", "name_ngram_jaccard_3", "name_ngram_jaccard_4", "name_edit_sim", "name_token_sort_sim",
    "name_jaro_winkler", "name_lcs_ratio", "name_acronym_match", "addr_jaccard", "addr_containment", "addr_word_jaccard",
    "addr_word_containment", "addr_edit_sim", "addr_jaro_winkler", "addr_house_num_match", "addr_house_num_conflict",
    "addr_house_num_overlap_count", "addr_shingle_overlap_count", "name_in_addr_cross_match", "addr_in_name_cross_match",
    "shared_tokens_total_count",
)


def compared(n1: list[str], n2: list[str], a1: list[str], a2: list[str]) -> np.ndarray:
    """The features ``COMPARED`` of pairs of normalised names and standardised addresses, a row each."""
    parts = [_compared(*(x[at : at + _PAIRS] for x in (n1, n2, a1, a2))) for at in range(0, len(n1), _PAIRS)]
    return np.concatenate([np.zeros((len(COMPARED), 0)), *parts], axis=1)


def _compared(n1: list[str], n2: list[str], a1: list[str], a2: list[str]) -> np.ndarray:
    names, addresses = {t: _name(t) for t in {*n1, *n2}}, {t: _address(t) for t in {*a1, *a2}}
    counts, sorted1, sorted2 = [], [], []
    for p, q, r, s in zip(n1, n2, a1, a2, strict=True):
        t1, c1, g1, h1, o1, l1 = names[p]
        t2, c2, g2, h2, o2, l2 = names[q]
        u1, w1, d1, s1, k1 = addresses[r]
        u2, w2, d2, s2, k2 = addresses[s]
        sorted1.append(o1)
        sorted2.append(o2)
        counts.append(
            (
                len(t1 & t2), len(t1), len(t2), len(g1 & g2), len(g1), len(g2), len(h1 & h2), len(h1), len(h2), not c1.isdisjoint(c2),
                len(u1 & u2), len(u1), len(u2), len(w1 & w2), len(w1), len(w2), len(d1 & d2), len(d1), len(d2), len(s1 & s2),
                any(w in s for w in l1), any(w in q for w in k1), len(p), len(q), len(r), len(s),
            )
        )
    x = np.array(counts, np.int64).T
    names3, grams3, grams4, address3, words3, (numbers, left, right) = x[0:3], x[3:6], x[6:9], x[10:13], x[13:16], x[16:19]
    p, q, r, s = x[22:26]
    edits, common, jw = aligned(n1, n2)
    sizes = [np.array([len(t) for t in side], np.int64) for side in (sorted1, sorted2)]
    order = aligned(sorted1, sorted2)[0]
    a_edits, _, a_jw = aligned(a1, a2)
    both = (r > 0) & (s > 0)
    return np.stack(
        [
            _jaccard(*names3), _containment(*names3), _jaccard(*grams3), _jaccard(*grams4),
            _edit_similarity(edits, np.maximum(p, q)), _edit_similarity(order, np.maximum(*sizes)),
            jw, np.where((p > 0) & (q > 0), 2.0 * common / np.maximum(p + q, 1), 0.0), x[9],
            _jaccard(*address3), _containment(*address3), _jaccard(*words3), _containment(*words3),
            np.where(both, _edit_similarity(a_edits, np.maximum(r, s)), 0.0), np.where(both, a_jw, 0.0),
            np.where((left == 0) & (right == 0), 0.5, numbers > 0), (left > 0) & (right > 0) & (numbers == 0), numbers,
            x[19], x[20], x[21], x[0] + x[10],
        ]
    ).astype(np.float64)
