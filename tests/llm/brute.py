"""Plain statements of what each operator returns, one row at a time; the tests hold the operators against them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import xxhash

ASCII_SPACE = "\x20\x09-\x0D"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text: str | None) -> dict:
    text = text or ""
    words = re.findall(f"[^{ASCII_SPACE}]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(f"[^{ASCII_SPACE}]", line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup,
        "n_repeat_words": len(inside),
        "base_failed": len(words) < 50 or 100 * len(inside) > 50 * len(words),
    }


def ngram_share(text: str, n: int) -> float:
    """Share of the words' bytes that lie in n-grams occurring twice or more."""
    words = re.findall(f"[^{ASCII_SPACE}]+", text)
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    inside = set()
    for i in range(len(words) - n + 1):
        if grams[tuple(words[i : i + n])] > 1:
            inside |= set(range(i, i + n))
    total = sum(len(w.encode()) for w in words)
    return sum(len(words[i].encode()) for i in inside) / max(1, total)


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None) -> int:
    words = re.findall(f"[^{ASCII_SPACE}]+", lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows: list[tuple[int, int]], bits: int = 2) -> dict[int, int]:
    """Smallest id reachable of every ``(id, fingerprint)``."""
    top = list(range(len(rows)))

    def find(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= bits:
                top[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc), doc)
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def contamination(text: str | None, items: list[tuple[int, str | None]]) -> dict:
    words = bench_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        own = bench_words(item_text)
        if not own:
            continue
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(item))
    return {
        "n_words": len(words),
        "n_hit": len(hit),
        "n_items": len(found),
        "items_sha256": sha(",".join(sorted(found))),
        "contaminated": len(hit) > 0 and 20 * len(hit) >= len(words),
    }


def judge(url: str | None) -> dict:
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return {"host": host, "path": path, "rule": best[1], "verdict": best[2] or "allow"}


def graph_components(edges: list[tuple]) -> dict:
    around: dict = {}
    for a, b in edges:
        around.setdefault(a, set()).add(b)
        around.setdefault(b, set()).add(a)
    out: dict = {}
    for start in sorted(around):
        if start in out:
            continue
        todo = [start]
        while todo:
            n = todo.pop()
            if n not in out:
                out[n] = start
                todo += around[n]
    return out


def span_runs(words: list[list[str]], min_sentences: int, min_words: int) -> set[tuple[int, int]]:
    """Sentence runs (start, end) that count as spans: the shortest from each sentence and up to each one."""
    n, runs = len(words), set()

    def enough(a: int, b: int) -> bool:
        return b - a >= min_sentences and sum(len(w) for w in words[a:b]) >= min_words

    for i in range(n):
        runs.add(next(((i, e) for e in range(i, n + 1) if enough(i, e)), None))
        runs.add(next(((s, i + 1) for s in range(i, -1, -1) if enough(s, i + 1)), None))
    return {r for r in runs if r}


def without_repeats(docs: list[tuple[int, str | None]], split, min_sentences: int = 2, min_words: int = 20) -> dict[int, str | None]:
    """Texts without the sentences inside any span that an earlier place (by id, then sentence) holds."""
    first: dict[tuple[str, ...], tuple[int, int, int]] = {}
    pieces = {i: split(t) if t else [] for i, t in docs}
    spans = {}
    for i, _ in sorted(docs, key=lambda d: d[0]):
        words = [p.split() for p in pieces[i]]
        for a, b in sorted(span_runs(words, min_sentences, min_words)):
            # what is compared is the words of each sentence that has any
            key = tuple(" ".join(w) for w in words[a:b] if w)
            place = (i, a, b - a)
            spans[place] = key
            first[key] = min(first.get(key, place), place)
    gone: dict[int, set[int]] = {}
    for (i, a, n), key in spans.items():
        if first[key] != (i, a, n):
            gone.setdefault(i, set()).update(range(a, a + n))
    return {i: t if i not in gone else "".join(p for k, p in enumerate(pieces[i]) if k not in gone[i]) for i, t in docs}


def ftrl(rows: list, p) -> tuple[float, dict[int, float]]:
    """FTRL-proximal, one coordinate at a time: bias and the weights that are not zero."""
    seen = Counter(f for features, _ in rows for f in features.tolist())
    use = {f for f, n in seen.items() if p.min_rows <= n <= max(p.min_rows, p.max_share * len(rows))}
    z, n = {f: 0.0 for f in use}, {f: 0.0 for f in use}
    zb = nb = 0.0

    def weight(f: int) -> float:
        if abs(z[f]) <= p.l1:
            return 0.0
        sign = 1.0 if z[f] > 0 else -1.0
        return (sign * p.l1 - z[f]) / ((p.beta + math.sqrt(n[f])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for features, label in rows:
            own = [f for f in features.tolist() if f in use]
            w = {f: weight(f) for f in own}
            wb = -zb / ((p.beta + math.sqrt(nb)) / p.alpha)
            g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - label
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / p.alpha * w[f]
                n[f] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / p.alpha * wb
            nb += g * g
    return -zb / ((p.beta + math.sqrt(nb)) / p.alpha), {f: weight(f) for f in use if weight(f)}


def grams(text: str | None) -> set:
    """Five-word shingles; a shorter text is one, a text without words has none."""
    w = re.findall(f"[^{ASCII_SPACE}]+", lower(text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows: list) -> set:
    """Smallest id of each group over links at 2 bits or Jaccard 0.8, all pairs compared."""
    prints, sets = [fingerprint(t) for _, t in rows], [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            if near or (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[find(i)][0] for i in range(len(rows))}
