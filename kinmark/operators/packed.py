"""Candidates by shared tokens from packed postings.

A row for every token of every record costs a shuffle several times the texts, and a row for every pair of every token
many times the pairs. Here a task turns stretches of records into small inverted indexes, sorted and compressed, one for
each bucket of tokens. A bucket counts its tokens over all targets and passes on only postings that can give pairs, by
blocks of records. A cell, one block of records by one of targets, then holds all that decides its pairs, and puts each
out once: as pairs, as a line of a record, or as the first of a ranking. Blocks are dealt by id, so that a record that
comes several times, or takes part in several passes, stays in one block.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmark.functions import records as rules
from kinmark.functions.fixed_values import NULL_WORDS, STREET_ABBREVIATIONS, UNKNOWN_COUNTRY
from kinmark.params import LinkParams
from kinmark.workers import let_workers_import

#: Records of a stretch (two bytes number them), and the tokens after which it ends.
_RECORDS, _TOKENS = 8192, 4_000_000
#: Repeated pairs, or cells of a block of records by targets, at a time.
_CELLS = 1 << 19
#: A token by which over this share of the pairs of a part meet is multiplied out, up to so many cells of tokens by targets.
_DENSE, _MATRIX = 0.003, 1 << 23
#: Single precision adds whole numbers exactly up to here.
_EXACT = 1 << 24
_MIX = np.random.default_rng(7).integers(1, 1 << 32, 256, dtype=np.uint32)
#: Between a token and its part.
_SEP = "\x1f"
_PREFIX = (("n_", "name"), ("num_", "num"), ("sh_", "shingle"), ("ng_", "ngram"))


@dataclass(frozen=True)
class Want:
    """What cells put out: ``pairs``; ``lines`` (``s1_id, ids``, sorted and joined by commas, one for every record, also
    without candidates, from what the cells of a block of records hold of them; not where records take part in several passes); the first ``n`` of a ranking by ``overlap`` (two for
    each shared name token, one for each of the address, above their caps as well) or by ``counter`` (tokens under their
    caps, as often as the record holds them if ``repeated``)."""

    form: str = "pairs"
    n: int = 0
    repeated: bool = False

    @property
    def schema(self) -> pa.Schema:
        last = {"pairs": ("cand_id", pa.string()), "lines": ("ids", pa.string())}
        if self.form in last:
            return pa.schema([("s1_id", pa.string()), last[self.form]])
        weight = pa.int32() if self.form == "overlap" else pa.int64()
        return pa.schema([("s1_id", pa.string()), ("cand_id", pa.string()), ("weight", weight)])

    @property
    def ddl(self) -> str:
        kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
        return ", ".join(f"{f.name} {kinds[f.type]}" for f in self.schema)


def _sums(tokens: pa.Array) -> np.ndarray:
    """A number for every token, none of them empty, that is the sum of what its bytes give."""
    if not len(tokens):
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2], np.uint8)
    return np.add.reduceat(_MIX[data[: offsets[-1]]], offsets[:-1], dtype=np.uint32)


def _of_sums(sums: np.ndarray, buckets: int) -> np.ndarray:
    return (((sums * np.uint32(2654435761)).astype(np.uint64) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


def _bucket(tokens: pa.Array, buckets: int) -> np.ndarray:
    """The same for equal tokens everywhere; none is empty."""
    return _of_sums(_sums(tokens), buckets)



def _pack(*arrays: np.ndarray) -> bytes:
    raw = np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(x.tobytes() for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _unpack(blob: bytes, *types) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for n, kind in zip(sizes, types):
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _planes(x: np.ndarray) -> np.ndarray:
    """Steps from number to number, their lowest bytes first, then the next: within a token they are small."""
    return np.ascontiguousarray(np.diff(x.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T).ravel()


def _from_planes(x: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32).astype(np.int32)


def _strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def _taken(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and bytes of strings."""
    values = pa.concat_arrays([values])
    offsets = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    return np.diff(offsets), data[: offsets[-1]]


# -- stretches ------------------------------------------------------------------------------------

#: Of an index: blocks of records, lengths of tokens, their counts, records, times, bytes of tokens.
_INDEX = (np.uint16, np.int32, np.int32, np.uint16, np.int32, np.uint8)
_STRETCH = pa.schema([("side", pa.string()), ("bucket", pa.int32()), ("stretch", pa.int64()), ("index", pa.binary())])


@dataclass
class _Held:
    """Occurrences of tokens: the record and the code of each, and the tokens of codes."""

    records: np.ndarray
    codes: np.ndarray
    tokens: pa.Array

    def named(self, codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        return self.tokens.take(pa.array(codes)), _sums(self.tokens)[codes]


@dataclass
class _Shingled(_Held):
    """Codes are pairs ``a * len(tokens) + b`` of kept words."""

    def named(self, codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        a, b = np.divmod(codes, len(self.tokens))
        sums = _sums(self.tokens)
        first = pc.binary_join_element_wise("sh", self.tokens, "_")
        joined = pc.binary_join_element_wise(first.take(pa.array(a)), self.tokens.take(pa.array(b)), "_")
        return joined, sums[a] + sums[b] + _sums(pa.array(["sh__"]))[0]


def _stretch(side: str, number: int, parts: pa.Array, ids: pa.Array, held: list[_Held], buckets: int, blocks: int, repeated: bool) -> Iterator[pa.RecordBatch]:
    """The indexes of records: a row for every bucket, and a last one with ids and parts."""
    coded = parts.dictionary_encode()
    # by part, so that the records of a token come part by part
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids, parts, part = ids.take(pa.array(order)), parts.take(pa.array(order)), coded.indices.to_numpy()[order]
    part_sums = _sums(pc.binary_join_element_wise("", coded.dictionary, _SEP))
    block = _bucket(pc.binary_join_element_wise("#", ids, ""), blocks).astype(np.uint16)
    tokens, sums, counts, records, times = [], [], [], [], []
    for own in held:
        if not len(own.codes):
            continue
        codes, known = own.codes.astype(np.int64), None
        if codes.max() >> 46:
            known, codes = np.unique(codes, return_inverse=True)
        keys = codes << 16 | place[own.records]
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        times.append(np.diff(np.append(first, len(keys))).astype(np.int32))
        keys = keys[first]
        code, record = keys >> 16, (keys & 0xFFFF).astype(np.uint16)
        of = part[record]
        start = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (of[1:] != of[:-1])]))
        counts.append(np.diff(np.append(start, len(code))).astype(np.int32))
        records.append(record)
        code, of = code[start], of[start]
        named, summed = own.named(code if known is None else known[code])
        tokens.append(pc.binary_join_element_wise(named, coded.dictionary.take(pa.array(of)), _SEP))
        sums.append(summed + part_sums[of])
    blobs = [_pack(block, *(np.zeros(0, t) for t in _INDEX[1:]))] * buckets
    if tokens:
        tokens, sums, counts, records, times = pa.concat_arrays(tokens), *map(np.concatenate, (sums, counts, records, times))
        bucket = _of_sums(sums, buckets)
        order = np.argsort(bucket, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        bounds, tokens, counts = np.searchsorted(bucket[order], np.arange(buckets + 1)), tokens.take(pa.array(order)), counts[order]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])
        records, times = records[at], times[at]
        for b in range(buckets):
            lo, hi = bounds[b], bounds[b + 1]
            if lo == hi:
                continue
            size, data = _taken(tokens.slice(lo, hi - lo))
            own = slice(ends[lo], ends[hi])
            blobs[b] = _pack(block, size, counts[lo:hi], records[own], times[own] if repeated else times[:0], data)
    blobs.append(_pack(block, *_taken(ids), *_taken(parts)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([side] * len(blobs)), pa.array(range(len(blobs)), pa.int32()), pa.array([number] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())],
        schema=_STRETCH,
    )


class _Lists:
    """A stretch of records ``(part, id, tokens)``."""

    def __init__(self):
        self.batches, self.rows, self.size = [], 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch.select(["part", "id", "tokens"]))
        self.rows += batch.num_rows
        self.size += len(batch.column("tokens").flatten())

    def ended(self) -> tuple[pa.Array, pa.Array, list[_Held]]:
        table = pa.Table.from_batches(self.batches)
        parts, ids, lists = (table[x].combine_chunks() for x in ("part", "id", "tokens"))
        coded = lists.flatten().dictionary_encode()
        records = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return parts, ids, [_Held(records, coded.indices.to_numpy(), coded.dictionary)]


def _within(words: pa.Array, some: Iterable[str]) -> np.ndarray:
    return pc.is_in(words, value_set=pa.array(list(some), pa.string())).to_numpy(zero_copy_only=False)


class _Texts:
    """A stretch of raw records, with the rules of ``blocking.with_part`` and ``token_rows``. Words are numbers, tokens are
    made of distinct words and pairs of words only, by what ``records`` says of single ones."""

    def __init__(self, params: LinkParams, kinds: tuple[str, ...] | None, has_unknown: bool):
        kinds = kinds or ("name", "word", "num", "shingle", "ngram")
        self.params, self.both = params, has_unknown and params.partitioning == "country"
        self.named, self.grams, self.placed = "name" in kinds, params.use_ngrams and "ngram" in kinds, {"word", "num", "shingle"} & set(kinds)
        self.raw = params.address_form != "standardized"
        self.countries = {}
        self.parts, self.ids, self.rows, self.size = [], [], 0, 0
        self.names, self.places = [], []

    def add(self, batch: pa.RecordBatch) -> None:
        named, placed = [], []
        for entity, name, address, country in zip(*(batch.column(x).to_pylist() for x in ("entity_id", "business_name", "business_address", "country"))):
            if (c := self.countries.get(country)) is None:
                c = self.countries[country] = " ".join(rules.normal_words(country)).upper() or UNKNOWN_COUNTRY
            if self.params.partitioning == "none":
                c = "ALL"
            elif self.params.partitioning == "fixed" and c not in self.params.countries:
                continue
            parts = {c, UNKNOWN_COUNTRY} if self.both else (c,)
            own = rules.normal_text(name) if self.named or self.grams else ""
            place = rules.normal_text(address) if self.placed else ""
            # one word may stand for none
            if not self.raw and own in NULL_WORDS:
                own = ""
            if not self.raw and STREET_ABBREVIATIONS.get(place, place) in NULL_WORDS:
                place = ""
            self.parts += parts
            self.ids += [entity] * len(parts)
            named += [own or None] * len(parts)
            placed += [place or None] * len(parts)
            self.rows += len(parts)
            self.size += len(parts) * (len(name or "") if self.grams else 0)
        for held, texts, weight in ((self.names, named, 1), (self.places, placed, 2)):
            held.append(pc.ascii_split_whitespace(pa.array(texts, pa.string())))
            self.size += weight * len(held[-1].flatten())

    def ended(self) -> tuple[pa.Array, pa.Array, list[_Held]]:
        lists = [pa.concat_arrays(x or [pa.array([], pa.list_(pa.string()))]) for x in (self.names, self.places)]
        flat = [x.flatten() for x in lists]
        coded = pa.concat_arrays(flat).dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        names, places = codes[: len(flat[0])], codes[len(flat[0]) :]
        ends = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False))]) for x in lists]
        held = (self._of_names(words.to_pylist(), names, ends[0]) if self.named or self.grams else []) + (self._of_places(words, places, ends[1]) if self.placed else [])
        return pa.array(self.parts, pa.string()), pa.array(self.ids, pa.string()), held

    def _of_names(self, words: list[str], codes: np.ndarray, ends: np.ndarray) -> list[_Held]:
        records, out, some, alone = np.repeat(np.arange(self.rows), np.diff(ends)), [], [], []
        # a word of letters stays as it is
        used, codes = np.unique(codes, return_inverse=True)
        coded = pa.array([w if self.raw or w.isalpha() else rules.again([w, ""])[0] for w in (words[c] for c in used.tolist())], pa.string()).dictionary_encode()
        codes, forms = coded.indices.to_numpy()[codes], coded.dictionary.to_pylist()
        if self.named:
            size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)
            taken = ((size >= 2) & ~_within(coded.dictionary, rules.LEGAL_STOPWORDS))[codes]
            out.append(_Held(records[taken], codes[taken], pc.binary_join_element_wise("n", coded.dictionary, "_")))
            without = np.diff(ends) > 0
            without[records[taken]] = False
            # acronyms are of all the short words of a name, and one without tokens has its longest word
            short = (size <= 2)[codes] & (np.diff(ends) >= 2)[records]
            letters, (own, at) = [forms[c] for c in codes[short].tolist()], np.unique(records[short], return_index=True)
            for r, lo, hi in zip(own.tolist(), at.tolist(), [*at[1:].tolist(), len(letters)]):
                acronym = "".join(letters[lo:hi])
                if len(acronym) >= 2 and acronym not in rules.LEGAL_STOPWORDS:
                    some.append(r)
                    alone.append("n_acr_" + acronym)
                    without[r] = False
            for r in np.flatnonzero(without).tolist():
                some.append(r)
                alone.append("n_" + max((forms[c] for c in codes[ends[r] : ends[r + 1]].tolist()), key=len))
        if self.grams:
            n, bare = self.params.ngram_size, []
            listed = codes.tolist()
            for lo, hi in itertools.pairwise(ends.tolist()):
                bare.append("".join([forms[c] for c in listed[lo:hi]]))
            size = np.array([len(x) for x in bare], np.int64)
            for r in np.flatnonzero((size > 0) & (size < n)).tolist():
                some.append(r)
                alone.append("ng_" + bare[r])
            data, many = np.frombuffer("".join(bare).encode(), np.uint8), np.maximum(size - n + 1, 0)
            at = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(many.sum())
            grams = np.empty((len(at), n), np.uint8)
            for k in range(n):
                grams[:, k] = data[at + k]
            coded = _strings(np.full(len(at), n, np.int32), grams.ravel()).dictionary_encode()
            tokens = pc.binary_join_element_wise("ng", coded.dictionary, "_")
            out.append(_Held(np.repeat(np.arange(self.rows), many), coded.indices.to_numpy(), tokens))
        coded = pa.array(alone, pa.string()).dictionary_encode()
        return [*out, _Held(np.array(some, np.int64), coded.indices.to_numpy(), coded.dictionary)]

    def _of_places(self, listed: pa.Array, codes: np.ndarray, ends: np.ndarray) -> list[_Held]:
        # most words are of letters and stand for themselves
        words = listed.to_pylist()
        plain = pc.utf8_is_alpha(listed).to_numpy(zero_copy_only=False)
        if not self.raw:
            plain &= ~_within(listed, STREET_ABBREVIATIONS)
        itself = plain & (pc.binary_length(listed).to_numpy(zero_copy_only=False) >= 3) & ~_within(listed, rules.ADDR_STOPWORDS)
        places, found = np.flatnonzero(itself).tolist(), []
        for i in np.flatnonzero(~plain).tolist():
            # an abbreviation may stand for several words
            full = [words[i]] if self.raw else rules.again([*STREET_ABBREVIATIONS.get(words[i], words[i]).split(" "), ""])[:-1]
            for token in [t for x in full for t in rules.address_tokens([x])]:
                places.append(i)
                found.append(token.split("_")[1])
        coded = pa.concat_arrays([listed.filter(pa.array(itself)), pa.array(found, pa.string())]).dictionary_encode()
        # shingles that follow each other begin alike, and so take fewer bytes
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        kept, many = coded.dictionary.take(pa.array(order)), np.bincount(np.array(places, np.int64), minlength=len(words))
        items = place[coded.indices.to_numpy()][np.argsort(places, kind="stable")]
        number = pc.utf8_is_digit(kept)
        tokens = pc.binary_join_element_wise(pc.if_else(number, "num", "w"), kept, "_")
        kinds = np.where(number.to_numpy(zero_copy_only=False), "num" in self.placed, "word" in self.placed)
        records = np.repeat(np.arange(self.rows), np.diff(ends))
        fan = many[codes]
        at = np.repeat((np.cumsum(many) - many)[codes] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
        codes, records = items[at], np.repeat(records, fan)
        taken = kinds[codes]
        out = [_Held(records[taken], codes[taken], tokens)]
        if "shingle" in self.placed:
            same = records[1:] == records[:-1]
            pairs = (codes[:-1] * len(kept) + codes[1:])[same]
            out.append(_Shingled(records[1:][same], pairs, kept))
        return out


def token_batches(params: LinkParams, kinds: tuple[str, ...] | None, has_unknown: bool):
    """What :func:`pack` reads stretches of raw records with; neither texts nor tokens of records leave the task."""
    return lambda: _Texts(params, kinds, has_unknown)


def pack(records: DataFrame, side: str, buckets: int, blocks: int, repeated: bool = False, tokenised=_Lists) -> DataFrame:
    """Indexes of records ``(part, id, tokens)``, or of raw ones that ``tokenised`` reads."""
    let_workers_import(records.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, tokenised()

        def ended() -> Iterator[pa.RecordBatch]:
            if held.rows:
                parts, ids, tokens = held.ended()
                # a record without its id can be no candidate, but it counts
                yield from _stretch(side, number, parts, pc.fill_null(ids, ""), tokens, buckets, blocks, repeated)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                held.add(batch.slice(start, 256))
                if held.rows + 512 > _RECORDS or held.size >= _TOKENS:
                    yield from ended()
                    held, number = tokenised(), number + 1
                    pa.default_memory_pool().release_unused()
        yield from ended()

    return records.mapInArrow(run, "side string, bucket int, stretch long, index binary")


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal keys, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if held and held[-1].column(key)[0].as_py() != values[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


# -- buckets --------------------------------------------------------------------------------------

_POSTINGS = pa.schema([("cell", pa.int32()), ("side", pa.string()), ("bucket", pa.int32()), ("index", pa.binary())])
_CAND, _NAME, _ADDRESS = 1, 2, 4


def _limits(tokens: pa.Array, caps: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Caps of tokens, and which of ``_NAME`` and ``_ADDRESS`` they are."""
    out, kind = np.full(len(tokens), caps["word"], np.int64), np.full(len(tokens), _ADDRESS, np.uint8)
    for start, name in _PREFIX:
        own = pc.starts_with(tokens, start).to_numpy(zero_copy_only=False)
        out[own] = caps[name]
        kind[own] = {"name": _NAME, "ngram": 0}.get(name, _ADDRESS)
    return out, kind


def _read(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all stretches with their counts, records (numbered within their block) and times, and the block of every
    record. Every bucket sees the same stretches, so that all of them number alike."""
    blocks, tokens, counts, records, times, n = [], [], [], [], [], 0
    for blob in rows["index"].to_pylist():
        block, size, many, held, often, data = _unpack(blob, *_INDEX)
        blocks.append(block)
        tokens.append(_strings(size, data))
        counts.append(many)
        records.append(held.astype(np.int64) + n)
        times.append(often)
        n += len(block)
    if not blocks:
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(4))
    return pa.concat_arrays(tokens), *map(np.concatenate, (counts, records, times, blocks))


def _numbered(block: np.ndarray) -> np.ndarray:
    """The number of every record within its block."""
    order = np.argsort(block, kind="stable")
    out = np.empty(len(block), np.int64)
    start = np.searchsorted(block[order], block[order])
    out[order] = np.arange(len(block)) - start
    return out


#: Of postings: codes in planes, their counts, attributes, records in planes, times; fallbacks: records, codes, counts, lengths, bytes.
_HELD = (np.uint8, np.int32, np.uint8, np.uint8, np.int32, np.int32, np.int32, np.int32, np.int32, np.uint8)
_NO_FALLBACK = tuple(np.zeros(0, t) for t in _HELD[5:])


def _present(codes: np.ndarray, records: np.ndarray, block: np.ndarray, blocks: int, n: int) -> np.ndarray:
    """Whether a block of records holds a code."""
    out = np.zeros((blocks, n), bool)
    out[block[records], codes] = True
    return out


def _by_block(side: str, bucket: int, codes, records, times, block, number, attribute, fallbacks, there: np.ndarray, whole: set[int]) -> Iterator[tuple]:
    """Postings of every block, by code, for each block of the other side that holds a code, as ``there`` says; all of them
    go there from the blocks ``whole``. ``fallbacks`` by block."""
    order = np.lexsort((records, codes, block[records]))
    codes, records, times = codes[order], records[order], times[order] if len(times) else times
    of = block[records]
    for b in sorted({*np.unique(of).tolist(), *fallbacks}):
        lo, hi = np.searchsorted(of, [b, b + 1])
        own, counts = np.unique(codes[lo:hi], return_counts=True)
        held, often, fallback, every = number[records[lo:hi]], times[lo:hi], fallbacks.get(b, _NO_FALLBACK), None
        for other, known in enumerate(there[:, own]):
            if known.all() or b in whole:
                every = blob = every or _posted(own, counts, attribute, held, often, fallback)
            elif known.any() or b in fallbacks:
                taken = np.repeat(known, counts)
                blob = _posted(own[known], counts[known], attribute, held[taken], often[taken] if len(often) else often, fallback)
            else:
                continue
            yield side, b, other, bucket, blob


def _posted(own, counts, attribute, held, often, fallback) -> bytes:
    arrays = (_planes(own), counts, attribute[own], _planes(held), often, *fallback)
    return _pack(*(x.astype(t, copy=False) for x, t in zip(arrays, _HELD)))


def _counted(sides: dict[str, pa.Table]) -> tuple | None:
    """Tokens of a bucket, the codes, records, times and blocks of its postings, how many targets hold each token, and
    whether both sides do; nothing where one side has no token."""
    s_tokens, s_counts, s_records, s_times, s_block = _read(sides["s"])
    t_tokens, t_counts, t_records, _, t_block = _read(sides["t"])
    if not len(s_tokens) or not len(t_tokens):
        return None
    coded = pa.concat_arrays([t_tokens, s_tokens]).dictionary_encode()
    words, codes, n = coded.dictionary, coded.indices.to_numpy(), len(coded.dictionary)
    t_codes, s_codes = np.repeat(codes[: len(t_tokens)], t_counts), np.repeat(codes[len(t_tokens) :], s_counts)
    many = np.bincount(t_codes, minlength=n)
    shared = (many > 0) & (np.bincount(s_codes, minlength=n) > 0)
    return words, s_codes, s_records, s_times, s_block, t_codes, t_records, t_block, many, shared


def _sided(rows: pa.Table) -> dict[str, pa.Table]:
    return {side: rows.filter(pc.equal(rows["side"], side)).sort_by("stretch") for side in "st"}


def _settle(rows: pa.Table, buckets: int, params: LinkParams) -> Iterator[tuple[int, bytes]]:
    """Of every stretch of records, bits of those that have a usable token in this bucket, then of those that have a token
    in this bucket that targets hold."""
    sides = _sided(rows)
    if rows["bucket"][0].as_py() == buckets or (met := _counted(sides)) is None:
        return
    words, s_codes, s_records, _, s_block, _, _, _, many, shared = met
    usable = shared & (many <= _limits(words, params.caps())[0])
    settled, known, at = np.zeros(len(s_block), bool), np.zeros(len(s_block), bool), 0
    settled[s_records[usable[s_codes]]] = True
    known[s_records[shared[s_codes]]] = True
    for number, blob in zip(sides["s"]["stretch"].to_pylist(), sides["s"]["index"].to_pylist()):
        n = len(_unpack(blob, *_INDEX)[0])
        yield number, np.packbits(settled[at : at + n]).tobytes() + np.packbits(known[at : at + n]).tobytes()
        at += n


def _meet(rows: pa.Table, buckets: int, params: LinkParams, want: Want, s_blocks: int, t_blocks: int) -> Iterator[tuple]:
    """Postings of one bucket that can give pairs, by blocks, and by the block of the other side that they go to (none: all)."""
    bucket = rows["bucket"][0].as_py()
    sides = _sided(rows)
    if bucket == buckets:
        for side, own in sides.items():
            yield from _ids(side, bucket, own)
        return
    met = _counted(sides)
    if met is None:
        return
    words, s_codes, s_records, s_times, s_block, t_codes, t_records, t_block, many, shared = met
    n = len(words)
    limits, kind = _limits(words, params.caps())
    usable = shared & (many <= limits)
    passed = usable | (shared & (kind > 0)) if want.form == "overlap" else usable
    attribute = usable.astype(np.uint8) * _CAND | kind
    # a record without a usable token anywhere may fall back on its rarest token of this bucket
    fallen, fallbacks, s_number, done = np.zeros(n, bool), {}, _numbered(s_block), np.ones(len(s_block), bool)
    if params.fallback and want.form != "counter":
        known = shared[s_codes]
        records, own = s_records[known], s_codes[known]
        settled = np.zeros(len(s_block), bool)
        settled[records[usable[own]]] = True
        at = 0
        for blob, elsewhere in zip(sides["s"]["index"].to_pylist(), sides["s"]["settled"].to_pylist()):
            m = len(_unpack(blob, *_INDEX)[0])
            done[at : at + m] = elsewhere is not None and np.unpackbits(np.frombuffer(elsewhere, np.uint8), count=m).astype(bool)
            at += m
        settled |= done
        records, own = records[~settled[records]], own[~settled[records]]
        if len(records):
            ties, order = np.unique(own), np.empty(n, np.int64)
            # by bytes; what follows a token, its part, is the same for all of a record and lower than any letter
            order[ties[pc.array_sort_indices(words.take(pa.array(ties))).to_numpy()]] = np.arange(len(ties))
            by = np.lexsort((order[own], many[own], records))
            records, own = records[by], own[by]
            first = np.concatenate([[True], records[1:] != records[:-1]])
            records, own = records[first], own[first]
            fallen[own] = True
            for b in np.unique(s_block[records]).tolist():
                here = s_block[records] == b
                chosen = own[here]
                fallbacks[b] = (s_number[records[here]], chosen, many[chosen], *_taken(words.take(pa.array(chosen))))
    # where a record may fall back, its block is told of all candidates, those of other records of its id among them
    s_kept, t_kept, whole = passed[s_codes], (passed | fallen)[t_codes], set(np.unique(s_block[~done]).tolist())
    s_there = _present(s_codes[s_kept], s_records[s_kept], s_block, s_blocks, n)
    for b, (_, chosen, *_) in fallbacks.items():
        s_there[b, chosen] = True
    t_there = _present(t_codes[t_kept], t_records[t_kept], t_block, t_blocks, n)
    times = s_times[s_kept] if len(s_times) else s_times
    yield from _by_block("s", bucket, s_codes[s_kept], s_records[s_kept], times, s_block, s_number, attribute, fallbacks, t_there, whole)
    yield from _by_block("t", bucket, t_codes[t_kept], t_records[t_kept], s_times[:0], t_block, _numbered(t_block), attribute, {}, s_there, set())


def _ids(side: str, bucket: int, rows: pa.Table) -> Iterator[tuple]:
    blocks, ids, parts = [], [], []
    for blob in rows["index"].to_pylist():
        block, size, data, part_size, part_data = _unpack(blob, np.uint16, np.int32, np.uint8, np.int32, np.uint8)
        blocks.append(block)
        ids.append(_strings(size, data))
        parts.append(_strings(part_size, part_data))
    if not blocks:
        return
    block, ids, parts = np.concatenate(blocks), pa.concat_arrays(ids), pa.concat_arrays(parts)
    for b in np.unique(block).tolist():
        own = pa.array(np.flatnonzero(block == b))
        yield side, b, None, bucket, _pack(*_taken(ids.take(own)), *_taken(parts.take(own)))


# -- cells ----------------------------------------------------------------------------------------


def _pairs(s: np.ndarray, code: np.ndarray, starts: np.ndarray, many: np.ndarray, targets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Distinct ``record * n + target``; ``s`` ascends, so that a block of records is done when it is left."""
    fan = many[code]
    total = np.cumsum(fan)
    at = 0
    while at < len(s):
        first = int(s[at])
        before = total[at] - fan[at]
        to = max(int(np.searchsorted(total, before + _CELLS, "right")), at + 1)
        if to < len(s):  # whole records; one that alone is over the size is taken alone
            whole = int(np.searchsorted(s, s[to], "left"))
            to = whole if whole > at else int(np.searchsorted(s, first, "right"))
        f = fan[at:to]
        within = np.arange(f.sum()) - np.repeat(np.cumsum(f) - f, f)
        within += np.repeat(starts[code[at:to]], f)
        keys = np.repeat((s[at:to].astype(np.int64) - first) * n, f)
        keys += targets[within]
        cells = int(s[to - 1] - first + 1) * n
        if cells <= 8 * len(keys):
            flags = np.zeros(cells, bool)
            flags[keys] = True
            yield np.flatnonzero(flags) + first * n
        else:
            yield np.unique(keys) + first * n
        at = to


def _joined(found: Iterator[np.ndarray], cells: int) -> Iterator[np.ndarray]:
    """Ascending keys, put together until they reach over so many cells."""
    held: list[np.ndarray] = []
    for keys in found:
        if len(keys):
            held.append(keys)
            if keys[-1] - held[0][0] >= cells:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def _hits(s: np.ndarray, code: np.ndarray, starts: np.ndarray, many: np.ndarray, targets: np.ndarray, first: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """Cells ``(record - first) * n + target``, with repeats, some at a time, with the fan of the postings ``slice``."""
    fan = many[code]
    total = np.cumsum(fan)
    at = 0
    while at < len(s):
        to = max(int(np.searchsorted(total, total[at] - fan[at] + _CELLS, "right")), at + 1)
        f = fan[at:to]
        size = int(f.sum())
        if size:
            ends = np.cumsum(f)
            shift = np.repeat(starts[code[at:to]] - (ends - f), f)
            shift += np.arange(size)
            keys = np.repeat((s[at:to].astype(np.int64) - first) * n, f)
            keys += targets[shift]
            yield keys, f, slice(at, to)
        at = to


@dataclass
class _Side:
    ids: pa.Array  # sorted, distinct
    of: np.ndarray  # of every record, the number of its id
    part: pa.Array

    def by_part(self) -> _Side:
        """The same, ids numbered part by part where every record has its own."""
        if len(self.ids) < len(self.of):
            return self
        order = np.lexsort((self.of, self.part.dictionary_encode().indices.to_numpy()))
        of = np.empty(len(order), np.int32)
        of[order] = np.arange(len(order))
        return _Side(self.ids.take(pa.array(self.of[order])), of, self.part)


_NAMED = (np.int32, np.uint8, np.int32, np.uint8)


def _side(blob: bytes) -> _Side:
    size, data, part_size, part_data = _unpack(blob, *_NAMED)
    ids = _strings(size, data)
    order = pc.array_sort_indices(ids).to_numpy()
    ids = ids.take(pa.array(order))
    coded = ids.dictionary_encode()
    of = np.empty(len(order), np.int32)
    of[order] = coded.indices.to_numpy()
    return _Side(coded.dictionary, of, _strings(part_size, part_data))


#: Records of a chunk, whose lines are made at a time; and what a cell has of it. Where over this share of a chunk's pairs are
#: candidates, a bit for each pair takes fewer bytes than numbers.
_CHUNK, _FULL = 128, 0.25
_PARTIAL = pa.schema([("chunk", pa.int64()), ("cell", pa.int32()), ("index", pa.binary()), ("ids", pa.binary())])


def _partial(s_block: int, cell: int, i: np.ndarray, j: np.ndarray, t_ids: pa.Array) -> pa.RecordBatch:
    """Pairs of a cell, ascending, by chunks of records: how many each has, the numbers of targets or bits of all, and their ids."""
    chunks, starts = np.unique(i // _CHUNK, return_index=True)
    blobs = []
    for chunk, lo, hi in zip(chunks.tolist(), starts.tolist(), [*starts[1:].tolist(), len(i)]):
        used, number = np.unique(j[lo:hi], return_inverse=True)
        row, bits = i[lo:hi] - chunk * _CHUNK, np.zeros(0, np.uint8)
        if hi - lo >= _FULL * _CHUNK * len(used):
            flags = np.zeros((_CHUNK, len(used)), bool)
            flags[row, number] = True
            bits, number = np.packbits(flags), number[:0]
        counts = np.bincount(row, minlength=_CHUNK).astype(np.int32)
        blobs.append(_pack(counts, _planes(number), bits, *_taken(t_ids.take(pa.array(used)))))
    n = len(blobs)
    columns = [pa.array(chunks + (s_block << 32), pa.int64()), pa.array([cell] * n, pa.int32()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTIAL)


def _records_of(s_block: int, cell: int, s_ids: pa.Array, copies: np.ndarray) -> pa.RecordBatch:
    """The ids of all chunks of a block of records, and how often each comes."""
    blobs = [_pack(copies[lo : lo + _CHUNK].astype(np.int32), *_taken(s_ids.slice(lo, _CHUNK))) for lo in range(0, len(s_ids), _CHUNK)]
    n = len(blobs)
    columns = [pa.array(np.arange(n) + (s_block << 32), pa.int64()), pa.array([cell] * n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=_PARTIAL)


def _lines(rows: pa.Table, want: Want) -> Iterator[pa.RecordBatch]:
    """The lines of a chunk of records."""
    copies, size, data = _unpack(next(x for x in rows["ids"].to_pylist() if x is not None), np.int32, np.int32, np.uint8)
    s_ids, records, numbers, ids, n = _strings(size, data), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.string())], 0
    for blob in rows["index"].to_pylist():
        if blob is not None:
            counts, number, bits, size, data = _unpack(blob, np.int32, np.uint8, np.uint8, np.int32, np.uint8)
            records.append(np.repeat(np.arange(_CHUNK), counts))
            if len(bits):
                number = np.nonzero(np.unpackbits(bits, count=_CHUNK * len(size)).reshape(_CHUNK, -1))[1]
            else:
                number = _from_planes(number).astype(np.int64)
            numbers.append(number + n)
            ids.append(_strings(size, data))
            n += len(size)
    coded = pa.concat_arrays(ids).dictionary_encode()
    order, m = pc.array_sort_indices(coded.dictionary).to_numpy(), len(coded.dictionary)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    keys = np.concatenate(records) * m + place[coded.indices.to_numpy()][np.concatenate(numbers)]
    keys.sort()  # cells have no target in common
    i, j = np.divmod(keys, max(m, 1))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(s_ids) + 1)), pa.int32()), coded.dictionary.take(pa.array(order)).take(pa.array(j)))
    again = pa.array(np.repeat(np.arange(len(s_ids)), copies))
    s_ids, lines = s_ids.take(again), pc.binary_join(lists, ",").take(again)
    yield pa.RecordBatch.from_arrays([pc.if_else(pc.equal(s_ids, ""), None, s_ids), lines], schema=want.schema)


def _cell(
    s_rows: dict[int, bytes], t_rows: dict[int, bytes], buckets: int, params: LinkParams, want: Want, cell: int = 0, t_blocks: int = 1
) -> Iterator[pa.RecordBatch]:
    if buckets not in s_rows or (buckets not in t_rows and want.form != "lines"):
        return
    left, right = _side(s_rows.pop(buckets)), _side(t_rows.pop(buckets, _pack(*(np.zeros(0, t) for t in _NAMED))))
    if want.form != "pairs":
        left = left.by_part()
    if want.form == "lines":
        # records meet targets of their part, so that numbers of a chunk are near each other
        right = right.by_part()
    codes, records, times, attributes, fallen, settled, n = [], [], [], [], [], [], 0
    many, held = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for bucket in sorted(s_rows):
        own, counts, attribute, record, often, *fallback = _unpack(s_rows.pop(bucket), *_HELD)
        own, record, attribute = _from_planes(own), _from_planes(record), np.repeat(attribute, counts)
        at = np.full(len(own), -1, np.int32)
        settled.append(record[(attribute & _CAND) > 0])
        f_at = np.full(len(fallback[1]), -1, np.int32)
        if bucket in t_rows:
            known, t_counts, _, record_t, *_ = _unpack(t_rows.pop(bucket), *_HELD)
            known = _from_planes(known)
            many.append(t_counts)
            held.append(_from_planes(record_t))
            for asked, found in ((own, at), (fallback[1], f_at)):
                place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                same = known[place] == asked
                found[same] = place[same] + n
            n += len(known)
        if len(f_at):
            fallen.append(pa.table([fallback[0], f_at, fallback[2], _strings(*fallback[3:])], ["record", "code", "count", "token"]))
        code = np.repeat(at, counts)
        met = code >= 0
        codes.append(code[met])
        records.append(record[met])
        attributes.append(attribute[met])
        times.append(often[met] if len(often) else often)
    if not codes:
        codes, records, times, attributes = ([np.zeros(0, np.int64)] for _ in range(4))
    codes, records, times, attributes, many, held = (np.concatenate(x) for x in (codes, records, times, attributes, many, held))
    starts = (np.cumsum(many) - many).astype(np.int64)
    s_ids, t_ids, m = left.ids, right.ids, len(right.ids)
    nameless = [pc.index(ids, "").as_py() for ids in (s_ids, t_ids)]
    by_id = right.of[held]
    if want.form == "counter":
        weights = np.where((attributes & _NAME) > 0, 2, 1) * (times if want.repeated else 1)
        scores = _Scores(left.of[records], codes, weights, starts, many, by_id, left.of, right.of, left.part, right.part, m)
        for lo, hi, columns, weight in scores.spans(0, len(s_ids)):
            flags = weight > 0
            if lo <= nameless[0] < hi:
                flags[nameless[0] - lo] = False
            flags[:, columns == nameless[1]] = False
            yield from _first(weight, flags, s_ids.slice(lo, hi - lo), t_ids.take(pa.array(columns)), want)
        return
    gives = (attributes & _CAND) > 0
    f_records, f_codes = _rarest(fallen, left, settled)
    rows, row_codes = _ascending(
        np.concatenate([left.of[records[gives]], left.of[f_records]]), np.concatenate([codes[gives], f_codes])
    )
    same = pc.index_in(s_ids, value_set=t_ids).fill_null(-1).to_numpy() if params.exclude_self else None
    if want.form == "overlap":
        scores = (attributes & (_NAME | _ADDRESS)) > 0
        ranking = _Ranking(left, right, records[scores], codes[scores], attributes[scores], starts, many, held, want)
    if want.form == "lines" and cell % t_blocks == 0:
        yield _records_of(cell // t_blocks, cell, s_ids, np.bincount(left.of, minlength=len(s_ids)))
    found = _pairs(rows, row_codes, starts, many, by_id, m)
    # sums of many records at once cost less
    for keys in _joined(found, 4 * _CELLS) if want.form == "overlap" else found:
        i, j = np.divmod(keys, m)
        kept = (i != nameless[0]) & (j != nameless[1])
        if same is not None:
            kept &= same[i] != j
        i, j = i[kept], j[kept]
        if want.form == "pairs":
            for at in range(0, len(i), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([s_ids.take(pa.array(i[part])), t_ids.take(pa.array(j[part]))], schema=want.schema)
        elif want.form == "lines":
            if len(i):
                yield _partial(cell // t_blocks, cell, i, j, t_ids)
        elif len(i):
            yield from ranking.first(i, j)


class _Ranking:
    """Candidates of whole records by what they share; a record that comes several times is ranked as often."""

    def __init__(self, left: _Side, right: _Side, records, codes, attributes, starts, many, held, want: Want):
        self.s_order, self.t_order = (np.argsort(x.of, kind="stable") for x in (left, right))
        self.s_of, self.t_of = left.of[self.s_order], right.of[self.t_order]
        s_place, t_place = np.argsort(self.s_order), np.argsort(self.t_order)
        points = np.where((attributes & _NAME) > 0, 2, 1)
        self.scores = _Scores(s_place[records], codes, points, starts, many, t_place[held], s_place, t_place, left.part, right.part, len(t_place))
        self.want = want
        self.s_ids, self.t_ids, self.m = left.ids.take(pa.array(self.s_of)), right.ids.take(pa.array(self.t_of)), len(right.ids)

    def first(self, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        lowest, end = np.searchsorted(self.s_of, [i[0], i[-1] + 1])
        for lo, hi, columns, weight in self.scores.spans(lowest, end):
            ids = self.s_of[lo:hi]
            a, b = np.searchsorted(i, [ids[0], ids[-1] + 1])
            if a == b:
                continue
            flags = np.zeros((ids[-1] - ids[0] + 1, self.m), bool)
            flags[i[a:b] - ids[0], j[a:b]] = True
            flags = flags[ids - ids[0]][:, self.t_of[columns]]
            yield from _first(weight, flags, self.s_ids.slice(lo, hi - lo), self.t_ids.take(pa.array(columns)), self.want)


def _ascending(rows: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    # small numbers are sorted by radix
    order = np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")
    return [x[order] for x in (rows, *others)]


def _rarest(fallen: list[pa.Table], left: _Side, settled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records without any candidate in their part, and the codes of their rarest known tokens, where targets have them."""
    if not fallen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = left.part.dictionary_encode()
    key = left.of.astype(np.int64) * len(part.dictionary) + part.indices.to_numpy()
    has = np.zeros(int(key.max()) + 1, bool)
    has[key[np.concatenate(settled)]] = True
    table = pa.concat_tables(fallen)
    own = key[table["record"].to_numpy()]
    table = table.append_column("key", pa.array(own)).filter(pa.array(~has[own]))
    table = table.sort_by([("key", "ascending"), ("count", "ascending"), ("token", "ascending")])
    own, code = table["key"].to_numpy(), table["code"].to_numpy()
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    first &= code >= 0
    return table["record"].to_numpy()[first], code[first]


class _Scores:
    """Sums of weights over shared tokens, for ``rows`` of postings by targets: of each part for its own targets only, where no
    record is in several parts (rows are then numbered part by part). Tokens that very many pairs of their part share are
    multiplied out as matrices of small whole numbers, which is exact; all others are added one by one."""

    def __init__(self, rows, codes, weights, starts, many, targets, s_place, t_place, s_part: pa.Array, t_part: pa.Array, width: int):
        self.starts, self.many = starts, many
        parts = pa.concat_arrays([s_part, t_part]).dictionary_encode()
        part, n = parts.indices.to_numpy(), len(s_part)
        height = int(s_place.max()) + 1 if n else 0
        of_row, of_target, dense = np.zeros(height, np.int32), np.zeros(width, np.int32), np.zeros(len(many), bool)
        if len(np.unique(s_place)) == n and len(np.unique(t_place)) == len(t_place):
            of_row[s_place], of_target[t_place] = part[:n], part[n:]
        # of every part: its first row and the next, its targets, and what is multiplied out
        self.parts: list[tuple] = []
        place, of_code = np.zeros(width, np.int32), np.zeros(len(many), np.int32)
        cuts = [0, *(np.flatnonzero(np.diff(of_row)) + 1).tolist(), height]
        for p, lo, hi in zip(of_row[cuts[:-1]].tolist() if height else (), cuts, cuts[1:]):
            columns = np.flatnonzero(of_target == p)
            place[columns] = np.arange(len(columns))
            self.parts.append([lo, hi, columns, None])
        self.targets = place[targets]
        of_code[codes] = of_row[rows]
        # sums of a record stay below what single precision holds, or its postings are added one by one
        small = np.bincount(rows, weights, minlength=height) < _EXACT
        hits, rest = np.bincount(codes, minlength=len(many)) * many, np.ones(len(rows), bool)
        for held in self.parts:
            lo, hi, columns, _ = held
            if not len(columns):
                continue
            chosen = np.flatnonzero((of_code == of_row[lo]) & (hits > max(_DENSE * (hi - lo) * len(columns), 0)))
            if not len(chosen):
                continue
            chosen = np.sort(chosen[np.argsort(-hits[chosen], kind="stable")][: max(1, _MATRIX // len(columns))])
            matrix, fan = np.zeros((len(chosen), len(columns)), np.float32), many[chosen]
            at = np.repeat(starts[chosen] - (np.cumsum(fan) - fan), fan) + np.arange(fan.sum())
            matrix[np.repeat(np.arange(len(chosen)), fan), self.targets[at]] = 1
            dense[:] = False
            dense[chosen] = True
            own = dense[codes] & small[rows]
            rest &= ~own
            held[3] = (matrix, *_ascending(rows[own], np.searchsorted(chosen, codes[own]), weights[own]))
        self.rest = [_ascending(rows[x], codes[x], weights[x]) for x in (rest & (weights == 1), rest & (weights != 1))]

    def spans(self, lo: int, hi: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The rows from ``lo`` to ``hi`` some at a time, none of two parts, with their targets and the sums of all cells."""
        for first, last, columns, product in self.parts:
            step = max(1, _CELLS // max(len(columns), 1))
            for a in range(max(lo, first), min(hi, last) if len(columns) else 0, step):
                b = min(a + step, hi, last)
                yield a, b, columns, self._of(a, b, len(columns), product)

    def _of(self, lo: int, hi: int, width: int, product: tuple | None) -> np.ndarray:
        out = np.zeros((hi - lo) * width)
        for single, (rows, codes, weights) in zip((True, False), self.rest):
            a, b = np.searchsorted(rows, [lo, hi])
            w = weights[a:b]
            for keys, fan, at in _hits(rows[a:b], codes[a:b], self.starts, self.many, self.targets, lo, width):
                out += np.bincount(keys, None if single else np.repeat(w[at], fan), minlength=len(out))
        out = out.reshape(hi - lo, width)
        if product:
            matrix, rows, codes, weights = product
            a, b = np.searchsorted(rows, [lo, hi])
            if a < b:
                values = np.zeros((hi - lo, len(matrix)), np.float32)
                values[rows[a:b] - lo, codes[a:b]] = weights[a:b]
                out += values @ matrix
        return out


def _first(weight: np.ndarray, flags: np.ndarray, s_ids: pa.Array, t_ids: pa.Array, want: Want) -> Iterator[pa.RecordBatch]:
    """The first ``n`` of every row by weight, ties by id, which is the order of the columns."""
    some = np.flatnonzero(flags.any(axis=1))
    if len(some) < len(flags):
        weight, flags, s_ids = weight[some], flags[some], s_ids.take(pa.array(some))
    m = flags.shape[1]
    key = np.where(flags, weight * m + (m - 1 - np.arange(m)), -1.0)
    if m > want.n:
        j = np.argpartition(-key, want.n - 1, axis=1)[:, : want.n]
    else:
        j = np.broadcast_to(np.arange(m), key.shape)
    i = np.repeat(np.arange(len(key)), j.shape[1])
    j = j.ravel()
    kept = flags[i, j]
    i, j = i[kept], j[kept]
    yield pa.RecordBatch.from_arrays(
        [s_ids.take(pa.array(i)), t_ids.take(pa.array(j)), pa.array(weight[i, j].astype(np.int64)).cast(want.schema.field("weight").type)], schema=want.schema
    )


# -- the whole ------------------------------------------------------------------------------------


def shape(sides: tuple[DataFrame, ...], want: Want) -> tuple[int, int, int]:
    """Buckets, blocks of records, and blocks of targets. More blocks need less memory and more shuffled bytes, for each is
    sent to all of the other side."""
    parts = int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = max(int(str(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in sides)
    # what comes from no file, and so is small, has no size that is known, and the largest number for it
    side = max(4, math.ceil(4 * (read / 1.2e8) ** 0.33)) if read < 1 << 50 else 4
    return max(16, 2 * parts), side, side


def packed(left: DataFrame, right: DataFrame, params: LinkParams, want: Want, form: tuple[int, int, int]) -> DataFrame:
    """What ``want`` says of records and targets that :func:`pack` indexed as ``s`` and ``t``."""
    buckets, s_blocks, t_blocks = form

    def met(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for side, block, other, bucket, blob in _meet(rows, buckets, params, want, s_blocks, t_blocks):
            cells = range(block * t_blocks, (block + 1) * t_blocks) if side == "s" else range(block, s_blocks * t_blocks, t_blocks)
            cells = cells if other is None else cells[other : other + 1]
            n = len(cells)
            columns = [pa.array(cells, pa.int32()), pa.array([side] * n), pa.array([bucket] * n, pa.int32()), pa.array([blob] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_POSTINGS)
        pa.default_memory_pool().release_unused()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            yield from met(rows.append_column("settled", pa.nulls(len(rows), pa.binary())))

    def meet_knowing(rows: pa.Table, known: pa.Table) -> pa.Table:
        of = dict(zip(known["stretch"].to_pylist(), known["settled"].to_pylist()))
        bits = pa.array([of.get(x) for x in rows["stretch"].to_pylist()], pa.binary())
        return pa.Table.from_batches(met(rows.append_column("settled", bits)), schema=_POSTINGS)

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "cell"):
            own: dict[str, dict[int, bytes]] = {"s": {}, "t": {}}
            cell = rows["cell"][0].as_py()
            for side, bucket, blob in zip(*(rows[x].to_pylist() for x in ("side", "bucket", "index"))):
                own[side][bucket] = blob
            del rows
            yield from _cell(own["s"], own["t"], buckets, params, want, cell, t_blocks)
            pa.default_memory_pool().release_unused()

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "bucket"):
            found = list(_settle(rows, buckets, params))
            yield pa.RecordBatch.from_pydict({"stretch": pa.array([x for x, _ in found], pa.int64()), "settled": pa.array([x for _, x in found], pa.binary())})

    def anywhere(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "stretch"):
            settled, known = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in rows["settled"].to_pylist()]).reshape(2, -1)
            bits, n = (settled | ~known).tobytes(), buckets + 1
            columns = [pa.array(range(n), pa.int32()), pa.array([rows["stretch"][0].as_py()] * n, pa.int64()), pa.array([bits] * n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "stretch", "settled"])

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "chunk"):
            yield from _lines(rows, want)

    posted = "cell int, side string, bucket int, index binary"
    indexes = left.unionByName(right).repartition(buckets, "bucket")
    if params.fallback and want.form != "counter":
        # who has a candidate is known before postings for fallbacks are passed on; the indexes are shuffled once
        known = (
            indexes.sortWithinPartitions("bucket").mapInArrow(settle, "stretch long, settled binary")
            .repartition("stretch").sortWithinPartitions("stretch").mapInArrow(anywhere, "bucket int, stretch long, settled binary")
            .repartition(buckets, "bucket")
        )
        postings = indexes.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(meet_knowing, posted)
    else:
        postings = indexes.sortWithinPartitions("bucket").mapInArrow(meet, posted)
    cells = postings.repartition(s_blocks * t_blocks, "cell").sortWithinPartitions("cell")
    if want.form != "lines":
        return cells.mapInArrow(pairs, want.ddl)
    partial = cells.mapInArrow(pairs, "chunk long, cell int, index binary, ids binary")
    return partial.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lines, want.ddl)
