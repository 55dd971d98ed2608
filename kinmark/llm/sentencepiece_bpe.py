"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is escaped (space to U+2581, one U+2581 in front) and cut into words wherever a U+2581 follows
another character; no piece of the vocabulary crosses such a place, so words merge independently. The
words that a worker has not met yet are encoded together: their symbols lie in one flat numpy array,
each round finds the best pair of every word by a segmented minimum of ranks, merges it and compacts
the arrays, until no word has a pair left.

Words of any length pass through the same rounds. A word is cut beforehand wherever no piece of the
vocabulary holds its two neighbouring characters, for no merge ever crosses such a place.

A round merges all leftmost non-overlapping occurrences of a word's best pair at once where no pair born by
these merges ranks as high or higher. A merge that does bear such a pair is risky: the sequential algorithm
(best score first, leftmost on ties) goes on with that pair before it merges any occurrence further right.
All these births grow one piece, so they reach no further than the longest piece of the vocabulary; an
occurrence that lies further off is independent of them and still merges in the same round.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinmark.llm.common import arrow_map, blocks, claim, texts

SPACE = "▁"
#: A word with its leading run of spaces.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words that a worker keeps encoded, in each of two generations.
CACHE_WORDS = 100_000
#: Characters encoded together; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
_NONE = np.iinfo(np.int64).max


class Strings:
    """Sequences of numbers in one flat array that grows."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, n: int, used: int):
        self.data, self.starts, self.n, self.used = data, starts, n, used

    @classmethod
    def of(cls, values: list[bytes], dtype=np.uint8) -> Strings:
        data = np.frombuffer(b"".join(values), dtype=np.uint8).astype(dtype)
        starts = np.r_[0, np.cumsum([len(v) for v in values], dtype=np.int64)].astype(np.int64)
        return cls(data, starts, len(values), len(data))

    def __len__(self) -> int:
        return self.n

    def extend(self, data: np.ndarray, counts: np.ndarray) -> None:
        self.data = _room(self.data, self.used, len(data))
        self.starts = _room(self.starts, self.n + 1, len(counts))
        self.data[self.used : self.used + len(data)] = data
        self.starts[self.n + 1 : self.n + 1 + len(counts)] = self.used + np.cumsum(counts)
        self.used += len(data)
        self.n += len(counts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``rows``, one after the other, and their lengths."""
        begin = self.starts[rows]
        counts = self.starts[rows + 1] - begin
        shift = np.r_[0, np.cumsum(counts)[:-1]] if len(counts) else counts
        index = np.repeat(begin - shift, counts)
        index += np.arange(len(index))
        return self.data[index], counts


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.empty(max(2 * len(array), used + more, 1024), dtype=array.dtype)
    grown[:used] = array[:used]
    return grown


class PieceModel:
    """The vocabulary of a SentencePiece BPE model with byte fallback, and its encoder and decoder."""

    def __init__(self, model_path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = library.get_piece_size()
        if library.normalize(" ½  x ") not in (f"{SPACE}{SPACE}½{SPACE}{SPACE}x{SPACE}", " ½  x ", "  ½  x "):
            raise ValueError("only models with identity normalisation are supported")
        self.end_id = library.eos_id()
        self.unknown_id = library.unk_id()
        self.surface: list[str] = [""] * n
        self.byte_id = [0] * 256
        self.piece_id: dict[str, int] = {}
        scores: dict[int, float] = {}
        for i in range(n):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not library.is_unknown(i) and not library.is_control(i):
                self.piece_id[piece] = i
                scores[i] = library.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ")
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses words")
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.byte_id] = True
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        # Symbols: vocabulary ids, and from n on the characters that no piece has.
        self.n = n
        self._pairs(order, scores)
        self.longest = max(map(len, self.piece_id))
        inside = {(ord(x) << 21) | ord(y) for piece in self.piece_id for x, y in zip(piece, piece[1:])}
        self.inside = np.array(sorted(inside), dtype=np.int64)  # neighbouring characters of any piece
        # symbol of every code point: the piece of one character, else n plus the code point
        self.symbol_of = np.arange(n, n + 0x110000, dtype=np.int64)
        for piece, i in self.piece_id.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        surfaces = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.surface)]
        self.surfaces = Strings.of(surfaces)
        self.numbers = Strings.of([b"%d " % i for i in range(n)])
        self.known, self.ids_of = {}, Strings.of([], np.int32)
        self.older, self.older_ids = self.known, self.ids_of

    def _pairs(self, order: dict[float, int], scores: dict[int, float]) -> None:
        """Sorted arrays of every pair of pieces that joins to a piece: key, rank and joined id."""
        found = []
        for piece, i in self.piece_id.items():
            for k in range(1, len(piece)):
                a, b = self.piece_id.get(piece[:k]), self.piece_id.get(piece[k:])
                if a is not None and b is not None:
                    found.append((a * self.n + b, order[scores[i]], i))
        table = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
        self.pair_key = np.ascontiguousarray(table[:, 0])
        self.pair_rank = np.ascontiguousarray(table[:, 1])
        self.pair_id = np.ascontiguousarray(table[:, 2])
        self.rank_or_none = np.append(self.pair_rank, _NONE)  # row -1: no pair
        # an open-addressing table answers the look-ups of a round without a binary search
        bits = max(8, int(4 * len(table)).bit_length())
        self.slot_mask = (1 << bits) - 1
        self.slot_shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, dtype=np.int64)
        where = self._slot(self.pair_key)
        left = np.arange(len(table))
        while len(left):
            free = left[self.slots[where[left]] < 0]
            self.slots[where[free]] = free
            left = left[self.slots[where[left]] != left]
            where[left] = (where[left] + 1) & self.slot_mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).astype(np.int64)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row in the pair table for each pair of symbols, or -1."""
        out = np.full(len(left), -1, dtype=np.int64)
        known = np.flatnonzero((left < self.n) & (right < self.n) & (left >= 0) & (right >= 0))
        keys = left[known] * self.n + right[known]
        at = self._slot(keys)
        while len(known):
            row = self.slots[at]
            hit = (row >= 0) & (self.pair_key[row] == keys)
            out[known[hit]] = row[hit]
            go = (row >= 0) & ~hit
            known, keys, at = known[go], keys[go], (at[go] + 1) & self.slot_mask
        return out

    # -- encoding ---------------------------------------------------------------------------------

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        fresh = np.ones(len(flat), dtype=bool)
        if len(flat) > 1:
            pair = (flat[:-1] << 21) | flat[1:]
            at = np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)
            fresh[1:] = (owner[1:] != owner[:-1]) | (self.inside[at] != pair)
        part = np.cumsum(fresh) - 1
        symbols, part = self._merge_rounds(self.symbol_of[flat], part)
        order = np.argsort(part, kind="stable")
        symbols, word = symbols[order], owner[np.flatnonzero(fresh)][part[order]]
        if len(symbols) and symbols.max() >= self.n:
            symbols, word = self._to_bytes(symbols, word)
        return symbols.astype(np.int32), np.bincount(word, minlength=len(words))

    def _to_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= self.n)
        raw = [chr(c).encode() for c in (symbols[odd] - self.n).tolist()]
        times = np.ones(len(symbols), dtype=np.int64)
        times[odd] = [len(r) for r in raw]
        out = np.repeat(symbols, times)
        out[out >= self.n] = np.array(self.byte_id)[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out, np.repeat(word, times)

    def _merge_rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left when no word has a pair, and the word of each; words in any order."""
        row = np.full(len(symbols), -1, dtype=np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        row[inside] = self._look_up(symbols[inside], symbols[inside + 1])
        first = np.arange(len(symbols))  # of each symbol, its first character
        done_symbols, done_word = [], []
        while len(symbols):
            rank = self.rank_or_none[row]
            fresh = np.empty(len(word), dtype=bool)
            fresh[0] = True
            np.not_equal(word[1:], word[:-1], out=fresh[1:])
            starts = np.flatnonzero(fresh)
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(symbols))
            active = best < _NONE
            if not active.all():
                keep = np.repeat(active, sizes)
                done_symbols.append(symbols[~keep])
                done_word.append(word[~keep])
                symbols, word, rank, row, first = symbols[keep], word[keep], rank[keep], row[keep], first[keep]
                best, sizes = best[active], sizes[active]
                if not len(symbols):
                    break
            take = self._leftmost_apart(rank == np.repeat(best, sizes))
            take = self._independent(symbols, word, row, rank, first, take)
            symbols[take] = self.pair_id[row[take]]
            kept = np.ones(len(symbols), dtype=bool)
            kept[take + 1] = False
            place = take - np.arange(len(take))  # of each joined symbol after compaction
            symbols, word, row, first = symbols[kept], word[kept], row[kept], first[kept]
            stale = np.concatenate([place, place[place > 0] - 1])
            stale = stale[stale + 1 < len(symbols)]
            row[place] = -1
            stale = stale[word[stale] == word[stale + 1]]
            row[stale] = self._look_up(symbols[stale], symbols[stale + 1])
        return np.concatenate([*done_symbols, symbols]), np.concatenate([*done_word, word])

    @staticmethod
    def _leftmost_apart(mask: np.ndarray) -> np.ndarray:
        """Positions of ``mask``, every second one dropped within a run of neighbours."""
        at = np.flatnonzero(mask)
        if not len(at):
            return at
        fresh = np.r_[True, np.diff(at) != 1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - first) % 2 == 0]

    def _independent(self, symbols, word, row, rank, first, take) -> np.ndarray:
        """Of a word's several merges those that the sequential algorithm would make whatever the others bear: all up
        to the first risky one, and again from the first one on that lies out of reach of all before it."""
        owner = word[take]
        again = owner[1:] == owner[:-1]
        if not again.any():
            return take
        joined, n = self.pair_id[row[take]], len(symbols)
        before = np.where((take > 0) & (word[take - 1] == owner), symbols[take - 1], -1)
        touching = np.r_[False, (np.diff(take) == 2) & again]
        before[touching] = joined[np.flatnonzero(touching) - 1]
        after_at = np.minimum(take + 2, n - 1)
        after = np.where((take + 2 < n) & (word[after_at] == owner), symbols[after_at], -1)
        risky = np.zeros(len(take), dtype=bool)
        for a, b in ((before, joined), (joined, after)):
            risky |= self.rank_or_none[self._look_up(a, b)] <= rank[take]
        if not risky.any():
            return take
        # merges of one chain may reach each other: each starts near the one before it
        near = again & (np.diff(first[take]) <= 3 * self.longest)
        chain = np.cumsum(np.r_[True, ~near]) - 1
        earlier = np.cumsum(risky) - risky  # risky ones before each
        head = np.flatnonzero(np.r_[True, ~near])
        return take[earlier == earlier[head][chain]]

    def words(self, text: str) -> list[str]:
        return WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _numbers_of(self, words: list[str]) -> np.ndarray:
        """Row of each word in ``ids_of``; words not yet known are encoded first. Two generations are kept,
        so that words which recur outlive a full cache."""
        if len(self.known) > CACHE_WORDS:
            self.older, self.older_ids = self.known, self.ids_of
            self.known, self.ids_of = {}, Strings.of([], np.int32)
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys([words[i] for i in missing.tolist()]))
            before = np.fromiter(map(self.older.get, new, repeat(-1)), np.int64, len(new))
            kept, fresh = np.flatnonzero(before >= 0), np.flatnonzero(before < 0)
            self._add([new[i] for i in kept.tolist()], *self.older_ids.take(before[kept]))
            for k in range(0, len(fresh), 100_000):
                block = [new[i] for i in fresh[k : k + 100_000].tolist()]
                self._add(block, *self.merge_words(block))
            at[missing] = [self.known[words[i]] for i in missing.tolist()]
        return at

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.ids_of), len(self.ids_of) + len(words)), strict=True))
        self.ids_of.extend(ids, counts)

    def encode_all(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other with an end id each, and how many each text has."""
        split = [self.words(t) for t in all_texts]
        flat_words = [w for found in split for w in found]
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        ids, per_word = self.ids_of_words(flat_words)
        edges = np.r_[0, np.cumsum(per_word)][np.r_[0, np.cumsum(per_text)]]
        ends = edges[1:]
        return np.insert(ids, ends, self.end_id), np.diff(edges) + 1

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        at = self._numbers_of(words)
        return self.ids_of.take(at)

    def encode(self, text: str) -> list[int]:
        """All ids of a text, the end id last."""
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 texts of ids that encode texts (so that byte pieces form whole characters)."""
        raw, sizes = self.surfaces.take(ids)
        data = raw.tobytes()
        edges = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b].removeprefix(b" ") for a, b in zip(edges, edges[1:])]

    def as_decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Decimal ids of each text, joined by one space."""
        raw, sizes = self.numbers.take(ids)
        data = raw.tobytes()
        edges = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a : b - 1] if b > a else b"" for a, b in zip(edges, edges[1:])]

    # -- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of any ids: byte pieces join to characters, bytes that form none become U+FFFD each, control
        ids vanish, the unknown id shows as a marked question mark, one space in front is dropped (unless
        ``first`` is false: ids from inside a text)."""
        parts: list[str] = []
        pending = bytearray()
        started = not first

        def flush() -> None:
            if pending:
                parts.append(_decode_bytes(bytes(pending)))
                pending.clear()

        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                started = True
                continue
            flush()
            if i == self.unknown_id:
                parts.append(" ⁇ ")
                started = True
                continue
            piece = self.surface[i]
            if not started and piece:
                piece = piece.removeprefix(" ")
                started = True
            parts.append(piece)
        flush()
        return "".join(parts)


def _decode_bytes(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for k in range(min(4, len(raw) - i), 0, -1):
                try:
                    char = raw[i : i + k].decode()
                except UnicodeDecodeError:
                    continue
                if len(char) == 1:
                    out.append(char)
                    i += k
                    break
            else:
                out.append("�")
                i += 1
        return "".join(out)


def load_model(path: str) -> PieceModel:
    """The model at ``path``, read once per Python worker."""
    return claim(("pieces", path), lambda: PieceModel(path))


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_tokens, [ids,] ids_sha256, decoded_sha256)``.

    Texts are encoded whole with an end id; null counts as empty, which gives the end id alone. The
    decoded digest comes from decoding these ids. Texts of any length, with or without spaces, take one path.
    Repeated rows and null ids stay as they are; other columns, whatever their names, are ignored; an empty
    table gives an empty result. ``model_path`` must exist on every executor.
    """

    def run(batch: pa.RecordBatch) -> dict:
        model = load_model(model_path)
        ids, counts, id_digests, text_digests = [], [], [], []
        for block in blocks(texts(batch, text_col), BLOCK_CHARS):
            block_ids, block_counts = model.encode_all(block)
            counts.append(block_counts)
            if with_ids:
                ids.append(block_ids)
            id_digests += [hashlib.sha256(x).hexdigest() for x in model.as_decimals(block_ids, block_counts)]
            text_digests += [hashlib.sha256(x).hexdigest() for x in model.decode_all(block_ids, block_counts)]
        all_counts = np.concatenate(counts)
        out = {"doc_id": batch.column(id_col), "n_tokens": pa.array(all_counts, pa.int64())}
        if with_ids:
            edges = pa.array(np.r_[0, np.cumsum(all_counts)].astype(np.int32))
            out["ids"] = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(ids), pa.int32()))
        out["ids_sha256"] = pa.array(id_digests, pa.string())
        out["decoded_sha256"] = pa.array(text_digests, pa.string())
        return out

    id_type = docs.schema[id_col].dataType.simpleString()
    ids_field = "ids array<int>, " if with_ids else ""
    return arrow_map(
        docs.select(id_col, text_col),
        run,
        f"doc_id {id_type}, n_tokens long, {ids_field}ids_sha256 string, decoded_sha256 string",
    )
