"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model merges the best-scored pair of neighbouring pieces until none is
left. With merge-dropout each candidate that comes up from the agenda is skipped
with a given probability, each for itself. A keyed hash of (seed, document, place
of the word in it, number of the draw) tells how many candidates pass before the
next one is skipped, so every occurrence of a word is segmented anew, and a run can
be repeated exactly, on any number of executors.

Pieces never cross from a character to a following space, nor over two
characters that no piece of the vocabulary has side by side. Texts are cut
there into units and their parts, which changes nothing. What units become without skips is kept in tables
of fixed size. The agendas of all other occurrences in a chunk are worked off together,
one step of each at a time in numpy, each with its own draws.
Decoding joins the bytes of the pieces and is exact for every text: bytes stand
for characters outside the vocabulary and for a literal U+2581.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import with_text
from webframe.llm.words import chunks, mixed

#: Units and characters of units before the tables are emptied.
UNITS, CHARS = 100_000, 1 << 21
#: Bytes of texts that are encoded at once.
ENCODED = 1 << 19
#: The longest part, and the most parts of a unit, that are worked off with others; and how many of them at once.
LONG, PARTS, TOGETHER = 32, 16, 1 << 13
#: Pieces that are decoded at once.
DECODED = 1 << 20
#: Most entries of the table of gaps; what is beyond takes another draw.
GAPS = 1 << 16
#: More candidates than any part has.
NEVER = 1 << 40
NO_RANK = (1 << 31) - 1
SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
#: Number of the unit for a U+2581 of the text.
LITERAL = 0
_OTHER, _BLANK, _BREAK = 0, 1, 2
#: Whether a unit starts at a byte, by the kinds of the one before and of itself.
_STARTS = np.array([a != b and (a, b) != (_BLANK, _OTHER) for a in range(4) for b in range(4)])
_M, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True, eq=False)
class Pieces:
    """What encoding needs of a model: id and score of each piece, ids of the 256 bytes."""

    ids: dict[str, int]
    scores: list[float]
    bytes: list[int]
    texts: list[bytes]

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        names = [model.id_to_piece(i) for i in range(n)]
        single = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        texts = [b""] * n
        for i in plain:
            texts[i] = names[i].replace(SPACE, " ").encode()
        for value, i in single.items():
            texts[i] = bytes([value])
        if len(single) < 256 or any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("the model must have byte pieces, and spaces only at the start of pieces")
        scores = [model.get_score(i) for i in range(n)]
        return cls({names[i]: i for i in plain}, scores, [single[b] for b in range(256)], texts)


class Encoder:
    """Encodes texts, many at once; results follow from seed, key and text alone, whatever is in its tables."""

    def __init__(self, pieces: Pieces, dropout: float, seed: int):
        self.pieces, self.limit = pieces, round(dropout * (1 << 32))
        self.salt = _mixed(crc32(str(seed).encode()))
        # A hash h lets as many candidates pass as there are bounds not above it: k or more with probability (1-p)^k.
        passed, bounds = 1 - self.limit / (1 << 32), []
        while self.limit and len(bounds) < GAPS and (not bounds or bounds[-1] < 1 << 32):
            bounds.append((1 << 32) - int(passed ** (len(bounds) + 1) * (1 << 32)))
        self.bounds, self.bound_array = bounds, np.array(bounds, np.uint64)
        # A line break that is in no piece is a place to cut as well.
        self.kinds = np.full(256, _OTHER, np.uint8)
        self.kinds[0x20] = _BLANK
        if not any("\n" in p for p in pieces.ids):
            self.kinds[0x0A] = _BREAK
        self.symbols = _symbols(pieces)
        self.units = _Units(self)

    def encode(self, text: str, key: int) -> bytes:
        """The ids, as 4 bytes each in native order."""
        data = np.frombuffer(text.encode(), np.uint8)
        return self.encode_rows(data, np.array([0, len(data)]), np.array([key], np.int64))[0].tobytes()

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, which lie one after the other in ``data``, and the offset of each text's ids."""
        filled = np.flatnonzero(np.diff(offsets))
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        # Each text starts with a space more.
        row_starts = offsets[:-1][filled] + np.arange(len(filled))
        data = np.insert(data, offsets[:-1][filled], 0x20)
        first, literal = self._cut(data, row_starts)
        units = self.units.numbers(data, first)
        rows = np.searchsorted(row_starts, first, "right") - 1
        at = np.searchsorted(first, row_starts)
        if literal:
            counted = np.cumsum(units != LITERAL)
            turn = counted - np.where(at > 0, counted[at - 1], 0)[rows]
        else:
            turn = np.arange(1, len(first) + 1) - at[rows]
        tables = self.units
        begin, size = tables.get(tables.unit_start, units), tables.get(tables.unit_size, units)
        cut = len(tables.ids)
        if self.limit:
            base = mixed(keys[filled].astype(np.int64).view(np.uint64) ^ np.uint64(self.salt))
            hashes = mixed(base[rows] + turn.astype(np.uint64) * np.uint64(_STEP))
            gaps = self._gaps(hashes)
            dropped = np.flatnonzero(gaps < tables.get(tables.unit_candidates, units))
            begin[dropped], size[dropped] = self._dropped(units[dropped], gaps[dropped], hashes[dropped])
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1])
        out = tables.get(tables.ids, np.repeat(begin - (ends - size), size) + np.arange(total))
        del tables.ids[cut:]
        counts = np.zeros(len(offsets) - 1, np.int64)
        counts[filled] = np.diff(np.append((ends - size)[at], total))
        return out, np.concatenate([[0], np.cumsum(counts)])

    def _cut(self, data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, bool]:
        """Where units start, and whether some are a literal U+2581, each one for itself.

        A unit is blanks and what follows up to the next blank or break, or blanks before a break or an end, or breaks.
        """
        kinds = self.kinds[data]
        starts = np.ones(len(data), bool)
        starts[1:] = _STARTS[kinds[:-1] << 2 | kinds[1:]]
        starts[row_starts] = True
        literal = data.tobytes().find(_SPACE_BYTES) >= 0
        if literal:
            a, b, c = _SPACE_BYTES
            found = np.flatnonzero((data[:-2] == a) & (data[1:-1] == b) & (data[2:] == c))
            starts[found], starts[found + 1], starts[found + 2] = True, False, False
            after = found + 3
            starts[after[after < len(data)]] = True
        return np.flatnonzero(starts), literal

    def _gap(self, h: int) -> int:
        """How many candidates pass before one is skipped."""
        bounds, total = self.bounds, 0
        while True:
            gap = bisect_right(bounds, h >> 32)
            total += gap
            if gap < len(bounds) or total >= NEVER:
                return total
            h = _mixed(h)

    def _gaps(self, hashes: np.ndarray) -> np.ndarray:
        gaps = np.searchsorted(self.bound_array, hashes >> np.uint64(32), "right")
        for i in np.flatnonzero(gaps == len(self.bounds)).tolist():
            gaps[i] = self._gap(int(hashes[i]))
        return gaps

    def _dropped(self, units: np.ndarray, gaps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of these occurrences of units; the ids are added to the table.

        ``gaps`` candidates pass before the first is skipped, more gaps are drawn. The first parts of all
        occurrences are worked off together, then the second ones with what is left of the gaps, and so on.
        """
        tables, symbols = self.units, self.symbols
        first, count = tables.get(tables.unit_first, units), tables.get(tables.unit_count, units).astype(np.int64)
        begin, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        hard = tables.get(tables.unit_hard, units) != 0
        for k in np.flatnonzero(hard).tolist():
            begin[k], size[k] = tables.keep(self._alone(int(units[k]), int(gaps[k]), int(keys[k])))
        here, turn = np.flatnonzero(~hard), np.zeros(len(units), np.uint64)
        which, order, starts, sizes, number = [], [], [], [], 0
        while len(here):
            part = first[here] + number
            candidates = tables.get(tables.candidates, part)
            skips = gaps[here] < candidates
            gaps[here[~skips]] -= candidates[~skips]
            begin_here, size_here = tables.get(tables.start, part), tables.get(tables.size, part).astype(np.int64)
            at = here[skips]
            lengths = tables.get(tables.char_count, part[skips])
            chars = tables.pool(tables.chars, tables.get(tables.char_start, part[skips]), lengths)
            found, counts, gaps[at], turn[at] = self.merge_all(chars, lengths, gaps[at], keys[at], turn[at])
            ids, counts = symbols.ids_of(found, counts)
            start = tables.keep(ids.tobytes())[0]
            begin_here[skips], size_here[skips] = start + np.cumsum(counts) - counts, counts
            which.append(here)
            order.append(np.full(len(here), number))
            starts.append(begin_here)
            sizes.append(size_here)
            number += 1
            here = here[count[here] > number]
        if not which:
            return begin, size
        if number == 1:
            begin[which[0]], size[which[0]] = starts[0], sizes[0]
            return begin, size
        # The ids of several parts are put side by side.
        which, order, starts, sizes = (np.concatenate(x) for x in (which, order, starts, sizes))
        place = np.lexsort((order, which))
        which, starts, sizes = which[place], starts[place], sizes[place]
        start = tables.keep(tables.pool(tables.ids, starts, sizes).tobytes())[0]
        np.add.at(size, which, sizes)
        firsts = np.flatnonzero(np.diff(which, prepend=-1))
        begin[which[firsts]] = start + (np.cumsum(sizes) - sizes)[firsts]
        return begin, size

    def _alone(self, unit: int, gap: int, key: int) -> bytes:
        """The same for one occurrence, part by part."""
        turn, out, tables = 0, [], self.units

        def draw() -> int:
            nonlocal turn
            turn += 1
            return self._gap(_mixed(key + turn * _STEP))

        first = tables.unit_first[unit]
        for part in range(first, first + tables.unit_count[unit]):
            if gap < tables.candidates[part]:
                start = tables.char_start[part]
                found, gap = self.merge(self.symbols.text(tables.chars[start : start + tables.char_count[part]]), gap, draw)
                out.append(found)
            else:
                gap -= tables.candidates[part]
                out.append(tables.ids[tables.start[part] : tables.start[part] + tables.size[part]].tobytes())
        return b"".join(out)

    def merge_all(
        self, chars: np.ndarray, counts: np.ndarray, gaps: np.ndarray, keys: np.ndarray | None = None, turns: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """``merge`` for many short parts, given by the symbols of their characters and the numbers of these.

        Returns the symbols left, how many each part has, and what is left of the gaps and drawn of each. ``keys`` and
        ``turns`` say what is drawn next; without them no gap may be used up.
        """
        first = np.cumsum(counts) - counts
        left, sizes = np.full(len(chars), -1, np.int32), np.zeros(len(counts), np.int64)
        gaps, turns = gaps.copy(), None if turns is None else turns.copy()
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 24, LONG):
            group = np.flatnonzero((counts > low) & (counts <= high))
            low = high
            for k in range(0, len(group), TOGETHER):
                rows = group[k : k + TOGETHER]
                at = first[rows, None] + np.arange(high)
                inside = np.arange(high) < counts[rows, None]
                pieces = np.where(inside, chars[np.where(inside, at, 0)], -1)
                own = None if keys is None else (keys[rows], turns[rows])
                gaps[rows], drawn = self._merge_rows(pieces, counts[rows], gaps[rows], own)
                if drawn is not None:
                    turns[rows] = drawn
                left[at[inside]] = pieces[inside]
                sizes[rows] = np.count_nonzero(pieces >= 0, 1)
        return left[left >= 0], sizes, gaps, turns

    def _merge_rows(
        self, pieces: np.ndarray, counts: np.ndarray, gaps: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None
    ) -> tuple[np.ndarray, np.ndarray | None]:
        """Works off one agenda for each row of ``pieces``, a step of all rows at a time; -1 stands where no piece starts.

        A row holds each piece where it starts, and there the rank of the candidate with the next piece. Of the best
        rank the leftmost is next, as in ``merge``.
        """
        n, width = pieces.shape
        step = width + 1
        symbols, keys = self.symbols, None if own is None else own[0]
        turns = None if own is None else own[1].copy()
        after = np.tile(np.arange(1, step + 1, dtype=np.int32), (n, 1))
        after[np.arange(n), counts - 1] = width
        before = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1))
        joint, rank = np.full((n, step), -1, np.int32), np.full((n, step), NO_RANK, np.int32)
        if width > 1:
            joint[:, : width - 1] = symbols.pair(pieces[:, :-1].ravel(), pieces[:, 1:].ravel()).reshape(n, -1)
            rank[:, : width - 1] = symbols.rank[joint[:, : width - 1]]
        flat = np.empty((n, step), np.int32)
        flat[:, :width] = pieces
        flat[:, width] = -1
        flat, after_, before_, joint, ranks = flat.ravel(), after.ravel(), before.ravel(), joint.ravel(), rank.ravel()
        rows = np.arange(n)
        while True:
            best = rank[rows].argmin(1) if len(rows) < n else rank.argmin(1)
            at = rows * step + best
            more = ranks[at] < NO_RANK
            if not more.all():
                rows, at, best = rows[more], at[more], best[more]
            if not len(rows):
                break
            left = gaps[rows]
            skip = left == 0
            gaps[rows] = left - 1
            if skip.any():
                out = rows[skip]
                ranks[at[skip]] = NO_RANK
                turns[out] += np.uint64(1)
                gaps[out] = self._gaps(mixed(keys[out] + turns[out] * np.uint64(_STEP)))
                keep = ~skip
                at, best, base = at[keep], best[keep], rows[keep] * step
            else:
                base = rows * step
            # The next piece joins the one at this place.
            gone = base + after_[at]
            following = after_[gone]
            flat[at] = joint[at]
            flat[gone], ranks[gone] = -1, NO_RANK
            after_[at] = following
            before_[base + following] = best
            # With the piece after it, which is -1 beyond the end, and with the one before.
            previous = before_[at]
            found = symbols.pair(flat[at], flat[base + following])
            joint[at], ranks[at] = found, symbols.rank[found]
            has = previous >= 0
            there = (base + previous)[has]
            found = symbols.pair(flat[there], flat[at[has]])
            joint[there], ranks[there] = found, symbols.rank[found]
        pieces[:] = flat.reshape(n, step)[:, :width]
        return gaps, turns

    def merge(self, part: str, gap: int, draw: Callable[[], int]) -> tuple[bytes, int]:
        """Segments one part by working off the agenda of candidate merges, best first, left to right.

        ``gap`` candidates pass, one is skipped, then ``draw()`` gives the next gap; what is left of a gap is returned.
        """
        ids, scores = self.pieces.ids, self.pieces.scores
        n = len(part)
        if n == 1:
            p = ids.get(part)
            return np.array([p] if p is not None else [self.pieces.bytes[b] for b in part.encode()], np.int32).tobytes(), gap
        starts, ends, before, after = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            p = ids.get(part[i : i + 2])
            if p is not None:
                agenda.append((-scores[p], i, i + 1, i + 2, p))
        heapify(agenda)
        while agenda:
            _, i, j, end, p = heappop(agenda)
            if ends[i] != j or j >= n or ends[j] != end or starts[i] < 0 or starts[j] < 0:
                continue
            if not gap:
                gap = draw()
                continue
            gap -= 1
            # The piece at j joins the one at i.
            ends[i], starts[j] = end, -1
            following = after[i] = after[j]
            if following < n:
                before[following] = i
                q = ids.get(part[i : ends[following]])
                if q is not None:
                    heappush(agenda, (-scores[q], i, following, ends[following], q))
            previous = before[i]
            if previous >= 0:
                q = ids.get(part[previous:end])
                if q is not None:
                    heappush(agenda, (-scores[q], previous, i, end, q))
        out, i = [], 0
        while i < n:
            piece = part[i : ends[i]]
            p = ids.get(piece)
            out += [p] if p is not None else [self.pieces.bytes[b] for b in piece.encode()]
            i = ends[i]
        return np.array(out, np.int32).tobytes(), gap


class _Symbols:
    """Pieces and characters as numbers: a piece has its id, a character that is no piece a number beyond these."""

    def __init__(self, pieces: Pieces):
        ids, self.bytes = pieces.ids, pieces.bytes
        self.code = np.full(0x110000, -1, np.int32)
        number = len(pieces.scores)
        self.start, self.size, self.ids, self.codes = array("q", range(number)), array("i", [1]) * number, array("i", range(number)), {}
        for c in sorted({c for p in ids for c in p}):
            self._char(c, ids.get(c))
        self.number = len(self.start)
        number = {c: int(self.code[ord(c)]) for p in ids for c in p} | ids
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.number + b] = i
        self.pairs = _Lookup(pairs)
        joined = {(a, b) for p in ids for a, b in zip(p, p[1:])}
        self.joined = _Lookup({number[a] * self.number + number[b]: 1 for a, b in joined})
        # Equal scores have equal ranks; the last rank is that of -1, which is no piece.
        _, rank = np.unique(-np.array(pieces.scores), return_inverse=True)
        self.rank = np.append(rank, NO_RANK).astype(np.int32)

    def _char(self, c: str, number: int | None) -> None:
        if number is None:
            number = len(self.start)
            self.start.append(len(self.ids))
            self.ids.extend([self.bytes[b] for b in c.encode()])
            self.size.append(len(self.ids) - self.start[-1])
        self.code[ord(c)] = number
        self.codes[number] = c

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        found = self.code[points]
        if len(found) and found.min() < 0:
            for c in sorted(set(points[found < 0].tolist())):
                self._char(chr(c), None)
            found = self.code[points]
        return found

    def text(self, chars: array) -> str:
        return "".join(map(self.codes.__getitem__, chars))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that two symbols side by side make, -1 where they make none."""
        key = a.astype(np.int64) * self.number + b
        key[(a < 0) | (b < 0) | (a >= self.number) | (b >= self.number)] = -1
        return self.pairs.get(key)

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a piece has these two characters side by side."""
        key = a.astype(np.int64) * self.number + b
        key[(a >= self.number) | (b >= self.number)] = -1
        return self.joined.get(key) >= 0

    def ids_of(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows of symbols that have so many each, and how many ids each row has."""
        sizes = np.frombuffer(self.size, np.int32)[symbols].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.cumsum(counts)
        ids = _Units.pool(self.ids, np.frombuffer(self.start, np.int64)[symbols], sizes)
        return ids, total[ends] - total[ends - counts]


@lru_cache(maxsize=1)
def _symbols(pieces: Pieces) -> _Symbols:
    return _Symbols(pieces)


class _Lookup:
    """Numbers by keys of at least 0, for arrays of keys; -1 for others. Keys lie at the first free place from their hash on."""

    def __init__(self, pairs: dict[int, int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.array(list(pairs), np.int64)
        for key, value, at in zip(pairs, pairs.values(), self._at(keys).tolist()):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = key, value

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(_STEP) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        held = self.keys[at]
        out = self.values[at]
        other = np.flatnonzero(held != keys)
        out[other] = -1
        other = other[(held[other] >= 0) & (keys[other] >= 0)]
        while len(other):
            at[other] = (at[other] + 1) & self.mask
            held = self.keys[at[other]]
            same = held == keys[other]
            out[other[same]] = self.values[at[other[same]]]
            other = other[~same & (held >= 0)]
        return out


class _Units:
    """What units become without skips, in flat tables that are emptied when full.

    A unit is cut into parts where no piece can reach across. Tables hold the symbols of a part's characters, its
    ids, and how many candidates come up; the ids of a unit's parts lie side by side.
    """

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self._empty()

    def _empty(self) -> None:
        self.number_of = {_SPACE_BYTES: LITERAL}
        self.unit_first, self.unit_count, self.unit_candidates = array("q", [0]), array("i", [0]), array("q", [0])
        self.unit_start, self.unit_size, self.unit_hard = array("q", [0]), array("i", [3]), array("b", [0])
        self.ids = array("i", [self.encoder.pieces.bytes[b] for b in _SPACE_BYTES])
        self.candidates, self.start, self.size, self.chars = array("q"), array("q"), array("i"), array("i")
        self.char_start, self.char_count = array("q"), array("q")

    @staticmethod
    def get(values: array, at: np.ndarray) -> np.ndarray:
        return np.frombuffer(values, values.typecode)[at] if len(values) else np.zeros(0, values.typecode)

    @staticmethod
    def pool(values: array, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The values of all these stretches, one after the other."""
        ends = np.cumsum(sizes)
        return _Units.get(values, np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0))

    def keep(self, ids: bytes) -> tuple[int, int]:
        """Start and number of ids that are added to the table of ids."""
        start = len(self.ids)
        self.ids.frombytes(ids)
        return start, len(self.ids) - start

    def numbers(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The numbers of the units that start at ``first``."""
        if len(self.unit_count) > UNITS or len(self.chars) > CHARS:
            self._empty()
        offsets = pa.py_buffer(np.append(first, len(data)).astype(np.int64))
        found = pa.Array.from_buffers(pa.large_binary(), len(first), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.number_of]
        if new:
            self._add(new)
        return np.array([self.number_of[u] for u in distinct], np.int64)[found.indices.to_numpy()]

    def _add(self, units: list[bytes]) -> None:
        encoder, symbols = self.encoder, self.encoder.symbols
        self.number_of.update(zip(units, range(len(self.unit_count), len(self.unit_count) + len(units))))
        texts = [u.decode() for u in units]
        chars = symbols.of("".join(texts).replace(" ", SPACE))
        unit_ends = np.cumsum([len(t) for t in texts])
        cuts = np.ones(len(chars), bool)
        cuts[1:] = ~symbols.side_by_side(chars[:-1], chars[1:])
        cuts[unit_ends[:-1]] = True
        first = np.flatnonzero(cuts)
        counts = np.diff(np.append(first, len(chars)))
        unit_first = np.searchsorted(first, np.concatenate([[0], unit_ends[:-1]]))
        unit_count = np.diff(np.append(unit_first, len(first)))
        # Long parts are merged one by one, the others together.
        long = counts > LONG
        found, sizes, left, _ = encoder.merge_all(chars[np.repeat(~long, counts)], counts[~long], np.full(int((~long).sum()), NEVER))
        ids, sizes = symbols.ids_of(found, sizes)
        size, candidates = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        size[~long], candidates[~long] = sizes, NEVER - left
        if long.any():
            own = []
            for k in np.flatnonzero(long).tolist():
                part, gap = encoder.merge(symbols.text(chars[first[k] : first[k] + counts[k]].tolist()), NEVER, lambda: NEVER)
                own.append(np.frombuffer(part, np.int32))
                size[k], candidates[k] = len(own[-1]), NEVER - gap
            merged = np.empty(int(size.sum()), np.int32)
            of_long = np.repeat(long, size)
            merged[~of_long], merged[of_long] = ids, np.concatenate(own)
            ids = merged
        start = len(self.ids) + np.cumsum(size) - size
        self.unit_first.frombytes((unit_first + len(self.size)).astype(np.int64).tobytes())
        self.unit_count.frombytes(unit_count.astype(np.int32).tobytes())
        self.unit_candidates.frombytes(np.add.reduceat(candidates, unit_first).tobytes())
        self.unit_start.frombytes(start[unit_first].astype(np.int64).tobytes())
        self.unit_size.frombytes(np.add.reduceat(size, unit_first).astype(np.int32).tobytes())
        self.unit_hard.frombytes((np.logical_or.reduceat(long, unit_first) | (unit_count > PARTS)).astype(np.int8).tobytes())
        self.candidates.frombytes(candidates.tobytes())
        self.start.frombytes(start.astype(np.int64).tobytes())
        self.size.frombytes(size.astype(np.int32).tobytes())
        self.char_start.frombytes((first + len(self.chars)).astype(np.int64).tobytes())
        self.char_count.frombytes(counts.astype(np.int64).tobytes())
        self.chars.frombytes(chars.astype(np.int32).tobytes())
        self.keep(ids.astype(np.int32).tobytes())


def _mixed(h: int) -> int:
    """``mixed`` of one number."""
    h &= _M
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & _M
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & _M
    return h ^ h >> 33


@lru_cache(maxsize=1)
def _encoder(pieces: Pieces, dropout: float, seed: int) -> Encoder:
    """Kept between the tasks of a worker, with its tables."""
    return Encoder(pieces, dropout, seed)


def encode_pieces(
    docs: DataFrame,
    model: str | None = None,
    dropout: float = 0.1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    out_col: str = "pieces",
    decoded_col: str | None = None,
) -> DataFrame:
    """``docs`` with the ids of the pieces of each text as a last column, which replaces one of that name.

    ``decoded_col`` asks for one more column, which replaces one of that name, maybe the text itself: the text that
    the pieces stand for, as ``decode_pieces`` gives it, but decoded by the task that has made them. So no second
    worker stands beside the first one, and neither pieces nor a text that is not wanted are sent to and fro.

    The path of the model is read on the driver; its pieces are broadcast, their number is fixed. The result follows
    from seed, id and text alone. Null and empty texts get an empty array; a null id is a key like another. Long texts
    are encoded whole. ``dropout=0`` gives the segmentation of the model itself.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(model or default_model()))
    kept = [c for c in docs.columns if c not in (out_col, decoded_col)]
    made = [out_col] if decoded_col is None else [out_col, decoded_col]
    fed, at = with_text(docs, kept, text_col)
    fed = fed.withColumn("_key", F.xxhash64(id_col))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, dropout, seed)
        texts = None if decoded_col is None else pa.array(shared.value.texts, pa.large_binary())
        for batch in batches:
            for row, data, offsets in chunks(batch.column(at), ENCODED):
                part = batch.slice(row, len(offsets) - 1)
                ids, ends = encoder.encode_rows(data, offsets, part.column("_key").to_numpy())
                found = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
                if texts is not None:
                    found.append(_joined(texts, pa.array(ids), ends))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *found], [*kept, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    kinds = [f"`{name}` {kind}" for name, kind in zip(made, ("array<int>", "string"))]
    return fed.mapInArrow(encode, ", ".join([*fields, *kinds]))


def _joined(texts: pa.Array, ids: pa.Array, ends: np.ndarray) -> pa.Array:
    """The text of each row of ids, without its first byte. The texts of all pieces one after the other are the rows'."""
    found = texts.take(ids)
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1][ends]
    filled = np.diff(offsets) > 0
    data = np.frombuffer(found.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = np.delete(data, offsets[:-1][filled])
    offsets -= np.concatenate([[0], np.cumsum(filled)])
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(filled), buffers).cast(pa.string())


def decode_pieces(
    docs: DataFrame, model: str | None = None, pieces_col: str = "pieces", out_col: str = "decoded"
) -> DataFrame:
    """``docs`` with ``pieces_col`` replaced by the text it stands for, as a last column; null gives an empty text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.load(model or default_model()).texts)
    kept = [c for c in docs.columns if c not in (pieces_col, out_col)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            ends = np.cumsum(pa.compute.list_value_length(batch.column(0)).fill_null(0).to_numpy(), dtype=np.int64)
            row = 0
            while row < len(batch):
                before = ends[row - 1] if row else 0
                end = max(row + 1, int(np.searchsorted(ends, before + DECODED, "right")))
                part = batch.slice(row, end - row)
                text = _joined(texts, part.column(0).flatten(), np.concatenate([[0], ends[row:end] - before]))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], text], [*kept, out_col])
                row = end

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return docs.select(F.col(pieces_col).alias("_pieces"), *kept).mapInArrow(
        decode, ", ".join([*fields, f"`{out_col}` string"])
    )
