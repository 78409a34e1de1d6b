"""BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a word has one encoding, so it has one last token. That token is
a vocabulary entry which ends where the prefix ends, and which the encoding of
the rest of the prefix can stand before: two tokens are compatible if no merge
crosses their border before both are complete. A suffix automaton of all tokens
gives the entries that end at a place, longest first; the first compatible one
is stored, and following the stored tokens back from the end of the word gives
the ids. Nothing is merged, so the time is linear in the length of a word, however
long it is.

Texts are cut into words as the tokenizers library does with the files of this
kind: added tokens as they are written, then NFC, lower case, and a pattern of
letters, single digits and the rest. Each character outside ASCII is tried out with the
library once; texts that hold one which Python's tables class otherwise, control
characters that are white space to Python alone, or added tokens are cut by the library.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import with_text
from webframe.llm.words import chunks

#: Entries of a cache before it is emptied, the longest word that is kept in one, and the bytes of a kept beginning.
CACHE_WORDS, CACHE_PAIRS, CACHE_HEADS, LONG, HEAD = 200_000, 500_000, 100_000, 48, 6
#: How the pattern of the tokenizer file is written, and the same for Python's expressions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
NEVER = 1 << 40


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a tokenizer file, as arrays of fixed size.

    ``left`` and ``right`` are the parts of each token (-1 for a single symbol), ``first`` and ``last`` the ids of
    the 256 bytes inside a word and at its end. The automaton has transitions ``(state << 16 | symbol) -> state``,
    a suffix link, a length, a token (or -1) and the next state above that has a token, for each state.
    """

    names: list[str]
    added: dict[str, int]
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    token: np.ndarray
    above: np.ndarray
    head: str

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        _require(spec, model, added)
        size = max(*vocab.values(), *added.values()) + 1
        names = [""] * size
        for name, i in [*vocab.items(), *added.items()]:
            names[i] = name
        left, right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        letters = _byte_letters()
        first = np.array([vocab[c] for c in letters], np.int32)
        last = np.array([vocab[c + end] for c in letters], np.int32)
        symbols = {int(i): [int(i)] for i in [*first, *last]}
        newest = max(symbols)
        for r, (a, b) in enumerate(merges):
            t = vocab[a + b]
            if t <= newest or not {vocab[a], vocab[b]} <= symbols.keys():
                raise ValueError(f"merge {r} must make a new token of older ones, with ids in the order of merges")
            newest, left[t], right[t] = t, vocab[a], vocab[b]
            symbols[t] = symbols[vocab[a]] + symbols[vocab[b]]
        pairs = Pairs(left, right)
        whole = {t: s for t, s in symbols.items() if left[t] < 0 or pairs.whole(t)}
        head = spec | {"model": model | {"vocab": {}, "merges": []}}
        return cls(names, added, left, right, first, last, *_automaton(whole), json.dumps(head))


def _require(spec: dict, model: dict, added: dict) -> None:
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    cut = spec["pre_tokenizer"]["pretokenizers"][0]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    plain = added and not any(t[f] for t in spec["added_tokens"] for f in flags) and not any(" " in t for t in added)
    if not (
        model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and plain
        and not model["byte_fallback"] and not model["ignore_merges"] and model["end_of_word_suffix"]
        and steps == ["NFC", "Replace", "Lowercase"] and cut["pattern"]["Regex"] == PATTERN and spec["decoder"] is None
    ):
        raise ValueError("a tokenizer of lower-case words with word ends is needed")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def _automaton(strings: dict[int, list[int]]) -> tuple[np.ndarray, ...]:
    """The suffix automaton of all strings of symbols, each marked with its token."""
    moves: list[dict[int, int]] = [{}]
    link, length, token = [-1], [0], [-1]

    def state(size: int, out: dict[int, int], up: int) -> int:
        moves.append(out)
        link.append(up)
        length.append(size)
        token.append(-1)
        return len(moves) - 1

    def split(p: int, c: int, q: int) -> int:
        """The state of the strings of ``q`` that end a path through ``p``."""
        if length[q] == length[p] + 1:
            return q
        copy = state(length[p] + 1, dict(moves[q]), link[q])
        link[q] = copy
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        return copy

    for t, string in strings.items():
        at = 0
        for c in string:
            if c in moves[at]:
                at = split(at, c, moves[at][c])
                continue
            new, p = state(length[at] + 1, {}, 0), at
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = split(p, c, moves[p][c])
            at = new
        token[at] = t
    above = [-1] * len(moves)
    for s in sorted(range(1, len(moves)), key=length.__getitem__):
        above[s] = link[s] if token[link[s]] >= 0 else above[link[s]]
    flat = [(s << 16 | c, q) for s, out in enumerate(moves) for c, q in out.items()]
    keys, targets = (np.array(x) for x in zip(*flat))
    return keys.astype(np.int64), targets.astype(np.int32), *(np.array(x, np.int32) for x in (link, length, token, above))


class Pairs(dict):
    """Whether the right token of a pair, keyed ``left << 32 | right``, can stand behind the left one."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left.tolist(), right.tolist()
        self.merged = {a << 32 | b: t for t, (a, b) in enumerate(zip(self.left, self.right)) if a >= 0}

    def __missing__(self, pair: int) -> bool:
        if len(self) >= CACHE_PAIRS:
            self.clear()
        found = self[pair] = self.crossing(pair >> 32, pair & 0xFFFFFFFF) is None
        return found

    def edge(self, token: int, part: list[int]) -> list[int]:
        """The tokens at one edge of ``token`` as it grows, from a symbol to itself."""
        out = [token]
        while part[out[-1]] >= 0:
            out.append(part[out[-1]])
        return out[::-1]

    def crossing(self, a: int, b: int) -> int | None:
        """The token that a merge over the border of ``a`` and ``b`` makes while both grow; later tokens have later merges."""
        rights, lefts = self.edge(a, self.right), self.edge(b, self.left)
        rights.append(NEVER)
        lefts.append(NEVER)
        i = j = 0
        while True:
            grows, follows = rights[i + 1], lefts[j + 1]
            made = self.merged.get(rights[i] << 32 | lefts[j])
            # Of equal pairs the leftmost is merged first: inside a, then over the border, then inside b.
            if made is not None and made < grows and made <= follows:
                return made
            if grows == follows == NEVER:
                return None
            i, j = i + (grows <= follows), j + (follows <= grows)

    def whole(self, token: int) -> bool:
        """Whether the symbols of ``token`` are merged to it and not otherwise. Its parts are asked first."""
        a, b = self.left[token], self.right[token]
        return a < 0 or (self.crossing(a, b) == token and self.whole(a) and self.whole(b))


def lowered(text: str) -> str:
    """NFC and lower case, each letter for itself: a sigma at the end of a word is one like any other."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class _Kept(dict):
    """Ids of what stands between white space, or of words in it, as 4 bytes each; long ones are worked out anew.

    When full it becomes the older of two halves, and what is asked for again moves to the newer one.
    """

    def __init__(self, work):
        self.work, self.older = work, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part)
        if found is None:
            found = self.work(part)
        if len(part) <= LONG:
            if len(self) >= CACHE_WORDS:
                self.older = self.copy()
                self.clear()
            self[part] = found
        return found


class Encoder:
    """Encodes texts; kept by a worker for its tasks."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.first, self.last = v.first.tolist(), v.last.tolist()
        self.link, self.length = v.link.tolist(), v.length.tolist()
        self.moves: list[dict[int, int]] = [{} for _ in self.link]
        for key, to in zip(v.keys.tolist(), v.targets.tolist()):
            self.moves[key >> 16][key & 0xFFFF] = to
        #: For each state the tokens that end there with their lengths, longest first; states share them.
        self.ending: list[tuple] = [()] * len(self.link)
        for state in np.argsort(v.length, kind="stable").tolist():
            above = self.ending[v.above[state]] if v.above[state] >= 0 else ()
            own = ((int(v.token[state]), self.length[state]),) if v.token[state] >= 0 else ()
            self.ending[state] = own + above if own else above
        self.compatible = Pairs(v.left, v.right)
        self.heads: dict[bytes, tuple[list[int], int, int]] = {}
        self.parts = _Kept(self.part)
        self.symbols = dict(zip(v.token[v.token >= 0].tolist(), v.length[v.token >= 0].tolist()))
        self.odd = re.compile("[\x1c-\x1f]|" + "|".join(map(re.escape, v.added)))
        self.added = re.compile("(" + "|".join(map(re.escape, v.added)) + ")")
        self.known: dict[str, bool] = {}
        self.usual: set[str] = set()
        self._library = None

    def word(self, word: str) -> list[int]:
        """The ids of one word: the last token of every prefix, then back from the end.

        What is stored for a prefix holds for every word that goes on from there, so it is kept for common beginnings.
        """
        data = word.encode()
        if len(data) > HEAD:
            head = data[:HEAD]
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) >= CACHE_HEADS:
                    self.heads.clear()
                known = self.heads[head] = self.follow([self.first[b] for b in head], [-1], 0, 0)
            ends, state, size = known[0].copy(), known[1], known[2]
            symbols = [self.first[b] for b in data[HEAD:-1]]
        else:
            ends, state, size = [-1], 0, 0
            symbols = [self.first[b] for b in data[:-1]]
        symbols.append(self.last[data[-1]])
        self.follow(symbols, ends, state, size)
        out, i, lengths = [], len(data), self.symbols
        while i:
            out.append(ends[i])
            i -= lengths[ends[i]]
        return out[::-1]

    def follow(self, symbols: list[int], ends: list[int], state: int, size: int) -> tuple[list[int], int, int]:
        """Goes on with ``symbols`` from a state of the automaton and the ``size`` of what it has matched there."""
        moves, link, length, ending, fits = self.moves, self.link, self.length, self.ending, self.compatible
        for i, c in enumerate(symbols, len(ends)):
            out = moves[state]
            while c not in out:
                state = link[state]
                size = length[state]
                out = moves[state]
            state, size = out[c], size + 1
            for t, n in ending[state if length[state] == size else link[state]]:
                before = ends[i - n]
                if before < 0 or fits[before << 32 | t]:
                    ends.append(t)
                    break
        return ends, state, size

    def packed(self, word: str) -> bytes:
        ids = self.word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if self.odd.search(text) or not (text.isascii() or self.usual >= (letters := set(text)) or all(map(self.is_usual, letters))):
            return self.unlike(text)
        return b"".join(map(self.parts.__getitem__, lowered(text).split()))

    def unlike(self, text: str) -> bytes:
        """The ids of a text with added tokens, or with characters that only the library cuts right."""
        out = []
        for k, piece in enumerate(self.added.split(text)):
            if k % 2:
                out.append(struct.pack("<I", self.vocabulary.added[piece]))
            else:
                out += map(self.packed, self.library(piece))
        return b"".join(out)

    def part(self, part: str) -> bytes:
        """The ids of what stands between white space, lower case already."""
        if part.isalpha():
            return self.packed(part)
        cut = WORDS.findall(part)
        return self.packed(part) if len(cut) == 1 else b"".join(map(self.parts.__getitem__, cut))

    def is_usual(self, c: str) -> bool:
        """Whether the library lowers and classes a character as Python does."""
        if c not in self.known:
            lower = lowered(c)
            tried = [before + lower * 2 for before in ("a", "1", "!", "'")]
            same = self.library(c, cut=False) in (lower, " " if lower.isspace() else lower)
            self.known[c] = same and all(self.library(t) == WORDS.findall(t) for t in tried)
            if self.known[c]:
                self.usual.add(c)
        return self.known[c]

    def library(self, text: str, cut: bool = True):
        """The text as the library normalises it, cut into words or not."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.vocabulary.head)
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)] if cut else text


@lru_cache(maxsize=2)
def _encoder(digest: str, shared) -> Encoder:
    return Encoder(shared.value)


def encode_bpe(
    docs: DataFrame, tokenizer: str | None = None, text_col: str = "text", out_col: str = "ids", digest_col: str = "ids_sha256"
) -> DataFrame:
    """``docs`` with the ids of each text and a digest of them as last columns, which replace columns of these names.

    The ids are what the tokenizers library gives for the file without adding special tokens; written ones become
    their ids. The digest is the sha256 of the ids as little-endian unsigned 32-bit integers. The path of the file is read on the
    driver; vocabulary and automaton are broadcast, their size is that of the file. Null and empty texts get an empty
    array. Each text is encoded whole and for itself, so repeated rows have equal ids.
    """
    vocabulary = Vocabulary.load(tokenizer or default_tokenizer())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    digest = sha256("\n".join(vocabulary.names).encode()).hexdigest()
    kept = [c for c in docs.columns if c not in (out_col, digest_col)]
    fed, at = with_text(docs, kept, text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(digest, shared)
        for batch in batches:
            for row, _, offsets in chunks(batch.column(at)):
                part = batch.slice(row, len(offsets) - 1)
                found = [encoder.encode(t) if t else b"" for t in part.column(at).to_pylist()]
                ends = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in found], out=ends[1:])
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                digests = pa.array([sha256(x).hexdigest() for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids, digests], [*kept, out_col, digest_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return fed.mapInArrow(encode, ", ".join([*fields, f"`{out_col}` array<int>", f"`{digest_col}` string"]))


def decode_bpe(docs: DataFrame, tokenizer: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``ids_col`` replaced by its decoded text, as a last column: the names of the tokens, special ones
    included, with a space between, as the library decodes with a file that names no decoder. Null gives an empty text."""
    vocabulary = Vocabulary.load(tokenizer or default_tokenizer())
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.names)
    kept = [c for c in docs.columns if c not in (ids_col, out_col)]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value.__getitem__
        for batch in batches:
            for row in range(0, len(batch), 256):
                part = batch.slice(row, 256)
                ids = part.column(0)
                found = [" ".join(map(names, x.values.to_numpy().tolist())) if x.is_valid else "" for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.string())], [*kept, out_col])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return docs.select(F.col(ids_col).alias("_ids"), *kept).mapInArrow(decode, ", ".join([*fields, f"`{out_col}` string"]))
