"""Language identification of mixed text: script ranges, per-word scores, Viterbi over words.

The model counts hashed letter trigrams (with word boundaries) for each language,
and which scripts a language is written in. A word's score for a language is the
log probability of its trigrams; languages not written in the word's script are
set back. Viterbi with a penalty for each switch then labels the words of a
document, so a few odd words do not break a span but a passage in another
language does. All documents of a chunk take a step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webframe.llm.common import with_text
from webframe.llm.words import chunks

UNKNOWN = "und"
#: Trigram counters of a language.
BUCKETS = 1 << 16
#: Cost of changing the language between two words, in nats, and of a language not written in a word's script.
SWITCH, WRONG_SCRIPT = 12.0, 30.0
#: A language is written in a script that has this share of its letters.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5
_CHUNK = 1 << 20
#: First code points of the Unicode blocks that tell scripts apart.
SCRIPT_RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x32000, "other"),
)
SCRIPTS = list(dict.fromkeys(name for _, name in SCRIPT_RANGES))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter, or 0 if it is no letter, and its script."""
    n = 0x110000
    lower, script = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
    for cp in range(n):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            lower[cp] = ord(low) if len(low) == 1 else cp
    starts = [a for a, _ in SCRIPT_RANGES] + [n]
    for (a, name), b in zip(SCRIPT_RANGES, starts[1:]):
        script[a:b] = SCRIPTS.index(name)
    return lower, script


def _letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the letters of a chunk: row, place in the row, script, trigram bucket, and whether one starts a word."""
    lower, scripts = _tables()
    cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    low = lower[cps]
    # Rows are apart: what lies before the first and after the last letter of a row is no letter.
    gap_before, gap_after = np.zeros(len(cps) + 1, bool), np.zeros(len(cps) + 1, bool)
    gap_before[begin[:-1]] = True
    gap_after[begin[1:]] = True
    before = np.where(gap_before[:-1], 0, np.concatenate([[0], low[:-1]])) if len(low) else low
    after = np.where(gap_after[1:], 0, np.concatenate([low[1:], [0]])) if len(low) else low
    at = np.flatnonzero(low)
    before, low, after = (x[at].astype(np.uint64) for x in (before, low, after))
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (low * np.uint64(0xC2B2AE3D27D4EB4F)) + after * np.uint64(
        0x165667B19E3779F9
    )
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
    row = np.searchsorted(begin, at, "right") - 1
    return row, at - begin[row], scripts[cps[at]], bucket, before == 0


def train(labelled: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by bucket and language, scripts by language), from all rows.

    Only counts reach the driver, at most BUCKETS and the scripts for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for row, data, offsets in chunks(batch.column(0), _CHUNK):
                langs = batch.column(1).slice(row, len(offsets) - 1).dictionary_encode()
                of, _, script, bucket, _ = _letters(data, offsets)
                own = langs.indices.to_numpy()[of]
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    if lang not in totals:
                        totals[lang] = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
                    totals[lang] += np.bincount(bucket[own == k], minlength=BUCKETS + len(SCRIPTS))
                    totals[lang][BUCKETS:] += np.bincount(script[own == k], minlength=len(SCRIPTS))
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "at", "n"]
            )

    fed = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    counted = fed.mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    table = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    table[got["at"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    grams, script = table[:BUCKETS] + SMOOTHING, table[BUCKETS:]
    written = script >= SCRIPT_SHARE * np.maximum(script.sum(0), 1)
    return langs, np.log(grams / grams.sum(0)).astype(np.float32), written


def viterbi(scores: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word; row r has ``counts[r]`` words from ``starts[r]`` on. Rows go step by step together."""
    label = np.zeros(len(scores), np.int64)
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return label
    first, sizes = starts[order], counts[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    moved, source = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
    now = scores[first].astype(np.float64)
    for t in range(1, sizes[0]):
        k = active[t]
        at = first[:k] + t
        top = now[:k].argmax(1)
        change = now[np.arange(k), top][:, None] - switch
        moved[at] = now[:k] < change
        source[at] = top
        now[:k] = np.maximum(now[:k], change) + scores[at]
    state = now.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        label[at] = state[:k]
        state[:k] = np.where(moved[at, state[:k]], source[at], state[:k])
    return label


def _label(data: np.ndarray, offsets: np.ndarray, langs: list[str], grams: np.ndarray, written: np.ndarray, switch: float):
    """Per row: language, share of its letters, spans as (start, end, language) in code points."""
    n = len(offsets) - 1
    row, place, script, bucket, begins = _letters(data, offsets)
    if not langs or not len(row):
        return [UNKNOWN] * n, [0.0] * n, [[]] * n
    word = np.flatnonzero(begins)
    sizes = np.diff(np.append(word, len(row)))
    scores = np.add.reduceat(grams[bucket], word, axis=0)
    fits = written[script[word]]
    scores -= np.where(fits | ~fits.any(1, keepdims=True), 0, WRONG_SCRIPT).astype(np.float32)
    of = row[word]
    counts = np.bincount(of, minlength=n)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    label = viterbi(scores, starts, counts, switch)
    weight = np.bincount(of * len(langs) + label, sizes, n * len(langs)).reshape(n, -1)
    best, total = weight.argmax(1), weight.sum(1)
    names = [langs[b] if t else UNKNOWN for b, t in zip(best, total)]
    share = (weight.max(1) / np.maximum(total, 1)).tolist()
    edge = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (label[1:] != label[:-1])]))
    last = np.append(edge[1:], len(word)) - 1
    end = place[word[last] + sizes[last] - 1] + 1
    spans: list[list] = [[] for _ in range(n)]
    for r, a, b, k in zip(of[edge].tolist(), place[word[edge]].tolist(), end.tolist(), label[edge].tolist()):
        spans[r].append({"start": a, "end": b, "lang": langs[k]})
    return names, share, spans


def identify_language(
    docs: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    switch: float = SWITCH,
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (share of the letters in spans of that language) and ``lang_spans``.

    Learns from the text and language of all rows of ``labelled`` that have a language. Predictions see the whole text
    and nothing else. A null text, or one without a letter, gets "und", score 0 and no spans, as does every text if
    nothing was learned; a text with letters always gets a learned language, the first by name of equals. Columns of
    ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(labelled, text_col, lang_col))
    added = ["lang_pred", "lang_score", "lang_spans"]
    kept = [c for c in docs.columns if c not in added]
    fed, at = with_text(docs, kept, text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, grams, written = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            for row, data, offsets in chunks(batch.column(at), _CHUNK):
                names, share, spans = _label(data, offsets, langs, grams, written, switch)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(row, len(names)).columns[: len(kept)], pa.array(names, pa.string()), pa.array(share, pa.float64()), pa.array(spans, kind)],
                    [*kept, *added],
                )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    schema = ", ".join([*fields, "lang_pred string, lang_score double, lang_spans array<struct<start:int,end:int,lang:string>>"])
    return fed.mapInArrow(label, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: CRC-32 of its id as text leaves 2 when divided by 4; a null id is "". """
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
