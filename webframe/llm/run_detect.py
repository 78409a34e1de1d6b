"""Periodic runs of words, found in a grammar of the texts.

A run is a stretch of words with smallest period q, at least twice as long as q
and at least ``LEAST`` words, that no neighbouring word extends with that
period. The word ids of a chunk of documents are compressed by Re-Pair: a pair of
neighbouring symbols that occurs again becomes a nonterminal, the most frequent
pairs first, until no pair occurs twice. What is left of each document is joined
two by two to one tree. Every run crosses the boundary of exactly one lowest node
around it, and that node sees it whole. So for each nonterminal the runs over the
boundary of its two parts are worked out once, at one of its places, and moved
to all its places in the derivation; those cut off by the end of a nonterminal lie
inside a longer one of the same period, and intervals of one period that share
at least a period are one run.

A round of Re-Pair replaces all occurrences that have more than their neighbours to
gain at once, which takes the most frequent pair of all everywhere and others
where they don't touch it. All steps work on whole arrays.

A run over a boundary has at least one period on one side of it. So it repeats
the word behind the boundary at that distance before, or the word before it at
that distance behind. Such places are candidates; common extensions come from
prefix hashes. Every run is compared word by word in the end; should two hashes
have been equal by chance, the chunk is worked out again without hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from webframe.llm.common import with_text
from webframe.llm.words import SPACE, chunks, words

#: Fewest words of a run.
LEAST = 12
#: Bytes of texts whose words are compressed by one grammar; a longer text is a chunk of its own.
CHUNK = 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: the index of each of sum(c) elements, and its number within the index."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Sequence:
    """Words of several documents one after another, with hashes of their prefixes."""

    def __init__(self, ids: np.ndarray, least: int):
        self.ids, self.least, self.by_hash = ids, least, True
        # A run repeats max(q, least - q) words or more at distance q.
        self.repeats = (least + 1) // 2
        values = np.random.default_rng(7).integers(0, 2**63, int(ids.max(initial=0)) + 1, dtype=np.uint64)
        self.power = np.full(len(ids) + 1, _BASE, np.uint64)
        self.power[0] = 1
        np.cumprod(self.power, out=self.power)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(values[ids] * self.power[:-1], out=self.sums[1:])

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether ``n`` words from ``x`` are those from ``y >= x``, by hash."""
        return (self.sums[x + n] - self.sums[x]) * self.power[y - x] == self.sums[y + n] - self.sums[y]

    def extent(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many words agree, ``most`` at best, from ``x`` and ``y`` on (step 1) or before both (step -1)."""
        low, high = np.zeros_like(x), most.copy()
        if not self.by_hash:
            going = np.flatnonzero(most)
            while len(going):
                k = low[going] if step > 0 else -low[going] - 1
                going = going[self.ids[x[going] + k] == self.ids[y[going] + k]]
                low[going] += 1
                going = going[low[going] < high[going]]
            return low
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            n = (low[open_] + high[open_] + 1) // 2
            back = n if step < 0 else 0
            same = self.equal(x[open_] - back, y[open_] - back, n)
            low[open_] = np.where(same, n, low[open_])
            high[open_] = np.where(same, high[open_], n - 1)

    def crossing(self, left: np.ndarray, middle: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, ...]:
        """(node, start, end, period) of the runs within ``[left, right)`` that hold the words on both sides of ``middle``.

        Maximal within the node; of several periods of one interval the smallest.
        """
        s = self.ids
        node, k = spread(middle - left)
        at = left[node] + k
        hit = np.flatnonzero(s[at] == s[middle[node]])
        node_l, x_l = node[hit], at[hit]
        period_l = middle[node_l] - x_l
        node, k = spread(right - middle)
        at = middle[node] + k
        hit = np.flatnonzero(s[at] == s[middle[node] - 1])
        node_r, y_r = node[hit], at[hit]
        period_r = y_r - middle[node_r] + 1
        # Both as (node, x, period) where word x agrees with word x + period.
        node = np.concatenate([node_l, node_r])
        x = np.concatenate([x_l, middle[node_r] - 1])
        period = np.concatenate([period_l, period_r])
        x, node, period = self._enough(x, node, period, left, right)
        ahead = self.extent(x, x + period, right[node] - x - period, 1)
        behind = self.extent(x, x + period, x - left[node], -1)
        start, end = x - behind, x + ahead + period
        good = np.flatnonzero(end - start >= np.maximum(self.least, 2 * period))
        node, start, end, period = node[good], start[good], end[good], period[good]
        order = np.lexsort((period, end, start, node))
        node, start, end, period = node[order], start[order], end[order], period[order]
        first = np.ones(len(node), bool)
        first[1:] = (node[1:] != node[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        return node[first], start[first], end[first], period[first]

    def _enough(self, x, node, period, left, right):
        """Drops candidates that agree on fewer words in a row than any run does; keeps the rest."""
        s, low, high = self.ids, left[node], right[node] - period
        count = np.ones(len(x), np.int64)
        for step in (1, -1):
            going = np.arange(len(x))
            for k in range(1, self.repeats):
                to = x[going] + step * k
                inside = (to < high[going]) if step > 0 else (to >= low[going])
                going, to = going[inside], to[inside]
                going = going[s[to] == s[to + period[going]]]
                if not len(going):
                    break
                count[going] += 1
        keep = count >= self.repeats
        return x[keep], node[keep], period[keep]

    def runs(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs, by start and period. ``bounds`` are the borders of the documents."""
        found = self._runs(bounds)
        if self.by_hash and not self._right(*found):
            # Words made to have equal hashes: extensions word by word instead.
            self.by_hash = False
            found = self._runs(bounds)
        return found

    def _right(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
        of, k = spread(end - start - period)
        return bool((self.ids[start[of] + k] == self.ids[start[of] + k + period[of]]).all())

    def _runs(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grammar = Grammar(self.ids, bounds)
        rule, start, end, period = [], [], [], []
        while grammar.round():
            new = np.flatnonzero(grammar.size[grammar.fresh] >= self.least)
            made, place = grammar.fresh[new], grammar.place[new]
            found = self.crossing(place, place + grammar.size[grammar.left[made]], place + grammar.size[made])
            rule.append(made[found[0]])
            start.append(found[1] - place[found[0]])
            end.append(found[2] - place[found[0]])
            period.append(found[3])
        rule, start, end, period = (_joined(x) for x in (rule, start, end, period))
        order = np.argsort(rule, kind="stable")
        rule, start, end, period = rule[order], start[order], end[order], period[order]
        symbol, at = grammar.occurrences(self.least)
        first, last = np.searchsorted(rule, symbol), np.searchsorted(rule, symbol, "right")
        of, k = spread(last - first)
        k += first[of]
        out = [(at[of] + start[k], at[of] + end[k], period[k])]
        for nodes in grammar.trees(self.least):
            out.append(self.crossing(*nodes)[1:])
        return self.merged(*(_joined(x) for x in zip(*out)))

    def merged(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
        """Intervals of one period that share at least a period, as one."""
        order = np.lexsort((-end, start, period))
        start, end, period = start[order], end[order], period[order]
        group = np.cumsum(np.diff(period, prepend=period[:1]) != 0)
        far = len(self.ids) + 1
        reach = np.maximum.accumulate(end + group * far) - group * far
        new = np.ones(len(start), bool)
        new[1:] = (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1 if len(first) else first
        start, end, period = start[first], reach[last], period[first]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def _joined(parts) -> np.ndarray:
    parts = [p for p in parts if len(p)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


class Grammar:
    """Re-Pair over the words of several documents; no pair reaches over the border of two."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        self.at = np.arange(len(ids))
        self.symbols = ids.astype(np.int64)
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.terminals = int(ids.max(initial=-1)) + 1
        self.end = int(len(ids))
        self.size = np.ones(self.terminals, np.int64)
        self.left = np.full(self.terminals, -1)
        #: Pairs that have a nonterminal, sorted, and the nonterminals.
        self.pairs, self.names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: Pairs that may occur again: a pair that occurs once never comes back.
        self.open = np.ones(max(len(ids) - 1, 0), bool)
        self.used: list[tuple[np.ndarray, np.ndarray]] = []
        #: The nonterminals of the last round, and one place of each.
        self.fresh = self.place = np.zeros(0, np.int64)

    def round(self) -> bool:
        """One round; whether any pair was replaced."""
        s = self.symbols
        self.open &= self.doc[:-1] == self.doc[1:] if len(s) else False
        at = np.flatnonzero(self.open)
        keys = s[at] << 32 | s[at + 1]
        pairs, pair, count = np.unique(keys, return_inverse=True, return_counts=True)
        known = self.named(pairs)
        again = (count > 1) | (known >= 0)
        self.open[at[~again[pair]]] = False
        # Of equal pairs in a row, as in a a a, every other one.
        start = np.ones(len(at), bool)
        start[1:] = (at[1:] != at[:-1] + 1) | (pair[1:] != pair[:-1])
        nth = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        gain = np.zeros(len(s) + 1, np.int64)
        gain[at + 1] = np.where(again[pair] & (nth % 2 == 0), count[pair] * (len(pairs) + 1) + len(pairs) - pair, 0)
        best = (gain[1:-1] > gain[:-2]) & (gain[1:-1] > gain[2:]) if len(s) > 1 else np.zeros(0, bool)
        taken = best[at]
        twice = (np.bincount(pair[taken], minlength=len(pairs)) > 1) | (known >= 0)
        taken &= twice[pair]
        at, pair = at[taken], pair[taken]
        if not len(at):
            return False
        used, first = np.unique(pair, return_index=True)
        new = used[known[used] < 0]
        known[new] = np.arange(len(new)) + len(self.size)
        self.fresh, self.place = known[new], self.at[at[first[known[used] >= len(self.size)]]]
        parts = pairs[new] >> 32, pairs[new] & 0xFFFFFFFF
        self.left = np.concatenate([self.left, parts[0]])
        self.size = np.concatenate([self.size, self.size[parts[0]] + self.size[parts[1]]])
        order = np.argsort(all_ := np.concatenate([self.pairs, pairs[new]]))
        self.pairs, self.names = all_[order], np.concatenate([self.names, known[new]])[order]
        symbol = known[pair]
        self.used.append((symbol, self.at[at]))
        self.symbols[at] = symbol
        touched = np.zeros(len(s) + 1, bool)
        touched[at] = touched[at + 1] = touched[at - 1] = True
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        opened = np.append(self.open, False)
        opened |= touched[:-1]
        # A pair now begins at its first symbol and ends at the next one that is left.
        self.symbols, self.at, self.doc, opened = s[keep], self.at[keep], self.doc[keep], opened[keep]
        self.open = opened[:-1]
        return True

    def named(self, pairs: np.ndarray) -> np.ndarray:
        """The nonterminals of pairs, -1 for those that have none."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.names[at], -1)

    def occurrences(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(nonterminal, place in the text) of all places in the derivation, for expansions of ``least`` words or more."""
        symbol, at = (_joined(x) for x in zip(*self.used)) if self.used else (self.place, self.place)
        long = self.size[symbol] >= least
        return symbol[long], at[long]

    def trees(self, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, boundary, end) of the nodes that join what is left of each document, one level after another."""
        at, doc = self.at, self.doc
        while True:
            first = np.ones(len(at), bool)
            first[1:] = doc[1:] != doc[:-1]
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            ends = np.append(at[1:], self.end)
            second = np.flatnonzero(nth % 2)
            if not len(second):
                return
            nodes = at[second - 1], at[second], ends[second]
            long = nodes[2] - nodes[0] >= least
            yield tuple(x[long] for x in nodes)
            at, doc = at[nth % 2 == 0], doc[nth % 2 == 0]


class Texts:
    """The words of a chunk of documents, each with a space behind it, their ids, and the borders of the documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, rows = words(data, offsets)
        size = ends - starts
        letters = data[~SPACE[data]]
        text = np.full(len(letters) + len(size), 0x20, np.uint8)
        text[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
        borders = np.concatenate([[0], np.cumsum(size + 1)])
        buffers = [None, pa.py_buffer(borders.astype(np.int64)), pa.py_buffer(text)]
        self.words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), buffers)
        self.ids = self.words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.bounds = np.searchsorted(rows, np.arange(len(offsets)))

    def joined(self, kept: np.ndarray) -> list[bytes]:
        """The words with the mark ``kept`` of each document, with one space between."""
        at = np.flatnonzero(kept)
        words = self.words.take(pa.array(at))
        borders = np.frombuffer(words.buffers()[1], np.int64)[: len(at) + 1] if len(at) else np.zeros(1, np.int64)
        text = words.buffers()[2].to_pybytes() if len(at) else b""
        ends = borders[np.searchsorted(at, self.bounds)].tolist()
        return [text[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]


def find_runs(
    docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least: int = LEAST
) -> DataFrame:
    """``docs`` with the runs of each text and the text without repeats as last columns, which replace columns of these names.

    ``runs`` are (start, length, period) in words counted from 0, by start and period. ``collapsed`` keeps a word unless
    a run contains it behind its first period, with one space between words. Words are what stands between ASCII
    white space, compared byte by byte. Null and empty texts have no run and an empty ``collapsed``. Every
    text is read whole and for itself; memory grows with the longest one.
    """
    kept = [c for c in docs.columns if c not in (runs_col, collapsed_col)]
    fed, place = with_text(docs, kept, text_col)
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column(place), CHUNK):
                part = batch.slice(row, len(offsets) - 1)
                texts = Texts(data, offsets)
                start, end, period = Sequence(texts.ids, least).runs(texts.bounds)
                ends = np.searchsorted(start, texts.bounds)
                first = np.repeat(texts.bounds[:-1], np.diff(ends))
                fields = [pa.array(x, pa.int64()) for x in (start - first, end - start, period)]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind)))
                covered = np.zeros(len(texts.ids) + 1, np.int64)
                np.add.at(covered, start + period, 1)
                np.add.at(covered, end, -1)
                collapsed = pa.array(texts.joined(np.cumsum(covered[:-1]) == 0), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], runs, collapsed], [*kept, runs_col, collapsed_col])

    out = f"`{runs_col}` array<struct<start:bigint,length:bigint,period:bigint>>, `{collapsed_col}` string"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return fed.mapInArrow(find, ", ".join([*fields, out]))
