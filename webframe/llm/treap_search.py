"""Ranked lexical search by a K2-treap over the grid of terms and documents.

Rows of the grid are the terms that are asked for, frequent ones first, columns
are documents. A point is a term in a document, its value is what it adds to the score
of an item with that term. The grid is a quadtree of cells of equal sides; only cells with
points are stored, each with a mask of its four quarters, the place of the first of
them and the largest value below it.

An item descends along the rows of all its terms at once. A node of the search is a
range of documents together with the cell of each row there, and the sum of
the cells' maxima bounds the score of every document of the range. The best ranges are
halved first, and the search ends when no range left can reach the k-th best document found.

Every task indexes and searches its documents in blocks, so no index is moved. Documents
number is what a block is bounded by, and a block searches with the k-th best of the ones before it.
Items are taken in blocks too, of a bounded number of terms, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webframe.llm.common import Scratch, lower_ascii
from webframe.llm.words import LOWER, chunks, words

#: Terms are maximal stretches of these: ASCII letters and digits, and all that is not ASCII.
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Most documents, and about the most points, of one treap.
BLOCK_DOCS, BLOCK_POINTS = 1 << 14, 1 << 21
#: Most (item, term) pairs that are searched for in one pass over the documents.
BLOCK_TERMS = 1 << 20
#: Ranges that are halved at a time.
BATCH = 64
#: Groups in which the best of an item are chosen before the last choice.
GROUPS = 64
_BEFORE = np.array([[bin(mask & ((1 << quarter) - 1)).count("1") for quarter in range(4)] for mask in range(16)], np.int64)


@dataclass(frozen=True)
class Asked:
    """One block of items: the terms in the order of rows, and the items as rows."""

    terms: list[bytes]
    items: list[tuple[object, np.ndarray]]


@dataclass(frozen=True)
class Weights:
    """Numbers of documents with a term and of all terms, and a weight for each row."""

    documents: int
    length: int
    weight: np.ndarray

    def value(self, rows: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a term adds that occurs ``tf`` times in a document of ``n`` terms."""
        m = 100 - 90 + 90 * n * self.documents // max(self.length, 1)
        return self.weight[rows] * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def points(column: pa.Array, terms: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row of the chunk, number of terms of each text, and document, row of the grid, occurrences of each point)."""
    for row, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, of = words(data, offsets, NO_TERM)
        size = ends - starts
        borders = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        buffers = [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data[~NO_TERM[data]]))]
        found = pc.index_in(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), buffers), value_set=terms)
        found = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = np.flatnonzero(found >= 0)
        point, tf = np.unique(of[hit] * len(terms) + found[hit], return_counts=True)
        yield row, np.bincount(of, minlength=len(offsets) - 1), point // len(terms), point % len(terms), tf


class Treap:
    """Cells of a quadtree over ``side`` rows and columns, level by level from the points up; cell 0 stands for all empty ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, side: int):
        self.height = max(1, (side - 1).bit_length())
        code = np.zeros(len(row), np.int64)
        for bit in range(self.height):
            code |= (row >> bit & 1) << (2 * bit + 1) | (column >> bit & 1) << (2 * bit)
        order = np.argsort(code)
        code, largest, place = code[order], value[order], 1
        masks, firsts, maxima = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        masks.append(np.zeros(len(code), np.int64))
        firsts.append(np.zeros(len(code), np.int64))
        maxima.append(largest)
        for _ in range(self.height):
            start = np.flatnonzero(np.diff(code >> 2, prepend=-1))
            masks.append(np.bitwise_or.reduceat(1 << (code & 3), start))
            firsts.append(start + place)
            place += len(code)
            largest, code = np.maximum.reduceat(largest, start), code[start] >> 2
            maxima.append(largest)
        self.root = place
        self.mask = np.concatenate(masks).astype(np.uint8)
        self.first = np.concatenate(firsts).astype(np.int32)
        self.largest = np.concatenate(maxima)

    def quarter(self, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.mask[cells]
        return np.where(mask >> quarter & 1, self.first[cells] + _BEFORE[mask, quarter], 0)

    def best(self, rows: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(column, score) of the documents that can be among the k best of an item with these rows.

        ``least`` is a score that is reached k times already. Documents with the score of the k-th best are all found.
        """
        found_at, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cells = np.full((1, len(rows)), self.root)
        kept = [cells]
        agenda = [(-int(self.largest[self.root]) * len(rows), 0, 0, self.height, 0)]
        while agenda and -agenda[0][0] >= least:
            taken = [heappop(agenda) for _ in range(min(BATCH, len(agenda)))]
            taken = [t for t in taken if -t[0] >= least]
            cells = np.stack([kept[block][at] for _, block, at, _, _ in taken])
            level = np.array([t[3] for t in taken]) - 1
            column = np.array([t[4] for t in taken])
            down = (rows[None, :] >> level[:, None] & 1) << 1
            cells = np.concatenate([self.quarter(cells, down), self.quarter(cells, down | 1)])
            bound = self.largest[cells].sum(1)
            level, column = np.concatenate([level, level]), np.concatenate([column * 2, column * 2 + 1])
            left = np.flatnonzero(bound >= least)
            at_end = left[level[left] == 0]
            if len(at_end):
                found_at, found = np.concatenate([found_at, column[at_end]]), np.concatenate([found, bound[at_end]])
                if len(found) >= k:
                    least = max(least, int(np.partition(found, -k)[-k]))
                    found_at, found = found_at[found >= least], found[found >= least]
            left = left[(level[left] > 0) & (bound[left] >= least)]
            if len(left):
                kept.append(cells[left])
                for at, x in enumerate(zip((-bound[left]).tolist(), level[left].tolist(), column[left].tolist())):
                    heappush(agenda, (x[0], len(kept) - 1, at, x[1], x[2]))
        return found_at, found


class Searcher:
    """The best documents of each item among those a task has seen."""

    def __init__(self, asked: Asked, weights: Weights, k: int):
        self.asked, self.weights, self.k = asked, weights, k
        self.terms = pa.array(asked.terms, pa.large_binary())
        #: For each item (score, id, whether the id is null), the best first.
        self.best: list[list[tuple[int, int, bool]]] = [[] for _ in asked.items]
        self._clear()

    def _clear(self) -> None:
        self.ids: list[pa.Array] = []
        self.block: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.documents = self.points = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        for row, n, document, term, tf in points(texts, self.terms):
            value = self.weights.value(term, tf, n[document])
            self.ids.append(ids[row : row + len(n)])
            self.block.append((term, document + self.documents, value))
            self.documents, self.points = self.documents + len(n), self.points + len(term)
            if self.documents >= BLOCK_DOCS or self.points >= BLOCK_POINTS:
                self.search()

    def search(self) -> None:
        """Searches the documents that have come since the last time."""
        if self.points:
            side = max(self.documents, len(self.terms))
            treap = Treap(*(np.concatenate(x) for x in zip(*self.block)), side)
            ids = pa.concat_arrays(self.ids)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for item, (_, rows) in enumerate(self.asked.items):
                best = self.best[item]
                least = max(1, best[-1][0]) if len(best) == self.k else 1
                at, score = treap.best(rows, self.k, least)
                if len(at):
                    best += zip(score.tolist(), ids[at].tolist(), null[at].tolist())
                    best.sort(key=lambda x: (-x[0], x[2], x[1]))
                    del best[self.k :]
        self._clear()

    def results(self) -> pa.RecordBatch:
        flat = [(item, None if null else doc, score) for item, best in enumerate(self.best) for score, doc, null in best]
        columns = list(zip(*flat)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_item", "_doc", "score"])


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term) once each. Texts of one item count together; items without terms have no row."""
    found = F.regexp_extract_all(lower_ascii(F.coalesce(text_col, F.lit(""))), F.lit(TERMS), F.lit(0))
    return items.select(F.col(item_col).alias("item"), F.explode(found).alias("term")).distinct()


def _asked(rows: list) -> Asked:
    """Rows of the grid are in the order in which terms are asked for most; likely frequent ones are neighbours."""
    of_item: dict[object, list[str]] = {}
    count: dict[str, int] = {}
    for r in rows:
        of_item.setdefault(r.item, []).append(r.term)
        count[r.term] = count.get(r.term, 0) + 1
    order = sorted(count, key=lambda t: (-count[t], t))
    place = {t: k for k, t in enumerate(order)}
    return Asked([t.encode() for t in order], [(i, np.array(sorted(map(place.get, terms)))) for i, terms in of_item.items()])


def _weights(docs: DataFrame, asked: Asked) -> tuple[Asked, Weights]:
    """One pass over all documents counts them, their terms and the documents of each term asked for. Rows are then
    ordered by these counts."""
    names = asked.terms

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, count, size, documents = pa.array(names, pa.large_binary()), np.zeros(len(names), np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in points(batch.column(0), terms):
                count += np.bincount(term, minlength=len(count))
                documents, size = documents + int((n > 0).sum()), size + int(n.sum())
        held = np.flatnonzero(count)
        columns = np.concatenate([[-2, -1], held]), np.concatenate([[documents, size], count[held]])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "n"])

    found = docs.select("_text").mapInArrow(counted, "row long, n long").groupBy("row").agg(F.sum("n").alias("n"))
    number = {r.row: r.n for r in found.collect()}
    documents, size = number.get(-2, 0), number.get(-1, 0)
    df = [number.get(k, 0) for k in range(len(names))]
    weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * n + 1))) for n in df], np.int64)
    order = np.argsort(-np.array(df, np.int64), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    asked = Asked([names[k] for k in order], [(i, np.sort(place[rows])) for i, rows in asked.items])
    return asked, Weights(documents, size, weight[order])


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents with the highest scores above 0 of each item, equal ones by id.

    With N documents that hold terms, L terms in all, n in a document, df documents with a term, tf occurrences in
    the document: w = floor(1000 ln((2N+2)/(2df+1))), m = 10 + 90nN div L, and a document scores the sum of
    w (10^9 tf div (1000 tf + 8m)) over the item's distinct terms, in 64-bit integers.

    Null and empty texts hold no term. Documents are rows: of repeated ones each has its rank, null ids come last among equals.
    Rows of one item id are one item; items without terms, or whose terms are nowhere, have no row. Ids of documents are integers.
    The driver holds one block of items at a time, of about ``BLOCK_TERMS`` pairs of item and term at most (one item
    more than that is taken whole), and counts for their terms; documents are read twice for each block.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_col).cast("long").alias("_doc"), F.col(text_col).alias("_text"))
    terms = item_terms(items, item_col, text_col)
    blocks = max(1, -(-terms.count() // (BLOCK_TERMS // 2)))
    kind = items.schema[item_col].dataType.simpleString()
    scratch, out = Scratch(spark, "search") if blocks > 1 else None, None
    for block in range(blocks):
        asked = _asked(terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect())
        found = _search(docs, asked, k, kind)
        found = scratch.save(found, f"block-{block}") if scratch else found
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("item").alias(item_col), "rank", F.col("_doc").alias(doc_col), "score")


def _search(docs: DataFrame, asked: Asked, k: int, kind: str) -> DataFrame:
    spark = docs.sparkSession
    if not asked.items:
        return spark.createDataFrame([], f"item {kind}, rank int, _doc long, score long")
    shared = spark.sparkContext.broadcast(_weights(docs, asked))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, k)
        for batch in batches:
            searcher.add(batch.column(0), batch.column(1))
        searcher.search()
        yield searcher.results()

    found = docs.mapInArrow(searched, "_item long, _doc long, score long")
    order = F.desc("score"), F.asc_nulls_last("_doc")
    # A task has k rows an item at most; so that no item is one task, the best of groups come first.
    found = found.withColumn("_group", F.pmod(F.xxhash64("_doc", "score"), F.lit(GROUPS)))
    for keys in (["_item", "_group"], ["_item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asked.items)], f"_item long, item {kind}")
    return found.join(names, "_item").select("item", "rank", "_doc", "score")
