import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from webframe.llm import treap_search
from webframe.llm.treap_search import Treap, lexical_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return WORD.findall((text or "").translate(SMALL))


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item."""
    tf = [Counter(terms(text)) for _, text in docs]
    n = [c.total() for c in tf]
    documents, size, df = sum(x > 0 for x in n), sum(n), Counter(t for c in tf for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked, scores = {t for i, text in items if i == item for t in terms(text)}, []
        for (doc, _), c, x in zip(docs, tf, n):
            score = 0
            for t in asked:
                w = floor(1000 * log((2 * documents + 2) / (2 * df[t] + 1)))
                score += c[t] and w * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * x * documents // size)))
            if score:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(rng, n):
    words = [f"W{k}" for k in range(40)] + ["Éa", "éa", "x1", "日本", "the", "The", "a_b", "c-d"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for k in range(n)]
    # Copies have equal scores.
    docs += [(n + k, docs[rng.randrange(n)][1]) for k in range(n // 3)]
    return docs, [(k, " ".join(rng.choices(words, k=rng.randrange(0, 12)))) for k in range(25)]


@pytest.mark.parametrize("block_docs, batch", [(1 << 14, 64), (7, 1), (40, 3)])
def test_against_brute_force(monkeypatch, block_docs, batch):
    rng = random.Random(block_docs)
    docs, items = corpus(rng, 150)
    monkeypatch.setattr(treap_search, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(treap_search, "BATCH", batch)
    # The task's own code, over several batches and blocks.
    tf = [Counter(terms(t)) for _, t in docs]
    df, size = Counter(t for c in tf for t in c), sum(c.total() for c in tf)
    documents = sum(bool(c) for c in tf)
    asked = treap_search._asked([type("R", (), {"item": i, "term": t}) for i, text in items for t in set(terms(text))])
    weight = np.array([floor(1000 * log((2 * documents + 2) / (2 * df[t.decode()] + 1))) for t in asked.terms])
    search = treap_search.Searcher(asked, treap_search.Weights(documents, size, weight), 10)
    order = rng.sample(docs, len(docs))
    for at in range(0, len(docs), 30):
        part = order[at : at + 30]
        search.add(pa.array([d for d, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string()))
    search.search()
    got = [(i, rank, x[1], x[0]) for (i, _), best in zip(asked.items, search.best) for rank, x in enumerate(best, 1)]
    assert sorted(got, key=repr) == brute(docs, items, 10)


def test_cells_hold_what_is_below_them():
    rng = np.random.default_rng(3)
    grid = np.where(rng.random((37, 90)) < 0.1, rng.integers(1, 100, (37, 90)), 0)
    row, column = np.nonzero(grid)
    treap = Treap(row, column, grid[row, column], 90)
    assert treap.height == 7
    for r in (0, 5, 36, 60):
        found = dict(zip(*(x.tolist() for x in treap.best(np.array([r]), 1000, 1))))
        assert found == ({c: int(grid[r, c]) for c in np.flatnonzero(grid[r])} if r < 37 else {})
    level = {treap.root: (0, 0, 128)}
    while level:
        below = {}
        for cell, (r, c, side) in level.items():
            assert treap.largest[cell] == grid[r : r + side, c : c + side].max()
            if side > 1:
                for q in range(4):
                    to = int(treap.quarter(np.array([cell]), np.array([q]))[0])
                    if to:
                        below[to] = (r + (q >> 1) * side // 2, c + (q & 1) * side // 2, side // 2)
        level = below


def test_fewer_cells_are_opened_than_there_are(monkeypatch):
    """With one document that has all terms, the search goes down to it and little beside it."""
    rng = np.random.default_rng(1)
    row, column = np.nonzero(rng.random((64, 4096)) < 0.02)
    value = np.full(len(row), 10)
    row, column = np.concatenate([row[column != 1234], np.arange(64)]), np.concatenate([column[column != 1234], np.full(64, 1234)])
    treap, seen = Treap(row, column, np.resize(value, len(row)), 4096), []
    quarter = Treap.quarter
    monkeypatch.setattr(Treap, "quarter", lambda self, cells, q: seen.append(len(cells)) or quarter(self, cells, q))
    monkeypatch.setattr(treap_search, "BATCH", 1)
    assert treap.best(np.arange(64), 1, 1)[0].tolist() == [1234]
    assert sum(seen) < 4096


@pytest.mark.parametrize("pairs", [1 << 20, 30])
def test_rows(spark, monkeypatch, pairs):
    monkeypatch.setattr(treap_search, "BLOCK_TERMS", pairs)
    docs, items = corpus(random.Random(8), 90)
    docs += [(None, docs[3][1]), (5, docs[5][1]), (5, docs[5][1]), (900, None), (901, ""), (902, "--- !"), (903, "W1 " * 30_000 + "é")]
    items += [(3, "W2 W3 extra"), (None, "W1 W2"), (77, None), (78, "nowhere"), (79, " . ")]
    left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS score", "3 AS item_id", "4 AS _doc")
    right = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "5 AS doc_id", "6 AS item")
    got = lexical_search(left.repartition(5), right, k=4)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows(got) == brute(docs, items, 4)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search(docs.limit(0), items).count() == 0
    assert lexical_search(docs, items.limit(0)).dtypes == lexical_search(docs, items).dtypes
    assert lexical_search(docs, items.limit(0)).count() == 0
    assert lexical_search(docs.where("doc_id > 5"), items).count() == 0
    assert rows(lexical_search(docs, items)) == brute([(1, "a b")], [(1, "a")], 10)
