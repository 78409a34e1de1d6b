import random
import re
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from webframe.llm.common import table
from webframe.llm.queries import QUERIES
from webframe.llm.run_detect import Grammar, Sequence, Texts, find_runs


def brute(words, least=12):
    """Every stretch that agrees with itself at a distance, for each distance; the smallest of one interval."""
    best, ids = {}, np.unique(np.array(words, object).astype(str), return_inverse=True)[1]
    for q in range(1, len(words) // 2 + 1):
        steps = np.diff(np.concatenate([[0], ids[:-q] == ids[q:], [0]]).astype(int))
        for i, j in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
    return sorted((a, b - a, q) for (a, b), q in best.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(rng):
    k, n, words = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 5, 13, 30, 80, 200]), []
    while len(words) < n:
        kind = rng.random()
        if kind < 0.5 or not words:
            words += [str(rng.randrange(k)) for _ in range(rng.randrange(1, 12))]
        elif kind < 0.8:
            a = rng.randrange(len(words))
            words += words[a : a + rng.randrange(1, 20)] * rng.randrange(1, 5)
        else:
            words += [str(rng.randrange(k))] * rng.randrange(1, 30)
    return words


def chunk(docs):
    texts = [" ".join(d).encode() for d in docs]
    return Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(int))


def found(docs, by_hash=True, least=12):
    texts = chunk(docs)
    sequence = Sequence(texts.ids, least)
    sequence.by_hash = by_hash
    start, end, period = sequence.runs(texts.bounds)
    ends = np.searchsorted(start, texts.bounds)
    return [
        [(int(a - first), int(b - a), int(q)) for a, b, q in zip(start[i:j], end[i:j], period[i:j])]
        for i, j, first in zip(ends, ends[1:], texts.bounds)
    ]


@pytest.mark.parametrize("by_hash", [True, False])
@pytest.mark.parametrize("least", [2, 7, 12])
def test_against_brute_force(by_hash, least):
    rng = random.Random(least)
    for _ in range(60):
        docs = [made(rng) for _ in range(rng.randrange(1, 8))]
        assert found(docs, by_hash, least) == [brute(d, least) for d in docs]


def test_grammar_gives_the_words_back():
    """Each nonterminal expands to what the text has at every place of its derivation, and no pair is left twice."""
    rng = random.Random(1)
    docs = [made(rng) for _ in range(30)]
    texts = chunk(docs)
    grammar = Grammar(texts.ids, texts.bounds)
    parts = {}
    while grammar.round():
        for t in grammar.fresh.tolist():
            parts[t] = None
    pairs = {int(n): (int(p) >> 32, int(p) & 0xFFFFFFFF) for p, n in zip(grammar.pairs, grammar.names)}

    def words(t):
        return words(pairs[t][0]) + words(pairs[t][1]) if t in pairs else [t]

    assert set(pairs) == set(parts) and len(pairs) > 20
    assert [w for t in grammar.symbols.tolist() for w in words(t)] == texts.ids.tolist()
    for t, at in zip(*map(np.ndarray.tolist, grammar.occurrences(0))):
        assert texts.ids[at : at + int(grammar.size[t])].tolist() == words(t)


def test_words_with_equal_hashes():
    """The Thue-Morse sequence and its complement have equal polynomial hashes for every base."""
    word = [bin(i).count("1") % 2 for i in range(1 << 12)]
    docs = [[str(w) for w in word + [1 - w for w in word] + word]]
    want = brute(docs[0])
    assert found(docs) == [want]


def test_long_periods_and_one_word():
    rng = random.Random(4)
    base = [str(rng.randrange(1000)) for _ in range(5000)]
    assert found([base * 3 + base[:77], ["x"] * 20_000]) == [[(0, 15_077, 5000)], [(0, 20_000, 1)]]


def test_rows(spark):
    six = "a b c d e f "
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, six * 2), (4, six * 2), (None, f"x  {six}\n{six} y"), (6, "wordé " * 12), (7, "a " * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("own")).withColumn("start", F.lit(1))
    got = find_runs(docs)
    assert got.columns == ["doc_id", "text", "start", "runs", "collapsed"]
    plain = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in got.collect())
    assert plain == sorted([
        ("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [(0, 12, 6)], "a b c d e f"), ("4", [(0, 12, 6)], "a b c d e f"),
        ("None", [(1, 12, 6)], "x a b c d e f y"), ("6", [(0, 12, 1)], "wordé"), ("7", [], " ".join("a" * 11)),
    ])
    assert find_runs(docs.limit(0)).count() == 0


def test_query(spark, sf):
    def row(doc_id, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
        milli = best[1] and 1000 * best[1] // best[2]
        return doc_id, len(runs), *best, milli, sha256(lines.encode()).hexdigest(), sha256(collapsed(words, runs).encode()).hexdigest()

    got = QUERIES["op13_periodic_runs"](spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert all(t == "bigint" for c, t in got.dtypes if not c.endswith("sha256"))
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert rows.keys() == docs.keys()
    for d, t in docs.items():
        assert rows[d] == row(d, t)
