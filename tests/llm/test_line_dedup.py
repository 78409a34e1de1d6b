import random
import re

import pytest

from webframe.llm.line_dedup import MOST_EDITS, _simhash, drop_fuzzy_lines, fuzzy_line_groups

SCHEMA = "doc_id long, text string, line string, norm string"


def table(spark, docs):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
    return row[-1]


def norm(line):
    return re.sub(r"[0-9]+", "0", re.sub(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ", line.lower())).strip()


def brute(spark, docs):
    """(doc_id, line_no, group_size, kept) by comparing all pairs of distinct lines."""
    lines = sorted({norm(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    df = spark.createDataFrame([((k, 0), x) for k, x in enumerate(lines)], "key struct<x:long,y:int>, norm string")
    sims = {r.key.x: r.sim & (2**64 - 1) for r in _simhash(df).collect()}
    label = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            a, b = lines[i].split(), lines[j].split()
            if (sims[i] ^ sims[j]).bit_count() <= 3 and edits(a, b) <= int(max(len(a), len(b)) * MOST_EDITS):
                label = [label[j] if x == label[i] else x for x in label]
    where = dict(zip(lines, label))
    rows = [(d, k, where.get(norm(x))) for d, t in docs for k, x in enumerate((t or "").split("\n"))]
    out, seen = [], set()
    for d, k, g in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out.append((d, k, 1 if g is None else sum(r[2] == g for r in rows), g is None or g not in seen))
        seen.add(g)
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    got = fuzzy_line_groups(table(spark, docs), **kw).collect()
    return sorted(((r.doc_id, r.line_no, r.group_size, r.kept) for r in got), key=repr)


@pytest.mark.parametrize("parts", [5, 4])
def test_against_all_pairs(spark, parts):
    rng, docs = random.Random(8), []
    bases = [[f"w{rng.randrange(500)}x" for _ in range(rng.choice([2, 5, 30, 80]))] for _ in range(25)]
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2])):
                line[rng.randrange(len(line))] = f"v{rng.randrange(500)}"
            lines.append(rng.choice([" ", ", "]).join(line).capitalize())
        docs.append((d, "\n".join(lines)))
    want = brute(spark, docs)
    assert run(spark, docs, parts=parts) == want and sum(not k for *_, k in want) > 20


def test_simhash_bits(spark):
    rows = [((1, 0), "a b c"), ((2, 0), "c a b"), ((3, 0), "a"), ((4, 0), "a a b"), ((1, 0), "a b c")]
    sims = {r.key.x: r.sim for r in _simhash(spark.createDataFrame(rows, "key struct<x:long,y:int>, norm string")).collect()}
    words = {w: spark.sql(f"select xxhash64('{w}')").first()[0] for w in "abc"}
    a, b, c = (words[w] for w in "abc")
    assert sims == {1: (a & b) | (a & c) | (b & c), 2: sims[1], 3: a, 4: a}


def test_odd_rows(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(1500))
    docs = [(1, "Same line here"), (2, "same LINE, here\n\n--\nother"), (3, None), (4, ""), (None, "other\nsame line here"), (5, long), (6, long + " x")]
    assert run(spark, docs) == brute(spark, docs)
    got = {r.doc_id: r.text for r in drop_fuzzy_lines(table(spark, docs)).collect()}
    assert got[1] == "Same line here" and got[2] == "\n--\nother" and got[3] == "" and got[None] == "" and got[6] == ""
    twice = run(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d")])
    assert twice == [(1, 0, 3, True), (1, 0, 3, True), (2, 0, 3, False)]
    assert run(spark, []) == []


def test_lines_read_again_are_few(spark, monkeypatch):
    """Only what may be in a pair is normalised again, at one place of each line; equal texts and null ids included."""
    from webframe.llm import line_dedup

    asked = []
    some = line_dedup._some
    monkeypatch.setattr(line_dedup, "_some", lambda lines, wanted: asked.append((lines, some(lines, wanted))) or asked[-1][1])
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)]
    docs = [(k, " ".join(words[i % 60] for i in range(k * 7, k * 7 + 9)) + "\n" + "-" * k) for k in range(200)] + [(None, "x y\n7 z 5")]
    docs += [(900, " ".join(words * 3)), (901, " ".join(words * 3) + " end")]
    assert run(spark, docs) == brute(spark, docs)
    for lines, found in asked:
        assert "norm" not in lines.columns and found.count() <= 60 < lines.count()


def test_majorities_of_many_equal_lines(spark):
    rows = [((1, 0), " ".join(["a"] * 5 + ["b"] * 5), 9), ((2, 0), "a a b " * 3000 + "c", 4), ((2, 0), "a a b " * 3000 + "c", 3)]
    got = _simhash(spark.createDataFrame(rows, "key struct<x:long,y:int>, norm string, at long")).collect()
    a, b = (spark.sql(f"select xxhash64('{w}')").first()[0] for w in "ab")
    assert {r.key.x: (r.sim, r["at"]) for r in got} == {1: (a & b, 9), 2: (a, 3)}


def test_fields_of_every_width(spark):
    from webframe.llm.line_dedup import _with_sim

    rows = [((k, 0), " ".join(f"w{(k * 7 + i * i) % 31}" for i in range(n))) for k, n in enumerate([1, 2, 3, 40, 41, 300])] + [(None, None)]
    df = spark.createDataFrame(rows, "key struct<x:long,y:int>, norm string").coalesce(1)
    want = [(r.key, r.sim, r.n) for r in _with_sim(df, 32).orderBy("row").collect()]
    assert want[-1] == (None, None, 0) and [n for *_, n in want[:-1]] == [1, 2, 3, 40, 41, 300]
    for width in (12, 16, 21):
        assert [(r.key, r.sim, r.n) for r in _with_sim(df, width).orderBy("row").collect()] == want


def test_only_lines_of_like_length_are_pairs_in_crowds_too(spark, monkeypatch):
    from webframe.llm import line_dedup

    asked = []
    verified = line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *a: asked.append(pairs.distinct().count()) or verified(pairs, *a))
    docs = [(k, " ".join(["same"] * n)) for k, n in enumerate((1, 2, 4, 8, 16, 17))]
    assert run(spark, docs) == brute(spark, docs) and asked == [1, 0]
    monkeypatch.setattr(line_dedup, "CROWD", 1)
    docs += [(9, " ".join(["same"] * 18)), (10, " ".join(["same"] * 9))]
    assert run(spark, docs) == brute(spark, docs)
