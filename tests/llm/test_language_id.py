import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from webframe.llm.language_id import (
    BUCKETS,
    SCRIPT_RANGES,
    SCRIPT_SHARE,
    SMOOTHING,
    SWITCH,
    WRONG_SCRIPT,
    held_out,
    identify_language,
    viterbi,
)
from webframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [
        ("the house and the garden are near the river that runs through the town", "en"),
        ("das Haus und der Garten sind nahe bei dem Fluss der durch die Stadt fließt", "de"),
        ("дом и сад находятся рядом с рекой которая течет через город", "ru"),
        ("nothing", None),
    ] * 5
    return spark.createDataFrame(rows, "text string, lang string")


def run(spark, labelled, texts):
    df = spark.createDataFrame([(i, t, "zz", "q") for i, t in enumerate(texts)], "doc_id long, text string, lang string, lang_pred string")
    return identify_language(df, labelled).orderBy("doc_id").collect()


def test_rows(spark, labelled):
    mixed = "the house and the garden. Das Haus und der Garten sind nahe bei dem Fluss, der fließt."
    long = "through the town " * 20000
    got = run(spark, labelled, ["the river runs", "der Fluss durch", "рядом с", mixed, None, "", "123 ... 45", long, "日本", "the river runs"])
    assert [r.lang_pred for r in got[:3]] == ["en", "de", "ru"] and got[0].lang_score == 1.0
    assert [r.lang_pred for r in got[4:7]] == ["und"] * 3 and [r.lang_score for r in got[4:7]] == [0] * 3
    assert got[7].lang_pred == "en" and got[8].lang_pred in ("de", "en", "ru") and got[9].lang_pred == "en"
    assert [s.lang for s in got[3].lang_spans] == ["en", "de"] and 0.5 < got[3].lang_score < 1
    a, b = got[3].lang_spans
    assert mixed[a.start : a.end] == "the house and the garden" and mixed[b.start : b.end].startswith("Das") and b.end == len(mixed) - 1
    assert got[0].lang == "zz" and len(got[0].asDict()) == 6


def test_no_rows_and_nothing_learned(spark, labelled):
    assert run(spark, labelled, []) == []
    assert [r.lang_pred for r in run(spark, labelled.limit(0), ["some text", None])] == ["und", "und"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    counts = np.array([3, 0, 6, 1, 5])
    scores = rng.normal(0, 2, (counts.sum(), 3))
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    got = viterbi(scores, starts, counts, 1.5)
    for s, c in zip(starts, counts):
        if c:
            cost = lambda p: sum(scores[s + k, x] for k, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
            assert tuple(got[s : s + c]) == max(itertools.product(range(3), repeat=c), key=cost)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", held_out())
    got = identify_language(docs, docs.where("not out")).select("doc_id", "lang", "lang_pred", "out").collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    tested = [r for r in got if r.out and r.lang]
    assert len(tested) > 150 and sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.95


def test_null_id_is_not_held_out(spark):
    df = spark.createDataFrame([(None,), (2,)], "doc_id long").select(held_out().alias("h"))
    assert [r.h for r in df.where(F.col("h").isNull()).collect()] == []


# The same model in plain loops over letters and words.


def letters(text):
    """Runs of letters as lists of (lower-case letter, script)."""
    out, run = [], []
    for c in text or "":
        if c.isalpha():
            low = c.lower() if len(c.lower()) == 1 else c
            script = [name for first, name in SCRIPT_RANGES if first <= ord(c)][-1]
            run.append((ord(low), script))
        elif run:
            out.append(run)
            run = []
    return out + [run] * bool(run)


def buckets(word):
    m64 = 2**64 - 1
    around = [0, *(c for c, _ in word), 0]
    for a, b, c in zip(around, around[1:], around[2:]):
        h = (a * 0x9E3779B97F4A7C15 & m64) ^ ((b * 0xC2B2AE3D27D4EB4F & m64) + (c * 0x165667B19E3779F9 & m64) & m64)
        h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & m64
        yield (h >> 40) % BUCKETS


def plain_model(rows):
    grams, scripts = {}, {}
    for text, lang in rows:
        grams.setdefault(lang, Counter())
        scripts.setdefault(lang, Counter())
        for word in letters(text):
            grams[lang].update(buckets(word))
            scripts[lang].update(s for _, s in word)
    # A language none of whose texts has a letter is not learned.
    return {k: g for k, g in grams.items() if g}, scripts


def plain_label(text, grams, scripts):
    words, langs = letters(text), sorted(grams)
    if not words or not langs:
        return "und", 0.0
    total = {k: sum(g.values()) + SMOOTHING * BUCKETS for k, g in grams.items()}
    written = {k: {s for s, n in c.items() if n >= SCRIPT_SHARE * max(sum(c.values()), 1)} for k, c in scripts.items()}
    rows = []
    for word in words:
        score = {k: sum(math.log((grams[k][b] + SMOOTHING) / total[k]) for b in buckets(word)) for k in langs}
        fits = {k for k in langs if word[0][1] in written[k]}
        rows.append({k: s - (WRONG_SCRIPT if fits and k not in fits else 0) for k, s in score.items()})
    best, back = dict(rows[0]), []
    for row in rows[1:]:
        top = max(langs, key=lambda k: best[k])
        back.append({k: k if best[k] >= best[top] - SWITCH else top for k in langs})
        best = {k: max(best[k], best[top] - SWITCH) + row[k] for k in langs}
    path = [max(langs, key=lambda k: best[k])]
    for step in reversed(back):
        path.append(step[path[-1]])
    held = Counter()
    for k, word in zip(reversed(path), words):
        held[k] += len(word)
    lang = min(held, key=lambda k: (-held[k], k))
    return lang, held[lang] / sum(held.values())


def test_query_against_plain_loops(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    kept = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None]
    model = plain_model(kept)
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op7_language_id"](spark, sf).collect()}
    assert got.keys() == {r.doc_id for r in docs}
    for r in docs:
        lang, score = plain_label(r.text, *model)
        assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-3), r.doc_id
