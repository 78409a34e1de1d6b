import random
import re
import zlib
from collections import Counter
from itertools import count

import numpy as np
import pytest
import sentencepiece

from webframe.llm import merge_dropout
from webframe.llm.merge_dropout import Encoder, Pieces, decode_pieces, default_model, encode_pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=default_model())


@pytest.fixture(scope="module")
def pieces():
    return Pieces.load(default_model())


def ids(encoder, text, key=0):
    return np.frombuffer(encoder.encode(text, key), np.int32).tolist()


def texts(rng, n):
    alphabet = ["the ", "and", "ing ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "1234", ".,", "###", "un", "able", " ", "<0x0A>", "</s>"]
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 30))) for _ in range(n)]


def test_without_dropout_as_the_model_itself(pieces, model):
    rng, encoder = random.Random(1), Encoder(pieces, 0, 0)
    cases = [t for t in texts(rng, 400) + [" lead", "a  b", "x" * 300, "Hello world, it's me."] if "</s>" not in t and "<0x0A>" not in t]
    assert [ids(encoder, t) for t in cases] == model.encode(cases)


def test_dropout_is_lossless_varied_and_repeatable(pieces, model):
    rng, first, again, other = random.Random(2), Encoder(pieces, 0.3, 7), Encoder(pieces, 0.3, 7), Encoder(pieces, 0.3, 8)
    cases = texts(rng, 200) + ["▁", "a▁ b", "▁▁x ", " "]
    for k, t in enumerate(cases):
        got = ids(first, t, k)
        assert got == ids(again, t, k)
        assert b"".join(pieces.texts[i] for i in got)[1:].decode() == t
    long = "international representation " * 200
    assert ids(first, long) != ids(other, long) and ids(first, long) != model.encode(long)
    variants = Counter(tuple(ids(Encoder(pieces, 0.3, 7), "international", k)) for k in range(4))
    assert len(variants) > 1


def test_share_of_skipped_merges(pieces):
    text = " ".join(f"word{k}ing" for k in range(3000))
    sizes = [len(ids(Encoder(pieces, p, 1), text)) for p in (0, 0.1, 0.5, 1)]
    assert sizes == sorted(sizes) and sizes[1] < 1.3 * sizes[0]
    assert sizes[3] >= len(text)


def test_table(spark):
    rows = [(1, "some text here", "a"), (1, "some text here", "b"), (None, "some text here", "c"), (2, None, "d"), (3, "", "e"), (4, "long wörds " * 30000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    out = decode_pieces(encode_pieces(df, seed=3)).collect()
    assert [(r.doc_id, r.text or "", r.decoded) for r in out] == [(i, t or "", t or "") for i, t, _ in rows]
    got = encode_pieces(df, seed=3)
    assert got.columns == ["doc_id", "text", "pieces"]
    by = {(r.doc_id, r.text): r.pieces for r in got.collect()}
    assert by[(2, None)] == [] and by[(3, "")] == []
    assert encode_pieces(df.limit(0)).count() == 0 and decode_pieces(got.limit(0)).count() == 0


def test_every_occurrence_is_segmented_anew(pieces):
    """As many segmentations of a word as dropout gives, each as often as with merges worked off one by one."""
    word, n = "▁international", 4000
    encoder = Encoder(pieces, 0.3, 5)
    one = [tuple(ids(encoder, "international", k)) for k in range(n)]
    rng = random.Random(1)

    def draw():
        gap = 0
        while rng.random() >= 0.3:
            gap += 1
        return gap

    plain = Counter(tuple(np.frombuffer(encoder.merge(word, draw(), draw)[0], np.int32).tolist()) for _ in range(n))
    got = Counter(one)
    assert len(got) > 20 and abs(len(got) - len(plain)) < 0.3 * len(plain)
    for x, times in plain.most_common(5):
        assert abs(got[x] - times) < 5 * (2 * times) ** 0.5
    again = ids(encoder, "international " * 500, 1)
    assert again == ids(Encoder(pieces, 0.3, 5), "international " * 500, 1)
    starts = [i for i, p in enumerate(again) if pieces.texts[p].startswith(b" ")] + [len(again)]
    assert len({tuple(again[a:b]) for a, b in zip(starts, starts[1:])}) > 20


# An independent version: pieces as a list of strings, all candidates in a plain list, draws by counting.

M64, STEP = 2**64 - 1, 0x9E3779B97F4A7C15


def mix(h):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> shift)) * factor & M64
    return h ^ (h >> 33)


def passing(h, dropout):
    """How many candidates pass before one is skipped: k or more with probability (1 - p)^k."""
    whole, k = 1 << 32, 0
    keep = 1 - round(dropout * whole) / whole
    while k < 1 << 16 and (h >> 32) >= whole - int(keep ** (k + 1) * whole):
        k += 1
    return k


def segments(part, scores, draw, gap):
    """The pieces of a part, and what is left of the gap."""
    spans = [(i, i + 1) for i in range(len(part))]
    waiting = [(a, b) for a, b in zip(spans, spans[1:]) if part[a[0] : b[1]] in scores]
    while waiting:
        best = min(waiting, key=lambda c: (-scores[part[c[0][0] : c[1][1]]], c[0][0], c[1][0]))
        waiting.remove(best)
        if best[0] not in spans or best[1] not in spans or spans.index(best[1]) != spans.index(best[0]) + 1:
            continue
        if gap == 0:
            gap = draw()
            continue
        gap -= 1
        at, new = spans.index(best[0]), (best[0][0], best[1][1])
        spans[at : at + 2] = [new]
        for a, b in ((spans[at - 1], new) if at else (None, None), (new, spans[at + 1]) if at + 1 < len(spans) else (None, None)):
            if a and part[a[0] : b[1]] in scores:
                waiting.append((a, b))
    return [part[a:b] for a, b in spans], gap


def plain(pieces, text, key, dropout, seed):
    scores = {p: pieces.scores[i] for p, i in pieces.ids.items()}
    side_by_side = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
    base, out = mix(key & M64 ^ mix(zlib.crc32(str(seed).encode()))), []
    units = re.findall("▁*[^▁\n]+|▁+|\n+" if not any("\n" in p for p in scores) else "▁*[^▁]+|▁+", "▁" + text.replace(" ", "▁"))
    for number, unit in enumerate(units, 1):
        state = (base + number * STEP) & M64
        draws = (passing(mix((mix(state) + turn * STEP) & M64), dropout) for turn in count(1))
        gap, start = passing(mix(state), dropout), 0
        for k in range(1, len(unit) + 1):
            if k == len(unit) or unit[k - 1 : k + 1] not in side_by_side:
                found, gap = segments(unit[start:k], scores, draws.__next__, gap)
                start = k
                for piece in found:
                    out += [pieces.ids[piece]] if piece in pieces.ids else [pieces.bytes[b] for b in piece.encode()]
    return out


@pytest.mark.parametrize("dropout", [0.05, 0.3, 0.8, 1.0])
def test_against_an_independent_version(pieces, dropout):
    rng = random.Random(dropout)
    cases = texts(rng, 150) + ["international representation of the unbelievable ", "x" * 60, "aaaa aaaa aaaaa"]
    for k, text in enumerate(t for t in cases if "▁" not in t):
        assert ids(Encoder(pieces, dropout, 9), text, k) == plain(pieces, text, k, dropout, 9) if text else True, text


def test_texts_of_a_chunk_together(pieces, monkeypatch):
    """Many texts at once become what each becomes alone, with hardly a part merged by itself, also when tables are emptied."""
    rng = random.Random(11)
    syllables = ["ka", "to", "ri", "mun", "sel", "ver", "ing", "é", "ß", "日本", ", ", " ", "\n", "42"]
    cases = ["".join(rng.choices(syllables, k=rng.randrange(40))) for _ in range(60)] + ["", "▁", "a▁▁ b▁c", "xy" * 40, "-日" * 30, "\n\n  \n"]
    data, offsets = np.frombuffer("".join(cases).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in cases)])
    alone = [ids(Encoder(pieces, 0.3, 2), t, k) for k, t in enumerate(cases)]
    assert [a for a, t in zip(alone, cases) if "▁" not in t] == [plain(pieces, t, k, 0.3, 2) if t else [] for k, t in enumerate(cases) if "▁" not in t]
    calls, merge = [], Encoder.merge
    monkeypatch.setattr(Encoder, "merge", lambda self, part, *rest: calls.append(part) or merge(self, part, *rest))
    together = Encoder(pieces, 0.3, 2)
    for most in (merge_dropout.UNITS, 0):
        monkeypatch.setattr(merge_dropout, "UNITS", most)
        for _ in range(2):
            found, ends = together.encode_rows(data, offsets, np.arange(len(cases)))
            assert [found[a:b].tolist() for a, b in zip(ends, ends[1:])] == alone
    assert {len(part) for part in calls} == {81}


def test_decoding_many_rows_at_once(spark, pieces, monkeypatch):
    monkeypatch.setattr(merge_dropout, "DECODED", 3)
    rows = [(k, t, None if t is None else ids(Encoder(pieces, 0.1, 1), t, k)) for k, t in enumerate(["one two three four", "", None, "日本 é", "x", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces array<int>").coalesce(1)
    assert [r.decoded for r in decode_pieces(df).collect()] == [t or "" for _, t, _ in rows]


def test_decoding_by_the_task_that_encodes(spark, monkeypatch):
    """The same pieces and texts as by two operators, with one worker for a task."""
    monkeypatch.setattr(merge_dropout, "ENCODED", 40)
    rows = [(k, t, "kept") for k, t in enumerate(["one two three four", "", None, "日本 é▁", "x" * 90, " \n  y", None, ""])] + [(None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string").repartition(3)
    first = encode_pieces(df, seed=3)
    want = {(r.doc_id, r.text): r for r in decode_pieces(first.withColumn("ids", first.pieces)).collect()}
    got = encode_pieces(df, seed=3, decoded_col="decoded")
    assert got.columns == ["doc_id", "text", "pieces", "decoded"]
    assert {(r.doc_id, r.text): (r.pieces, r.decoded) for r in got.collect()} == {k: (r.ids, r.decoded) for k, r in want.items()}
    over = encode_pieces(df, seed=3, decoded_col="text")
    assert over.columns == ["doc_id", "decoded", "pieces", "text"] and sorted(r.text for r in over.collect()) == sorted(t or "" for _, t, _ in rows)
    assert encode_pieces(df.limit(0), decoded_col="text").count() == 0


def test_one_worker_for_a_task(spark, tmp_path):
    from corpus_pipeline import sentencepiece as stage
    from webframe.llm.queries import op2_sentencepiece

    rows = [(1, "a b", "en", "web"), (2, None, None, "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for found in (op2_sentencepiece(spark, str(tmp_path)), stage(spark, docs, str(tmp_path))):
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert all(r.lossless for r in found.collect())
