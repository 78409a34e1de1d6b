import random

import pytest

from webframe.llm.decontaminate import LEAST_SHARE, LEAST_TOKENS, WIDTH, contaminated_pairs, decontaminate, marked, template, values

ITEM = "A train leaves Paris at 60 km per hour and Maria waits 3 hours before she walks 60 steps to the old gate"
ITEMS = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "what is the capital city here"), (6, "two words")]
BENCH, DOCS = "item_id long, text string, id string", "doc_id long, text string, item_id string, tokens string"


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "z") for i, t in items], BENCH)
    got = contaminated_pairs(d, b)
    return sorted(((r.doc_id, r.item_id, r.n_match, r.kind) for r in got.collect()), key=repr)


def test_tokens(evaluate):
    rows = [("He met Anna, who ran 3,500.5m in 7 km. Then 5kg! x2y",), (None,), ("",)]
    n, u, m = "\ue001", "\ue002", "\ue000"
    assert evaluate(rows, ["t"], lambda: template(marked("t"))) == [
        f"he met {m} who ran {n} {u} in {n} {u} then {n} {u} x2y".split(), [], [],
    ]
    assert evaluate(rows, ["t"], lambda: values(marked("t")))[0] == "he met anna who ran 35005 m in 7 km then 5 kg x2y".split()


def test_kinds(spark):
    changed = ITEM.replace("60", "85").replace("Paris", "Rome").replace("Maria", "Olga")
    mixed = ITEM.replace("60 km", "85 km").replace("Maria", "Paris")
    words = ITEM.split()
    docs = [
        (1, "intro words of no use. " + ITEM + " and more"),
        (2, ITEM.upper().lower()),
        (3, "so " + changed),
        (4, " ".join(words[:8])),
        (5, " ".join(words[8:])),
        (6, "nothing to see in this text at all, it is clean and it stays that way for good"),
        (7, None), (8, ""), (None, "x " + ITEM), (1, "intro words of no use. " + ITEM + " and more"),
        (9, "and so what is the capital city here"),
        (10, "filler " * 20000 + ITEM),
        (11, mixed),
    ]
    got = run(spark, docs)
    assert {(d, i, k) for d, i, _, k in got} == {
        (1, 1, "exact"), (2, 1, "exact"), (3, 1, "reparameterised"), (5, 1, "exact"), (None, 1, "exact"),
        (9, 5, "exact"), (10, 1, "exact"), (11, 1, "reparameterised"),
    }
    assert len(got) == 8
    full = {d: n for d, i, n, _ in got if i == 1}
    assert full[1] == len(words) and full[11] < len(words)
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], BENCH)
    assert sorted(r.doc_id for r in decontaminate(d, b).collect()) == [4, 6, 7, 8]


def test_empty_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, ITEM)], []) == []


def best_chain(a, b):
    """Most tokens of ``b`` in ``a`` in a chain of alignments at most three apart, each of which shares six in a row."""
    starts = []
    for s in range(-len(b), len(a)):
        agree = [0 <= s + k < len(a) and a[s + k] == b[k] for k in range(len(b))]
        if max(map(len, "".join("x" if x else " " for x in agree).split()), default=0) >= WIDTH:
            starts.append((s, {k for k, x in enumerate(agree) if x}))
    best, chain = 0, []
    for s, ks in starts:
        chain = [*chain, (s, ks)] if chain and s - chain[-1][0] <= 3 else [(s, ks)]
        best = max(best, len({(k, s + k) for s, ks in chain for k in ks} and set().union(*(ks for _, ks in chain))))
    return best


def test_against_all_alignments(spark):
    """No condition on tiles or positions: every passage with six tokens in a row and enough in all is found."""
    rng = random.Random(4)
    vocabulary = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    items = [(k, " ".join(rng.sample(vocabulary, k=rng.randrange(11, 40)))) for k in range(15)]
    docs = []
    for k in range(160):
        words = rng.choices(vocabulary, k=rng.randrange(0, 80))
        if k % 3:
            part = rng.choice(items)[1].split()
            a = rng.randrange(len(part))
            part = part[a : a + rng.randrange(5, 40)]
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(part))
                part[i : i + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(1, 3))
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((k, " ".join(words)))
    want = set()
    for d, text in docs:
        for i, item in items:
            w = item.split()
            n = best_chain(text.split(), w)
            if n >= LEAST_TOKENS or n >= LEAST_SHARE * len(w):
                want.add((d, i))
    got = {(d, i) for d, i, _, _ in run(spark, docs, items)}
    assert len(want) > 20 and got == want


TWENTY = "please tell me how many green boxes fit on the long shelf when every row must hold nine of them".split()


@pytest.mark.parametrize("kind", ["two changed", "one more", "one less", "two names"])
def test_every_place_in_a_document(spark, kind):
    """An item with small changes is found wherever it begins."""
    part = list(TWENTY)
    item = " ".join(TWENTY)
    if kind == "two changed":
        part[6], part[13] = "other", "words"
    elif kind == "one more":
        part.insert(10, "really")
    elif kind == "one less":
        del part[9]
    else:
        item = item.replace("green boxes", "boxes of Anna").replace("shelf", "shelf of Bob")
        part = item.replace("Anna", "Maria Lopez").replace("Bob", "Carl Gustav Meyer").split()
    docs = [(k, " ".join([f"x{chr(97 + j)}" for j in range(k)] + part + ["end"])) for k in range(8)]
    got = run(spark, docs, [(1, item)])
    assert [d for d, *_ in got] == list(range(8))
    assert {k for *_, k in got} == {"reparameterised" if kind == "two names" else "exact"}


def test_items_of_names_and_numbers(spark):
    title = "The Quick Brown Fox Jumps Over The Lazy Dog And Runs Away Home"
    rows = [(1, f"he wrote {title} today"), (2, "he wrote Some Quite Other Title Of As Many Words As That One Had Before today"), (3, f"so {title.lower()} it is")]
    n = len(title.split())
    assert run(spark, rows, [(7, "X " + title)]) == [(1, 7, n, "exact"), (3, 7, n, "exact")]


def test_short_items(spark):
    items = [(1, "who was the first king of all"), (2, "name four seas"), (3, "what is five times six right now")]
    docs = [(1, "so who was the first king of all then"), (2, "who was the first queen of all"), (3, "please name four seas"), (4, "and What is five times six right now"), (5, "is five times six")]
    assert [(d, i) for d, i, *_ in run(spark, docs, items)] == [(1, 1), (4, 3)]
