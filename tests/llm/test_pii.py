import hashlib
import random
import re

from webframe.llm.common import Scratch
from webframe.llm.pii import SHARE, _generation, find_personal_data

SCHEMA = "doc_id long, text string, value string, base string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    found = {k: [m for m in re.finditer(p, text or "") if valid(k, m.group())] for k, p in PATTERNS.items()}
    spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
    return *[len(v) for v in found.values()], hashlib.sha256(spans.encode()).hexdigest(), spans


def run(spark, docs, **kw):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA)
    return find_personal_data(df, **kw).collect()


def test_base_kinds_against_plain_search(spark):
    rng, docs = random.Random(2), []
    parts = [
        "a.b+c@mail-1.example.com", "@x.y", "q@z", "x@y.z.", "1.2.3.4", "001.255.0.9", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "6011000990139424", "+1 (017) 555-7713", "+12", "+123-4567-8", "+1234567890123456", "9" * 40, "12 34", "é🙂", "word", ". ", "\n", " ", "-", "+",
    ]
    for k in range(400):
        docs.append((k, "".join(rng.choices(parts, k=rng.randrange(0, 9)))))
    docs += [(None, "a@b.c"), (500, None), (501, ""), (502, "1" * 5_000), (503, "w " * 100_000 + "1.2.3.4"), (0, docs[0][1])]
    got = run(spark, docs, least_seeds=10**6)
    assert sorted([tuple(r) for r in got], key=repr) == sorted([(d, *brute(t)) for d, t in docs], key=repr)
    assert run(spark, []) == []
    assert run(spark, [(1, '1' * 300_000 + ' a' * 100_000)])[0].spans == ''


def test_patterns_discover_identifiers(spark):
    docs = [(k, f"text {k} and more. My badge is {k}{k}@mail{k}.example.com thanks") for k in range(8)]
    docs += [(20, "é My badge is AB-773-9912 thanks"), (21, "the code AB1234567 is not known"), (22, "1 My badge is AB-773-9912")]
    got = {r.doc_id: r for r in run(spark, docs, trust=0.7)}
    assert got[20].spans == "id:14:25" and got[20].n_email == 0 and got[21].spans == ""
    assert got[20].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].spans == brute(docs[1][1])[-1]
    assert all(r.spans == brute(dict(docs)[r.doc_id])[-1] for r in run(spark, docs, least_seeds=100))


def test_later_generations(spark):
    """Values found behind one phrase make the next phrase trusted, which finds further values, and so on."""
    old, new, last = ([f"{c}-4{k}-77" for k in range(6)] for c in "XYZ")
    texts = [f"here my badge is a{k}@mail.example.com" for k in range(8)] + [f"here my badge is {v}" for v in old]
    texts += [f"the member number {v}" for v in old + new] + [f"her holder code {v}" for v in new + last]
    texts += [f"bought article size {v}" for v in ("Q-11-22", "Q-11-23", "Q-11-24")]
    got = {t: r.spans for t, r in zip(texts, sorted(run(spark, list(enumerate(texts))), key=lambda r: r.doc_id))}
    assert {t for t, spans in got.items() if "id:" in spans} == {t for t in texts if t.split()[-1] in old + new + last}


def settled(edges, seeds, least):
    """Scores of patterns by many more rounds than are needed."""
    values = {v: float(v in seeds) for _, v in edges}
    for _ in range(500):
        held = {p: [v for q, v in edges if q == p] for p, _ in edges}
        score = {p: sum(values[v] for v in vs) / len(vs) for p, vs in held.items()}
        enough = {p for p, vs in held.items() if sum(v in seeds for v in vs) >= least}
        values = {v: max([float(v in seeds)] + [SHARE * score[p] for p, w in edges if w == v and p in enough]) for v in values}
    return score


def test_scores_have_settled(spark):
    """Patterns that share values, so that scores rise for many rounds."""
    rng = random.Random(3)
    names = [f"v{k}" for k in range(120)]
    edges = sorted({(f"p{k}", v) for k in range(12) for v in rng.sample(names[k * 8 : k * 8 + 30], 20)})
    seeds = set(rng.sample(names, 45))
    df = spark.createDataFrame([(p, v, v in seeds) for p, v in edges], "pattern string, value string, seed boolean")
    want = settled(edges, seeds, 3)
    found = _generation(df, Scratch(spark, "t"), 0, 1e-9, 0.0, 3).collect()
    assert len(found) > 5
    assert all(abs(r.score - want[r.pattern]) < 1e-5 for r in found)


def test_patterns_far_before_their_value(spark):
    gap = " -" * 200
    docs = [(k, f"my badge is{gap} a{k}@mail{k}.example.com") for k in range(8)] + [(20, f"my badge is{gap} AB-773-9912")]
    got = {r.doc_id: r.spans for r in run(spark, docs)}
    assert got[20].startswith("id:")
