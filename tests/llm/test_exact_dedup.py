import hashlib
import random
import re

import pytest

from webframe.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, _row string"


def brute(docs):
    """(doc_id, keep_id, group_size, sha256) by looking texts up."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    out = []
    for (d, _), t in zip(docs, norm):
        ids = [e for (e, _), u in zip(docs, norm) if u == t]
        out.append((d, min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, **kw):
    return exact_dedup(spark.createDataFrame([(d, t, "x", "y") for d, t in docs], SCHEMA), **kw).collect()


@pytest.mark.parametrize("first_block,growth", [(32, 8), (1, 2)])
def test_against_lookup(spark, first_block, growth):
    rng = random.Random(first_block)
    texts = ["".join(rng.choices(["ab", "é", " ", "\n\t", "\x0b"], k=rng.randrange(0, 9))) for _ in range(60)]
    texts += ["p" * 31, "p" * 32, "p" * 33, "p" * 32 + " ", "p" * 290, "p" * 290 + "q", "é" * 16, "é" * 16 + "x", None, "", " ", " "]
    docs = [(k, rng.choice(texts)) for k in range(150)] + [(None, "ab"), (None, "only null ids"), (None, "only null ids"), (3, "twice"), (3, "twice")]
    got = run(spark, docs, first_block=first_block, growth=growth)
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=repr) == brute(docs)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_long_copies_and_no_rows(spark):
    long = "long wörds " * 40_000
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in run(spark, [(2, long), (1, long), (3, long + "!"), (4, long[:-1])])}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 1, True), 4: (4, 1, True)}
    assert run(spark, []) == []
