import json
import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webframe.llm.common import table
from webframe.llm.prefix_bpe import WORDS, Encoder, Vocabulary, decode_bpe, default_tokenizer, encode_bpe
from webframe.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary.load(default_tokenizer()))


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def wanted(library, text):
    return library.encode(text, add_special_tokens=False).ids


PARTS = [
    *"aaabcdeeeinorst' \n\t.,!-_0123456789ABZ", "'s", "'T", "ΣΑΣ", "é", "é", "İ", "ß", "日本", "🙂", "½", "²", "٣", "<|endoftext|>",
    "<|startoftext|>", "<|", "\x1c", "\x85", " ", "​", "՘", "Ɤ", "ing", "tion", "the", "̀", "\x00",
]


@pytest.mark.parametrize("seed", range(4))
def test_as_the_library(library, encoder, seed):
    rng = random.Random(seed)
    for _ in range(1500):
        text = "".join(rng.choices(PARTS, k=rng.randrange(25)))
        assert ids(encoder, text) == wanted(library, text), text
        text = "".join(rng.choices("aeinorstl", k=rng.randrange(1, 40)))
        assert ids(encoder, text) == wanted(library, text), text


def test_every_token_that_the_merges_make_is_its_own_encoding(encoder):
    v = encoder.vocabulary
    letters = {**{int(t): bytes([b]) for b, t in enumerate(v.first)}, **{int(t): bytes([b]) for b, t in enumerate(v.last)}}
    for t in range(len(v.left)):
        if v.left[t] >= 0:
            letters[t] = letters[int(v.left[t])] + letters[int(v.right[t])]
    at_end = [t for t, name in enumerate(v.names) if name.endswith("</w>")]
    for t in random.Random(5).sample(at_end, 4000):
        try:
            word = letters[t].decode()
        except UnicodeDecodeError:
            continue
        if t in encoder.symbols and WORDS.fullmatch(word):
            assert encoder.word(word) == [t]


def test_last_tokens_do_not_depend_on_what_follows(encoder, library):
    """The stored tokens of a word and of the word with more letters are the same up to the end of the shorter one."""
    rng = random.Random(9)
    for _ in range(200):
        word = "".join(rng.choices("abcdeinorst", k=30))
        assert encoder.word(word) == wanted(library, word)


def test_usual_characters(encoder):
    unlike = [c for c in map(chr, range(128)) if not encoder.is_usual(c)]
    assert unlike == list("\x1c\x1d\x1e\x1f")
    assert not encoder.is_usual("½") and encoder.is_usual("é")


def test_very_long_words(encoder, library):
    for text in ("a" * 50_000, "ab" * 20_000 + "c", "<|endoftext|>" * 500, "x " * 30_000, "日" * 10_000):
        assert ids(encoder, text) == wanted(library, text)


def test_rows(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (None, "Hello  World's", "c"), (4, "Hello  World's", None), (4, "Hello  World's", None), (5, " \n", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(None).cast("string"))
    found = encode_bpe(docs)
    assert found.columns == ["doc_id", "text", "decoded", "ids", "ids_sha256"]
    back = decode_bpe(found).collect()
    by_text = {r.text: r for r in back}
    assert len(back) == 6 and by_text["Hello  World's"].decoded == "hello</w> world</w> 's</w>"
    assert by_text[None].decoded == by_text[""].decoded == by_text[" \n"].decoded == ""
    assert by_text[""].ids_sha256 == sha256(b"").hexdigest()
    empty = decode_bpe(encode_bpe(docs.limit(0)))
    assert empty.count() == 0 and "decoded" in empty.columns
    assert decode_bpe(spark.createDataFrame([(None,)], "ids array<int>")).collect() == [("",)]


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op11_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        found = wanted(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(found), sha256(np.array(found, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest()


def test_other_kinds_of_file_are_refused(tmp_path):
    with open(default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["dropout"] = 0.5
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        Vocabulary.load(str(tmp_path / "t.json"))
