import hashlib
import random

import pytest

from webframe.llm.chat_format import TEMPLATE, TemplateError, compile_template, escape, fold, format_conversations, parse, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, part string, generated string"


def render(template, **names):
    return "".join(t for t, _ in compile_template(template)(names))


def test_language():
    who = {"role": "user", "tags": ["a", "b"]}
    loop = "{% for x in xs %}{{ loop.index }}{% if loop.first %}<{% elif loop.last %}>{% else %}-{% endif %}{{ x|upper }}{% endfor %}"
    assert render(loop, xs=iter("abc")) == "1<A2-B3>C"
    assert render("{{ m.role ~ '!' }}{{ m['tags'][1] }}{{ m.none }}{{ m.tags|length + 1 }}", m=who) == "user!b3"
    assert render("{% if not a and (b or 'x' in 'xyz') == true %}y{% endif %}", a=0) == "y"
    assert render("{% for x in nothing %}a{% endfor %}{{ 'it\\'s' }}{{ 1 < 'a' }}") == "it'sFalse"


def test_folding():
    assert fold(parse("a{{ 'b' ~ 'c' }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}e")) == [("text", "abcde")]
    assert fold(parse("{% if false %}a{% elif x %}b{% endif %}")) == [("if", [(("name", "x"), [("text", "b")])])]


@pytest.mark.parametrize(
    "bad",
    ["{{ x() }}", "{{ x.__class__ }}", "{{ x|system }}", "{% import os %}", "{% for x in y %}", "{{ }}", "{{ 1 2 }}", "{% if %}{% endif %}", "{{ x.y.(z) }}", "{{ @ }}"],
)
def test_sandbox_refuses(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choices(["\\", "#", "###", "</turn>", "\n", ": ", "a", "<", "</turn"], k=rng.randrange(9)))
        assert unescape(escape(text)) == text and "</turn>" not in escape(text).replace("\\\\", "").replace("\\</turn>", "")


def want(rows):
    convs = {}
    for c, _, r, t in sorted(rows, key=lambda x: tuple((v is not None, v) for v in x)):
        convs.setdefault(c, []).append((r or "", t or ""))
    out = []
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha(said), len(loss), sha(loss)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("part", [1, 40, 1 << 20])
def test_round_trip(spark, part):
    rng, rows = random.Random(4), []
    for c in [None, *range(30)]:
        for k in range(rng.randrange(1, 9)):
            text = "".join(rng.choices(["\\", "### Assistant: ", "</turn>", "\n", ": ", "añ", "🙂", "</turn>\n"], k=rng.randrange(6)))
            rows.append((c, k, rng.choice(["user", "assistant", "assistant", "a: b\n### ", None]), rng.choice([text, text, None])))
    rows += [(40, 0, "assistant", "x" * 200_000), (40, 0, "assistant", "x" * 200_000), (41, None, "user", ""), (41, None, "user", "")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA)
    got = read_back(format_conversations(df, part=part)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == want(rows)
    assert read_back(format_conversations(df.limit(0))).count() == 0


def test_marks_of_the_default_template():
    pieces = list(compile_template(TEMPLATE)({"messages": [{"role": "user", "text": "a"}, {"role": "assistant", "text": "### b"}]}))
    assert "".join(t for t, _ in pieces) == "### user: a</turn>\n### assistant: \\### b</turn>\n"
    assert [t for t, g in pieces if g] == ["\\### b"]
