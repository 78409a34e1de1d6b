"""Chat formatting by compiled templates.

A template is text with {{ expressions }}, {% for x in y %}, {% if %}, {% elif %}, {% else %},
{% generation %} (what a model is trained on) and their ends. It is parsed to a
syntax tree, constants are folded, and the tree becomes Python closures that yield
(text, generated) pieces. The language is a sandbox: it reads fields and items of
plain values, compares, joins, and applies a fixed set of filters; it calls nothing.

Conversations are streamed: turns arrive sorted, a loop looks one turn ahead, and
output is cut into parts of bounded size. So a conversation need not fit in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the default template. Texts and roles are escaped, so they can hold none of them unescaped.
TEMPLATE = (
    "{% for m in messages %}### {{ m.role|escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}"
    "{{ '</turn>' ~ '\\n' }}{% endfor %}"
)
#: Code points of a part of the output; a piece of text is not cut, so one turn can make a part longer.
PART = 1 << 20
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_STOP = re.compile(r"\\(?:\\|###|</turn>|:)|</turn>\n")
_ROLE_END = re.compile(r"\\(?:\\|###|</turn>|:)|: ")

Piece = tuple[str, bool]


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "escape_role": lambda x: _ROLE_CONTROL.sub(r"\\\g<0>", _text(x)),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
}


class TemplateError(ValueError):
    """The template is not in the language."""


def _text(value) -> str:
    return "" if value is None else str(value)


# --- Parsing. Nodes: ("text", s) ("out", e) ("if", [(e, body)...]) ("for", name, e, body) ("gen", body);
# expressions: ("const", v) ("name", n) ("item", e, e) ("filter", f, e) ("not", e) ("op", o, a, b).

_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([0-9]+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|.()\[\]]))", re.S)
_OPS = [("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("~", "+")]
_WORDS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] > 2 else None

    def take(self, *expected: str) -> tuple[int, str]:
        if self.at >= len(self.tokens) or expected and self.tokens[self.at][1] not in expected:
            raise TemplateError(f"expected {expected or 'a value'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self):
        out = self.binary(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"did not expect {self.tokens[self.at][1]!r}")
        return out

    def binary(self, level: int):
        if level == 2 and self.peek() == "not":
            self.take()
            return ("not", self.binary(2))
        if level == len(_OPS):
            return self.postfix()
        left = self.binary(level + 1)
        while self.peek() in _OPS[level]:
            left = ("op", self.take()[1], left, self.binary(level + 1))
        return left

    def postfix(self):
        kind, token = self.take()
        if kind == 1:
            out = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S))
        elif kind == 2:
            out = ("const", int(token))
        elif kind == 3:
            out = ("const", _WORDS[token]) if token in _WORDS else ("name", token)
        elif token == "(":
            out = self.binary(0)
            self.take(")")
        else:
            raise TemplateError(f"did not expect {token!r}")
        while self.peek() in (".", "[", "|"):
            mark = self.take()[1]
            if mark == "[":
                out = ("item", out, self.binary(0))
                self.take("]")
            else:
                kind, name = self.take()
                if kind != 3 or name.startswith("_") or mark == "|" and name not in FILTERS:
                    raise TemplateError(f"no such {'filter' if mark == '|' else 'field'}: {name}")
                out = ("item", out, ("const", name)) if mark == "." else ("filter", name, out)
        return out


def parse(source: str) -> list:
    """The syntax tree of a template."""
    pieces, at = [], 0
    for m in _TAGS.finditer(source):
        pieces += [("text", source[at : m.start()])] if m.start() > at else []
        pieces.append(("out", _Expression(m[1]).parse()) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    pieces += [("text", source[at:])] if at < len(source) else []
    stream = iter(pieces)

    def body(*ends: str) -> tuple[list, str]:
        out = []
        for kind, value in stream:
            if kind != "tag":
                out.append((kind, value))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, value
            if word == "generation":
                out.append(("gen", body("endgeneration")[0]))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"not a loop: {value}")
                out.append(("for", m[1], _Expression(m[2]).parse(), body("endfor")[0]))
            elif word == "if":
                branches, test = [], _Expression(rest).parse()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((test, inner))
                    word, _, rest = end.partition(" ")
                    if word == "endif":
                        break
                    test = _Expression(rest).parse() if word == "elif" else ("const", True)
                out.append(("if", branches))
            else:
                raise TemplateError(f"unknown tag: {value}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return body()[0]


# --- Folding of constants.


def fold(nodes: list) -> list:
    """The tree with constant expressions worked out, dead branches gone and neighbouring texts joined."""
    out: list = []

    def add(node) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            e = _fold(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif node[0] == "gen":
            add(("gen", fold(node[1])))
        elif node[0] == "for":
            add(("for", node[1], _fold(node[2]), fold(node[3])))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = _fold(test)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold(inner)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def _fold(e):
    parts = tuple(_fold(x) if isinstance(x, tuple) else x for x in e)
    if e[0] in ("item", "filter", "not", "op") and all(x[0] == "const" for x in parts if isinstance(x, tuple)):
        return ("const", _closure(parts)({}))
    return parts


# --- Closures.


def _item(value, key):
    try:
        return value[key] if isinstance(value, (dict, list, str)) else None
    except (KeyError, IndexError, TypeError):
        return None


def _compare(test: Callable) -> Callable:
    def run(a, b):
        try:
            return test(a, b)
        except TypeError:
            return False

    return run


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _compare(lambda a, b: a < b), ">": _compare(lambda a, b: a > b),
    "<=": _compare(lambda a, b: a <= b), ">=": _compare(lambda a, b: a >= b), "in": _compare(lambda a, b: a in b),
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b),
}


def _closure(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda scope: e[1]
    if kind == "name":
        return lambda scope: scope.get(e[1])
    if kind == "item":
        of, key = _closure(e[1]), _closure(e[2])
        return lambda scope: _item(of(scope), key(scope))
    if kind == "filter":
        apply, of = FILTERS[e[1]], _closure(e[2])
        return lambda scope: apply(of(scope))
    if kind == "not":
        of = _closure(e[1])
        return lambda scope: not of(scope)
    a, b = _closure(e[2]), _closure(e[3])
    if e[1] == "or":
        return lambda scope: a(scope) or b(scope)
    if e[1] == "and":
        return lambda scope: a(scope) and b(scope)
    work = _BINARY[e[1]]
    return lambda scope: work(a(scope), b(scope))


def _renderer(nodes: list, generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(node, generated) for node in nodes]
    return lambda scope: chain.from_iterable(step(scope) for step in steps)


def _step(node, generated: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda scope: ((node[1], generated),)
    if kind == "out":
        value = _closure(node[1])
        return lambda scope: ((_text(value(scope)), generated),)
    if kind == "gen":
        return _renderer(node[1], True)
    if kind == "if":
        branches = [(_closure(test), _renderer(body, generated)) for test, body in node[1]]

        def choose(scope: dict) -> Iterator[Piece]:
            return next((body(scope) for test, body in branches if test(scope)), iter(()))

        return choose
    name, values, body = node[1], _closure(node[2]), _renderer(node[3], generated)

    def loop(scope: dict) -> Iterator[Piece]:
        found = values(scope)
        ahead, nothing = iter(found if hasattr(found, "__iter__") else ()), object()
        now, index = next(ahead, nothing), 0
        while now is not nothing:
            after = next(ahead, nothing)
            place = {"index0": index, "index": index + 1, "first": index == 0, "last": after is nothing}
            yield from body(scope | {name: now, "loop": place})
            now, index = after, index + 1

    return loop


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    """A function from the names a template may read to the (text, generated) pieces of its output."""
    return _renderer(fold(parse(source)))


# --- Spark.

_FORMATTED = "part long, text string, generated array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 100 + sum(len(x) for x in row if isinstance(x, str))
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, part: int = PART, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, part, text, generated): each conversation as formatted text, in parts from 0, sorted within partitions.

    ``turns`` has (conv_id, turn, role, text) and perhaps other columns, which are not read. Rows of a conversation go
    by turn, then role and text, nulls first; repeated rows are turns of their own. A null role or text is empty, a
    null conv_id is a conversation like another. ``generated`` holds the spans (code points of the part) that the
    template marks. The template reads ``messages`` (role, text, turn). No turns give no rows.
    """
    compile_template(template)
    kind = turns.schema[id_col].dataType.simpleString()
    fed = turns.select(F.col(id_col).alias("c"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("text").alias("x"))
    fed = fed.repartition("c").sortWithinPartitions("c", "t", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, first = compile_template(template), next(batches, None)
        if first is None:
            return
        schema = pa.schema([("conv_id", first.schema.field(0).type), ("part", pa.int64()), ("text", pa.string()), ("generated", _SPANS)])

        def parts() -> Iterator[tuple]:
            for conv, rows in groupby(_rows(chain([first], batches)), key=lambda r: r[0]):
                messages = ({"role": r or "", "text": x or "", "turn": t} for _, t, r, x in rows)
                number, held, spans, at = 0, [], [], 0
                for text, generated in render({"messages": messages}):
                    if generated and text:
                        if spans and spans[-1]["end"] == at:
                            spans[-1]["end"] = at + len(text)
                        else:
                            spans.append({"start": at, "end": at + len(text)})
                    held.append(text)
                    at += len(text)
                    if at >= part:
                        yield conv, number, "".join(held), spans
                        number, held, spans, at = number + 1, [], [], 0
                if at or not number:
                    yield conv, number, "".join(held), spans

        yield from _batches(parts(), schema)

    return fed.mapInArrow(run, f"conv_id {kind}, {_FORMATTED}").withColumnRenamed("conv_id", id_col)


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the parts of the default template's output say, for each conversation: ``n_turns``, ``turns_sha256`` of role,
    line feed, text, line feed for each turn, ``loss_chars`` and ``loss_sha256`` of the generated texts, unescaped and
    with nothing between, and ``formatted_chars``.

    Takes the output of ``format_conversations`` as it is, with the parts of a conversation one after another.
    """
    kind = formatted.schema[id_col].dataType.simpleString()
    out = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        schema = pa.schema([("conv_id", first.schema.field(0).type), *fields])
        convs = groupby(_rows(chain([first], batches)), key=lambda r: r[0])
        yield from _batches(((conv, *_read((r[1:] for r in parts))) for conv, parts in convs), schema)

    return formatted.select(id_col, "text", "generated").mapInArrow(run, f"conv_id {kind}, {out}").withColumnRenamed("conv_id", id_col)


def _read(parts: Iterator[tuple[str, list]]) -> tuple[int, str, int, str, int]:
    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    held, masked, whole = "", [], True

    def lose() -> None:
        nonlocal loss_chars, masked
        text = unescape("".join(masked))
        loss.update(text.encode())
        loss_chars += len(text)
        masked = []

    for text, spans in parts:
        chars += len(text)
        for span in spans:
            if masked and not (whole and span["start"] == 0):
                lose()
            masked.append(text[span["start"] : span["end"]])
            whole = False
        whole = bool(spans) and spans[-1]["end"] == len(text)
        if masked and not whole:
            lose()
        held += text
        while held:
            turn = _turn(held)
            if turn is None:
                break
            role, said, end = turn
            turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            n, held = n + 1, held[end:]
    if masked:
        lose()
    if held:
        raise ValueError("the formatted text does not end with a turn")
    return n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def _turn(text: str) -> tuple[str, str, int] | None:
    """Role, escaped text and end of the turn that ``text`` begins with; None if it is not complete."""
    if not text.startswith("### "[: len(text)]):
        raise ValueError("the formatted text does not begin with a turn")
    role = next((m for m in _ROLE_END.finditer(text, 4) if m[0] == ": "), None)
    if role is None:
        return None
    end = next((m for m in _STOP.finditer(text, role.end()) if m[0] == "</turn>\n"), None)
    return None if end is None else (text[4 : role.start()], text[role.end() : end.start()], end.end())
