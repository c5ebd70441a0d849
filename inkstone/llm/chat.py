"""Chat formatting: a small sandboxed template language, compiled to Python closures.

The language has text, `{{ expression }}`, `{# comment #}`, `{% for name in expression %}`, `{% if %}`/`{% elif %}`/`{% else %}`,
`{% set name = expression %}` and `{% generation %}`, each block ended by `{% end… %}`; a `-` at a tag's edge drops the white
space beside it. Expressions have strings, integers, true, false, none, names, `a.b` and `a['b']` on mappings, `a[0]` on lists,
`+`, `==`, `!=`, `<`, `<=`, `>`, `>=`, `in`, `not in`, `and`, `or`, `not`, parentheses and `| filter`: `trim`, `upper`, `lower`,
`length` and those given to the compiler. A loop's name and `loop` hold within the loop only. There are no calls and no
attributes of Python objects, so a template can reach nothing but its data; nesting is limited to DEPTH, and a value that a
template makes to LONGEST characters. A template is parsed to a syntax tree, constant parts are folded, and each
node becomes a closure that yields (text, under a generation marker) pieces. `for` takes its items one by one with one
item looked ahead (for `loop.last`), so a conversation of any length is rendered in the memory of a turn.

Edge cases of `format_conversations`: a null text or role is empty; a null conversation id is a conversation of its
own; rows with the same turn come by role, then text; null turns come first; repeated rows are turns like others; an
empty table gives no rows. Other columns are not read, so they may clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Pieces = Iterator[tuple[str, bool]]


#: Levels of blocks and of expressions.
DEPTH = 50
#: Characters of a string that `+` makes.
LONGEST = 1 << 26


class TemplateError(ValueError):
    pass


# Syntax tree. An expression is ("const", value), ("name", n), ("get", e, key), (operator, e, ...) or ("filter", e, name).


@dataclass
class Text:
    value: str


@dataclass
class Output:
    value: tuple


@dataclass
class Set:
    name: str
    value: tuple


@dataclass
class If:
    branches: list[tuple[tuple, list]]


@dataclass
class For:
    name: str
    items: tuple
    body: list


@dataclass
class Generation:
    body: list = field(default_factory=list)


_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+.|()\[\]=<>]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"not understood: {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _tokens(source), 0, 0

    def take(self, *values: str) -> bool:
        if self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return True
        return False

    def need(self, kind: str) -> str:
        found, value = self.tokens[self.at]
        if found != kind:
            raise TemplateError(f"{kind} expected, not {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        out = self.either()
        self.need("end")
        return out

    def deeper(self, part: Callable[[], tuple]) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        out = part()
        self.depth -= 1
        return out

    def either(self) -> tuple:
        return self.deeper(self._either)

    def _either(self) -> tuple:
        left, n = self.both(), 0
        while self.take("or"):
            left, n = ("or", left, self.both()), self.chained(n)
        return left

    def chained(self, n: int) -> int:
        """A chain of operators is as deep a tree as it is long."""
        if n >= DEPTH:
            raise TemplateError("too long a chain")
        return n + 1

    def both(self) -> tuple:
        left, n = self.negated(), 0
        while self.take("and"):
            left, n = ("and", left, self.negated()), self.chained(n)
        return left

    def negated(self) -> tuple:
        return ("not", self.deeper(self.negated)) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.sum()
        for op in ("==", "!=", "<=", ">=", "<", ">", "in"):
            if self.take(op):
                return (op, left, self.sum())
        if self.take("not"):
            if not self.take("in"):
                raise TemplateError("in expected")
            return ("not", ("in", left, self.sum()))
        return left

    def sum(self) -> tuple:
        left, n = self.filtered(), 0
        while self.take("+"):
            left, n = ("+", left, self.filtered()), self.chained(n)
        return left

    def filtered(self) -> tuple:
        left, n = self.reached(), 0
        while self.take("|"):
            left, n = ("filter", left, self.need("name")), self.chained(n)
        return left

    def reached(self) -> tuple:
        left, n = self.atom(), 0
        while True:
            n = self.chained(n)
            if self.take("."):
                left = ("get", left, ("const", self.need("name")))
            elif self.take("["):
                left = ("get", left, self.either())
                if not self.take("]"):
                    raise TemplateError("] expected")
            else:
                return left

    def atom(self) -> tuple:
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        if (kind, value) == ("op", "("):
            inner = self.either()
            if not self.take(")"):
                raise TemplateError(") expected")
            return inner
        raise TemplateError(f"not expected: {value!r}")


_INSIDE = r"""(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|(?!-?[%}]\}).)*"""
_TAG = re.compile(r"\{\{-?(" + _INSIDE + r")-?\}\}|\{%-?(" + _INSIDE + r")-?%\}|\{#-?.*?-?#\}", re.S)


def parse(source: str) -> list:
    """The syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    at, bare = 0, False

    def text(end: int, strip: bool) -> None:
        own = source[at:end].lstrip() if bare else source[at:end]
        if own := own.rstrip() if strip else own:
            stack[-1][1].append(Text(own))

    for m in _TAG.finditer(source):
        text(m.start(), m[0][2] == "-")
        at, bare = m.end(), m[0][-3] == "-"
        if m[1] is not None:
            stack[-1][1].append(Output(_Expression(m[1]).whole()))
            continue
        if m[2] is None:
            continue
        if len(stack) > DEPTH:
            raise TemplateError("nested too deeply")
        word, _, rest = m[2].strip().partition(" ")
        here = stack[-1][1]
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"not a name: {name!r}")
            here.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "for":
            name, _, items = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError(f"not a name: {name!r}")
            here.append(For(name.strip(), _Expression(items).whole(), []))
            stack.append(("for", here[-1].body))
        elif word == "if":
            here.append(If([(_Expression(rest).whole(), [])]))
            stack.append(("if", here[-1].branches[-1][1]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            branches = stack[-2][1][-1].branches
            branches.append((_Expression(rest).whole() if word == "elif" else ("const", True), []))
            stack[-1] = ("if", branches[-1][1])
        elif word == "generation":
            here.append(Generation())
            stack.append(("generation", here[-1].body))
        elif word == f"end{stack[-1][0]}" and len(stack) > 1:
            stack.pop()
        else:
            raise TemplateError(f"not expected: {m[2].strip()!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} without end")
    text(len(source), False)
    return root


def _joined(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int):
        return a + b
    a, b = _shown(a), _shown(b)
    if len(a) + len(b) > LONGEST:
        raise TemplateError("a string is too long")
    return a + b


def _ordered(test: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    """Of two numbers or two strings; anything else has no order."""
    return lambda a, b: isinstance(a, int | str) and isinstance(b, int | str) and isinstance(a, str) == isinstance(b, str) and test(a, b)


_OPERATORS: dict[str, Callable] = {
    "+": _joined,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b),
    "<=": _ordered(lambda a, b: a <= b),
    ">": _ordered(lambda a, b: a > b),
    ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: isinstance(a, str) and a in b if isinstance(b, str) else isinstance(b, Mapping | list | tuple) and a in b,
}


def _length(value: Any) -> int:
    return len(value) if isinstance(value, str | Mapping | list | tuple) else 0


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _get(value: Any, key: Any) -> Any:
    if isinstance(value, list | tuple) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    return value.get(key) if isinstance(value, Mapping) else None


def _fold(e: tuple, filters: Mapping[str, Callable[[str], str]]) -> tuple:
    """`e` with its constant parts worked out."""
    if e[0] in ("const", "name"):
        return e
    if e[0] == "filter":
        if e[2] not in filters:
            raise TemplateError(f"no filter {e[2]!r}")
        inner = _fold(e[1], filters)
        return ("const", _evaluator(("filter", inner, e[2]), filters)({})) if inner[0] == "const" else ("filter", inner, e[2])
    parts = [_fold(x, filters) for x in e[1:]]
    if all(x[0] == "const" for x in parts):
        return ("const", _evaluator((e[0], *parts), filters)({}))
    return (e[0], *parts)


def _evaluator(e: tuple, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "filter":
        inner, f = _evaluator(e[1], filters), filters[e[2]]
        if f is _length:
            return lambda scope: f(inner(scope))
        return lambda scope: f(_shown(inner(scope)))
    parts = [_evaluator(x, filters) for x in e[1:]]
    if kind == "not":
        return lambda scope: not parts[0](scope)
    a, b = parts
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "get":
        return lambda scope: _get(a(scope), b(scope))
    f = _OPERATORS[kind]
    return lambda scope: f(a(scope), b(scope))


def fold(nodes: list, filters: Mapping[str, Callable[[str], str]]) -> list:
    """The tree with constants worked out: constant outputs become text, texts in a row one, and branches that a
    constant decides go."""
    out: list = []
    for node in nodes:
        if isinstance(node, Output):
            e = _fold(node.value, filters)
            node = Text(_shown(e[1])) if e[0] == "const" else Output(e)
        elif isinstance(node, Set):
            node = Set(node.name, _fold(node.value, filters))
        elif isinstance(node, For):
            node = For(node.name, _fold(node.items, filters), fold(node.body, filters))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body, filters))
        elif isinstance(node, If):
            branches = []
            for test, body in node.branches:
                test = _fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold(body, filters)))
                if test[0] == "const":
                    break
            if not branches:
                continue
            if branches[0][0][0] == "const":
                out += branches[0][1]
                continue
            node = If(branches)
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            out.append(node)
    return out


def _block(nodes: list, filters: Mapping, marked: bool) -> Callable[[dict], Pieces]:
    steps = [_closure(x, filters, marked) for x in nodes]

    def run(scope: dict) -> Pieces:
        for step in steps:
            yield from step(scope)

    return run


def _closure(node: Any, filters: Mapping, marked: bool) -> Callable[[dict], Pieces]:
    if isinstance(node, Text):
        piece = (node.value, marked)
        return lambda scope: iter((piece,))
    if isinstance(node, Output):
        value = _evaluator(node.value, filters)
        return lambda scope: iter(((_shown(value(scope)), marked),))
    if isinstance(node, Set):
        value = _evaluator(node.value, filters)

        def assign(scope: dict) -> Pieces:
            scope[node.name] = value(scope)
            return iter(())

        return assign
    if isinstance(node, Generation):
        return _block(node.body, filters, True)
    if isinstance(node, If):
        branches = [(_evaluator(test, filters), _block(body, filters, marked)) for test, body in node.branches]

        def choose(scope: dict) -> Pieces:
            for test, body in branches:
                if test(scope):
                    return body(scope)
            return iter(())

        return choose
    items, body = _evaluator(node.items, filters), _block(node.body, filters, marked)

    def loop(scope: dict) -> Pieces:
        rest = iter(items(scope) or ())
        end = object()
        before = {n: scope.get(n, end) for n in (node.name, "loop")}
        now, k = next(rest, end), 0
        while now is not end:
            after = next(rest, end)
            scope |= {node.name: now, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": after is end}}
            yield from body(scope)
            now, k = after, k + 1
        for n, was in before.items():
            if was is end:
                scope.pop(n, None)
            else:
                scope[n] = was

    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[str], str]] | None = None) -> Callable[..., Pieces]:
    """A function of the template's names that yields (text, under a generation marker)."""
    filters = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": _length, **(filters or {})}
    run = _block(fold(parse(source), filters), filters, False)
    return lambda **names: run(dict(names))


#: Control strings of common chat formats and of the template below.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
TEMPLATE = "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}<|end|>{{ '\\n' }}{% endfor %}"


def escape(text: str) -> str:
    """`text` without control strings: backslashes doubled, and one put after the first character of each of them."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def turns(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """(formatted turn, with its end; (start, end) of what is under the generation marker) of rendered pieces."""
    text, spans = "", []
    for piece, marked in pieces:
        if marked and piece:
            spans.append((len(text), len(text) + len(piece)))
        text += piece
        while m := _TURN.match(text):
            yield m[0], m, [s for s in spans if s[0] < m.end()]
            spans = [(a - m.end(), b - m.end()) for a, b in spans if a >= m.end()]
            text = text[m.end() :]
    if text:
        raise ValueError("a turn without its end")


def _conversations(batches: Iterator[pa.RecordBatch], kind: list[pa.DataType]) -> Iterator[list[Any]]:
    """The rows; the type of the ids is put into `kind` before the first."""
    for batch in batches:
        kind[:] = [batch.column("conv_id").type]
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)


def _render(batches: Iterator[pa.RecordBatch], template: str, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn; memory is that of a turn, or of a conversation's text if it is asked for."""
    render = compile_template(template, {"escape": escape})
    kind: list[pa.DataType] = []
    rows = _conversations(batches, kind)
    row, out = next(rows, None), []
    same = lambda a, b: a == b or (a != a and b != b)  # noqa: E731  not a number is one id
    while row is not None:
        conv = row[0]

        def messages() -> Iterator[dict]:
            nonlocal row
            while row is not None and same(row[0], conv):
                now = {"role": row[1] or "", "text": row[2] or ""}
                row = next(rows, None)
                yield now

        n, chars, loss_chars, every, loss, kept = 0, 0, 0, hashlib.sha256(), hashlib.sha256(), []
        for formatted, m, spans in turns(render(messages=messages())):
            n, chars = n + 1, chars + len(formatted)
            every.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            for a, b in spans:
                own = unescape(formatted[a:b])
                loss_chars += len(own)
                loss.update(own.encode())
            if with_text:
                kept.append(formatted)
        out.append((conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, *["".join(kept)] * with_text))
        if len(out) >= 1000 or row is None:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", *["formatted"] * with_text]
            types = [kind[0], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * with_text]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
            out = []


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, with_text: bool = True) -> DataFrame:
    """A row for each conversation: its formatted text, and digests read back from that text.

    Digests: n_turns; turns_sha256 of role, newline, text, newline of each turn; loss_chars and loss_sha256 of what is
    under the generation markers, unescaped; formatted_chars. Rows go through a task one by one in order, so that a
    conversation of any length needs the memory of a turn only when `with_text` is false.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint" + ", formatted string" * with_text
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda b: _render(b, template, with_text), schema)
