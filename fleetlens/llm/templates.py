"""A small sandboxed template language, compiled to Python closures.

Syntax, a subset of the usual chat template language:
    {{ expression }}                       {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in messages %} {% endfor %}  {% generation %} {% endgeneration %}   {# comment #}
Expressions: names, 'strings', integers, true, false, none, a.b, a['b'], == != < <= > >=, in, + , and, or, not,
e if c else d, (e), and filters: e | trim, upper, lower, line. Attributes are looked up in mappings only; there are no
calls, no imports and no way to a Python attribute.

A template is lexed, parsed to a syntax tree, folded (constant expressions and branches, adjacent texts) and
turned into closures that write to an `Output`. What an expression yields is escaped on the way out, so that no
control string inside a value survives; template text is not. Text inside a generation block is marked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

# ---- escaping ------------------------------------------------------------------------------------------------

_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """`<|` becomes `<\\|`, and `<\\|` one backslash more, so no `<|` is left and nothing is lost."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def line(text: str) -> str:
    """The text on one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "line": line}


class TemplateError(ValueError):
    """The template is not in the language, or asks for what the sandbox lacks."""


# ---- syntax tree ---------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: str


@dataclass(frozen=True)
class Operation:
    """An operator, filter or conditional on parts."""

    op: str
    parts: tuple


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
    "not": lambda a: not a, "and": lambda a, b: a and b, "or": lambda a, b: a or b,
    "if": lambda test, then, other: then if test else other,
    **{f"|{k}": f for k, f in FILTERS.items()},
}

# ---- parser --------------------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+|.()\[\]]))")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:at + 10]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {values}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        e = self.conditional()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return e

    def conditional(self):
        e = self.either()
        if self.peek("if"):
            self.take("if")
            test = self.either()
            self.take("else")
            return Operation("if", (test, e, self.conditional()))
        return e

    def _chain(self, below: Callable, *ops: str):
        e = below()
        while self.peek(*ops):
            e = Operation(self.take(*ops), (e, below()))
        return e

    def either(self):
        return self._chain(lambda: self._chain(self.negation, "and"), "or")

    def negation(self):
        if self.peek("not"):
            self.take("not")
            return Operation("not", (self.negation(),))
        return self._chain(lambda: self._chain(self.filtered, "+"), "==", "!=", "<", "<=", ">", ">=", "in")

    def filtered(self):
        e = self.primary()
        while self.peek("|", ".", "["):
            sign = self.take("|", ".", "[")
            kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
            self.at += 1
            if sign == "|" and kind == "name" and value in FILTERS:
                e = Operation(f"|{value}", (e,))
            elif sign == "." and kind == "name":
                e = Item(e, value)
            elif sign == "[" and kind == "string":
                e = Item(e, value[1:-1])
                self.take("]")
            else:
                raise TemplateError(f"unexpected {value!r} after {sign!r}")
        return e

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1]))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        if value == "(":
            e = self.conditional()
            self.take(")")
            return e
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    stack: list[tuple[str, list, dict]] = [("", [], {})]
    at = 0

    def body() -> list:
        return stack[-1][1]

    for m in _PARTS.finditer(source):
        if m.start() > at:
            body().append(Emit(Const(source[at:m.start()])))
        at = m.end()
        if m[1] is not None:
            body().append(Emit(Operation("escape", (_Expression(m[1]).whole(),))))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word in ("if", "elif"):
                if word == "elif" and (not stack[-1][2] or stack[-1][0] != "if"):
                    raise TemplateError("elif without if")
                stack.append((word, [], {"test": _Expression(rest).whole()}))
                if word == "elif":
                    stack[-1] = ("if", stack[-1][1], stack[-1][2] | {"inner": True})
            elif word == "else":
                if stack[-1][0] != "if":
                    raise TemplateError("else without if")
                stack.append(("else", [], {}))
            elif word == "for":
                f = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.S)
                if not f:
                    raise TemplateError("for needs a name and an expression")
                stack.append(("for", [], {"name": f[1], "over": _Expression(f[2]).whole()}))
            elif word == "generation":
                stack.append(("generation", [], {}))
            elif word in ("endif", "endfor", "endgeneration"):
                _shut(stack, word[3:])
            else:
                raise TemplateError(f"unknown tag {word!r}")
    if at < len(source):
        body().append(Emit(Const(source[at:])))
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return tuple(stack[0][1])


def _shut(stack: list[tuple[str, list, dict]], kind: str) -> None:
    """Close the innermost block of a kind; an if takes its else and elif branches with it."""
    other: tuple = ()
    while True:
        tag, body, given = stack.pop()
        if kind == "if" and tag == "else" and not other:
            other = tuple(body)
            continue
        if tag != kind:
            raise TemplateError(f"end{kind} without {kind}")
        if tag == "if":
            node = If(given["test"], tuple(body), other)
            if given.get("inner"):
                other = (node,)
                continue
            stack[-1][1].append(node)
        elif tag == "for":
            stack[-1][1].append(For(given["name"], given["over"], tuple(body)))
        else:
            stack[-1][1].append(Generation(tuple(body)))
        return


# ---- folding -------------------------------------------------------------------------------------------------

def fold_expression(e):
    if isinstance(e, Item):
        return Item(fold_expression(e.of), e.key)
    if not isinstance(e, Operation):
        return e
    parts = tuple(fold_expression(p) for p in e.parts)
    if e.op in ("and", "or", "if") and isinstance(parts[0], Const):
        test = bool(parts[0].value)
        if e.op == "if":
            return parts[1] if test else parts[2]
        return parts[1] if test == (e.op == "and") else parts[0]
    if all(isinstance(p, Const) for p in parts):
        values = [p.value for p in parts]
        return Const(escape(_text(values[0])) if e.op == "escape" else OPERATORS[e.op](*values))
    return Operation(e.op, parts)


def fold(nodes: Iterable) -> tuple:
    """Constant expressions, branches on constants and adjacent constant texts, folded."""
    out: list = []
    for n in nodes:
        if isinstance(n, Emit):
            n = Emit(fold_expression(n.value))
            if isinstance(n.value, Const):
                if not _text(n.value.value):
                    continue
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    out[-1] = Emit(Const(_text(out[-1].value.value) + _text(n.value.value)))
                    continue
            out.append(n)
        elif isinstance(n, If):
            test = fold_expression(n.test)
            if isinstance(test, Const):
                for x in fold(n.then if test.value else n.other):
                    out = list(fold([*out, x])) if isinstance(x, Emit) else [*out, x]
            else:
                out.append(If(test, fold(n.then), fold(n.other)))
        elif isinstance(n, For):
            out.append(For(n.name, fold_expression(n.over), fold(n.body)))
        else:
            out.append(Generation(fold(n.body)))
    return tuple(out)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# ---- closures ------------------------------------------------------------------------------------------------

@dataclass
class Output:
    """Rendered text and the ranges, in code points, that generation blocks wrote."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[int] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(e) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        v = e.value
        return lambda names: v
    if isinstance(e, Name):
        name = e.name
        return lambda names: names.get(name)
    if isinstance(e, Item):
        of, key = _value(e.of), e.key

        def item(names: dict):
            found = of(names)
            return found.get(key) if isinstance(found, dict) else None

        return item
    parts = [_value(p) for p in e.parts]
    if e.op in ("and", "or"):
        a, b = parts
        return (lambda names: a(names) and b(names)) if e.op == "and" else (lambda names: a(names) or b(names))
    if e.op == "if":
        test, then, other = parts
        return lambda names: then(names) if test(names) else other(names)
    if e.op == "escape":
        (a,) = parts
        return lambda names: escape(_text(a(names)))
    f = OPERATORS[e.op]
    if e.op.startswith("|"):
        (a,) = parts
        return lambda names: f(_text(a(names)))
    if len(parts) == 1:
        (a,) = parts
        return lambda names: f(a(names))
    a, b = parts
    return lambda names: f(a(names), b(names))


def _render(nodes: tuple) -> Callable[[dict, Output], None]:
    steps = [_step(n) for n in nodes]

    def run(names: dict, out: Output) -> None:
        for s in steps:
            s(names, out)

    return steps[0] if len(steps) == 1 else run


def _step(n) -> Callable[[dict, Output], None]:
    if isinstance(n, Emit):
        if isinstance(n.value, Const):
            text = _text(n.value.value)
            return lambda names, out: out.write(text)
        value = _value(n.value)
        return lambda names, out: out.write(_text(value(names)))
    if isinstance(n, If):
        test, then, other = _value(n.test), _render(n.then), _render(n.other)
        return lambda names, out: then(names, out) if test(names) else other(names, out)
    if isinstance(n, For):
        over, body, name = _value(n.over), _render(n.body), n.name

        def loop(names: dict, out: Output) -> None:
            for i, x in enumerate(over(names) or ()):
                body({**names, name: x, "loop": {"index0": i, "index": i + 1, "first": i == 0}}, out)

        return loop
    inner = _render(n.body)

    def generation(names: dict, out: Output) -> None:
        start = out.length
        inner(names, out)
        out.spans += [start, out.length]

    return generation


class Template:
    """A compiled template. Its loop over `messages` can be fed turn by turn, so a conversation of any length streams."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For)]
        if len(loops) != 1 or self.tree[loops[0]].over != Name("messages"):
            raise TemplateError("a chat template has one loop, over messages, at its top level")
        at, loop = loops[0], self.tree[loops[0]]
        self.name, self._before, self._turn, self._after = loop.name, _render(self.tree[:at]), _render(loop.body), _render(self.tree[at + 1:])

    def stream(self, messages: Iterable[dict], names: dict | None = None) -> Iterator[Output]:
        """What comes before the turns, each turn, and what comes after."""
        names = dict(names or {})
        yield self._run(self._before, names)
        for i, m in enumerate(messages):
            yield self._run(self._turn, {**names, self.name: m, "loop": {"index0": i, "index": i + 1, "first": i == 0}})
        yield self._run(self._after, names)

    @staticmethod
    def _run(step: Callable[[dict, Output], None], names: dict) -> Output:
        out = Output()
        step(names, out)
        return out

    def render(self, messages: Iterable[dict], names: dict | None = None) -> tuple[str, list[int]]:
        """The whole text and its generation ranges."""
        text, spans, length = [], [], 0
        for out in self.stream(messages, names):
            text += out.parts
            spans += [length + x for x in out.spans]
            length += out.length
        return "".join(text), spans
