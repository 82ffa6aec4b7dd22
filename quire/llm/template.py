"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {# comment #}
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in e %} {% endfor %}      with loop.index, loop.index0, loop.first, loop.last
    {% set name = e %} {% set space.name = e %}
    {% generation %} {% endgeneration %}   marks what a model is to produce

A dash inside a tag's bracket ({%- or -%}) trims the white space on that side.
Expressions: literals, names, a.b, a[e] and a[e:e] on dictionaries, lists and strings,
+ - * // % ~, comparisons, in, not in, is and is not with a test (defined, none, string,
number, mapping, sequence), not, and, or, x if c else y, parentheses, filters
(e | upper | default('x')), and the calls namespace(name=e), range(e) and raise_exception(e).

Sandbox: names reach the given variables only; a.b is a dictionary lookup and never a
Python attribute; filters, tests and calls come from fixed tables; strings can't be
repeated and whole numbers stay below 2**63. Every character that an operation makes or
writes and every round of a loop is charged to an allowance (FREE and PER_CHAR times the
input's characters), so a rendering's time and memory are bounded by its input. What isn't
allowed, and what fails in Python, raises TemplateError.

``parse`` gives a tree, ``fold`` evaluates its constant parts, and ``compile_template``
turns it into closures that write to an ``Output``, which also holds the stretches
inside generation marks.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template or an operation in it isn't allowed."""


#: A rendering's allowance: characters and rounds that are free, and more for each character of its input.
FREE = 1 << 22
PER_CHAR = 64
MOST_NUMBER = 1 << 63


# ---- tree ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    op: str
    value: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filter:
    name: str
    value: Any
    args: tuple


@dataclass(frozen=True)
class Test:
    name: str
    value: Any


@dataclass(frozen=True)
class Pick:
    cond: Any
    yes: Any
    no: Any


@dataclass(frozen=True)
class Part:
    of: Any
    start: Any
    stop: Any


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    named: tuple  # of (name, value)


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class Choice:
    branches: tuple  # of (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any
    space: str = ""  # the namespace that has the name


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- lexing and parsing -------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_TOKEN = re.compile(
    r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<op>==|!=|<=|>=|//|[-+*%~<>()\[\].,|=:]))",
    re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 10]!r}")
        at = m.end()
        kind = m.lastgroup
        if kind == "str":
            out.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), m["str"][1:-1], flags=re.S)))
        elif kind == "num":
            out.append(("const", float(m["num"]) if "." in m["num"] else int(m["num"])))
        else:
            out.append((kind, m[kind]))
    return out


class _Expression:
    """Precedence climbing over one tag's tokens."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "//", "%"))

    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, value: Any = None) -> Any:
        kind, got = self.peek()
        if kind == "end" or (value is not None and got != value):
            raise TemplateError(f"expected {value or 'more'}, found {got!r}")
        self.at += 1
        return got

    def word(self) -> str:
        kind, got = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {got!r}")
        self.at += 1
        return got

    def choice(self) -> Any:
        """x if c else y, whose parts bind more tightly."""
        node = self.level(0)
        if self.peek() != ("name", "if"):
            return node
        self.take()
        cond = self.level(0)
        if self.peek() != ("name", "else"):
            return Pick(cond, node, Const(None))
        self.take()
        return Pick(cond, node, self.choice())

    def whole(self) -> Any:
        node = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def level(self, n: int) -> Any:
        if n == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[n] == ("not",):
            if self.peek() == ("name", "not"):
                self.take()
                return Unary("not", self.level(n))
            return self.level(n + 1)
        node = self.level(n + 1)
        while True:
            kind, op = self.peek()
            if kind in ("op", "name") and op in self.LEVELS[n]:
                self.take()
                node = Binary(op, node, self.level(n + 1))
            elif "in" in self.LEVELS[n] and (kind, op) == ("name", "not") and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                node = Unary("not", Binary("in", node, self.level(n + 1)))
            elif "in" in self.LEVELS[n] and (kind, op) == ("name", "is"):
                self.take()
                no = self.peek() == ("name", "not")
                if no:
                    self.take()
                name = self.word()
                if name not in TESTS:
                    raise TemplateError(f"no test {name!r}")
                node = Unary("not", Test(name, node)) if no else Test(name, node)
            else:
                return node

    def filtered(self) -> Any:
        node = self.primary()
        while True:
            if self.peek() == ("op", "."):
                self.take()
                node = Item(node, Const(self.word()))
            elif self.peek() == ("op", "["):
                self.take()
                start = Const(None) if self.peek() == ("op", ":") else self.choice()
                if self.peek() == ("op", ":"):
                    self.take()
                    node = Part(node, start, Const(None) if self.peek() == ("op", "]") else self.choice())
                else:
                    node = Item(node, start)
                self.take("]")
            elif self.peek() == ("op", "|"):
                self.take()
                name, args = self.word(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.peek() == ("op", "("):
                    self.take()
                    while self.peek() != ("op", ")"):
                        args.append(self.choice())
                        if self.peek() == ("op", ","):
                            self.take()
                    self.take(")")
                node = Filter(name, node, tuple(args))
            else:
                return node

    def primary(self) -> Any:
        kind, got = self.peek()
        self.take()
        if kind == "const":
            return Const(got)
        if kind == "name":
            named = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            if self.peek() == ("op", "("):
                return self.call(got)
            return Const(named[got]) if got in named else Name(got)
        if got == "(":
            node = self.choice()
            self.take(")")
            return node
        if got == "-":
            return Unary("-", self.filtered())
        raise TemplateError(f"unexpected {got!r}")


    def call(self, name: str) -> Any:
        if name not in CALLS:
            raise TemplateError(f"no call {name!r}")
        self.take("(")
        args, named = [], []
        while self.peek() != ("op", ")"):
            if self.peek()[0] == "name" and self.tokens[self.at + 1 : self.at + 2] == [("op", "=")]:
                key = self.word()
                self.take("=")
                named.append((key, self.choice()))
            else:
                args.append(self.choice())
            if self.peek() == ("op", ","):
                self.take()
        self.take(")")
        return Call(name, tuple(args), tuple(named))


def expression(source: str) -> Any:
    return _Expression(_tokens(source)).whole()


def parse(source: str) -> tuple:
    """The template's tree: a tuple of Text, Emit, Choice, Loop, Assign and Generation."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        n = 1 if m[2] is not None else 4 if m[5] is not None else 7
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        pieces.append(("text", text.rstrip() if m[n] else text))
        if n != 7:
            pieces.append(("emit" if n == 1 else "tag", m[n + 1].strip()))
        at, trim = m.end(), bool(m[n + 2])
    pieces.append(("text", source[at:].lstrip() if trim else source[at:]))

    place = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place
        out: list = []
        while place < len(pieces):
            kind, got = pieces[place]
            place += 1
            if kind == "text":
                if got:
                    out.append(Text(got))
                continue
            if kind == "emit":
                out.append(Emit(expression(got)))
                continue
            head, _, rest = got.partition(" ")
            if head in ends:
                return tuple(out), got
            if head == "if":
                branches, cond = [], expression(rest)
                while True:
                    inner, end = body(("elif", "else", "endif"))
                    branches.append((cond, inner))
                    if end == "endif":
                        break
                    cond = expression(end.partition(" ")[2]) if end.startswith("elif") else Const(True)
                out.append(Choice(tuple(branches)))
            elif head == "for":
                made = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not made:
                    raise TemplateError(f"bad loop {got!r}")
                inner, _ = body(("endfor",))
                out.append(Loop(made[1], expression(made[2]), inner))
            elif head == "set":
                made = re.fullmatch(r"(?:([A-Za-z_]\w*)\.)?([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)
                if not made:
                    raise TemplateError(f"bad assignment {got!r}")
                out.append(Assign(made[2], expression(made[3]), made[1] or ""))
            elif head == "generation":
                inner, _ = body(("endgeneration",))
                out.append(Generation(inner))
            else:
                raise TemplateError(f"unknown tag {got!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), ""

    return body(())[0]


# ---- operations ---------------------------------------------------------------------


def _text(value: Any) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    if not isinstance(value, str | int | float):
        raise TemplateError("only strings and numbers can be written")
    return str(value)


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, list | tuple | str) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _number(op: Callable) -> Callable:
    def run(a: Any, b: Any) -> Any:
        if isinstance(a, str) or isinstance(b, str) or not isinstance(a, int | float) or not isinstance(b, int | float):
            raise TemplateError("arithmetic takes numbers")
        made = op(a, b)
        if abs(made) >= MOST_NUMBER:
            raise TemplateError("a number is too large")
        return made

    return run


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str):
        return a + b
    return _number(operator.add)(a, b)


OPS: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda a, b: a in b if b is not None else False,
    "~": lambda a, b: _text(a) + _text(b),
    "+": _plus,
    "-": _number(operator.sub),
    "*": _number(operator.mul),
    "//": _number(operator.floordiv),
    "%": _number(operator.mod),
}

#: Control strings of the chat format.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_TO_ESCAPE = re.compile("|".join(["\\\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_ESCAPED = re.compile(r"\\(\\?)")


def escape_controls(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of every control
    string, so none of them is left in the result."""
    return _TO_ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape_controls(text: str) -> str:
    """The text that ``escape_controls`` was given."""
    return _ESCAPED.sub(lambda m: m[1], text) if "\\" in text else text


class Namespace(dict):
    """What ``set space.name`` may change."""


def _refuse(message: Any = "") -> None:
    raise TemplateError(_text(message))


def _range(scope: dict, *ends: int) -> list[int]:
    made = range(*ends[:2])
    _charge(scope, len(made))
    return list(made)


CALLS: dict[str, Callable[..., Any]] = {
    "namespace": lambda scope, **named: Namespace(named),
    "range": _range,
    "raise_exception": lambda scope, message="": _refuse(message),
}
TESTS: dict[str, Callable[[Any], bool]] = {
    "defined": lambda x: x is not None,  # of names and items; see _expression
    "none": lambda x: x is None,
    "string": lambda x: isinstance(x, str),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
    "mapping": lambda x: isinstance(x, dict),
    "sequence": lambda x: isinstance(x, list | tuple | str),
}
FILTERS: dict[str, Callable[..., Any]] = {
    "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "trim": lambda x: _text(x).strip(),
    "length": lambda x: len(x) if x is not None else 0,
    "default": lambda x, other="": other if x is None else x,
    "join": lambda x, by="": _text(by).join(_text(y) for y in x or ()),
    "escape_controls": lambda x: escape_controls(_text(x)),
}


# ---- folding ------------------------------------------------------------------------


def fold(node: Any) -> Any:
    """The tree with constant expressions evaluated, dead branches removed and
    neighbouring texts joined. What would fail is left to fail when it runs."""
    if isinstance(node, tuple):
        return _joined(x for part in node for x in _folded_statement(part))
    if isinstance(node, Item):
        node = Item(fold(node.of), fold(node.key))
        constant = isinstance(node.of, Const) and isinstance(node.key, Const)
    elif isinstance(node, Unary):
        node = Unary(node.op, fold(node.value))
        constant = isinstance(node.value, Const)
    elif isinstance(node, Binary):
        node = Binary(node.op, fold(node.left), fold(node.right))
        if node.op in ("and", "or") and isinstance(node.left, Const):
            return node.right if bool(node.left.value) == (node.op == "and") else node.left
        constant = isinstance(node.left, Const) and isinstance(node.right, Const)
    elif isinstance(node, Filter):
        node = Filter(node.name, fold(node.value), tuple(fold(a) for a in node.args))
        constant = isinstance(node.value, Const) and all(isinstance(a, Const) for a in node.args)
    elif isinstance(node, Test):
        node = Test(node.name, fold(node.value))
        constant = isinstance(node.value, Const)
    elif isinstance(node, Part):
        node = Part(fold(node.of), fold(node.start), fold(node.stop))
        constant = all(isinstance(x, Const) for x in (node.of, node.start, node.stop))
    elif isinstance(node, Pick):
        node = Pick(fold(node.cond), fold(node.yes), fold(node.no))
        return (node.yes if node.cond.value else node.no) if isinstance(node.cond, Const) else node
    elif isinstance(node, Call):
        return Call(node.name, tuple(fold(a) for a in node.args), tuple((k, fold(v)) for k, v in node.named))
    else:
        return node
    if constant:
        try:
            return Const(_expression(node)({}))
        except Exception:
            return node
    return node


def _folded_statement(node: Any) -> Iterable[Any]:
    if isinstance(node, Emit):
        value = fold(node.value)
        if isinstance(value, Const):
            try:
                return (Text(_text(value.value)),)
            except ValueError:
                pass
        return (Emit(value),)
    if isinstance(node, Choice):
        kept = []
        for cond, body in node.branches:
            cond = fold(cond)
            if isinstance(cond, Const) and not cond.value:
                continue
            kept.append((cond, fold(body)))
            if isinstance(cond, Const):
                break
        if not kept:
            return ()
        if isinstance(kept[0][0], Const):
            return kept[0][1]
        return (Choice(tuple(kept)),)
    if isinstance(node, Loop):
        return (Loop(node.name, fold(node.over), fold(node.body)),)
    if isinstance(node, Assign):
        return (Assign(node.name, fold(node.value), node.space),)
    if isinstance(node, Generation):
        return (Generation(fold(node.body)),)
    return (node,)


def _joined(nodes: Iterable[Any]) -> tuple:
    out: list = []
    for node in nodes:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            out.append(node)
    return tuple(out)


# ---- closures -----------------------------------------------------------------------


@dataclass
class Output:
    """What a rendering has written, and its generation stretches in code points."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    marked: list[tuple[int, int]] = field(default_factory=list)
    left: int = FREE  # of the allowance

    def charge(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise TemplateError("a rendering makes too much of its input")

    def write(self, text: str) -> None:
        self.charge(len(text))
        self.parts.append(text)
        self.length += len(text)

    @property
    def text(self) -> str:
        return "".join(self.parts)


Scope = dict[str, Any]
#: Where a scope holds its Output; no name is empty. Constants are folded without one.
_OUT = ""


def _charge(scope: Scope, n: int) -> None:
    if _OUT in scope:
        scope[_OUT].charge(n)


def _made(scope: Scope, value: Any) -> Any:
    """``value``, charged by its size."""
    if isinstance(value, str | list | tuple):
        _charge(scope, len(value))
    return value


def _size(value: Any) -> int:
    """Characters and items of the variables."""
    if isinstance(value, dict):
        return 1 + sum(_size(x) for x in value.values())
    if isinstance(value, list | tuple):
        return 1 + sum(map(_size, value))
    return len(value) if isinstance(value, str) else 1


def _expression(node: Any) -> Callable[[Scope], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _expression(node.of), _expression(node.key)
        return lambda scope: _get(of(scope), key(scope))
    if isinstance(node, Unary):
        value = _expression(node.value)
        if node.op == "not":
            return lambda scope: not value(scope)
        return lambda scope: OPS["-"](0, value(scope))
    if isinstance(node, Filter):
        call, value, args = FILTERS[node.name], _expression(node.value), [_expression(a) for a in node.args]
        return lambda scope: _made(scope, call(value(scope), *(a(scope) for a in args)))
    if isinstance(node, Test):
        if node.name == "defined" and isinstance(node.value, Name):
            name = node.value.name
            return lambda scope: name in scope
        if node.name == "defined" and isinstance(node.value, Item):
            holder, at = _expression(node.value.of), _expression(node.value.key)
            return lambda scope: at(scope) in h if isinstance(h := holder(scope), dict) else _get(h, at(scope)) is not None
        test, tested = TESTS[node.name], _expression(node.value)
        return lambda scope: test(tested(scope))
    if isinstance(node, Pick):
        cond, yes, no = _expression(node.cond), _expression(node.yes), _expression(node.no)
        return lambda scope: yes(scope) if cond(scope) else no(scope)
    if isinstance(node, Part):
        whole, start, stop = _expression(node.of), _expression(node.start), _expression(node.stop)

        def cut(scope: Scope) -> Any:
            of = whole(scope)
            if not isinstance(of, str | list | tuple):
                raise TemplateError("parts are of lists and strings")
            return _made(scope, of[start(scope) : stop(scope)])

        return cut
    if isinstance(node, Call):
        function, values = CALLS[node.name], [_expression(a) for a in node.args]
        named = [(k, _expression(v)) for k, v in node.named]
        return lambda scope: function(scope, *(v(scope) for v in values), **{k: v(scope) for k, v in named})
    if isinstance(node, Binary):
        left, right = _expression(node.left), _expression(node.right)
        if node.op == "and":
            return lambda scope: left(scope) and right(scope)
        if node.op == "or":
            return lambda scope: left(scope) or right(scope)
        op = OPS[node.op]
        if node.op == "in":
            return lambda scope: op(left(scope), _made(scope, right(scope)))
        return lambda scope: _made(scope, op(left(scope), right(scope)))
    raise TemplateError(f"not an expression: {node!r}")


def _statement(node: Any) -> Callable[[Scope, Output], None]:
    if isinstance(node, Text):
        text = node.text
        return lambda scope, out: out.write(text)
    if isinstance(node, Emit):
        value = _expression(node.value)
        return lambda scope, out: out.write(_text(value(scope)))
    if isinstance(node, Assign):
        name, space, value = node.name, node.space, _expression(node.value)

        def assign(scope: Scope, out: Output) -> None:
            if not space:
                scope[name] = value(scope)
            elif isinstance(scope.get(space), Namespace):
                scope[space][name] = value(scope)
            else:
                raise TemplateError(f"{space!r} is no namespace")

        return assign
    if isinstance(node, Choice):
        branches = [(_expression(c), _body(b)) for c, b in node.branches]

        def choose(scope: Scope, out: Output) -> None:
            for cond, run in branches:
                if cond(scope):
                    run(scope, out)
                    return

        return choose
    if isinstance(node, Loop):
        name, over, run = node.name, _expression(node.over), _body(node.body)

        def loop(scope: Scope, out: Output) -> None:
            items = over(scope) or ()
            if not isinstance(items, list | tuple):
                raise TemplateError("loops run over lists")
            inner = dict(scope)
            for i, item in enumerate(items):
                out.charge(1)
                inner[name] = item
                inner["loop"] = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(items) - 1}
                run(inner, out)

        return loop
    if isinstance(node, Generation):
        run_inside = _body(node.body)

        def generation(scope: Scope, out: Output) -> None:
            start = out.length
            run_inside(scope, out)
            out.marked.append((start, out.length))

        return generation
    raise TemplateError(f"not a statement: {node!r}")


def _body(nodes: tuple) -> Callable[[Scope, Output], None]:
    runs = [_statement(n) for n in nodes]
    if len(runs) == 1:
        return runs[0]

    def run(scope: Scope, out: Output) -> None:
        for r in runs:
            r(scope, out)

    return run


def compile_template(source: str) -> Callable[[Scope], Output]:
    """Parses, folds and compiles; the result renders a dictionary of variables."""
    run = _body(fold(parse(source)))

    def render(variables: Scope) -> Output:
        out = Output(left=FREE + PER_CHAR * _size(variables))
        try:
            run({**variables, _OUT: out}, out)
        except TemplateError:
            raise
        except (TypeError, ValueError, ArithmeticError, RecursionError) as e:
            raise TemplateError(f"an operation failed: {e}") from e
        return out

    return render
