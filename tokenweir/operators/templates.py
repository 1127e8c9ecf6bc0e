"""Chat templates as Spark expressions.

A tokenizer's template is text with fields ``{{ }}`` and blocks ``{% %}``: loops over the messages, conditions, local names. The part
of that language which chat templates use is read once into a tree of functions, and the tree, given the columns of a row, makes one
expression: a loop becomes ``transform`` over the messages, a condition ``when``. So rendering stays in the plan, without a step in
Python for each row. What the part does not know is refused by name. A null content renders as empty text.

As tokenizer files do, a line break after a block goes, and blanks before a block that begins its line; ``-`` at a mark takes all
white space on its side.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A tree: from the names that hold at a place to the expression.
Node = Callable[[dict], object]

_MARK = re.compile(r"(?:^[ \t]*(?=\{%-?\+?))?\{([{%#])(-?)(.*?)(-?)[}%#]\}", re.S | re.M)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>()\[\].,|:]))""")


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at, code = [], 0, code.strip()
    while at < len(code):
        m = _TOKEN.match(code, at)
        if m is None:
            raise ValueError(f"a template cannot be read at: {code[at : at + 20]}")
        kind = next(k for k, v in zip(("text", "number", "name", "mark"), m.groups(), strict=True) if v is not None)
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def _unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _text(value) -> Column:
    if value is None or isinstance(value, bool):
        value = str(value)
    return F.coalesce(_column(value).cast("string"), F.lit(""))


def _joined(*values) -> object:
    """Texts behind one another; whole numbers that are known add up."""
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return sum(values)
    return "".join(values) if all(isinstance(v, str) for v in values) else F.concat(*map(_text, values))


def _compared(mark: str, a, b) -> object:
    if not isinstance(a, Column) and not isinstance(b, Column):
        return {"==": a == b, "!=": a != b}[mark] if mark in ("==", "!=") else {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[mark]
    a, b = _column(a), _column(b)
    return {"==": a.eqNullSafe(b), "!=": ~a.eqNullSafe(b), "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[mark]


def _not(a) -> object:
    return ~a if isinstance(a, Column) else not a


def _both(a, b) -> object:
    return (b if a else a) if not isinstance(a, Column) else a & _column(bool(b) if not isinstance(b, Column) else b)


def _either(a, b) -> object:
    return (a if a else b) if not isinstance(a, Column) else a | _column(bool(b) if not isinstance(b, Column) else b)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: F.regexp_replace(_text(x), r"^\s+|\s+$", ""),
    "upper": lambda x: F.upper(_text(x)),
    "lower": lambda x: F.lower(_text(x)),
    "length": lambda x: F.size(x),
    "string": lambda x: x,
}


class _Expression:
    """Reads one expression, from the weakest mark to the strongest."""

    def __init__(self, code: str) -> None:
        self.tokens, self.at = _tokens(code), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def next(self, value: str | None = None) -> str:
        kind, own = self.peek()
        if kind == "end" or value is not None and own != value:
            raise ValueError(f"a template needs {value or 'a value'}, not {own or 'its end'}")
        self.at += 1
        return own

    def takes(self, *values: str) -> str | None:
        kind, own = self.peek()
        return self.next() if kind in ("mark", "name") and own in values else None

    def whole(self) -> Node:
        out = self.either()
        if self.peek()[0] != "end":
            raise ValueError(f"a template goes on at: {self.peek()[1]}")
        return out

    def either(self) -> Node:
        out = self.both()
        while self.takes("or"):
            out = (lambda a, b: lambda e: _either(a(e), b(e)))(out, self.both())
        return out

    def both(self) -> Node:
        out = self.negated()
        while self.takes("and"):
            out = (lambda a, b: lambda e: _both(a(e), b(e)))(out, self.negated())
        return out

    def negated(self) -> Node:
        if self.takes("not"):
            own = self.negated()
            return lambda e: _not(own(e))
        return self.compared()

    def compared(self) -> Node:
        left = self.added()
        if self.takes("is"):
            turned, what = bool(self.takes("not")), self.next()
            if what not in ("defined", "none"):
                raise ValueError(f"a template asks whether a value is {what}")

            def known(e: dict) -> object:
                try:
                    value = left(e)
                except KeyError:
                    value = None
                there = value.isNotNull() if isinstance(value, Column) else value is not None
                return there if (what == "defined") != turned else _not(there)

            return known
        if self.takes("in"):
            right = self.added()
            return lambda e: F.contains(_text(right(e)), _text(left(e)))
        mark = self.takes("==", "!=", "<", ">", "<=", ">=")
        if mark is None:
            return left
        right = self.added()
        return lambda e: _compared(mark, left(e), right(e))

    def added(self) -> Node:
        parts = [self.filtered()]
        while self.takes("+", "~"):
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else lambda e: _joined(*(p(e) for p in parts))

    def filtered(self) -> Node:
        out = self.value()
        while self.takes("|"):
            name = self.next()
            if name not in FILTERS:
                raise ValueError(f"a template uses the filter {name}")
            out = (lambda x, f: lambda e: f(x(e)))(out, FILTERS[name])
        return out

    def value(self) -> Node:
        kind, own = self.peek()
        self.next()
        if kind == "text":
            literal = _unquoted(own)
            out: Node = lambda e: literal
        elif kind == "number":
            number = int(own)
            out = lambda e: number
        elif own == "(":
            out = self.either()
            self.next(")")
        elif own in ("true", "True", "false", "False", "none", "None"):
            known = {"t": True, "f": False, "n": None}[own[0].lower()]
            out = lambda e: known
        elif own == "raise_exception":
            self.next("(")
            said = self.either()
            self.next(")")
            return lambda e: F.raise_error(_text(said(e))).cast("string")
        elif kind == "name":
            out = lambda e: e[own]
        else:
            raise ValueError(f"a template has {own} where a value is to be")
        while True:
            if self.takes("."):
                name = self.next()
                out = (lambda x, n: lambda e: _field(x(e), n))(out, name)
            elif self.takes("["):
                out = self.index(out)
            else:
                return out

    def index(self, of: Node) -> Node:
        if self.takes(":"):
            raise ValueError("a template takes a slice without its first place")
        place = self.either()
        if self.takes(":"):
            self.next("]")
            return lambda e: F.slice(of(e), F.lit(place(e) + 1), F.greatest(F.lit(0), F.size(of(e)) - place(e)))
        self.next("]")
        return lambda e: _field(of(e), place(e))


def _field(value, name) -> object:
    if isinstance(value, dict):
        return value[name]
    return F.get(value, F.lit(name)) if isinstance(name, int) else value.getField(name)


def _pieces(template: str) -> list[tuple[str, str]]:
    """Text, fields and blocks in turn."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _MARK.finditer(template):
        text = template[at : m.start()]
        if strip:
            text = text.lstrip()
        if m[2]:
            text = text.rstrip()
        out += [("text", text), ({"{": "field", "%": "block", "#": "note"}[m[1]], m[3])]
        at, strip = m.end(), bool(m[4])
        if not strip and m[1] != "{" and template[at : at + 1] == "\n":
            at += 1
    out.append(("text", template[at:].lstrip() if strip else template[at:]))
    return [p for p in out if p[0] != "note" and p != ("text", "")]


def _body(pieces: list[tuple[str, str]], ends: tuple[str, ...]) -> tuple[Node, str]:
    """The tree up to one of ``ends``, and the block that ended it. ``pieces`` is used up from its front."""
    steps: list[Callable[[dict], object]] = []
    while pieces:
        kind, code = pieces.pop(0)
        if kind == "text":
            steps.append(lambda e, t=code: t)
            continue
        if kind == "field":
            steps.append(_Expression(code).whole())
            continue
        word, _, rest = code.strip().partition(" ")
        if word in ends:
            return _sequence(steps), code.strip()
        if word == "set":
            name, _, value = rest.partition("=")
            steps.append((name.strip(), _Expression(value).whole()))
        elif word == "if":
            steps.append(_condition(pieces, rest))
        elif word == "for":
            name, _, over = rest.partition(" in ")
            body, _ = _body(pieces, ("endfor",))
            steps.append(_loop(name.strip(), _Expression(over).whole(), body))
        else:
            raise ValueError(f"a template has the block {word}")
    if ends:
        raise ValueError(f"a template ends before {ends[-1]}")
    return _sequence(steps), ""


def _sequence(steps: list) -> Node:
    def run(e: dict) -> object:
        own, parts = dict(e), []
        for step in steps:
            if isinstance(step, tuple):
                own[step[0]] = step[1](own)
            else:
                parts.append(step(own))
        return _joined(*parts) if parts else ""

    return run


def _condition(pieces: list[tuple[str, str]], first: str) -> Node:
    branches, test = [], _Expression(first).whole()
    while True:
        body, end = _body(pieces, ("elif", "else", "endif"))
        branches.append((test, body))
        word, _, rest = end.partition(" ")
        if word == "endif":
            break
        test = _Expression(rest).whole() if word == "elif" else lambda e: True

    def run(e: dict) -> object:
        tests = [(t(e), b) for t, b in branches]
        out: object = ""
        for t, b in reversed(tests):
            if isinstance(t, Column):
                out = F.when(t, _text(b(e))).otherwise(_text(out))
            elif t:
                out = b(e)
        return out

    return run


def _loop(name: str, over: Node, body: Node) -> Node:
    def run(e: dict) -> object:
        items = over(e)
        count = F.size(items)

        def each(item: Column, at: Column) -> Column:
            return _text(body({**e, name: item, "loop": {"index0": at, "index": at + 1, "first": at == 0, "last": at == count - 1, "length": count}}))

        return F.array_join(F.transform(items, each), "")

    return run


def chat_template(template: str, **names: object) -> Callable[[Column, bool], Column]:
    """A template as a function of the messages (role and content) and of whether an answer is to follow. ``names``: what else the
    template may use, such as ``bos_token`` and ``eos_token``."""
    tree, _ = _body(_pieces(template), ())
    return lambda messages, generation_prompt=False: _text(tree({**names, "messages": messages, "add_generation_prompt": generation_prompt}))
