"""A compiler for chat templates: text to syntax tree to Python closures.

The language is a sandboxed part of the usual template notation: ``{{ expression }}``,
``{% for x in e %} {% else %} {% endfor %}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% set x = e %}``, ``{% generation %} {% endgeneration %}`` and ``{# comment #}``; a hyphen
inside a mark strips the white space beside it. Expressions know strings, integers, true, false,
none, names, ``a.b``, ``a[b]`` and ``a[b:c]`` on mappings and sequences only, ``or and not``, comparisons,
``in``, ``not in``, tests (``is defined``, ``is none``, ``is string``, ``is mapping``, each with ``not``),
``+ - * % ~``, conditional expressions and the filters given. No Python attribute can be
reached and nothing can be called but ``raise_exception(text)``, which ends the rendering with a
TemplateError, as does every operation on values that it doesn't fit. Numbers are kept within 64
bits and what ``* + ~`` make within LONGEST characters, so a template can't allocate at will.

Constant expressions are folded, branches on constants are dropped and neighbouring texts joined
before closures are made. A rendered template yields its pieces as they come, and loops draw from
iterators, so a conversation of any length needs the memory of a turn. Such turns (``Turns``) can be
gone through once; before that the first few can be looked at (``messages[0]``) or left out
(``messages[1:]``); whatever else would need them all is a TemplateError.
"""

from __future__ import annotations

import operator
import re
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from enum import Enum


class TemplateError(ValueError):
    """The template doesn't follow the grammar, or asks for something that isn't allowed."""


class Turns:
    """Values that are drawn once and in order, of which the first AHEAD can be looked at before."""

    AHEAD = 16

    def __init__(self, values: Iterator, source: Turns | None = None, skipped: int = 0) -> None:
        self.values, self.source, self.skipped = values, source or self, skipped
        self.head: deque = deque()
        self.begun = False

    def peek(self, k: int) -> object:
        """The k-th value, none if there are fewer."""
        k, source = k + self.skipped, self.source
        if source.begun or not self.skipped <= k < self.AHEAD:
            raise TemplateError("only the first turns can be looked at, and before the loop over them")
        while len(source.head) <= k and (value := next(source.values, source)) is not source:
            source.head.append(value)
        return source.head[k] if k < len(source.head) else None

    def after(self, k: int) -> Turns:
        """The values without the first k."""
        if not 0 <= k < self.AHEAD:
            raise TemplateError("only the first turns can be left out")
        return Turns(self.values, self.source, self.skipped + k)

    def __bool__(self) -> bool:
        return self.peek(0) is not None

    def __iter__(self) -> Iterator:
        source = self.source
        if source.begun:
            raise TemplateError("turns can be gone through once")
        source.begun = True
        for k, value in enumerate(self._all()):
            if k >= self.skipped:
                yield value

    def _all(self) -> Iterator:
        head = self.source.head
        while head:
            yield head.popleft()
        yield from self.source.values


class Edge(Enum):
    """What a renderer yields around text that the model is to learn to generate."""

    BEGIN = "begin"
    END = "end"


@dataclass
class Node:
    """A syntax tree's node: its kind, its value (of constants: what they stand for) and its parts."""

    kind: str
    value: object = None
    parts: list = field(default_factory=list)


MARK = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{-?\s*(.*?)\s*-?\}\}|\{#.*?#\}", re.S)
WORD = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>().,:\[\]|=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("*", "%")]
LONGEST, WIDEST = 1 << 28, 1 << 63
TESTS = {
    "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, Mapping),
    "number": lambda x: type(x) is int, "boolean": lambda x: isinstance(x, bool), "defined": None, "undefined": None,
}


def text_of(value: object) -> str:
    if isinstance(value, Turns):
        raise TemplateError("turns have no text")
    return "" if value is None else str(value)


def _times(a: object, b: object) -> object:
    for x, n in ((a, b), (b, a)):
        if isinstance(x, str) and type(n) is int and len(x) * n > LONGEST:
            raise TemplateError("a text too long")
    return a * b


def _modulo(a: object, b: object) -> object:
    if type(a) is not int or type(b) is not int:
        raise TemplateError("% needs numbers")
    return a % b


def _joined(a: object, b: object) -> str:
    return text_of(a) + text_of(b)


def _contains(a: object, b: object) -> bool:
    if isinstance(b, Turns):
        raise TemplateError("turns can't be searched")
    return a in b


def bounded(f: Callable[[object, object], object]) -> Callable[[object, object], object]:
    """``f`` with its errors as TemplateErrors, and its results kept small."""

    def run(a: object, b: object) -> object:
        try:
            value = f(a, b)
        except (TypeError, ValueError, ArithmeticError, MemoryError) as e:
            raise e if isinstance(e, TemplateError) else TemplateError(str(e)) from None
        if isinstance(value, (str, list, tuple)) and len(value) > LONGEST or type(value) is int and abs(value) >= WIDEST:
            raise TemplateError("a value too large")
        return value

    return run


BINARY = {
    word: bounded(f)
    for word, f in {
        "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": _contains,
        "not in": lambda a, b: not _contains(a, b), "+": operator.add, "-": operator.sub, "*": _times, "%": _modulo, "~": _joined,
    }.items()
}


class Expression:
    """A parser of one expression, by precedence."""

    def __init__(self, source: str) -> None:
        self.words: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = WORD.match(source, at)
            if not m:
                raise TemplateError(f"not an expression: {source[at:]!r}")
            self.words.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "str" else ""

    def take(self, wanted: str = "") -> str:
        if self.at >= len(self.words) or wanted and self.peek() != wanted:
            raise TemplateError(f"{wanted or 'a term'} is missing")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> Node:
        node = self.conditional()
        if self.at < len(self.words):
            raise TemplateError(f"what is {self.words[self.at][1]!r} here?")
        return node

    def conditional(self) -> Node:
        node = self.level(0)
        if self.peek() == "if":
            self.take()
            test = self.level(0)
            self.take("else")
            return Node("choose", None, [test, node, self.conditional()])
        return node

    def level(self, k: int) -> Node:
        if k == len(LEVELS):
            return self.filtered()
        if LEVELS[k] == ("not",):
            if self.peek() == "not":
                self.take()
                return Node("not", None, [self.level(k)])
            return self.level(k + 1)
        node = self.level(k + 1)
        while True:
            if self.peek() in LEVELS[k]:
                node = Node("binary", self.take(), [node, self.level(k + 1)])
            elif "in" in LEVELS[k] and self.peek() == "not":
                self.take()
                self.take("in")
                node = Node("binary", "not in", [node, self.level(k + 1)])
            elif "in" in LEVELS[k] and self.peek() == "is":
                self.take()
                against = self.peek() == "not" and bool(self.take())
                test = self.take()
                if test not in TESTS:
                    raise TemplateError(f"no test {test}")
                node = Node("is", test, [node])
                node = Node("not", None, [node]) if against else node
            else:
                return node

    def filtered(self) -> Node:
        node = self.term()
        while self.peek() in (".", "[", "|"):
            mark = self.take()
            if mark == ".":
                node = Node("item", None, [node, Node("const", self.take())])
            elif mark == "[":
                start = Node("const") if self.peek() == ":" else self.conditional()
                if self.peek() == ":":
                    self.take()
                    node = Node("slice", None, [node, start, Node("const") if self.peek() == "]" else self.conditional()])
                else:
                    node = Node("item", None, [node, start])
                self.take("]")
            else:
                node = Node("filter", self.take(), [node])
        return node

    def term(self) -> Node:
        kind = self.words[self.at][0] if self.at < len(self.words) else ""
        word = self.take()
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return Node("const", int(word))
        if word in CONSTANTS:
            return Node("const", CONSTANTS[word])
        if kind == "name" and word == "raise_exception" and self.peek() == "(":
            self.take()
            node = Node("raise", None, [self.conditional()])
            self.take(")")
            return node
        if kind == "name":
            return Node("name", word)
        if kind == "op" and word == "-":
            return Node("binary", "-", [Node("const", 0), self.filtered()])
        if word == "(":
            node = self.conditional()
            self.take(")")
            return node
        raise TemplateError(f"{word!r} begins no term")


def parse(source: str) -> list[Node]:
    """The template's syntax tree."""
    stack: list[tuple[str, Node, list[Node]]] = [("", Node("all"), [])]
    at, strip = 0, False
    for m in MARK.finditer(source):
        piece = source[at : m.start()]
        piece = piece.lstrip() if strip else piece
        piece = piece.rstrip() if m[0][2:3] == "-" else piece
        if piece:
            stack[-1][2].append(Node("text", piece))
        at, strip = m.end(), m[0][-3:-2] == "-"
        if m[2] is not None:
            stack[-1][2].append(Node("print", None, [Expression(m[2]).whole()]))
        elif m[1] is not None:
            _statement(m[1], stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    rest = source[at:].lstrip() if strip else source[at:]
    return stack[0][2] + ([Node("text", rest)] if rest else [])


def _statement(source: str, stack: list) -> None:
    word, _, rest = source.partition(" ")
    if word == "if":
        node = Node("if", None, [(Expression(rest).whole(), [])])
        stack[-1][2].append(node)
        stack.append(("if", node, node.parts[0][1]))
    elif word in ("elif", "else") and stack[-1][0] in ("if", "for"):
        kind, node, _ = stack.pop()
        if word == "elif" and kind == "for":
            raise TemplateError("elif outside if")
        node.parts.append((Expression(rest).whole() if word == "elif" else Node("const", True), []))
        stack.append((kind, node, node.parts[-1][1]))
    elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)):
        node = Node("for", m[1], [(Expression(m[2]).whole(), [])])
        stack[-1][2].append(node)
        stack.append(("for", node, node.parts[0][1]))
    elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(.*)", rest, re.S)):
        stack[-1][2].append(Node("set", m[1], [Expression(m[2]).whole()]))
    elif word == "generation":
        node = Node("generation")
        stack[-1][2].append(node)
        stack.append(("generation", node, node.parts))
    elif word.startswith("end") and len(stack) > 1 and word[3:] == stack[-1][0]:
        stack.pop()
    else:
        raise TemplateError(f"unknown or misplaced: {source!r}")


def fold(node: Node, filters: Mapping[str, Callable]) -> Node:
    """The expression with what is constant worked out."""
    node = Node(node.kind, node.value, [fold(x, filters) for x in node.parts])
    if node.kind == "filter" and node.value not in filters:
        raise TemplateError(f"no filter {node.value}")
    if node.kind == "choose" and node.parts[0].kind == "const":
        return node.parts[1] if node.parts[0].value else node.parts[2]
    if node.kind != "raise" and node.parts and all(x.kind == "const" for x in node.parts):
        return Node("const", evaluate(node, filters)({}))
    return node


def fold_all(nodes: list[Node], filters: Mapping[str, Callable]) -> list[Node]:
    """The statements folded: no constant prints or branches, no two texts side by side."""
    out: list[Node] = []
    for node in nodes:
        made = [node]
        if node.kind in ("print", "set"):
            expression = fold(node.parts[0], filters)
            made = [Node(node.kind, node.value, [expression])]
            if node.kind == "print" and expression.kind == "const":
                made = [Node("text", text_of(expression.value))]
        elif node.kind == "generation":
            made = [Node("generation", None, fold_all(node.parts, filters))]
        elif node.kind == "for":
            made = [Node("for", node.value, [(fold(test, filters), fold_all(body, filters)) for test, body in node.parts])]
        elif node.kind == "if":
            live = []
            for test, body in ((fold(t, filters), fold_all(b, filters)) for t, b in node.parts):
                if test.kind != "const" or test.value:
                    live.append((test, body))
                if test.kind == "const" and test.value:
                    break
            made = live[0][1] if live and live[0][0].kind == "const" else [Node("if", None, live)] if live else []
        for x in made:
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + x.value)
            elif x.kind != "text" or x.value:
                out.append(x)
    return out


def evaluate(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    """A closure from the variables to the expression's value."""
    parts = [evaluate(x, filters) for x in node.parts]
    if node.kind == "const":
        return lambda env, value=node.value: value
    if node.kind == "name":
        return lambda env, name=node.value: env.get(name)
    if node.kind == "item":
        return lambda env, a=parts[0], b=parts[1]: item(a(env), b(env))
    if node.kind == "slice":
        return lambda env, a=parts[0], b=parts[1], c=parts[2]: part_of(a(env), b(env), c(env))
    if node.kind == "filter":
        return lambda env, f=filters[node.value], a=parts[0]: filtered(f, a(env))
    if node.kind == "is":
        return _test(node, parts[0])
    if node.kind == "raise":

        def fail(env: dict) -> None:
            raise TemplateError(text_of(parts[0](env)))

        return fail
    if node.kind == "not":
        return lambda env, a=parts[0]: not a(env)
    if node.kind == "choose":
        return lambda env, t=parts[0], a=parts[1], b=parts[2]: a(env) if t(env) else b(env)
    if node.value in ("or", "and"):
        return (lambda env, a=parts[0], b=parts[1]: a(env) or b(env)) if node.value == "or" else (lambda env, a=parts[0], b=parts[1]: a(env) and b(env))
    return lambda env, f=BINARY[node.value], a=parts[0], b=parts[1]: f(a(env), b(env))


def item(value: object, key: object) -> object:
    """value[key] of a mapping or sequence, none if it isn't there."""
    if isinstance(value, Mapping):
        return value.get(key) if isinstance(key, (str, int)) else None
    if isinstance(value, Turns):
        if type(key) is not int:
            raise TemplateError("turns are numbered")
        return value.peek(key)
    if isinstance(value, (list, tuple, str)) and type(key) is int:
        return value[key] if -len(value) <= key < len(value) else None
    return None


def part_of(value: object, start: object, stop: object) -> object:
    """value[start:stop] of a sequence, none of anything else; of turns only a slice without an end."""
    if any(x is not None and type(x) is not int for x in (start, stop)):
        raise TemplateError("slices need numbers")
    if isinstance(value, Turns):
        if stop is not None:
            raise TemplateError("turns can't be cut at their end")
        return value.after(start or 0)
    return value[start:stop] if isinstance(value, (list, tuple, str)) else None


def filtered(f: Callable, value: object) -> object:
    """A filter's result; turns are too many for any."""
    if isinstance(value, Turns):
        raise TemplateError("turns can't be filtered")
    try:
        return f(value)
    except (TypeError, ValueError) as e:
        raise TemplateError(str(e)) from None


def _test(node: Node, value: Callable[[dict], object]) -> Callable[[dict], object]:
    """A closure for ``x is test``; a name is defined if it is set, an item if it is there and not none."""
    if node.value in ("defined", "undefined"):
        wanted, inner = node.value == "defined", node.parts[0]
        if inner.kind == "name":
            return lambda env, name=inner.value: (name in env) == wanted
        return lambda env: (value(env) is not None) == wanted
    return lambda env, test=TESTS[node.value]: test(value(env))


def generate(nodes: list[Node], filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[object]]:
    """A closure from the variables to the pieces of the statements' output."""
    steps = [_step(x, filters) for x in nodes]

    def run(env: dict) -> Iterator[object]:
        for step in steps:
            yield from step(env)

    return run


def _step(node: Node, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[object]]:
    if node.kind == "text":
        return lambda env, pieces=(node.value,): iter(pieces)
    if node.kind == "print":
        return lambda env, f=evaluate(node.parts[0], filters): iter((text_of(f(env)),))
    if node.kind == "generation":
        body = generate(node.parts, filters)

        def marked(env: dict) -> Iterator[object]:
            yield Edge.BEGIN
            yield from body(env)
            yield Edge.END

        return marked
    if node.kind == "set":
        f, name = evaluate(node.parts[0], filters), node.value

        def assign(env: dict) -> Iterator[object]:
            env[name] = f(env)
            return iter(())

        return assign
    branches = [(evaluate(test, filters), generate(body, filters)) for test, body in node.parts]
    if node.kind == "if":

        def choose(env: dict) -> Iterator[object]:
            return next((body(env) for test, body in branches if test(env)), iter(()))

        return choose

    def loop(env: dict) -> Iterator[object]:
        values = iter(branches[0][0](env) or ())
        own, absent = dict(env), object()
        current, k = next(values, absent), 0
        if current is absent and len(branches) > 1:
            yield from branches[1][1](env)
        while current is not absent:
            following = next(values, absent)
            own |= {node.value: current, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": following is absent}}
            yield from branches[0][1](own)
            current, k = following, k + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable]) -> Callable[[dict], Iterator[object]]:
    """A renderer: from variables to pieces of text, with the edges around generations."""
    return generate(fold_all(parse(source), filters), filters)
