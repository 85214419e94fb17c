"""A small template language for chat formats, compiled to Python closures.

    {{ expr }}   {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% for name in expr %} .. {% endfor %}   {% generation %} .. {% endgeneration %}

Expressions: literals, names, a.b, a['b'], ==, !=, not, and, or, +, ( ), and filters x | upper. Names are looked up
in the values given; attributes are keys of mappings only, and filters come from a fixed table, so a template reaches
nothing else. Constant parts are folded when the tree is built. A compiled template yields (text, generated) pieces;
`generated` is true inside a generation block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[.\[\]()|+]))")
PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """kind: const, name, key, eq, ne, not, and, or, add, filter; text, out, if, for, generation, body."""

    kind: str
    value: object = None
    parts: list[Node] = field(default_factory=list)


def tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Expression:
    """Recursive descent over the tokens of one expression, loosest operator first."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.rest, self.filters = tokens(source), filters
        self.tree = self.either()
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r} in {source!r}")

    def take(self, *values: str) -> str | None:
        if self.rest and self.rest[0][1] in values and self.rest[0][0] != "str":
            return self.rest.pop(0)[1]
        return None

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = folded(Node("or", None, [left, self.both()]))
        return left

    def both(self) -> Node:
        left = self.inverted()
        while self.take("and"):
            left = folded(Node("and", None, [left, self.inverted()]))
        return left

    def inverted(self) -> Node:
        return folded(Node("not", None, [self.inverted()])) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.added()
        while op := self.take("==", "!="):
            left = folded(Node("eq" if op == "==" else "ne", None, [left, self.added()]))
        return left

    def added(self) -> Node:
        left = self.filtered()
        while self.take("+"):
            left = folded(Node("add", None, [left, self.filtered()]))
        return left

    def filtered(self) -> Node:
        left = self.atom()
        while self.take("|"):
            name = self.rest.pop(0)[1] if self.rest else ""
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            left = folded(Node("filter", self.filters[name], [left]))
        return left

    def atom(self) -> Node:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        elif not self.rest:
            raise TemplateError("an expression ends early")
        else:
            kind, value = self.rest.pop(0)
            if kind == "str":
                tree = Node("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1]))
            elif kind == "num":
                tree = Node("const", int(value))
            elif kind == "name":
                tree = Node("const", value == "true") if value in ("true", "false") else Node("name", value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                if not self.rest or self.rest[0][0] != "name":
                    raise TemplateError("a name must follow '.'")
                key = Node("const", self.rest.pop(0)[1])
            else:
                key = self.either()
                if not self.take("]"):
                    raise TemplateError("a bracket is not closed")
            tree = Node("key", None, [tree, key])
        return tree


def folded(node: Node) -> Node:
    """A node of constants as a constant."""
    return Node("const", evaluator(node)({})) if all(p.kind == "const" for p in node.parts) else node


def parse(source: str, filters: Mapping[str, Callable]) -> Node:
    """Syntax tree of a template; adjacent constant output is one text node, constant conditions are decided."""
    root = Node("body")
    stack: list[tuple[str, Node]] = [("", root)]
    bodies = [root]
    at = 0

    def add(node: Node) -> None:
        into = bodies[-1].parts
        if node.kind == "text" and into and into[-1].kind == "text":
            into[-1] = Node("text", into[-1].value + node.value)
        elif node.kind != "text" or node.value:
            into.append(node)

    for m in PIECE.finditer(source):
        add(Node("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            tree = Expression(m[1], filters).tree
            add(Node("text", as_text(tree.value)) if tree.kind == "const" else Node("out", None, [tree]))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "if":
            node = Node("if", None, [Expression(rest, filters).tree, Node("body")])
            stack.append(("if", node))
            bodies.append(node.parts[1])
        elif word in ("elif", "else") and stack[-1][0] == "if":
            node = stack[-1][1]
            node.parts += [Expression(rest, filters).tree if word == "elif" else Node("const", True), Node("body")]
            bodies[-1] = node.parts[-1]
        elif word == "for":
            name, _, over = rest.strip().partition(" in ")
            if not name.isidentifier():
                raise TemplateError(f"no loop in {m[2]!r}")
            node = Node("for", name, [Expression(over, filters).tree, Node("body")])
            stack.append(("for", node))
            bodies.append(node.parts[1])
        elif word == "generation":
            node = Node("generation", None, [Node("body")])
            stack.append(("generation", node))
            bodies.append(node.parts[0])
        elif word.startswith("end") and stack[-1][0] == word[3:] != "":
            node = stack.pop()[1]
            bodies.pop()
            for part in decided(node) if node.kind == "if" else [node]:
                add(part)
        else:
            raise TemplateError(f"unexpected {m[2].strip()!r}")
    add(Node("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return root


def decided(node: Node) -> list[Node]:
    """An if node without branches that are never taken; its content if one is always taken first."""
    live: list[Node] = []
    for test, body in zip(node.parts[::2], node.parts[1::2]):
        if test.kind == "const" and not test.value:
            continue
        if test.kind == "const" and not live:
            return body.parts
        live += [test, body]
        if test.kind == "const":
            break
    return [Node("if", None, live)] if live else []


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def evaluator(node: Node) -> Callable[[Mapping], object]:
    """Closure that evaluates an expression node."""
    p = [evaluator(x) for x in node.parts]
    v = node.value
    if node.kind == "const":
        return lambda env: v
    if node.kind == "name":
        return lambda env: env.get(v)
    if node.kind == "key":
        return lambda env: held.get(p[1](env)) if isinstance(held := p[0](env), Mapping) else None
    if node.kind == "filter":
        return lambda env: v(p[0](env))
    two = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "add": lambda a, b: as_text(a) + as_text(b) if isinstance(a, str) or isinstance(b, str) else a + b}
    if node.kind in two:
        f = two[node.kind]
        return lambda env: f(p[0](env), p[1](env))
    if node.kind == "not":
        return lambda env: not p[0](env)
    if node.kind == "and":
        return lambda env: p[0](env) and p[1](env)
    return lambda env: p[0](env) or p[1](env)


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def renderer(node: Node) -> Render:
    """Closure that yields a template node's pieces. A loop takes its items one at a time and looks one ahead."""
    if node.kind == "text":
        return lambda env, mark, v=node.value: iter(((v, mark),))
    if node.kind == "out":
        value = evaluator(node.parts[0])
        return lambda env, mark: iter(((as_text(value(env)), mark),))
    if node.kind == "body":
        inner = [renderer(x) for x in node.parts]

        def body(env: dict, mark: bool) -> Iterator[tuple[str, bool]]:
            for r in inner:
                yield from r(env, mark)

        return body
    if node.kind == "generation":
        inside = renderer(node.parts[0])
        return lambda env, mark: inside(env, True)
    if node.kind == "if":
        branches = [(evaluator(t), renderer(b)) for t, b in zip(node.parts[::2], node.parts[1::2])]

        def choose(env: dict, mark: bool) -> Iterator[tuple[str, bool]]:
            for test, then in branches:
                if test(env):
                    yield from then(env, mark)
                    return

        return choose
    over, each, name = evaluator(node.parts[0]), renderer(node.parts[1]), node.value

    def loop(env: dict, mark: bool) -> Iterator[tuple[str, bool]]:
        items = iter(over(env) or ())
        end = object()
        now, index = next(items, end), 0
        while now is not end:
            then = next(items, end)
            yield from each(env | {name: now, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": then is end}}, mark)
            now, index = then, index + 1

    return loop


def compiled(source: str, filters: Mapping[str, Callable]) -> Callable[[Mapping], Iterator[tuple[str, bool]]]:
    """The template as a function from values to (text, generated) pieces."""
    render = renderer(parse(source, filters))
    return lambda values: render(dict(values), False)
