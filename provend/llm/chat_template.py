"""Compiler of chat templates: text -> syntax tree -> folded tree -> Python closures.

The language is small and closed. Text stands for itself; ``{{ x }}`` writes a value;
statements are ``{% for m in messages %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}``,
``{% set name = x %}`` and ``{% generation %}`` ... ``{% endgeneration %}`` around what a
model is to learn. A ``-`` inside a tag strips the white space next to it. Expressions have
strings, whole numbers, ``true`` / ``false``, ``m.role`` / ``m['content']``,
``loop.first`` / ``last`` / ``index`` / ``index0``, ``== != < <= > >= + ~ in``, ``not``,
``and``, ``or``, parentheses and the filters of ``FILTERS``. There is no way to reach Python
objects, call functions or loop over anything but the messages; unknown names, fields and
filters are errors when the template is compiled.

The one loop over the messages is the body of a template; what stands before and after it
is written once. So a conversation is rendered turn by turn from an iterator, and a part of
one can be rendered by itself if it is told its first turn's number and whether more follow.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

TAG = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\})", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)"""
                   r"""|(?P<op>==|!=|<=|>=|[<>+~()\[\].|=]))""", re.S)
FIELDS = {"message": ("role", "content"), "loop": ("first", "last", "index", "index0")}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
LEVELS = [("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~")]  # weakest first


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    r"""Text in which no control string can stand: ``<|`` becomes ``<\|``, and one more ``\`` where there are some."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_line(text: str) -> str:
    """Like ``escape``, on one line."""
    return escape(text).replace("%", "%25").replace("\n", "%0A")


def unescape_line(text: str) -> str:
    return unescape(text.replace("%0A", "\n").replace("%25", "%"))


FILTERS: dict[str, Callable] = {"trim": lambda s: str(s).strip(), "upper": lambda s: str(s).upper(),
                                "lower": lambda s: str(s).lower(), "length": len, "escape": escape,
                                "escape_line": escape_line}
BINARY: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "~": lambda a, b: str(a) + str(b), "in": lambda a, b: a in b}


# ---------------------------------------------------------------- expressions

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Name
    key: str


@dataclass(frozen=True)
class Apply:
    op: str  # an operator, "not", "and", "or" or "|filter"
    args: tuple


class Expressions:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next_is(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if texts and not self.next_is(*texts):
            raise TemplateError(f"expected one of {texts} at token {self.at} of {self.tokens}")
        if self.at == len(self.tokens):
            raise TemplateError("a tag ends too early")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self, level: int = 0):
        if level == len(LEVELS):
            return self.filtered()
        if level == 2 and self.next_is("not"):
            self.take()
            return Apply("not", (self.expression(level),))
        left = self.expression(level + 1)
        while self.next_is(*LEVELS[level]) or (level == 2 and self.next_is("not")):
            op = self.take()
            if op == "not":  # not in
                self.take("in")
                left = Apply("not", (Apply("in", (left, self.expression(level + 1))),))
            else:
                left = Apply(op, (left, self.expression(level + 1)))
        return left

    def filtered(self):
        value = self.atom()
        while self.next_is("|"):
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            value = Apply("|" + name, (value,))
        return value

    def atom(self):
        kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
        text = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if text == "(":
            value = self.expression()
            self.take(")")
            return value
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        if text in ("true", "false"):
            return Const(text == "true")
        if self.next_is("."):
            self.take()
            return Field(Name(text), self.take())
        if self.next_is("["):
            self.take()
            key = self.atom()
            self.take("]")
            if not isinstance(key, Const):
                raise TemplateError("only fixed fields can be read")
            return Field(Name(text), key.value)
        return Name(text)


# ---------------------------------------------------------------- statements

@dataclass
class Text:
    text: str


@dataclass
class Write:
    value: object


@dataclass
class Assign:
    name: str
    value: object


@dataclass
class Block:
    kind: str  # "for", "if" or "generation"
    branches: list = field(default_factory=list)  # (condition, statements); one without condition unless "if"
    var: str = ""


def parse(source: str) -> list:
    """The statements of a template."""
    root: list = []
    open_: list[Block] = []
    body, strip = root, False
    for piece in TAG.split(source):
        if not piece.startswith(("{%", "{{")):
            if strip:
                piece = piece.lstrip()
            if piece:
                body.append(Text(piece))
            continue
        if piece[2] == "-" and body and isinstance(body[-1], Text):
            body[-1].text = body[-1].text.rstrip()
        strip = piece[-3] == "-"
        inner = piece[2:-2].strip("-") if piece[2] == "-" or strip else piece[2:-2]
        x = Expressions(inner)
        if piece.startswith("{{"):
            body.append(Write(x.expression()))
        else:
            word = x.take()
            if word == "set":
                name = x.take()
                x.take("=")
                body.append(Assign(name, x.expression()))
            elif word in ("for", "if", "generation"):
                block = Block(word)
                if word == "for":
                    block.var = x.take()
                    x.take("in")
                    x.take("messages")
                block.branches.append((x.expression() if word == "if" else None, []))
                body.append(block)
                open_.append(block)
                body = block.branches[-1][1]
            elif word in ("elif", "else"):
                if not open_ or open_[-1].kind != "if" or open_[-1].branches[-1][0] is None:
                    raise TemplateError(f"{word} without if")
                open_[-1].branches.append((x.expression() if word == "elif" else None, []))
                body = open_[-1].branches[-1][1]
            elif word.startswith("end"):
                if not open_ or open_[-1].kind != word[3:]:
                    raise TemplateError(f"{word} without its beginning")
                open_.pop()
                body = open_[-1].branches[-1][1] if open_ else root
            else:
                raise TemplateError(f"unknown statement {word!r}")
        x.done()
    if open_:
        raise TemplateError(f"{open_[-1].kind} is not ended")
    return root


# ---------------------------------------------------------------- folding

def fold_value(e, names: dict[str, object], scope: dict[str, str]):
    """The expression with its constant parts computed; ``names`` are fixed values, ``scope`` what else is known."""
    if isinstance(e, Name):
        if e.name in names:
            return Const(names[e.name])
        if scope.get(e.name) != "value":
            raise TemplateError(f"unknown name {e.name!r}")
    elif isinstance(e, Field):
        if e.key not in FIELDS.get(scope.get(e.of.name, ""), ()):
            raise TemplateError(f"{e.of.name} has no field {e.key!r} here")
    elif isinstance(e, Apply):
        args = tuple(fold_value(a, names, scope) for a in e.args)
        e = Apply(e.op, args)
        if e.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(value_closure(e)({}))
            except TypeError as problem:
                raise TemplateError(str(problem)) from problem
    return e


def fold(body: list, names: dict[str, object], scope: dict[str, str]) -> list:
    """Statements with constants written out, dead branches gone and neighbouring texts joined."""
    out: list = []

    def add(statement) -> None:
        if isinstance(statement, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + statement.text)
        elif not (isinstance(statement, Text) and not statement.text):
            out.append(statement)

    for s in body:
        if isinstance(s, Write):
            value = fold_value(s.value, names, scope)
            add(Text(str(value.value)) if isinstance(value, Const) else Write(value))
        elif isinstance(s, Assign):
            if s.name in names or scope.get(s.name, "value") != "value":
                raise TemplateError(f"{s.name!r} cannot be set")
            add(Assign(s.name, fold_value(s.value, names, scope)))
            scope[s.name] = "value"
        elif isinstance(s, Block) and s.kind == "if":
            kept: list = []
            for condition, inner in s.branches:
                condition = Const(True) if condition is None else fold_value(condition, names, scope)
                inner = fold(inner, names, scope)
                if isinstance(condition, Const):
                    if condition.value:
                        kept.append((None, inner))
                        break
                    continue
                kept.append((condition, inner))
            if kept and kept[0][0] is None:
                for x in kept[0][1]:
                    add(x)
            elif kept:
                add(Block("if", kept))
        elif isinstance(s, Block):
            known = {**scope, s.var: "message", "loop": "loop"} if s.kind == "for" else scope
            add(Block(s.kind, [(None, fold(s.branches[0][1], names, known))], s.var))
        else:
            add(s)
    return out


# ---------------------------------------------------------------- closures

class Output:
    """Text written so far and the spans (start, end) between generation marks, in code points."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.at += len(text)


def value_closure(e) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        return lambda env, n=e.name: env.get(n, "")
    if isinstance(e, Field):
        return lambda env, n=e.of.name, k=e.key: env[n][k]
    args = [value_closure(a) for a in e.args]
    if e.op.startswith("|"):
        return lambda env, f=FILTERS[e.op[1:]], a=args[0]: f(a(env))
    if e.op == "not":
        return lambda env, a=args[0]: not a(env)
    a, b = args
    if e.op == "and":
        return lambda env: a(env) and b(env)
    if e.op == "or":
        return lambda env: a(env) or b(env)
    return lambda env, f=BINARY[e.op]: f(a(env), b(env))


def body_closure(body: list) -> Callable[[dict, Output], None]:
    steps = [statement_closure(s) for s in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)
    return run


def statement_closure(s) -> Callable[[dict, Output], None]:
    if isinstance(s, Text):
        return lambda env, out, t=s.text: out.write(t)
    if isinstance(s, Write):
        return lambda env, out, v=value_closure(s.value): out.write(str(v(env)))
    if isinstance(s, Assign):
        return lambda env, out, n=s.name, v=value_closure(s.value): env.__setitem__(n, v(env))
    if s.kind == "generation":
        inner = body_closure(s.branches[0][1])

        def marked(env: dict, out: Output) -> None:
            start = out.at
            inner(env, out)
            if out.at > start:
                out.spans.append((start, out.at))
        return marked
    if s.kind == "for":
        raise TemplateError("the loop over the messages must be the only one, and stand outside all blocks")
    branches = [(None if c is None else value_closure(c), body_closure(b)) for c, b in s.branches]

    def choose(env: dict, out: Output) -> None:
        for condition, inner in branches:
            if condition is None or condition(env):
                inner(env, out)
                return
    return choose


class Template:
    """A compiled template. ``names`` are fixed values that expressions may use."""

    def __init__(self, source: str, names: dict[str, object] | None = None):
        self.tree = fold(parse(source), dict(names or {}), {})
        loops = [i for i, s in enumerate(self.tree) if isinstance(s, Block) and s.kind == "for"]
        if len(loops) != 1:
            raise TemplateError("a template needs one loop over the messages")
        loop = self.tree[loops[0]]
        self.var, self.turn = loop.var, body_closure(loop.branches[0][1])
        self.head, self.foot = body_closure(self.tree[:loops[0]]), body_closure(self.tree[loops[0] + 1:])

    def render(self, messages: Iterable[tuple[str, str]], first: int = 0, more: bool = False) -> Output:
        """Text and spans of (role, content) turns, of which the first has number ``first``.

        The head is written before turn 0, the foot after the last turn if no ``more`` follow.
        """
        out, env = Output(), {}
        if first == 0:
            self.head(env, out)
        for index, last, (role, content) in _with_last(messages, first, more):
            inner = {**env, self.var: {"role": role, "content": content},
                     "loop": {"first": index == 0, "last": last, "index": index + 1, "index0": index}}
            self.turn(inner, out)
        if not more:
            self.foot(env, out)
        return out


def _with_last(messages: Iterable, first: int, more: bool) -> Iterator[tuple[int, bool, tuple[str, str]]]:
    held, index = None, first
    for m in messages:
        if held is not None:
            yield index, False, held
            index += 1
        held = m
    if held is not None:
        yield index, not more, held
