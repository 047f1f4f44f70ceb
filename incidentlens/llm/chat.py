"""Chat formatting: a small template language compiled to Python closures.

The language (all of it; nothing else of Python can be reached from a template):

    {{ expression }}                           insert a value
    {% for NAME in messages %} ... {% endfor %}
    {% if expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   text inside counts for the loss

Expressions: string literals, ``message.role`` / ``message.text``, ``loop.first`` ``loop.index``,
``==`` ``!=`` ``and`` ``or`` ``not``, ``+`` for strings, filters ``| escape`` ``| line`` ``| upper``
``| trim``, parentheses. ``parse`` gives a syntax tree, ``fold`` evaluates what is constant and joins
neighbouring text, ``generate`` turns each node into one closure. Rendering is a generator over the
messages: a conversation is never held as a whole, so its length does not matter.

Definitions
* rows of a conversation are taken by turn, then role, then text (nulls first); repeated rows all
  count; null role or text is formatted as empty text; null ``conv_id`` is one conversation of
  its own; the first message carries the text before the loop;
* ``escape`` puts a backslash before ``\\ # <``; ``line`` also writes a newline as ``\\n``; ``unescape``
  undoes both. With them no text can hold a control string of DEFAULT_TEMPLATE.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlens.llm.tables import map_rows

DEFAULT_TEMPLATE = (
    "{% for message in messages %}"
    "{{ '### ' + (message.role | line) + ':\\n' }}"
    "{% if message.role == 'assistant' %}"
    "{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '\\n</turn>\\n' }}"
    "{% endfor %}"
)

_SPECIAL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "line": line,
    "upper": str.upper,
    "trim": str.strip,
}


class TemplateError(ValueError):
    """The template does not follow the language."""


# Syntax tree -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    owner: str
    attribute: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter with its arguments."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Emit:
    expr: object


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[().|+]))")
_STRING_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, names: frozenset[str]):
        self.names, self.tokens, at = names, [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append(m.group().strip() if not m[1] else m[1])
            at = m.end()
        self.tokens.append("")
        self.at = 0

    def take(self, *wanted: str) -> str:
        token = self.tokens[self.at]
        if wanted and token not in wanted:
            return ""
        self.at += 1
        return token

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected, not {self.tokens[self.at]!r}")

    def whole(self):
        node = self.binary(0)
        if self.tokens[self.at]:
            raise TemplateError(f"{self.tokens[self.at]!r} left over")
        return node

    LEVELS = (("or",), ("and",), ("==", "!="), ("+",))

    def binary(self, level: int):
        if level == len(self.LEVELS):
            return self.filtered()
        if level == 2 and self.take("not"):
            return Apply("not", (self.binary(level),))
        node = self.binary(level + 1)
        while op := self.take(*self.LEVELS[level]):
            node = Apply(op, (node, self.binary(level + 1)))
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Apply(name, (node,))
        return node

    def atom(self):
        token = self.take()
        if token == "(":
            node = self.binary(0)
            self.need(")")
            return node
        if token.startswith("'"):
            text = re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
            return Const(text)
        if token in ("true", "false"):
            return Const(token == "true")
        if token in self.names:
            self.need(".")
            attribute = self.take()
            allowed = ("first", "index") if token == "loop" else ("role", "text")
            if attribute not in allowed:
                raise TemplateError(f"{token} has no {attribute!r}")
            return Name("loop" if token == "loop" else "message", attribute)
        raise TemplateError(f"unknown name {token!r}")


def parse(template: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts, at = [], 0
    for m in _TAGS.finditer(template):
        if m.start() > at:
            parts.append(("text", template[at : m.start()]))
        parts.append(("emit", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        parts.append(("text", template[at:]))
    parts.append(("tag", ""))
    position = 0

    def block(ends: tuple[str, ...], names: frozenset[str], generating: bool) -> tuple[tuple, str]:
        nonlocal position
        nodes = []
        while True:
            kind, value = parts[position]
            position += 1
            if kind == "text":
                nodes.append(Emit(Const(value)))
            elif kind == "emit":
                nodes.append(Emit(_Expression(value, names).whole()))
            elif value in ends:
                return tuple(nodes), value
            elif m := re.fullmatch(r"for ([A-Za-z_]\w*) in messages", value):
                if names:
                    raise TemplateError("loops cannot be nested")
                body, _ = block(("endfor",), frozenset((m[1], "loop")), generating)
                nodes.append(For(m[1], body))
            elif value.startswith("if "):
                test = _Expression(value[3:], names).whole()
                then, end = block(("else", "endif"), names, generating)
                other = block(("endif",), names, generating)[0] if end == "else" else ()
                nodes.append(If(test, then, other))
            elif value == "generation":
                if generating:
                    raise TemplateError("generation cannot be nested")
                nodes.append(Generation(block(("endgeneration",), names, True)[0]))
            else:
                raise TemplateError(f"unknown tag {value!r}" if value else "the template ends early")

    tree, _ = block(("",), frozenset(), False)
    if sum(isinstance(node, For) for node in tree) > 1:
        raise TemplateError("one loop over the messages at most")
    return tree


def _apply(op: str, args: tuple) -> object:
    if op in FILTERS:
        return FILTERS[op](_text(args[0]))
    if op == "+":
        return _text(args[0]) + _text(args[1])
    if op == "not":
        return not args[0]
    if op == "and":
        return args[0] and args[1]
    if op == "or":
        return args[0] or args[1]
    return (args[0] == args[1]) == (op == "==")


def _text(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


def _folded(expr):
    if not isinstance(expr, Apply):
        return expr
    args = tuple(map(_folded, expr.args))
    if all(isinstance(x, Const) for x in args):
        return Const(_apply(expr.op, tuple(x.value for x in args)))
    return Apply(expr.op, args)


def fold(nodes: tuple) -> tuple:
    """Constant expressions evaluated, decided branches inlined, neighbouring text joined."""
    out: list = []

    def add(node) -> None:
        if isinstance(node, Emit) and isinstance(node.expr, Const):
            text = _text(node.expr.value)
            if out and isinstance(out[-1], Emit) and isinstance(out[-1].expr, Const):
                text = _text(out.pop().expr.value) + text
            node = Emit(Const(text))
            if not text:
                return
        out.append(node)

    for node in nodes:
        if isinstance(node, Emit):
            add(Emit(_folded(node.expr)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.body)))
        elif isinstance(node, Generation):
            add(Generation(fold(node.body)))
        else:
            test = _folded(node.test)
            if isinstance(test, Const):
                for inner in fold(node.then if test.value else node.other):
                    add(inner)
            else:
                add(If(test, fold(node.then), fold(node.other)))
    return tuple(out)


# Closures ----------------------------------------------------------------------------------


@dataclass
class _Out:
    """One message's text, and where loss text starts and ends in it."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[dict[str, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(expr) -> Callable[[dict], object]:
    if isinstance(expr, Const):
        value = expr.value
        return lambda scope: value
    if isinstance(expr, Name):
        key = (expr.owner, expr.attribute)
        return lambda scope: scope[key]
    args = tuple(map(_value, expr.args))
    op = expr.op
    if op in FILTERS:
        work, (arg,) = FILTERS[op], args
        return lambda scope: work(_text(arg(scope)))
    return lambda scope: _apply(op, tuple(arg(scope) for arg in args))


def _block(nodes: tuple) -> Callable[[dict, _Out], None]:
    steps = tuple(map(_step, nodes))

    def run(scope: dict, out: _Out) -> None:
        for step in steps:
            step(scope, out)

    return run


def _step(node) -> Callable[[dict, _Out], None]:
    if isinstance(node, Emit):
        value = _value(node.expr)
        return lambda scope, out: out.put(_text(value(scope)))
    if isinstance(node, If):
        test, then, other = _value(node.test), _block(node.then), _block(node.other)
        return lambda scope, out: (then if test(scope) else other)(scope, out)
    body = _block(node.body)

    def generation(scope: dict, out: _Out) -> None:
        start = out.length
        body(scope, out)
        out.loss.append({"start": start, "end": out.length})

    return generation


Message = tuple[str, str]


class Template:
    """A compiled template. ``render`` yields one (text, loss spans) per message."""

    def __init__(self, source: str = DEFAULT_TEMPLATE):
        tree = fold(parse(source))
        at = next((i for i, node in enumerate(tree) if isinstance(node, For)), len(tree))
        self.before = _block(tree[:at])
        self.body = _block(tree[at].body) if at < len(tree) else _block(())
        self.after = _block(tree[at + 1 :])

    def render(self, messages: Iterable[Message]) -> Iterator[tuple[str, list[dict[str, int]]]]:
        out, index = _Out(), 0
        self.before({}, out)
        pending = None
        for role, text in messages:
            if pending is not None:
                yield "".join(pending.parts), pending.loss
                out = _Out()
            index += 1
            self.body(
                {
                    ("message", "role"): role,
                    ("message", "text"): text,
                    ("loop", "index"): index,
                    ("loop", "first"): index == 1,
                },
                out,
            )
            pending = out
        self.after({}, out)
        yield "".join(out.parts), out.loss


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of one formatted turn of DEFAULT_TEMPLATE, unescaped."""
    head, _, rest = segment.partition("\n")
    if not (head.startswith("### ") and head.endswith(":") and rest.endswith("\n</turn>\n")):
        raise ValueError(f"not a formatted turn: {segment[:80]!r}")
    return unescape(head[4:-1]), unescape(rest[: -len("\n</turn>\n")])


# Spark -------------------------------------------------------------------------------------

FORMATTED = "conv_id bigint, seq bigint, formatted string, loss array<struct<start: int, end: int>>"


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """One row per turn: ``conv_id``, ``seq`` (from 1), ``formatted`` text, ``loss`` spans in it.

    The formatted conversation is its rows' text by ``seq``. Rows stay sorted by conversation within
    partitions, so consumers can stream on; only one message is held at a time.
    """
    Template(template)  # a bad template fails here, not in a task
    dealt = (
        rows.select(
            F.col("conv_id").cast("bigint"), F.col("turn"), F.col("role"), F.col("text")
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        compiled = Template(template)
        for conv, group in groupby(rows, key=lambda row: row[0]):
            messages = ((role or "", text or "") for _, role, text in group)
            for seq, (text, loss) in enumerate(compiled.render(messages), 1):
                yield conv, seq, text, loss

    return map_rows(dealt, ["conv_id", "role", "text"], run, FORMATTED)


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint"
)


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted turns say when read back; needs rows as they come from
    ``format_conversations`` with DEFAULT_TEMPLATE (sorted within partitions)."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, group in groupby(rows, key=lambda row: row[0]):
            turns, lost = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, loss in group:
                role, said = read_turn(text)
                turns.update(f"{role}\n{said}\n".encode())
                n_turns += 1
                chars += len(text)
                for span in loss:
                    part = unescape(text[span["start"] : span["end"]])
                    lost.update(part.encode())
                    loss_chars += len(part)
            yield conv, n_turns, turns.hexdigest(), loss_chars, lost.hexdigest(), chars

    return map_rows(formatted, ["conv_id", "formatted", "loss"], run, DIGESTS)
