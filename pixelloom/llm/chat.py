"""Chat formatting with a compiled template.

A template is text with ``{{ value|filter }}`` and ``{% for %}``, ``{% if %}``/``{% elif %}``/``{% else %}``,
``{% generation %}`` tags.  It can name only the loop variable, its fields, string literals, ``==``, ``!=``, ``and``,
``or``, ``not`` and the filters given to the compiler; there is no attribute access to Python objects, no call and no
evaluation of code.  :func:`compile_template` parses it into a syntax tree, folds constants, joins neighbouring
literals and turns every node into a Python closure.  Text inside ``{% generation %}`` is under the loss mask.

Conversations are dealt by a hash of conv_id and sorted by turn within the partitions (a sort that spills); a task
then streams over its rows, holding one conversation at a time.

Order: turn (nulls first), then role and text for rows of one turn.  A null role or text is empty, rows with a null
conv_id form one conversation, repeated rows are turns of their own, extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the default template. Every one begins with ``<`` or ``[``, which :func:`escape` leaves in no text.
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST] {{ m.text|escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text|escape }}<</SYS>>"
    "{% else %}[ROLE]{{ m.role|escape }}[/ROLE]{{ m.text|escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)
_TURN = re.compile(
    r"<s>\[INST\] (?P<user>[^<\[]*) \[/INST\]|(?P<assistant>[^<\[]*)</s>|<<SYS>>(?P<system>[^<\[]*)<</SYS>>|\[ROLE\](?P<role>[^<\[]*)\[/ROLE\](?P<text>[^<\[]*)\[/TURN\]"
)


def escape(text: str) -> str:
    """Hide the characters that begin control strings; :func:`unescape` gives the text back."""
    return text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lsqb;")


def unescape(text: str) -> str:
    return text.replace("&lsqb;", "[").replace("&lt;", "<").replace("&amp;", "&")


class TemplateError(ValueError):
    pass


# Syntax tree


@dataclass
class Literal:
    text: str


@dataclass
class Value:
    of: Expr
    filters: list[str]


@dataclass
class Block:
    body: list


@dataclass
class If:
    arms: list[tuple[Expr, Block]]
    otherwise: Block


@dataclass
class For:
    name: str
    over: str
    body: Block


@dataclass
class Generation:
    body: Block


@dataclass
class Expr:
    """op: const, field, eq, ne, and, or, not."""

    op: str
    args: list = field(default_factory=list)


_PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<op>==|!=|\||\(|\))|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?))")


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while text[at:].strip():
        if not (m := _TOKEN.match(text, at)):
            raise TemplateError(f"cannot read {text[at:]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


def _expression(tokens: list[str], names: set[str], level: int = 0) -> Expr:
    """A recursive descent over or, and, not, comparison, atom; it takes its tokens off the list."""
    if level < 2:
        word = ("or", "and")[level]
        left = _expression(tokens, names, level + 1)
        while tokens and tokens[0] == word:
            tokens.pop(0)
            left = Expr(word, [left, _expression(tokens, names, level + 1)])
        return left
    if level == 2 and tokens and tokens[0] == "not":
        tokens.pop(0)
        return Expr("not", [_expression(tokens, names, 2)])
    if level < 4:
        left = _expression(tokens, names, 4)
        if tokens and tokens[0] in ("==", "!="):
            op = "eq" if tokens.pop(0) == "==" else "ne"
            return Expr(op, [left, _expression(tokens, names, 4)])
        return left
    if not tokens:
        raise TemplateError("an expression ends too early")
    token = tokens.pop(0)
    if token == "(":
        inner = _expression(tokens, names)
        if not tokens or tokens.pop(0) != ")":
            raise TemplateError("a bracket is not closed")
        return inner
    if token[0] in "'\"":
        return Expr("const", [token[1:-1]])
    base, _, part = token.partition(".")
    if base not in names or not part:
        raise TemplateError(f"unknown name {token!r}")
    return Expr("field", [base, part])


def parse(template: str, filters: dict[str, Callable[[str], str]]) -> Block:
    pieces = [p for p in _PIECE.split(template) if p]

    def block(names: set[str], ends: tuple[str, ...]) -> tuple[Block, str]:
        body: list = []
        while pieces:
            piece = pieces.pop(0)
            if piece.startswith("{{"):
                tokens = _tokens(piece[2:-2])
                of, used = _expression(tokens, names), []
                while tokens:
                    if tokens.pop(0) != "|" or not tokens or tokens[0] not in filters:
                        raise TemplateError(f"unknown filter in {piece!r}")
                    used.append(tokens.pop(0))
                body.append(Value(of, used))
            elif piece.startswith("{%"):
                tag, _, rest = piece[2:-2].strip().partition(" ")
                if tag in ends:
                    return Block(body), f"{tag} {rest}".strip()
                if tag == "for":
                    if not (m := re.fullmatch(r"(\w+)\s+in\s+(\w+)", rest.strip())):
                        raise TemplateError(f"cannot read {piece!r}")
                    inner, _ = block(names | {m[1]}, ("endfor",))
                    body.append(For(m[1], m[2], inner))
                elif tag == "generation":
                    body.append(Generation(block(names, ("endgeneration",))[0]))
                elif tag == "if":
                    arms, otherwise, head = [], Block([]), rest
                    while True:
                        test = None
                        if head is not None:
                            tokens = _tokens(head)
                            test = _expression(tokens, names)
                            if tokens:
                                raise TemplateError(f"cannot read {head!r}")
                        inner, end = block(names, ("elif", "else", "endif") if test else ("endif",))
                        if test:
                            arms.append((test, inner))
                        else:
                            otherwise = inner
                        if end == "endif":
                            break
                        head = end[5:] if end.startswith("elif") else None
                    body.append(If(arms, otherwise))
                else:
                    raise TemplateError(f"unknown tag {piece!r}")
            else:
                body.append(Literal(piece))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return Block(body), ""

    return block(set(), ())[0]


def fold(node, filters: dict[str, Callable[[str], str]]):
    """The same tree with constant values, tests and branches worked out and neighbouring literals joined."""
    if isinstance(node, Expr):
        if node.op in ("const", "field"):
            return node
        args = [fold(x, filters) for x in node.args]
        known = [x.args[0] for x in args if x.op == "const"]
        if len(known) == len(args):
            return Expr("const", [_OPS[node.op](*known)])
        if node.op in ("and", "or") and args[0].op == "const":
            return args[1] if bool(args[0].args[0]) == (node.op == "and") else args[0]
        return Expr(node.op, args)
    if isinstance(node, Value):
        of = fold(node.of, filters)
        if of.op == "const":
            return Literal(reduce(lambda x, f: filters[f](x), node.filters, str(of.args[0])))
        return Value(of, node.filters)
    if isinstance(node, Block):
        out: list = []
        for x in (fold(x, filters) for x in node.body):
            for y in x.body if isinstance(x, Block) else [x]:
                if isinstance(y, Literal) and out and isinstance(out[-1], Literal):
                    out[-1] = Literal(out[-1].text + y.text)
                elif not (isinstance(y, Literal) and not y.text):
                    out.append(y)
        return Block(out)
    if isinstance(node, If):
        arms = []
        for test, body in node.arms:
            test = fold(test, filters)
            if test.op == "const" and not test.args[0]:
                continue
            if test.op == "const":
                return If(arms, fold(body, filters)) if arms else fold(body, filters)
            arms.append((test, fold(body, filters)))
        return If(arms, fold(node.otherwise, filters)) if arms else fold(node.otherwise, filters)
    if isinstance(node, For):
        return For(node.name, node.over, fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


_OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}


class _Out:
    """Collects the text and the spans under the loss mask."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _closure(node, filters: dict[str, Callable[[str], str]]) -> Callable:
    if isinstance(node, Expr):
        if node.op == "const":
            constant = node.args[0]
            return lambda env: constant
        if node.op == "field":
            name, part = node.args
            return lambda env: env[name].get(part, "")
        parts, op = [_closure(x, filters) for x in node.args], node.op
        if op == "and":
            return lambda env: parts[0](env) and parts[1](env)
        if op == "or":
            return lambda env: parts[0](env) or parts[1](env)
        run = _OPS[op]
        return lambda env: run(*(p(env) for p in parts))
    if isinstance(node, Literal):
        text = node.text
        return lambda env, out: out.write(text)
    if isinstance(node, Value):
        get, steps = _closure(node.of, filters), [filters[f] for f in node.filters]

        def value(env, out):
            text = get(env)
            for step in steps:
                text = step(text)
            out.write(text)

        return value
    if isinstance(node, Block):
        runs = [_closure(x, filters) for x in node.body]

        def block(env, out):
            for run in runs:
                run(env, out)

        return block
    if isinstance(node, If):
        arms, otherwise = [(_closure(t, filters), _closure(b, filters)) for t, b in node.arms], _closure(node.otherwise, filters)

        def branch(env, out):
            for test, run in arms:
                if test(env):
                    return run(env, out)
            return otherwise(env, out)

        return branch
    if isinstance(node, For):
        run, name, over = _closure(node.body, filters), node.name, node.over

        def loop(env, out):
            for item in env[over]:
                run({**env, name: item}, out)

        return loop
    run = _closure(node.body, filters)

    def generation(env, out):
        begin = out.length
        run(env, out)
        out.spans.append((begin, out.length))

    return generation


def compile_template(template: str = DEFAULT_TEMPLATE, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (role, text) to the formatted text and the spans under the loss mask."""
    filters = filters or {"escape": escape}
    run = _closure(fold(parse(template, filters), filters), filters)

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns that a text of the default template holds."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]), unescape(m["text"])) if kind == "text" else (kind, unescape(m[kind])))
        at = m.end()
    return turns


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted (text), loss_spans (begin and end offsets of the masked text), one row per conversation."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(lambda frames: _stream(frames, template), f"conv_id {kind}, formatted string, loss_spans array<struct<begin:int,end:int>>")


def _stream(frames: Iterator[pd.DataFrame], template: str) -> Iterator[pd.DataFrame]:
    render = compile_template(template)
    current, messages, done = None, [], []

    def close() -> None:
        if messages:
            text, spans = render(messages)
            done.append((current, text, [{"begin": a, "end": b} for a, b in spans]))

    for frame in frames:
        ids = frame["conv_id"].astype(object).where(frame["conv_id"].notna(), None)
        for conv, role, text in zip(ids, frame["role"], frame["text"], strict=True):
            if conv != current:
                close()
                current, messages = conv, []
            messages.append({"role": role, "text": text})
        if done:
            yield pd.DataFrame(done, columns=["conv_id", "formatted", "loss_spans"])
            done = []
    close()
    if done:
        yield pd.DataFrame(done, columns=["conv_id", "formatted", "loss_spans"])


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation holds, read back from its text and its loss spans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for conv, text, spans in zip(frame["conv_id"], frame["formatted"], frame["loss_spans"], strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
                said = "".join(f"{role}\n{x}\n" for role, x in turns)
                out.append((conv, len(turns), _sha256(said), len(loss), _sha256(loss), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
