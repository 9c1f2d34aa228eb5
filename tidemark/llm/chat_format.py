"""Chat formatting by compiled templates.

*Compiler.* A template is text, ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}``, ``{% elif %}``, ``{% else %}``,
``{% set x = ... %}`` and ``{% generation %}``, each with its end tag. It is parsed into a tree, constants are folded
(also whole branches and neighbouring texts), and the tree becomes nested Python closures. The language is a sandbox:
names are looked up in the given values alone, a member is a key of a mapping, there are no calls but the listed
filters, no attributes and no loops over anything but given sequences. A closure yields pieces of (text, marked)
as it goes, so a conversation is never held whole; ``marked`` is true inside ``generation``.

*Controls.* All fixed text of the marks that a reader relies on are control strings. Where one begins inside a text, a
backslash follows its first character, and a backslash is doubled: no control string is left, and removing the
backslashes again gives the text. The template's own marks are checked when it is compiled: no mark may overlap itself,
and no end of a text may form a control string with the mark that follows it.

*Jobs.* ``formatted`` deals conversations out by id, sorts them by turn on disk, and renders each task's rows as a
stream; output is cut into segments of about ``segment`` characters, so that neither a conversation of any length nor a
hot id has to fit in memory. ``read_back`` parses segments as a stream too, and knows only control strings, never the
input.

Defined results: a null text or role is empty. Turns of equal number follow role and text; a null turn comes first. Rows
without an id are one conversation without an id. Repeated rows are turns of their own. A conversation without assistant
turns has no loss text (zero characters, digest of nothing). An empty table gives no conversations of its own. Columns
other than those that are named are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Piece = tuple[str, bool]

FILTERS: dict[str, Callable[[str], str]] = {"trim": str.strip, "upper": str.upper, "lower": str.lower}

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+~|.<>()\[\]%]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not of the language, or its marks cannot be told from texts."""


# ---- expressions: ("const", value), ("name", n), ("item", e, e), ("not", e), ("op", sign, e, e), ("filter", name, e)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">="), ("~", "+", "-"), ("%",))

    def __init__(self, source: str, allowed: Iterable[str]):
        self.source, self.allowed, self.tokens, at = source, set(allowed), [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def next(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError(f"{self.source!r} ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in signs:
            return self.next()[1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign} is missing in {self.source!r}")

    def whole(self) -> tuple:
        e = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over in {self.source!r}")
        return e

    def level(self, k: int) -> tuple:
        if k == len(self.LEVELS):
            return self.unary()
        e = self.level(k + 1)
        while sign := self.take(*self.LEVELS[k]):
            e = fold(("op", sign, e, self.level(k + 1)))
        return e

    def unary(self) -> tuple:
        if self.take("not"):
            return fold(("not", self.unary()))
        kind, value = self.next()
        if kind == "text":
            e = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "number":
            e = ("const", int(value))
        elif kind == "name":
            e = ("const", {"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else ("name", value)
        elif value == "(":
            e = self.level(0)
            self.need(")")
        else:
            raise TemplateError(f"{value!r} starts nothing in {self.source!r}")
        while sign := self.take(".", "[", "|"):
            if sign == "[":
                e = ("item", e, self.level(0))
                self.need("]")
                continue
            kind, name = self.next()
            if kind != "name" or sign == "|" and name not in self.allowed:
                raise TemplateError(f"no {'filter' if sign == '|' else 'member'} {name!r}")
            e = ("item", e, ("const", name)) if sign == "." else fold(("filter", name, e))
        return e


def _text(value: Any) -> str:
    return "" if value is None else str(value)


_OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: int(a) % int(b),
    "~": lambda a, b: _text(a) + _text(b),
}


def fold(e: tuple) -> tuple:
    """The constant that an operation on constants gives; ``and`` and ``or`` need their left side alone."""
    if e[0] == "not" and e[1][0] == "const":
        return ("const", not e[1][1])
    if e[0] == "filter" and e[2][0] == "const" and e[1] in FILTERS:
        return ("const", FILTERS[e[1]](_text(e[2][1])))
    if e[0] == "op" and e[2][0] == "const":
        if e[1] in ("and", "or"):
            return e[3] if bool(e[2][1]) == (e[1] == "and") else e[2]
        if e[3][0] == "const":
            return ("const", _OPERATIONS[e[1]](e[2][1], e[3][1]))
    return e


def _evaluator(e: tuple, filters: Mapping[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda scope: value
    if kind == "name":
        name = e[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        of, key = _evaluator(e[1], filters), _evaluator(e[2], filters)

        def item(scope: dict) -> Any:
            v = of(scope)
            return v.get(key(scope)) if isinstance(v, Mapping) else None

        return item
    if kind == "not":
        inner = _evaluator(e[1], filters)
        return lambda scope: not inner(scope)
    if kind == "filter":
        f, inner = filters[e[1]], _evaluator(e[2], filters)
        return lambda scope: f(_text(inner(scope)))
    sign, a, b = e[1], _evaluator(e[2], filters), _evaluator(e[3], filters)
    if sign == "and":
        return lambda scope: a(scope) and b(scope)
    if sign == "or":
        return lambda scope: a(scope) or b(scope)
    operation = _OPERATIONS[sign]
    return lambda scope: operation(a(scope), b(scope))


# ---- statements: ("print", e), ("for", name, e, body), ("if", e, body, body), ("set", name, e), ("generation", body)


def parse(source: str, filters: Iterable[str] = FILTERS) -> list[tuple]:
    """The folded tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        parts.append(("text", source[at : m.start()]))
        if m[1] is not None or m[2] is not None:
            parts.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    stream = iter(parts)

    def body(*ends: str) -> tuple[list[tuple], str]:
        out: list[tuple] = []
        for kind, value in stream:
            if kind == "tag":
                word, _, rest = value.partition(" ")
                if word in ends:
                    return folded(out), value
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z_]\w*) in (.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"cannot read {value!r}")
                    out.append(("for", m[1], _Expression(m[2], filters).whole(), body("endfor")[0]))
                elif word == "if":
                    out.append(branch(rest))
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"cannot read {value!r}")
                    out.append(("set", m[1], _Expression(m[2], filters).whole()))
                elif word == "generation":
                    out.append(("generation", body("endgeneration")[0]))
                else:
                    raise TemplateError(f"no tag {word!r} here")
            else:
                out.append(("print", ("const", value) if kind == "text" else _Expression(value, filters).whole()))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return folded(out), ""

    def branch(condition: str) -> tuple:
        then, end = body("elif", "else", "endif")
        word, _, rest = end.partition(" ")
        other = [branch(rest)] if word == "elif" else body("endif")[0] if word == "else" else []
        return ("if", _Expression(condition, filters).whole(), then, other)

    return body()[0]


def folded(statements: list[tuple]) -> list[tuple]:
    """Branches of constant conditions are taken, and texts that follow each other become one."""
    out: list[tuple] = []
    for s in statements:
        chosen = (s[2] if s[1][1] else s[3]) if s[0] == "if" and s[1][0] == "const" else [s]
        for x in chosen:
            if x[0] == "print" and x[1][0] == "const":
                x = ("print", ("const", _text(x[1][1])))
                if out and out[-1][0] == "print" and out[-1][1][0] == "const":
                    x = ("print", ("const", out.pop()[1][1] + x[1][1]))
                if not x[1][1]:
                    continue
            out.append(x)
    return out


def _runner(statements: list[tuple], filters: Mapping[str, Callable[[str], str]], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(s, filters, marked) for s in statements]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _step(s: tuple, filters: Mapping[str, Callable[[str], str]], marked: bool) -> Callable[[dict], Iterable[Piece]]:
    if s[0] == "print":
        if s[1][0] == "const":
            pieces = ((s[1][1], marked),)
            return lambda scope: pieces
        value = _evaluator(s[1], filters)
        return lambda scope: ((_text(value(scope)), marked),)
    if s[0] == "generation":
        return _runner(s[1], filters, True)
    if s[0] == "set":
        name, value = s[1], _evaluator(s[2], filters)

        def put(scope: dict) -> Iterable[Piece]:
            scope[name] = value(scope)
            return ()

        return put
    if s[0] == "if":
        test, then, other = _evaluator(s[1], filters), _runner(s[2], filters, marked), _runner(s[3], filters, marked)
        return lambda scope: then(scope) if test(scope) else other(scope)
    name, over, inner = s[1], _evaluator(s[2], filters), _runner(s[3], filters, marked)

    def loop(scope: dict) -> Iterator[Piece]:
        items = iter(over(scope) or ())
        ahead, i = next(items, items), 0
        while ahead is not items:
            this, ahead = ahead, next(items, items)
            yield from inner(scope | {name: this, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": ahead is items}})
            i += 1

    return loop


class Controls:
    """The strings that mean something in formatted text, and the way to write them inside a text."""

    def __init__(self, strings: Iterable[str]):
        self.strings = sorted(strings, key=lambda s: (-len(s), s))
        if any(len(s) < 2 or "\\" in s for s in self.strings):
            raise TemplateError("a control string has two characters or more and no backslash")
        any_of = "|".join(map(re.escape, self.strings))
        self._begins = re.compile(rf"\\|(?=(?:{any_of})).", re.S)
        self.find = re.compile(any_of)

    def escape(self, text: str) -> str:
        return self._begins.sub(lambda m: m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        """Backwards: a backslash goes, and the character after it is taken as it is, be it another backslash."""
        return re.sub(r"\\(\\?)", r"\1", text)

    def check_end(self, mark: str) -> None:
        """No control string may begin in a text and end in the mark behind it, nor the mark begin inside itself."""
        for c in self.strings:
            for i in range(1, len(c)):
                if mark.startswith(c[i:]) or c[i:].startswith(mark):
                    raise TemplateError(f"a text before {mark!r} could form {c!r}")


class Template:
    """A compiled template: ``pieces`` renders values as a stream, ``render`` as a whole with the marked spans."""

    def __init__(self, source: str, controls: Iterable[str] = (), text_ends: Iterable[str] = ()):
        self.source, self.controls = source, Controls(controls) if controls else None
        filters = dict(FILTERS)
        if self.controls:
            filters["escape"] = self.controls.escape
            for mark in text_ends:
                self.controls.check_end(mark)
        self.tree = parse(source, filters)
        self._run = _runner(self.tree, filters, False)

    def pieces(self, **values: Any) -> Iterator[Piece]:
        return self._run(dict(values))

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        text, spans, at = [], [], 0
        for t, marked in self.pieces(**values):
            if marked and t:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(t))
                else:
                    spans.append((at, at + len(t)))
            text.append(t)
            at += len(t)
        return "".join(text), spans


#: Turns of any role in any order. A role of its own mark needs no name.
TURNS = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[END]{% endif %}"
    "{% endfor %}"
)
#: begin -> (role, end)
MARKS = {"[INST]": ("user", "[/INST]"), "<<SYS>>": ("system", "<</SYS>>"), "<s>": ("assistant", "</s>")}
CONTROLS = (*MARKS, *(end for _, end in MARKS.values()), "[ROLE]", "[/ROLE]", "[END]")
ENDS = (*(end for _, end in MARKS.values()), "[/ROLE]", "[END]")


def turns_template() -> Template:
    return Template(TURNS, CONTROLS, ENDS)


#: Characters that a task puts together before it hands them on.
BATCH_CHARS = 1 << 20
SEGMENTS = "conv_id long, segment long, text string, spans array<struct<start: int, end: int>>"


def formatted(conversations: DataFrame, template: Callable[[], Template] = turns_template, segment: int = 1 << 20) -> DataFrame:
    """conv_id, segment, text, spans: the output of each conversation in segments from 0, whose texts follow each other;
    spans are the marked places of a segment. The rows of a task stand in the order of conv_id and segment."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = template()
        each = (r for b in batches for r in zip((None if pd.isna(x) else int(x) for x in b["conv_id"]), b["role"], b["text"], strict=True))
        waiting, size = [], 0
        for conv, turns in itertools.groupby(each, key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for i, (text, spans) in enumerate(_segments(compiled.pieces(messages=messages), segment)):
                waiting.append((conv, i, text, [{"start": a, "end": b} for a, b in spans]))
                size += len(text)
                if size >= BATCH_CHARS or len(waiting) >= 4096:
                    yield _frame(waiting, ["conv_id", "segment", "text", "spans"])
                    waiting, size = [], 0
        if waiting:
            yield _frame(waiting, ["conv_id", "segment", "text", "spans"])

    return dealt.mapInPandas(render, SEGMENTS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})


def _segments(pieces: Iterator[Piece], size: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Pieces in texts of ``size`` characters at most, with the marked spans of each; one empty text if there are none."""
    text: list[str] = []
    spans: list[tuple[int, int]] = []
    at, none_yet = 0, True
    for piece, marked in pieces:
        for i in range(0, max(1, len(piece)), size):
            t = piece[i : i + size]
            if at and at + len(t) > size:
                yield "".join(text), spans
                text, spans, at, none_yet = [], [], 0, False
            if marked and t:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(t))
                else:
                    spans.append((at, at + len(t)))
            text.append(t)
            at += len(t)
    if at or none_yet:
        yield "".join(text), spans


class Reader:
    """Parses the output of TURNS as it comes. Digests are taken as texts go by; nothing is kept but what may still be
    part of a control string or an escape. No control string begins another, so the first match is the one."""

    def __init__(self) -> None:
        self.controls = Controls(CONTROLS)
        self.keep = max(map(len, CONTROLS))
        self.turns, self.chars, self.rest = 0, 0, ""
        self.digest, self.loss = hashlib.sha256(), hashlib.sha256()
        self.loss_chars = 0
        self.state: str | None = None  # the end mark that is waited for
        self.pending = self.loss_pending = ""

    def _put(self, raw: str) -> None:
        """Text of a turn or a role; an odd backslash at its end waits for what it stands before."""
        raw = self.pending + raw
        held = (len(raw) - len(raw.rstrip("\\"))) % 2
        self.pending = "\\" if held else ""
        self.digest.update(Controls.unescape(raw[: len(raw) - held]).encode())

    def feed(self, text: str, last: bool = False) -> None:
        self.chars += len(text)
        self.rest += text
        at = 0
        for m in self.controls.find.finditer(self.rest):
            self._between(self.rest[at : m.start()])
            self._mark(m[0])
            at = m.end()
        # What could still become a control string stays.
        stay = 0 if last else next((k for k in range(min(self.keep - 1, len(self.rest) - at), 0, -1) if any(c.startswith(self.rest[-k:]) for c in CONTROLS)), 0)
        self._between(self.rest[at : len(self.rest) - stay])
        self.rest = self.rest[len(self.rest) - stay :]

    def _between(self, raw: str) -> None:
        if raw and not self.state:
            raise ValueError(f"text outside of turns: {raw[:40]!r}")
        if raw:
            self._put(raw)

    def _mark(self, mark: str) -> None:
        if self.state is None:
            if mark == "[ROLE]":
                self.state = "[/ROLE]"
            elif mark in MARKS:
                role, self.state = MARKS[mark]
                self.digest.update(f"{role}\n".encode())
            else:
                raise ValueError(f"{mark} ends nothing")
        elif mark != self.state:
            raise ValueError(f"{mark} inside a text")
        elif self.pending:
            raise ValueError("a text ends within an escape")
        elif mark == "[/ROLE]":
            self.digest.update(b"\n")
            self.state = "[END]"
        else:
            self.digest.update(b"\n")
            self.turns += 1
            self.state = None

    def marked(self, raw: str) -> None:
        raw = self.loss_pending + raw
        held = (len(raw) - len(raw.rstrip("\\"))) % 2
        self.loss_pending = "\\" if held else ""
        text = Controls.unescape(raw[: len(raw) - held])
        self.loss_chars += len(text)
        self.loss.update(text.encode())

    def end(self) -> None:
        self.feed("", last=True)
        if self.state or self.pending or self.loss_pending:
            raise ValueError("the output ends inside a turn")


BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame, in_order: bool = False) -> DataFrame:
    """One row a conversation, from the segments alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. ``in_order``: the rows come straight from ``formatted`` and need not be dealt and sorted again."""
    rows = segments.select("conv_id", "segment", "text", "spans")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = (r for b in batches for r in zip((None if pd.isna(x) else int(x) for x in b["conv_id"]), b["text"], b["spans"], strict=True))
        out = []
        for conv, parts in itertools.groupby(each, key=lambda r: r[0]):
            reader = Reader()
            for _, text, spans in parts:
                reader.feed(text)
                for s in spans:
                    reader.marked(text[s["start"] : s["end"]])
            reader.end()
            out.append((conv, reader.turns, reader.digest.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.chars))
            if len(out) >= 4096:
                yield _frame(out, [c.split()[0] for c in BACK.split(", ")])
                out = []
        if out:
            yield _frame(out, [c.split()[0] for c in BACK.split(", ")])

    return rows.mapInPandas(read, BACK)


#: A conversation whose texts are made of control strings.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def chat_format(conversations: DataFrame) -> DataFrame:
    """All conversations and PLANTED, formatted and read back."""
    planted = conversations.sparkSession.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(formatted(rows.unionByName(planted)), in_order=True)


#: Lengths by the marks of TURNS; an escape adds a backslash for each backslash and each control string.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(text) + len(regexp_extract_all(text, '\\|\[/?INST\]|<</?SYS>>|</?s>|\[/?ROLE\]|\[END\]')) AS n,
  CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7
    ELSE 18 + len(role) + len(regexp_extract_all(role, '\\|\[/?INST\]|<</?SYS>>|</?s>|\[/?ROLE\]|\[END\]')) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + marks) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""
