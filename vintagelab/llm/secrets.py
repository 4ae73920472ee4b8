"""Operator 10, secret scans: base patterns, and an assignment-aware lexer.

The lexer turns source and configuration text into name-literal pairs (x = "...", "x": "...", x: ..., export X=..., x := ...,
x => ...), follows names and concatenations to the constants that they stand for, and scores each literal by how sensitive the
names are that it reaches and by how random it looks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_rows, out_batches, text_or_empty

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HEX_RUN = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))

#: Parts of names that tell of secrets, with the weight of each.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "private_key": 1.0, "privatekey": 1.0, "access_key": 1.0, "accesskey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signing_key": 0.9, "encryption_key": 0.9, "client_secret": 1.0, "connection_string": 0.7, "dsn": 0.6}
#: Words that stand for a value rather than being one.
PLACEHOLDERS = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|null|none|true|false|undefined|todo|changeme|change_me|example|sample|test|dummy|placeholder|your[_-].*|my[_-].*|redacted)$")
#: The same for values longer than a word of that pattern can be: how they begin and end.
OPENED = [("<", ">"), ("${", "}"), ("{{", "}}"), ("%", "%"), ("your_", ""), ("your-", ""), ("my_", ""), ("my-", "")]
#: Characters kept of a value's ends; no word among the placeholders is longer.
_ENDS = 16
#: What can only be there if a name that tells of a secret is.
SENSITIVE = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|bearer|connection|dsn")
#: The lexer's states: comments, strings, elements with text alone, and names with an assignment after them.
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"
_PEM = r"""(?P<pem>["'])-----BEGIN\x20(?:(?!(?P=pem))[\s\S])*+(?P=pem)"""
_STRING = "(?<![A-Za-z0-9_])(?P<prefix>[fFrRbBuU]{0,2})(?P<quoted>\"\"\"[\\s\\S]*?\"\"\"|\'\'\'[\\s\\S]*?\'\'\'|" + _PEM + "|" + _DOUBLE + "|" + _SINGLE + "|`[^`]*+`)"
STRING = re.compile(_STRING)
LEXEME = re.compile(
    r"(?P<comment>(?<!:)//[^\n]*+|/\*[\s\S]*?(?:\*/|\Z)|<!--[\s\S]*?(?:-->|\Z)|(?:^|(?<=[\s;]))\#[^\n]*+)"
    + f"|{_STRING}"
    + r"|<(?P<tag>[A-Za-z_][A-Za-z0-9_.:\-]*+)(?P<attributes>(?:\s[^<>]*+)?)>(?P<body>[^<>]++)</(?P=tag)\s*+>"
    + r"|(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?=[ \t]*+(?::=|=>|=(?![=~])|:(?![:/])))"
)
ASSIGNS = re.compile(r"\]?[ \t]*+(?P<op>:=|=>|=(?![=~])|:(?![:/]))")
ANNOTATION = re.compile(r"[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\n:=]*\])?(?:[ \t]*+\|[ \t]*+[A-Za-z_][A-Za-z0-9_.]*+)*+[ \t]*+=(?![=>~])")
BLANKS, PLUS = re.compile(r"[ \t]*+"), re.compile(r"""[ \t]*+(?:\+[ \t]*+(?:\\?\n[ \t]*+)?|(?=["']))""")
NAME = re.compile(r"\$?\{?([A-Za-z_][A-Za-z0-9_.]*+)\}?")
UNQUOTED = re.compile(r"""[^\s"'`,;)}\]]++""")
BLOCK = re.compile(r"[ \t]*+[|>][+\-0-9]*+[ \t]*+\n")
HOLE = re.compile(r"\$?\{([A-Za-z_][A-Za-z0-9_.]*+)(?:![a-z])?(?::[^{}]*+)?\}")
LEAST_SCORE = 0.6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if text.encode("utf-8").translate(_HEX_RUN).find(b"x" * 24) >= 0:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def name_score(name: str) -> float:
    """How sensitive a name is: its parts, as snake, kebab, dotted or camel case, against NAME_WEIGHTS."""
    flat = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    parts = [p for p in re.split(r"[^a-z0-9]+", flat) if p]
    grams = {*parts, *("_".join(x) for x in zip(parts, parts[1:])), *("".join(x) for x in zip(parts, parts[1:]))}
    return max((NAME_WEIGHTS[g] for g in grams if g in NAME_WEIGHTS), default=0.0)


class Value:
    """What a name stands for: a literal at a place, or several values joined. Others share it rather than copy it; what its score
    depends on (length, characters, both ends) is known without the joined text, which can double with each assignment."""

    __slots__ = ("parts", "place", "size", "counts", "head", "tail", "told")

    def __init__(self, parts: list["Value"], text: str = "", place: tuple[int, int] | None = None):
        self.parts, self.place, self.told = parts, place, False
        self.size, self.counts, self.head, self.tail = len(text), Counter(text), text[:_ENDS], text[-_ENDS:]
        for p in parts:
            self.size += p.size
            for c, n in p.counts.items():
                self.counts[c] += n
            if len(self.head) < _ENDS:
                self.head = (self.head + p.head)[:_ENDS]
            self.tail = (self.tail + p.tail)[-_ENDS:]

    def places(self) -> Iterator[tuple[int, int]]:
        """The places of its literals that haven't been told of yet."""
        left = [self]
        while left:
            v = left.pop()
            if not v.told:
                v.told = True
                if v.place:
                    yield v.place
                left += v.parts

    def score(self) -> float:
        """How much it looks like a secret: entropy per character, length and kinds of characters, from 0 to 1. A PEM block counts
        without its white space; any other white space, and what stands for a value rather than being one, gives 0."""
        counts, size = self.counts, self.size
        if self.head.startswith("-----BEGIN "):
            counts = {c: n for c, n in counts.items() if not c.isspace()}
            size = sum(counts.values())
        elif any(c.isspace() for c in counts) or self._placeholder():
            return 0.0
        if size < 6:
            return 0.0
        entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
        kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return min(1.0, entropy / 4) * 0.6 + min(1.0, size / 16) * 0.2 + (kinds - 1) / 3 * 0.2

    def _placeholder(self) -> bool:
        if self.size <= _ENDS:
            return bool(PLACEHOLDERS.match(self.head))
        if len({c.lower() for c in self.counts}) == 1:
            return self.head[0] in "xX*.%"
        return any(self.head.lower().startswith(a) and self.tail.endswith(b) for a, b in OPENED)


def literal_score(value: str) -> float:
    """Value.score() of one literal."""
    return Value([], value).score()


def looks_random(word: str) -> bool:
    """Whether a word that could be an identifier is rather a value: digits in it, more than once and not few."""
    return len(word) >= 8 and len(re.findall("[0-9]+", word)) >= 2 and sum(map(str.isdigit, word)) >= 0.15 * len(word)


def _inside(quoted: re.Match) -> tuple[int, int]:
    """Where the content of a string is."""
    a, b = quoted.span("quoted")
    n = 3 if quoted["quoted"][:3] in ('"""', "\'\'\'") and b - a >= 6 else 1
    return a + n, b - n


def _block(text: str, name_at: int, at: int) -> tuple[int, int]:
    """The lines from a place on that are indented deeper than the line of the name, as (start, end)."""
    line = text.rfind("\n", 0, name_at) + 1
    indent, end = len(BLANKS.match(text, line)[0]), at
    start = at
    while end < len(text):
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        blank = BLANKS.match(text, end).end()
        if blank < stop and blank - end <= indent:
            break
        end = min(stop + 1, len(text))
    return start, end


def _value(text: str, name_at: int, at: int, op: str, constants: dict[str, Value]) -> tuple[list[Value], int]:
    """(the values that are joined at a place, where lexing goes on); calls and indexes stand for none."""
    parts: list[Value] = []

    def literal(a: int, b: int) -> None:
        parts.append(Value([], text[a:b], (a, b)))

    if op == ":":
        if block := BLOCK.match(text, at):
            a, b = _block(text, name_at, block.end())
            lines = text[a:b].split("\n")
            held = "".join(x.strip() for x in lines) if lines[0].lstrip().startswith("-----BEGIN ") else "\n".join(x.strip() for x in lines).strip()
            body = text[a:b]
            a, b = a + len(body) - len(body.lstrip()), b - (len(body) - len(body.rstrip()))
            words = [x for x in held.split("\n") if x]
            held = "".join(words) if all(" " not in x for x in words) else held
            return ([Value([], held, (a, b))] if b > a else []), max(a, b)
        if typed := ANNOTATION.match(text, at):
            at = typed.end()
    while True:
        at = BLANKS.match(text, at).end()
        if quoted := STRING.match(text, at):
            a, b = _inside(quoted)
            if "{" in text[a:b] and ("f" in quoted["prefix"].lower() or text[a - 1] == "`"):
                for hole in HOLE.finditer(text, a, b):
                    if hole.start() > a:
                        literal(a, hole.start())
                    if hole[1] in constants:
                        parts.append(constants[hole[1]])
                    a = hole.end()
            if b > a:
                literal(a, b)
            at = quoted.end()
        else:
            raw, name = UNQUOTED.match(text, at), NAME.match(text, at)
            if not raw:
                return parts, at
            if name and name[1] in constants and name.end() >= raw.end() - (1 if raw[0].endswith("+") else 0):
                parts.append(constants[name[1]])
                at = name.end()
            elif "(" in raw[0] or text[raw.end() : raw.end() + 1] == "(" or name and text[name.end() : name.end() + 1] in ("[", "("):
                return [], name.end() if name else raw.end()
            elif name and name.end() == raw.end() and not looks_random(raw[0]):
                at = name.end()  # a name of something unknown
            else:
                literal(at, raw.end())
                at = raw.end()
        plus = PLUS.match(text, at)
        if not plus:
            return parts, at
        at = plus.end()


def pairs(text: str) -> list[tuple[str, Value]]:
    """(name, value that it stands for) of each assignment outside comments and strings, in order.

    Assignments are x = v, x: v, x := v, x => v, "x": v, y["x"] = v, x: type = v and <x>v</x>; v is a string of any quotes, a block
    of deeper lines after | or >, or a bare word that isn't a name. A name on the right stands for what it was given last before
    that place; what is joined by + or by place, and what stands in the braces of a formatted string, counts with all its parts.
    """
    constants: dict[str, Value] = {}
    out, at = [], 0
    while m := LEXEME.search(text, at):
        if m["comment"] is not None:
            at = m.end()
            continue
        if m["tag"] is not None:
            body = m["body"].strip()
            if body:
                start = m.start("body") + m["body"].index(body)
                out.append((m["tag"], Value([], body, (start, start + len(body)))))
            at = m.start("attributes") if m["attributes"] else m.end()
            continue
        if m["quoted"] is not None:
            a, b = _inside(m)
            name, begin, end = text[a:b], a, m.end()
        else:
            name, begin, end = m["name"], m.start("name"), m.end("name")
        op = ASSIGNS.match(text, end)
        if not op or "\n" in name:
            at = max(end, at + 1)
            continue
        parts, at = _value(text, begin, op.end(), op["op"], constants)
        at = max(at, op.end())
        if parts:
            constants[name] = parts[0] if len(parts) == 1 else Value(parts)
            out.append((name, constants[name]))
        else:
            constants.pop(name, None)
    return out


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that sensitive names stand for and that look like secrets."""
    found = set()
    for name, value in pairs(text):
        if weight := name_score(name):
            if weight * value.score() >= LEAST_SCORE * 0.9:
                found.update((a, b, "literal") for a, b in value.places())
    return sorted(found, key=_order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base (base spans) and spans (with the lexer's) of every whole text, as kind:start:end.

    Code points, end exclusive, by start and then kind as listed. A null text is empty and has no spans; null and repeated ids
    and repeated rows each give a row; an empty table gives none; other columns are not read. Texts are lexed whole, by one task
    each; values that names stand for are shared, not copied, so time and memory grow with the text's length (and, for joined values,
    with their distinct characters). No shuffle.
    """
    schema = pa.schema([("id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def rows(batches):
        for doc_id, text in in_rows(batches):
            base = base_spans(text)
            more = literal_spans(text) if SENSITIVE.search(text) else []
            n = Counter(k for _, _, k in base)
            yield doc_id, n["assign"], n["access"], n["hex"], joined(base), joined(sorted([*base, *more], key=_order) if more else base)

    found = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return found.mapInArrow(lambda b: out_batches(rows(b), schema), "id long, n_assign long, n_access long, n_hex long, base string, spans string").withColumnRenamed("id", id_col)
