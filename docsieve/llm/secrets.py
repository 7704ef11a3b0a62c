"""Secret scan: base patterns, and assignment-aware lexing.

The lexer reads ``name = literal`` and ``name: literal`` pairs out of source and
configuration text, follows constants through names and through ``+``, and scores
each literal by its target name and its own look. Base spans are always kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import col, small_batches
from ._text import batches

# The base patterns, their order and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

_HEX_RUN = re.compile(r"[0-9a-f]{16,}")
_HINTS = ("passw", "secret", "token", "api_key", "apikey")

#: What stands between a name and its value; the name itself is read backwards from here.
_OPERATOR = re.compile(r""":=|=>|->(?=[ \t]*["'`])|[:=](?!=)""")
#: A type between a declared name and its value.
_TYPE = re.compile(r"[ \t]*[&*]?[A-Za-z_][A-Za-z0-9_.]*(?:[<\[][A-Za-z0-9_., |<>\[\]]*[>\]])?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*)*[?&*]?[ \t]*")
_LONGEST_TYPE = 120
#: An element whose content is its value.
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.\-]*)(?:\s[^<>]*)?>\s*([^<>\s][^<>]*?)\s*</")
_NAME_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-"
#: String literals of common languages: three quotes, back quotes, double and single quotes; a prefix of letters may stand before them.
_QUOTED = re.compile(r"""(?:[rbfuRBFU]{1,2}(?=["']))?(?:\"{3}(.*?)\"{3}|'{3}(.*?)'{3}|`([^`]*)`|"([^"\\\n]*(?:\\.[^"\\\n]*)*)"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)')""", re.DOTALL)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
#: An unquoted value: to white space, or to a separator before the next pair of a list of pairs.
_BARE = re.compile(r"""(?:[^\s,;&]+|[,;&](?!(?:"[A-Za-z_][A-Za-z0-9_.\-]*"|'[A-Za-z_][A-Za-z0-9_.\-]*')[ \t]*[:=]|[A-Za-z_][A-Za-z0-9_.\-]*=))+""")
#: What may follow a name that stands for its constant, and what joins values.
_ENDS = re.compile(r"""[\s,;)\]}]|\Z|\+[ \t]*["'`]""")
_PLUS = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)?\+\s*(?:\\\r?\n\s*)?")
#: Blanks and a continued line before a value; in brackets, line ends too.
_BLANKS = re.compile(r"[ \t]*(?:\\\r?\n[ \t]*)*")
_OPEN = re.compile(r"[(\[{]\s*")
#: A call whose first argument is a literal, and what stands between the items of a list.
_CALL = re.compile(r"""[A-Za-z_][A-Za-z0-9_.:]*!?\(\s*(?=(?:[rbfuRBFU]{1,2})?["'`])""")
_COMMA = re.compile(r"""\s*,\s*(?=(?:[rbfuRBFU]{1,2})?["'`])""")
_SPACE = re.compile(r"\s*")
#: The head of a YAML block scalar, with the rest of its line.
_BLOCK = re.compile(r"[|>][+\-0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
_IDENTIFIER = re.compile(r"[A-Za-z_]+(?:(?:\.|->|::)[A-Za-z_]+)*(?:[(\[].*)?")
#: Code points kept of both ends of a value.
_EDGE = 32
#: Parts of names that say their value is to be kept secret, with weights.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api_key": 3.0, "credential": 2.0, "private_key": 3.0, "access_key": 3.0, "auth": 1.0, "signature": 1.0}
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
_HARMLESS = re.compile(r"(?i)^(?:true|false|null|none|changeme|example|placeholder|your[_-].*|x+|\*+|<.*>|\$\{.*\})$")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the base patterns as (start, end, kind), sorted by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # a maximal run of 16 or more is a match of [0-9a-f]+ that does not fail, and the other way round
    found += [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class _Value:
    """A literal, or values joined by ``+``: its length, ends and characters, and where it stands, but not its text."""

    __slots__ = ("n", "head", "tail", "span", "of", "counts")

    def __init__(self, n: float, head: str, tail: str, span: tuple[int, int] | None, of: tuple = (), counts: dict | None = None):
        self.n, self.head, self.tail, self.span, self.of, self.counts = n, head, tail, span, of, counts


class _Lexer:
    """Values of one text. Nothing is read twice where values overlap, so the work is linear in the text."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[str, _Value] = {}
        self.quote_end = self.bare_end = -1
        self.counted: tuple[int, int, Counter] = (0, -1, Counter())

    def literal(self, start: int, end: int) -> _Value:
        head, tail = self.text[start : min(end, start + _EDGE)], self.text[max(start, end - _EDGE) : end]
        return _Value(end - start, head, tail, (start, end))

    def counts(self, v: _Value) -> dict:
        if v.counts is None:
            start, end = v.span
            at, stop, c = self.counted
            if stop == end and at <= start:
                # a value in a value: what stands before it goes
                c = c - Counter(self.text[at:start])
            else:
                c = Counter(self.text[start:end])
            self.counted = (start, end, c)
            v.counts = c
        return v.counts

    def join(self, parts: list[_Value]) -> _Value:
        if len(parts) == 1:
            return parts[0]
        n, head, tail = 0, "", ""
        counts: dict[str, float] = {}
        for p in parts:
            n, head, tail = n + p.n, head + p.head if len(head) < _EDGE else head, (tail + p.tail)[-_EDGE:]
            for c, x in self.counts(p).items():
                counts[c] = counts.get(c, 0) + x
        while n > 1 << 60:
            # no such text can be, but names that double each other can say so
            n, counts = n / 2, {c: x / 2 for c, x in counts.items()}
        # the parts' own characters are not needed to find where they stand
        return _Value(n, head[:_EDGE], tail, None, tuple((p.span, p.of) for p in parts), counts)

    def term(self, at: int, inside: bool, spaced: bool) -> tuple[_Value | None, int]:
        """The value at a place, if there is one, and the place after it; ``spaced``: blanks stand round the operator."""
        if m := _QUOTED.match(self.text, at):
            self.quote_end = max(self.quote_end, m.end() - 1)
            return self.literal(*m.span(m.lastindex)), m.end()
        if m := _NAME.match(self.text, at):
            own = self.known.get(m.group())
            if _ENDS.match(self.text, m.end()):
                if own or self.text.startswith("+", m.end()):
                    return own or self.literal(*m.span()), m.end()
            elif own and self.text.startswith("+", m.end()) and (x := _NAME.match(self.text, m.end() + 1)) and x.group() in self.known:
                return own, m.end()
        if self.text.startswith(('"', "'"), at):
            at += 1
        if at >= self.bare_end:
            m = _BARE.match(self.text, at)
            self.bare_end = m.end() if m else at
        end = self.bare_end if at >= self.quote_end else min(self.bare_end, self.quote_end)
        last = end
        while last > at and self.text[last - 1] in (",;)]}" if inside else ",;"):
            last -= 1
        # a name without digits is a reference, unless it stands like a value of a configuration file
        if last == at or (spaced and _IDENTIFIER.fullmatch(self.text, at, last)):
            return None, end
        return self.literal(at, last), end

    def block(self, name_at: int, at: int) -> tuple[_Value | None, int]:
        """A YAML block scalar: the lines that stand deeper than the name's line, from their first letter to their last."""
        line = self.text.rfind("\n", 0, name_at) + 1
        depth = len(self.text[line:name_at]) - len(self.text[line:name_at].lstrip(" "))
        start = end = at
        while at < len(self.text):
            stop = self.text.find("\n", at)
            stop = len(self.text) if stop < 0 else stop
            row = self.text[at:stop]
            if row.strip():
                if len(row) - len(row.lstrip(" ")) <= depth:
                    break
                if end == start:
                    start = at + len(row) - len(row.lstrip())
                end = at + len(row.rstrip())
            at = stop + 1
        return (self.literal(start, end) if end > start else None), at

    def values(self, at: int, name_at: int, spaced: bool) -> list[_Value]:
        """Values from a place on: literals joined by ``+`` or by standing next to each other are one, the items of a list are several."""
        at = _BLANKS.match(self.text, at).end()
        if m := _BLOCK.match(self.text, at):
            own = self.block(name_at, m.end())[0]
            return [own] if own else []
        items, parts, inside = [], [], False
        while m := _OPEN.match(self.text, at) or _CALL.match(self.text, at):
            at, inside = m.end(), True
        while at < len(self.text):
            part, at = self.term(at, inside, spaced)
            if part:
                parts.append(part)
            if m := _PLUS.match(self.text, at):
                at = m.end()
            elif (m := (_SPACE if inside else _BLANKS).match(self.text, at)) and self.text.startswith(('"', "'", "`"), m.end()) and part and _QUOTED.match(self.text, m.end()):
                at = m.end()
            elif inside and (m := _COMMA.match(self.text, at)):
                at = m.end()
                items.append(parts)
                parts = []
            else:
                break
        return [self.join(p) for p in (*items, parts) if p]

    def score(self, name: str, v: _Value) -> float:
        by_name = max((SENSITIVE[m.group().lower()] for m in _SENSITIVE.finditer(name)), default=0.0)
        if v.n < 6 or not by_name:
            return 0.0
        counts, ends = self.counts(v), v.head if v.n <= _EDGE else v.head + v.tail
        # forms that are open in their middle are told by the ends, runs of one character by all characters
        if _HARMLESS.match(ends) and (ends[0] in "yY<$" or set(ends) == set(counts)):
            return 0.0
        look = by_name * (0.5 + min(1.0, entropy(counts, v.n) / 4))
        if " " in counts:
            # a pass phrase has blanks, and so has a message that speaks of one
            return 0.0 if _SENSITIVE.search(ends) or ends.rstrip()[-1:] in ".!?:" else 0.6 * look
        return look


def entropy(counts: dict[str, float], n: float) -> float:
    return -sum(c / n * math.log2(c / n) for c in counts.values())


def lexed_spans(text: str, threshold: float = 2.0) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, directly or through constants; the span is the literal's own.

    A quoted literal is whole, whatever stands in it and however long it is. An unquoted
    value goes to white space or the line's end, less ``,`` and ``;`` at its end; where
    ``,``, ``;`` or ``&`` is followed by the next name and its operator, it ends there.
    A YAML block scalar is its indented lines. Literals next to each other are one value,
    in brackets also over line ends, and the items of a list are values of their own. A
    type between a name and its value, and a call round a literal, are passed over. A
    constant may be defined below its use. An element's content is its value. An unquoted name without digits is a reference, not a
    literal, where blanks stand round the operator or after a colon.
    """
    if not any(x in text for x in ("=", ":", "<", "->")) or not _SENSITIVE.search(text):
        return []
    lexer = _Lexer(text)
    # once for the constants, as one may be defined below its use
    for _ in _pairs(lexer):
        pass
    found: set[tuple[int, int, str]] = set()
    seen: dict[int, tuple] = {}
    for name, value in _pairs(lexer):
        if lexer.score(name, value) >= threshold:
            stack = [(value.span, value.of)]
            while stack:
                span, of = stack.pop()
                if span and span[1] > span[0]:
                    found.add((*span, "literal"))
                elif of and id(of) not in seen:
                    seen[id(of)] = of
                    stack += of
    return sorted(found)


def _pairs(lexer: _Lexer) -> Iterator[tuple[str, _Value]]:
    """Names with their values; the first value of a name is its constant from there on."""
    text, before, declared = lexer.text, 0, None
    lexer.quote_end = lexer.bare_end = -1
    lexer.counted = (0, -1, Counter())
    for m in _OPERATOR.finditer(text):
        seg = text[before : m.start()]
        before = m.end()
        if m.group() == "=" and declared and len(seg) <= _LONGEST_TYPE and _TYPE.fullmatch(seg):
            # name: type = value
            name, name_at = declared
            spaced = True
        else:
            shown = seg.rstrip(" \t")
            bare = shown[:-1] if shown[-1:] in ("'", '"', "`", "]") else shown
            bare = bare[:-1] if shown[-1:] == "]" and bare[-1:] in ("'", '"') else bare
            name = bare[len(bare.rstrip(_NAME_LETTERS)) :].lstrip("0123456789.-")
            name_at = m.start() - len(seg) + len(bare) - len(name)
            spaced = len(shown) < len(seg) or text[m.end() : m.end() + 1] in " \t"
        declared = (name, name_at) if m.group() == ":" and name else None
        if not name:
            continue
        own = lexer.values(m.end(), name_at, spaced)
        if own:
            lexer.known[name] = own[0]
        yield from ((name, v) for v in own)
    for m in _ELEMENT.finditer(text):
        if text.startswith(m.group(1), m.end()):
            yield m.group(1), lexer.literal(*m.span(2))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 2.0) -> DataFrame:
    """One row per input row: ``id``, ``base`` and ``spans``, arrays of (kind, start, end) in code points, end exclusive.

    ``base`` holds the spans of the base patterns; ``spans`` these and those of the
    lexer (kind ``literal``). A null or empty text has none; a very long one is scanned
    whole, in linear time. Of spans that start together, kinds come as listed. Repeated
    rows and null ids are scanned like any others; columns other than the two are not
    read; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            base, spans = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                own = base_spans(text)
                base.append(own)
                spans.append(sorted({*own, *lexed_spans(text, threshold)}, key=lambda s: (s[0], (*KINDS, "literal").index(s[2]), s[1])))
            rows = lambda v: pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in r] for r in v], span)
            yield pa.RecordBatch.from_arrays([b.column(0), rows(base), rows(spans)], names=["id", "base", "spans"])

    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(col(id_col).alias("id"), col(text_col).alias("text")).mapInArrow(scan, f"id {kind}, base {one}, spans {one}")


def joined(spans: str):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
