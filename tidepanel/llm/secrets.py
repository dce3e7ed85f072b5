"""Secret scan by assignment-aware lexing.

Three base patterns (assignments to secret-like keys, access keys, long hex runs) are found in every whole text. Beside them, source
and configuration syntax is lexed into statements `name = value`: string literals, bare words, names and sums of those. Names carry the
literals last assigned to them, so `k = "..."; password = k` leads back to the literal: a name holds references to the parts of its
value, however many, and a summary of fixed size, so memory grows with the statements, about two kilobytes for a sum. A literal is
reported when the words of the name it reaches, weighed together with how random it looks, pass a threshold. A `name` or `key` whose
`value` follows gives that value its name, and calls that only decode or wrap a literal are looked into.

Null and empty texts have no spans. Repeated rows are reported once per row; rows are independent, so there is no shuffle. Offsets are
code points, ends exclusive. Lines of any length are scanned whole. The base patterns stop at the line; a value may go on over line
breaks: in triple quotes, backticks and YAML block scalars, inside parentheses, after a sign, around an operator and after a backslash.
It is weighed without breaks and indents. Elements of lists are no values of the list's name, and comments inside sums end them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import texts

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_LEAST = 6
# `AKIA[A-Z0-9]+` of 20 characters and `[0-9a-f]+` of 24: what is long enough is the same run, so shorter ones need no step of their own.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")

# Weights of the words of a target name; the heaviest word decides, a damping word lowers it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "auth": 0.7, "bearer": 0.8, "signature": 0.6, "key": 0.5,
    "pass": 0.6, "salt": 0.6, "cert": 0.5, "conn": 0.4, "dsn": 0.6,
}
DAMPING = {"public": 0.5, "id": 0.4, "name": 0.4, "count": 0.6, "max": 0.6, "min": 0.6, "type": 0.5, "url": 0.3, "path": 0.4, "file": 0.3,
           "length": 0.6, "limit": 0.6, "primary": 0.4, "foreign": 0.4}
PLACEHOLDER = re.compile(r"change_?me|example|placeholder|your[_-]|dummy|sample|redacted|x{4,}|\*{3,}", re.I)
WRAPPED = re.compile(r"<.*>|\$\{.*\}|%.*%|\{\{.*\}\}")
#: Code points kept from both ends of a value; no placeholder word needs more to be found across a joint.
_EDGE = 16
THRESHOLD = 0.55

# A statement is found by its sign; the target is read back from it, the terms of the value after it.
_SIGN = re.compile(r":=|=>|==|!=|=|:")
_QUOTED = re.compile(r"[A-Za-z_][\w .$/-]*", re.A)
_SUBSCRIPT = re.compile(r"[\w .-]+", re.A)
_NAME_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-"
_PIECE = re.compile(r"[\w$]+|[.-]", re.A)
_BLANK = re.compile(r"[ \t]*")
_TERM = re.compile(
    r"""[rRbBuUfF]?\"{3}(?P<double3>(?:[^\\]|\\[\s\S])*?)\"{3}|[rRbBuUfF]?'{3}(?P<single3>(?:[^\\]|\\[\s\S])*?)'{3}|"""
    r"""[rRbBuUfF]?"(?P<double>(?:[^"\\\n]|\\.)*)"|[rRbBuUfF]?'(?P<single>(?:[^'\\\n]|\\.)*)'|`(?P<back>[^`]*)`|(?P<bare>[^\s"'`,;(){}\[\]<>|]+)"""
)
# Blanks with any line breaks, with escaped ones only, and with breaks before indented lines only.
_ANY, _ESCAPED, _INDENTED = r"[ \t]*+(?:\\?\r?\n[ \t]*+)*+", r"[ \t]*+(?:\\\r?\n[ \t]*+)*+", r"[ \t]*+(?:\\?\r?\n[ \t]++)*+"
_OPENS = r"(?=[rRbBuUfF]?[\"'`])"
_VALUE = re.compile(rf"{_ANY}(?P<open>(?:\({_ANY})*+)")
#: Joints of a sum: a line ends after an operator, or the next one begins with it, indented; inside parentheses lines do not count.
_JOIN = re.compile(
    rf"{_ESCAPED}{_OPENS}|[ \t]*\.[ \t]*{_OPENS}|(?:[ \t]++|[ \t]*+(?:\\?\r?\n[ \t]++)++)\.{_ANY}{_OPENS}"
    rf"|{_INDENTED}(?:\+|\.\.|&){_ANY}{_OPENS}|{_INDENTED}(?:\+|&|\.\.){_ANY}(?=[A-Za-z_$])")
_JOIN_INSIDE = re.compile(rf"{_ANY}(?:\+|\.\.|\.|&)?{_ANY}{_OPENS}|{_ANY}(?:\+|&|\.\.){_ANY}(?=[A-Za-z_$])")
_KEY_SIGN = re.compile(r"[ \t]*[:=]")
#: A call that only decodes or wraps the literal inside it.
_WRAPS = re.compile(r"(?:.*\.)?(?:base64|b64decode|b64encode|decode|encode|unhex|fromhex|bytes|str|string|from|atob|btoa)", re.I)
_CALL = re.compile(rf"\({_ANY}{_OPENS}")
_ENDS_LINE = re.compile(r"[ \t]*[;,]?[ \t]*(?:\r?\n|\Z)")
_BLOCK = re.compile(r"[ \t]*[|>][-+1-9]{0,2}[ \t]*(?:(?<=[ \t])#[^\n]*)?\r?\n")
_KEY_INDENT = re.compile(r"[ \t]*(?:-[ \t]+)*")
_ARMOUR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*$", re.A)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

Span = tuple[int, int]


def signed_lines(text: str) -> Iterator[Span]:
    """The lines with a sign of assignment; no base pattern's assignment lies outside them, and none goes beyond its line."""
    at = 0
    while m := _SIGN.search(text, at):
        start = text.rfind("\n", at, m.start()) + 1 or at
        at = text.find("\n", m.end())
        if at < 0:
            at = len(text)
        yield start, at


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each base pattern, those below the least length dropped."""
    return {
        "assign": [m.span() for line in signed_lines(text) for m in ASSIGN.finditer(text, *line) if len(m[2]) >= ASSIGN_LEAST],
        "access": [m.span() for m in ACCESS.finditer(text)],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def name_weight(name: str) -> float:
    """How sensitive a target is, from its words: `dbPassword`, `API_KEY` and `aws.secret-key` are split into theirs."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:])]
    weight = max((SENSITIVE.get(w, 0.0) for w in words + pairs), default=0.0)
    return max(0.0, weight - sum(DAMPING.get(w, 0.0) for w in words))


class Tally:
    """What the score needs of a value, a kilobyte whatever its length: counts of its code points by their last eight bits, classes, both ends."""

    __slots__ = ("counts", "n", "head", "tail", "dummy", "kinds", "space")

    def __init__(self, value: str = ""):
        points = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32) & 255
        self.counts, self.n = np.bincount(points, minlength=256).astype(np.float32), len(value)
        self.head, self.tail, self.dummy = value[:_EDGE], value[-_EDGE:], PLACEHOLDER.search(value) is not None
        distinct = set(value)
        self.kinds = frozenset(0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in distinct)
        self.space = any(map(str.isspace, distinct))

    def copy(self) -> Tally:
        other = Tally.__new__(Tally)
        other.counts = self.counts.copy()
        other.n, other.head, other.tail, other.dummy, other.kinds, other.space = self.n, self.head, self.tail, self.dummy, self.kinds, self.space
        return other

    def add(self, other: Tally) -> None:
        self.dummy = self.dummy or other.dummy or PLACEHOLDER.search(self.tail + other.head) is not None
        self.head = self.head if self.n >= _EDGE else (self.head + other.head)[:_EDGE]
        self.tail = other.tail if other.n >= _EDGE else (self.tail + other.tail)[-_EDGE:]
        self.n += other.n
        self.counts += other.counts
        self.kinds, self.space = self.kinds | other.kinds, self.space or other.space
        if self.n > 1 << 100:  # `k = k + k` over and over: only the shares matter
            self.counts *= np.float32(2.0 ** -60)
            self.n >>= 60

    def weight(self) -> float:
        if self.n < 6 or self.dummy or self.space:
            return 0.0
        if WRAPPED.fullmatch(self.head + self.tail if self.n > _EDGE else self.head):
            return 0.0
        share = self.counts[self.counts > 0].astype(np.float64)
        share /= share.sum()
        entropy = -float((share * np.log2(share)).sum())
        return min(1.0, 0.25 * (len(self.kinds) - 1) + min(entropy, 4.0) / 8 + min(self.n, 24) / 96)


def literal_weight(value: str) -> float:
    """How much a literal looks like a credential: its length, mix of character classes and entropy; placeholders count nothing."""
    return Tally(value).weight()


def trailing_name(text: str) -> str | None:
    """The longest dotted or dashed name that ends the text; each part of it begins with no digit."""
    run = text[len(text.rstrip(_NAME_CHARS)):]
    best, word_next = None, True
    for piece in reversed(list(_PIECE.finditer(run))):
        word = piece[0] not in ".-"
        if word != word_next:
            break
        if word:
            digits = len(piece[0]) - len(piece[0].lstrip("0123456789"))
            if digits == len(piece[0]):
                break
            best = piece.start() + digits
            if digits:
                break
        word_next = not word
    return None if best is None else run[best:]


def target_of(gap: str) -> str | None:
    """The name that ends what lies before a sign: a quoted one, a name, or a name with a quoted subscript, of any length."""
    gap = gap.rstrip(" \t")
    if gap[-1:] in ('"', "'"):
        body = gap[gap.rfind(gap[-1], 0, -1) + 1:-1]
        return body if len(body) < len(gap) - 1 and _QUOTED.fullmatch(body) else None
    if gap[-2:] in ('"]', "']"):
        opening = gap.rfind(gap[-2], 0, -2)
        if opening < 1 or gap[opening - 1] != "[" or not _SUBSCRIPT.fullmatch(gap, opening + 1, len(gap) - 2):
            return None
        name = trailing_name(gap[:opening - 1])
        return name and f"{name}.{gap[opening + 1:-2]}"
    return trailing_name(gap)


def block_scalar(text: str, at: int, stop: int, column: int) -> Span | None:
    """The lines from `at` that are indented beyond the column of their key, as far as the first one's indent goes."""
    start, end, indent = None, None, column + 1
    while at < stop:
        line_end = text.find("\n", at, stop)
        line_end = stop if line_end < 0 else line_end
        first = _BLANK.match(text, at, line_end).end()
        if first < line_end and text[first] != "\r":
            if first - at < indent:
                break
            if start is None:
                start, indent = first, first - at
            end = line_end - (text[line_end - 1] == "\r")
        at = line_end + 1
    return None if start is None else (start, end)


def flat(value: str) -> str:
    """A value of several lines as it is weighed: without breaks, indents and the frame of a PEM block."""
    return "".join(line for line in map(str.strip, value.split("\n")) if not _ARMOUR.fullmatch(line))


def statements(text: str) -> Iterator[tuple[str, list[tuple[str | None, int, int, str | None, bool]]]]:
    """(target, terms) of each statement; a term is (name or None, start, end, value, quoted), without the value if it has several lines."""
    # What lies inside a value of several lines is lexed too, up to its end; then reading goes on after the statement.
    ends = [(len(text), len(text))]
    at = low = 0
    last_break = text.rfind("\n")
    while True:
        stop = ends[-1][0]
        sign = _SIGN.search(text, at, stop)
        if sign is None:
            if len(ends) == 1:
                return
            at = low = ends.pop()[1]
            continue
        # No sign is part of a target, so none reaches back over the sign before.
        gap, low = text[low:sign.start()], sign.end()
        target, at = target_of(gap), low
        if target is None or sign[0] in ("==", "!="):
            continue
        line = gap[gap.rfind("\n") + 1:]
        if sign[0] == ":" and at <= last_break and (head := _BLOCK.match(text, at, stop)):
            span = block_scalar(text, head.end(), stop, _KEY_INDENT.match(line).end())
            if span:
                yield target, [(None, *span, None, True)]
                ends.append((span[1], span[1]))
                at = low = span[0]
                continue
        opening = _VALUE.match(text, at, stop)
        wrapped, inside = "\n" in text[at:opening.end()], bool(opening["open"])
        join = _JOIN_INSIDE if inside else _JOIN
        at = opening.end()
        terms = []
        while t := _TERM.match(text, at, stop):
            group = t.lastgroup
            value, (start, end) = t[group], t.span(group)
            joint = join.match(text, t.end(), stop)
            if wrapped and not terms and not inside:
                # On the next line a key is no value; a bare word must be all of an indented line, and the target of a colon all of its own.
                if _KEY_SIGN.match(text, t.end(), stop):
                    break
                if group == "bare" and (text[start - 1] not in " \t" or not (joint or _ENDS_LINE.match(text, t.end(), stop))
                                        or sign[0] == ":" and line.strip(" \t\"'-") != target.strip("-")):
                    break
            if group == "bare" and value.endswith(":"):
                break  # a key, never a value
            if group == "bare" and not terms and _WRAPS.fullmatch(value) and (call := _CALL.match(text, t.end(), stop)):
                at, join, inside = call.end(), _JOIN_INSIDE, True
                continue
            if group == "bare" and text[t.end():t.end() + 1] == "(" and _NAME.match(value):
                break  # any other call
            at = t.end()
            bare_name = group == "bare" and _NAME.match(value) is not None
            terms.append((value if bare_name else None, start, end, None if "\n" in value else value, group != "bare"))
            if joint is None:
                break
            at = joint.end()
        if terms:
            yield target, terms
            if len(terms) == 1 and not terms[0][4]:
                at = terms[0][1]  # a bare word may itself be the target of the next sign, as in `a = b = "c"`
            elif long := [t for t in terms if t[3] is None]:
                ends.append((long[-1][2], at))
                at = low = long[0][1]
        else:
            at = low


class Value:
    """What a name holds: spans and other values, told at most once; the score is kept by the names, not by the parts."""

    __slots__ = ("parts", "told")

    def __init__(self, parts: list[Span | Value]):
        self.parts, self.told = parts, False

    def tell(self, found: set[Span]) -> None:
        rest = [self]
        while rest:
            value = rest.pop()
            if not value.told:
                value.told = True
                found.update(p for p in value.parts if isinstance(p, tuple))
                rest += [p for p in value.parts if isinstance(p, Value)]


#: Code points between a name and its value, as in `- name: DB_PWD`, `value: "..."`.
NEAR = 200


def with_next(items: Iterator) -> Iterator:
    """Each item with the one after it, None after the last."""
    before = next(items, None)
    for item in items:
        yield before, item
        before = item
    if before is not None:
        yield before, None


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive target, directly or through names, in order of their place."""
    held: dict[str, tuple[Value, Tally | str | Span]] = {}
    found: set[Span] = set()

    def counted(said: Tally | str | Span) -> Tally:
        """A value of several lines is held by its place, so that values inside values take no space of their own."""
        return said if isinstance(said, Tally) else Tally(said if isinstance(said, str) else flat(text[slice(*said)]))

    label = None  # the name that a `name: ...` or `key="..."` gives to the `value` after it
    for (target, terms), after in with_next(statements(text)):
        names, label = label, None
        if target.lower() in ("name", "key") and after and after[0].lower() == "value" and len(terms) == 1 and terms[0][3]:
            if after[1][0][1] - terms[0][2] <= NEAR:
                label = terms[0][3]
                continue
        parts, tallies, quoted = [], [], False
        for name, start, end, literal, is_quoted in terms:
            known = held.get(name) if name else None
            if known:
                parts.append(known[0])
                tallies.append(known[1])
                quoted = True
            elif name is None or len(terms) == 1:  # an unknown name inside a sum tells nothing
                quoted = quoted or is_quoted
                tallies.append((start, end) if literal is None else literal)
                if end > start:
                    parts.append((start, end))
        # One part is kept as it is, and counted when a sensitive name is reached; sums are counted at once.
        tally = tallies[0] if len(tallies) == 1 else ""
        if len(tallies) > 1:
            tally = tallies[0].copy() if isinstance(tallies[0], Tally) else counted(tallies[0])
            for t in tallies[1:]:
                tally.add(counted(t))
        value = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else Value(parts)
        held[target] = held[target.rpartition(".")[2]] = (value, tally)
        weight = name_weight(names if names and target.lower() == "value" else target)
        if weight:
            looks = counted(tally).weight()
            if looks and weight * (0.45 + 0.55 * quoted) * 0.5 + looks * 0.5 * (weight > 0.3) >= THRESHOLD:
                value.tell(found)
    return sorted(found)


def scan_text(text: str) -> dict[str, list[Span]]:
    """Spans of every kind; literals that a base span already covers are not repeated."""
    spans = base_spans(text)
    covered = sorted(s for kind in ("assign", "access", "hex") for s in spans[kind])
    extra, i, reach = [], 0, -1
    for start, end in literal_spans(text):
        while i < len(covered) and covered[i][0] <= start:
            reach = max(reach, covered[i][1])
            i += 1
        if end > reach:
            extra.append((start, end))
    return spans | {"literal": extra}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and `found`, an array of (kind, start, end) ordered by start, then kind."""
    thin = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    order = {k: i for i, k in enumerate(KINDS)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts(batch):
                rows = [(s, order[k], e, k) for k, spans in scan_text(text).items() for s, e in spans]
                found.append([{"kind": k, "start": s, "end": e} for s, _, e, k in sorted(rows)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    id_type = thin.schema["doc_id"].dataType.simpleString()
    return thin.mapInArrow(scan, f"doc_id {id_type}, found array<struct<kind:string,start:bigint,end:bigint>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
