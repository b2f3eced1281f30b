"""Operator 3: secrets in texts, by patterns and by assignment-aware lexing.

Three patterns give the base spans: assign, access and hex. The lexer then reads source and configuration syntax around
each = and : into pairs of a name and a value. A value is a chain of string literals, bare words and names joined by
+ or by standing next to each other, in brackets over several lines with comments between them; or it is a block of lines: a
triple-quoted string, a shell document (<<TAG) or the deeper lines after key: | or key: >. Assignments in comments count, as they give secrets away too. Names that were given constant values earlier in the text stand for
those values, so password = part1 + part2 leads back to both literals, also without blanks and as $part1, ${part1} or $(part1). A
value refers to the constants in it and holds a digest of the whole literal, so constants made of constants stay small however many
parts they have. A new value replaces the old one; = without a value that can be read ends it. The words of the target name and the
form of the whole literal give a score; from LEAST up every literal that went into the value is a span of kind lexed, unless a base span
covers it.

Cases: null or empty texts have no spans; offsets are code points, ends exclusive; every row is searched for itself, so repeated
rows and null ids change nothing; spans with one start are in the order of their kinds; a very long text is read once, in steps that grow
with its length (no pattern may go back into what it has read, and comments in brackets are read once); an assignment within a bracket whose
parts have been read is part of it; an empty table gives an empty one; other columns are left out of the result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import slices, texts

KINDS = ("assign", "access", "hex", "lexed")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a shorter run can't hold a match that counts
HEX = re.compile(r"[0-9a-f]{24,}")

OPERATOR = re.compile(r"(?<![=!<>:+\-*/~^|&%])(?::=|=>|=(?![=~])|:(?![:/=]))")
VALUE = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|(\$\{\w+\}|\$\(\w+\)|[A-Za-z0-9_$][\w.+/=$-]*))""", re.ASCII)
JOIN = re.compile(r"[ \t]*(?:\+|\.\.|\\\n)?[ \t]*")
#: After a name with $, a single point joins too, as in PHP.
JOIN_NAMES = re.compile(r"[ \t]*(?:\+|\.\.?|\\\n)?[ \t]*")
#: In brackets, lines may end and comments may stand between the parts: what lies before a comment, and what lies from it on.
GAP = re.compile(r"(?:[\s+]++|\.\.)*+")
COMMENTS = re.compile(r"(?:(?:#|//)[^\n]*+(?:[\s+]++|\.\.)*+)*+")
BRACKET = re.compile(r"[ \t]*+\(")
PART = frozenset("\"'_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
FENCE = re.compile(r"""[ \t]*("{3}|'{3})""")
#: A shell or configuration document: the rest of the line, then lines up to one that holds the tag alone.
HEREDOC = re.compile(r"""[ \t]*+(?:\$\([ \t]*+cat[ \t]*+)?<<[-~]?[ \t]*+["']?([A-Za-z_]\w*+)""", re.ASCII)
#: Fences, and lines that hold nothing but a name, brackets and semicolons.
CLOSE = re.compile(r"""("{3}|'{3})|^[ \t]*+([A-Za-z_]\w*+)[ \t]*+[);]*+[ \t]*+$""", re.ASCII | re.M)
#: A block of deeper lines after a key.
BLOCK = re.compile(r"[ \t]*+[|>][-+0-9]{0,2}[ \t]*+(?=[#\n])")
LINE = re.compile(r"[^\n]+")
OPERAND = re.compile(r"\$?(?:(?!\.\$)[^+$])+")
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
STRONG = frozenset(("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "credential", "credentials", "auth", "bearer"))
WEAK = frozenset(("key", "pass", "pin", "salt", "cert", "private", "access", "signature", "session"))
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|your.*|.*example.*|changeme|todo|placeholder|test|dummy)$|\$\{|\{\{|^<|^%")
LEAST = 4.0
#: Distinct characters that a digest counts; a literal that holds more is varied whatever their shares.
COUNTS = 512
#: What a digest keeps of both ends, and what is sought in any place or at the start of a literal that is longer than that.
HEAD, EDGE = 16, 6
ANYWHERE, START = re.compile(r"(?i)example|\$\{|\{\{"), re.compile(r"(?i)your|<|%")
FORMS = (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum(), str.isspace)

Span = tuple[int, int, int, float]  # kind, start, end, score


class Value:
    """A literal that may consist of parts: its own spans, the constants it uses, and a digest of the whole."""

    __slots__ = ("spans", "uses", "length", "counts", "many", "head", "tail", "odd", "forms", "given")

    def __init__(self):
        self.spans: list[tuple[int, int]] = []
        self.uses: list[Value] = []
        self.length, self.counts, self.many, self.head, self.tail, self.odd, self.forms, self.given = 0, Counter(), False, "", "", False, 0, 0.0

    def digest(self, length: int, counts: Counter, many: bool, head: str, tail: str, odd: bool, forms: int) -> None:
        self.forms |= forms
        self.odd = self.odd or odd or bool(ANYWHERE.search(self.tail + head))
        if len(self.head) < HEAD:
            self.head = (self.head + head)[:HEAD]
        self.tail = (self.tail + tail)[-EDGE:]
        self.length += length
        self.many = self.many or many
        if not self.many:
            self.counts.update(counts)
            self.many = len(self.counts) > COUNTS
        if self.many:
            self.counts = Counter()

    def write(self, start: int, end: int, text: str) -> None:
        self.spans.append((start, end))
        counts = Counter(text)
        forms = sum(any(map(f, counts)) << i for i, f in enumerate(FORMS))
        self.digest(len(text), counts, False, text[:HEAD], text[-EDGE:], bool(ANYWHERE.search(text)), forms)

    def use(self, other: Value) -> None:
        self.uses.append(other)
        self.digest(other.length, other.counts, other.many, other.head, other.tail, other.odd, other.forms)

    def placeholder(self) -> bool:
        if self.odd or self.length <= HEAD:
            return self.odd or bool(PLACEHOLDER.search(self.head))
        return bool(START.match(self.head)) or not self.many and any(self.counts.keys() <= same for same in ({"x", "X"}, {"*"}, {"."}))

    def give(self, score: float, found: dict[tuple[int, int], float]) -> None:
        """All spans of the value and of what it uses get the score; what has it or a higher one is passed over."""
        todo = [self]
        while todo:
            value = todo.pop()
            if value.given < score:
                value.given = score
                found.update({x: max(score, found.get(x, 0)) for x in value.spans if x[1] > x[0]})
                todo += value.uses


def entropy(counts: Counter, length: int) -> float:
    return -sum(p * math.log2(p) for n in counts.values() if (p := n / length))


def name_weight(name: str) -> float:
    words = [w.lower() for w in PARTS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:])} | set(words)
    return 2.0 if joined & STRONG else 1.0 if joined & WEAK else 0.0


def score(name: str, literal: Value) -> float:
    """Of a literal given to a name; 0 where the name isn't sensitive."""
    weight = name_weight(name)
    if not weight or literal.length < 6 or literal.placeholder():
        return 0.0
    kinds, space = (literal.forms & 15).bit_count(), literal.forms >> 4
    return weight + (literal.length >= 8) + (literal.length >= 20) + (kinds >= 2) + (literal.many or entropy(literal.counts, literal.length) >= 3.0) - 3.0 * space


def base(text: str) -> list[Span]:
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(0, *m.span(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span(), 1.0) for m in ACCESS.finditer(text)]
    return found + [(2, *m.span(), 1.0) for m in HEX.finditer(text)]


def target(text: str, at: int) -> str:
    """The name that ends before an operator: quotes, brackets and blanks between them are skipped."""
    end = at
    while end and text[end - 1] in " \t\"']":
        end -= 1
    start = end
    while start and text[start - 1] in NAME:
        start -= 1
    return text[start:end]


def operands(word: str, constants: dict[str, Value]) -> list[tuple[int, int, Value | None]]:
    """What a bare word consists of: itself, or its parts at + and $ with the constants they name, if they name any."""
    if word not in constants:
        each = [(*o.span(), constants.get(o[0].strip("${}()"))) for o in OPERAND.finditer(word)]
        if any(known for _, _, known in each):
            return each
    return [(0, len(word), constants.get(word))]


class Blocks:
    """Literals of several lines. Where they may end is listed once for a text, so what has no end isn't sought again and again."""

    def __init__(self, text: str):
        self.text = text
        self.ends: dict[str, list[tuple[int, int]]] | None = None
        self.line = (0, -1)  # a line that a place was found in: its start and where the next one starts

    def next_line(self, at: int) -> int:
        """Where the line of a place ends, its \\n included, or 0 if nothing ends it. Places only grow, so each line is sought once."""
        if not self.line[0] <= at < self.line[1]:
            end = self.text.find("\n", at) + 1
            self.line = (at, end or len(self.text) + 1)
        return self.line[1] if self.line[1] <= len(self.text) else 0

    def close(self, what: str, at: int) -> tuple[int, int] | None:
        """The first fence, or line that holds the tag alone, from at on."""
        if self.ends is None:
            self.ends = {}
            for m in CLOSE.finditer(self.text):
                self.ends.setdefault(m[1] or m[2], []).append(m.span())
        own = self.ends.get(what, [])
        i = bisect_left(own, (at, 0))
        return own[i] if i < len(own) else None

    def at(self, place: int, colon: bool) -> tuple[int, int, int] | None:
        """Where a block that opens at place begins and ends, and where reading goes on."""
        text = self.text
        if m := FENCE.match(text, place):
            end = self.close(m[1], m.end())
            return (m.end(), *end) if end else None
        if (m := HEREDOC.match(text, place)) and (first := self.next_line(m.end())):
            end = self.close(m[1], first)
            return (first, *end) if end else None
        if colon and (m := BLOCK.match(text, place)) and (first := self.next_line(m.end())):
            line = text.rfind("\n", 0, place) + 1
            depth = len(text[line:place]) - len(text[line:place].lstrip(" -"))
            end = first
            while end < len(text):
                stop = text.find("\n", end) + 1 or len(text)
                own = text[end:stop]
                if own.strip() and len(own) - len(own.lstrip(" ")) <= depth:
                    break
                end = stop
            return first, end, end
        return None


class Gaps:
    """What lies between the parts in a bracket. A run of comments is read once, wherever in it one asks again."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, 0, 0

    def after(self, at: int) -> int:
        """The place after blanks, line ends, joining signs and comments."""
        at = GAP.match(self.text, at).end()
        if self.start <= at < self.end:
            return self.end if self.text.startswith(("#", "//"), at) else at
        if (end := COMMENTS.match(self.text, at).end()) > at:
            self.start, self.end = at, end
        return end


def lexed(text: str) -> list[Span]:
    """Literals that reach a sensitive name, through constants if need be."""
    constants: dict[str, Value] = {}
    found: dict[tuple[int, int], float] = {}
    done = 0
    blocks, gaps = Blocks(text), Gaps(text)
    for m in OPERATOR.finditer(text):
        if m.start() < done or not (name := target(text, m.start())):
            continue
        value, end, at, n = Value(), m.end(), m.end(), 0
        if block := blocks.at(at, m[0] == ":"):
            for x in LINE.finditer(text, *block[:2]):
                own = x[0].strip()
                if own:
                    first = x.start() + x[0].index(own)
                    value.write(first, first + len(own), own)
                    n += 1
            at = end = block[2]
        bracket = None if block else BRACKET.match(text, at)
        if bracket:
            first = gaps.after(bracket.end())
            at, bracket = (first, bracket) if text[first : first + 1] in PART else (at, None)
        while not block and (v := VALUE.match(text, at)):
            group, first, at = v.lastindex, v.start(v.lastindex), v.end()
            parts = operands(v[3], constants) if group == 3 else [(0, len(v[group]), None)]
            more = True
            for a, b, known in parts:
                part = v[group][a:b]
                if known:
                    value.use(known)
                    end = v.end() if bracket else m.end()
                elif group != 3 or not bracket and not part.startswith(("${", "$(")) and (n == 0 or re.search(r"[0-9]", part)):
                    value.write(first + a, first + b, part)
                    end = first + b
                else:
                    more = False
                    break
                n += 1
            if not more:
                break
            names = group == 3 and parts[-1][2] is not None
            marked = names and "$" in v[3]
            if bracket:
                at = gaps.after(at)
                continue
            j = (JOIN_NAMES if marked else JOIN).match(text, at)
            if group == 3 and not (j[0].strip() or (names and v[3].endswith("+")) or (marked and not j[0])):
                break  # bare words are joined by an operator, or names with $ by standing together
            at = j.end()
        if not n:
            if m[0] != ":":
                constants.pop(name, None)  # what it holds now can't be read
            continue
        done = max(m.end(), end)
        constants[name] = value
        s = score(name, value)
        if s >= LEAST:
            value.give(s, found)
    return [(3, a, b, s) for (a, b), s in found.items()]


def spans(text: str) -> list[Span]:
    """All spans by start, then by kind; lexed ones only where no base span covers them."""
    own = base(text)
    if "=" in text or ":" in text:
        starts, reach, most = [], [], 0
        for _, a, b, _ in sorted(own, key=lambda x: x[1]):
            most = max(most, b)
            starts.append(a)
            reach.append(most)  # the furthest end of what starts here or before

        def covered(x: Span) -> bool:
            i = bisect_right(starts, x[1])
            return i > 0 and reach[i - 1] >= x[2]

        own += [x for x in lexed(text) if not covered(x)]
    return sorted(own, key=lambda x: (x[1], x[0], x[2]))


KIND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and secrets: array of kind, start, end and score, for every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            each = [[{"kind": KINDS[k], "start": a, "end": e, "score": s} for k, a, e, s in spans(t)] for t in texts(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(each, pa.list_(KIND))], names=["doc_id", "secrets"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, secrets array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def query(docs: DataFrame) -> DataFrame:
    joined = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    own = F.filter("secrets", lambda s: s["kind"] != "lexed")
    return find(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
