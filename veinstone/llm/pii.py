"""Personal data in texts, also where it is disguised, with offsets into the text as it is.

Two passes over each whole text.  The plain pass finds identifiers as they stand.  The second
pass finds disguises: three transducers, one after the other, rewrite the whole text.  The first
replaces single characters (full-width, Cyrillic and Greek look-alikes, digits of other scripts,
characters without width), the second at and dot in words or brackets, the third spelled digits and
plus.  Each emits edits, (source span, output, core of the source span), and copies the rest, so an
offset of its output is mapped back by a search among its edits.  The same detectors run over the
rewritten text, and what they find is mapped back through all three.  A span is added where no plain
span of its kind overlaps it, or where it holds those that do and reaches beyond them by a replaced
character or a bracketed word, as in an address of which a look-alike hides the head.  A text in which
no transducer has an edit is not read again.

Words that are also prose need more than words in brackets: a bare at is rewritten only where spelled dots
follow that end, with a known top-level domain, at the end of a clause.

Every pass is linear in the text.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++").match
# a run of digits that fails at its start fails at all its digits: only its start is tried
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Every match has one ``@``: the local part is what may stand before it, back to the match
    before; so each ``@`` is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN(text, at + 1)):
            yield ("email", start, m.end())
            done = m.end()
        else:
            done = max(done, at + 1)  # no local part reaches over an @
        at = text.find("@", max(done, at + 1))


def plain(text: str) -> list[Span]:
    """The identifiers that stand in a text as they are, by start and then kind."""
    found: list[Span] = []
    if "@" in text:
        found += emails(text)
    for m in _IP(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD(text):
        a, b = m.span()
        if b - a >= 14 and b - a <= 40:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                found.append(("card", a, b))
    if "+" in text:
        for m in _PHONE(text):
            if 10 <= len(_digits(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like Latin ones, and the words of the disguises.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2024": ".", "\u3002": ".", "\u00a0": " ", "\u2009": " ", "\u202f": " ",
}
# What a spelled-out domain may end in: generic names, and country codes.
TOP_LEVEL = frozenset(["com", "org", "net", "edu", "gov", "info", "biz", "name", "dev", "app"]) | frozenset(
    "ae ar at au be bg br ca ch ci cl cn co cy cz de dk ee eg es eu fi fr gb gr hk hr hu id ie il in io ir is it jp ke kr lt lu lv ma me mx my ng nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tv tw ua uk us uy vn za".split()
)
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_FOLDED = str.maketrans("\u0131\u017f", "is")  # letters that patterns without case take for i and s
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


@lru_cache(maxsize=4096)
def _plain_char(c: str) -> str:
    """What a character is rewritten to; itself where nothing is known."""
    if c < "\x80":
        return c
    if c in ZERO_WIDTH:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return c


#: Every character that the character transducer changes: those listed, and all decimals but ASCII's.
_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES) + ZERO_WIDTH) + "！-～" + "".join(f"{chr(c)}-{chr(c + 9)}" for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) == 0) + "]")
#: An edit: the source span, what it is replaced by, and the span that the output stands for.
Edit = tuple[int, int, str, int, int]

_NUMERAL = "|".join(DIGIT_WORDS)
_BRACKETED = "|".join(rf"{re.escape(a)}\s*(?:{{0}})\s*{re.escape(b)}" for a, b in ("()", "[]", "{}", "<>"))
# a run of white space is tried from its start only
_CONNECTOR = re.compile(rf"(?:(?<!\s)\s++)?(?:{_BRACKETED.replace('{0}', 'at|dot')})\s*|(?<!\s)\s++(?:at|dot)\s+", re.I)
_IN_BRACKETS = re.compile(_BRACKETED.replace("{0}", "at|dot"), re.I)
#: What may stand behind a domain that ends a clause.
_CLAUSE_ENDS = re.compile(r"[^\S\n]*(?:[\n.,;:!?)\]}>\"'\u2019\u201d]|\Z)").match
_CORE = re.compile(r"\S(?:.*\S)?", re.S).search
_LABELS = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)*+", re.I)
_NUMBER = re.compile(rf"(?:{_NUMERAL}|[0-9]+)\b", re.I)
_ENDS_IN_NUMBER = re.compile(rf"(?:\b(?:{_NUMERAL})|[0-9])\Z", re.I)
_SPELLED = re.compile(rf"\b(?:plus\s+(?=(?:{_NUMERAL}|[0-9]+)\b)|(?:{_NUMERAL})\b(?:[\s,]+(?=(?:{_NUMERAL}|[0-9]+)\b))?)", re.I)
_WORD = re.compile(r"[a-z\u0131\u017f]+", re.I)


def characters(text: str) -> list[Edit]:
    """Edits of single characters."""
    if text.isascii():
        return []
    return [(m.start(), m.end(), _plain_char(m.group()), m.start(), m.end()) for m in _ODD.finditer(text)]


def connectors(text: str) -> list[Edit]:
    """Edits of spelled at and dot.

    In brackets they are always rewritten.  A bare dot is rewritten where labels and dots lead on to
    a top-level domain, or between numbers; a bare at where a label, a spelled dot and such a domain
    follow, with which the clause ends.  The text is read from right to left: whether a domain follows a
    connector depends on the labels behind it and, if they end at another connector, on that one.
    """
    found = [m.span() for m in _CONNECTOR.finditer(text)]
    out: list[Edit] = []
    next_start, next_dot, next_leads, next_closes = -1, False, False, False
    for a, b in reversed(found):
        core = _CORE(text, a, b)
        said = core.group()
        dot, bare = "o" in said.lower(), said[0] not in "([{<"
        labels = _LABELS.match(text, b)
        end = labels.end() if labels else b
        on = labels is not None and end == next_start and next_dot
        names = labels.group().lower().split(".") if labels else [""]
        leads = any(x in TOP_LEVEL for x in names) or on and next_leads
        closes = next_closes if on else names[-1] in TOP_LEVEL and _CLAUSE_ENDS(text, end) is not None
        if not bare:
            take = True
        elif dot:
            take = leads or _NUMBER.match(text, b) is not None and _ENDS_IN_NUMBER.search(text, max(0, a - 8), a) is not None
        else:
            take = on and closes and len(names) == 1
        if take:
            out.append((a, b, "." if dot else "@", core.start(), core.end()))
        next_start, next_dot, next_leads, next_closes = a, dot, leads, closes
    return out[::-1]


def numerals(text: str) -> list[Edit]:
    """Edits of spelled digits, with the space before a next digit, and of plus before a digit."""
    out = []
    for m in _SPELLED.finditer(text):
        word = _WORD.match(text, m.start())
        said = word.group().lower().translate(_FOLDED)
        out.append((m.start(), m.end(), DIGIT_WORDS.get(said, "+"), *word.span()))
    return out


class Rewritten:
    """The output of a transducer, and where it comes from."""

    def __init__(self, text: str, edits: list[Edit]):
        parts, done, size = [], 0, 0
        self.at: list[int] = []  # where the output of every edit starts
        self.ends: list[int] = []
        self.edits = edits
        for a, b, new, _, _ in edits:
            parts += [text[done:a], new]
            size += a - done
            self.at.append(size)
            size += len(new)
            self.ends.append(size)
            done = b
        parts.append(text[done:])
        self.text = "".join(parts)

    def _origin(self, i: int) -> tuple[int, int]:
        """The source span of one character of the output."""
        k = bisect_right(self.at, i) - 1
        if k < 0:
            return i, i + 1
        if i < self.ends[k]:
            return self.edits[k][3], self.edits[k][4]
        a = self.edits[k][1] + i - self.ends[k]
        return a, a + 1

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self._origin(a)[0], self._origin(b - 1)[1]


def disguised(text: str) -> list[Span]:
    """What the detectors find after rewriting, as spans of the source; nothing if nothing is rewritten."""
    steps = []
    for transducer in (characters, connectors, numerals):
        if edits := transducer(text):
            steps.append(Rewritten(text, edits))
            text = steps[-1].text
    if not steps:
        return []
    found = []
    for kind, a, b in plain(text):
        for step in reversed(steps):
            a, b = step.source(a, b)
        found.append((kind, a, b))
    return found


def _reaches_beyond(text: str, a: int, b: int, starts: list[int], ends: list[int]) -> bool:
    """Whether a disguised span adds something to plain spans of its kind, which don't overlap each other."""
    first, last = bisect_right(ends, a), bisect_right(starts, b - 1) - 1
    if first > last:
        return True
    if starts[first] < a or ends[last] > b:
        return False
    beyond = text[a : starts[first]], text[ends[last] : b]
    return any(_ODD.search(x) or _IN_BRACKETS.search(x) for x in beyond)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: the plain ones and disguised ones that overlap none of their kind or hold them and more."""
    base = plain(text)
    places = {k: ([s for kind, s, _ in base if kind == k], [e for kind, _, e in base if kind == k]) for k in KINDS}
    more = [(kind, a, b) for kind, a, b in disguised(text) if _reaches_beyond(text, a, b, *places[kind])]
    return base, sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, spans`` for every row: arrays of (kind, start, end).

    A map over partitions without a shuffle.  Null and empty texts have no spans, very long ones are
    read whole; repeated rows and null ids stay; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t.as_py() or "") for t in batch.column(1)]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, base {spans}, spans {spans}")


def digest(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Counts of the plain spans by kind, their digest, and all spans as text."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(id_col), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
