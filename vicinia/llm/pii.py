"""Personal data, with offset-preserving deobfuscation.

Base spans come from plain patterns over the text as it is. Transducers then
rewrite the disguised stretches only, one after another: homoglyphs, wide and
circled forms and the digits of all scripts become ASCII, "at"/"dot" disguises become
@ and . , spelled digits become digits. Each keeps what it replaced as runs of
shifted offsets, so identifiers found in the rewritten text map back, transducer by
transducer, to spans of the source. Spans that overlap a base span of their kind are
left out; base spans stay.

All offsets are code points, ends exclusive. Nulls and edges: a null text counts
as empty, without spans; the work grows with a text's length and with its matches,
not with their square, and what is held besides the text with what is rewritten;
null doc_ids and repeated rows pass; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches: a local part ends at its @, so each @ decides alone and no start is tried twice."""
    out, bound, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > bound and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        bound = m.end() if m else at + 1
        at = text.find("@", bound)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABEKMHOPCTXaeopcyxijsdhABEZHIKMNOPTYXoa", strict=True))
#: Digits as words, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: Three spelled digits or more in a row: fewer are ordinary words,
SPELLED = re.compile(rf"(?<!\w)(?:(?:{_DIGIT})(?!\w)(?:[ ,.-]{{1,2}}(?=\w))?){{3,}}", re.I)
#: but for those that stand between digits.
BETWEEN = re.compile(rf"(?<=[0-9])[ ,.-]{{1,2}}((?:{_DIGIT})(?:[ ,.-]{{1,2}}(?:{_DIGIT}))*)(?=[ ,.-]{{1,2}}[0-9])", re.I)
ONE_DIGIT = re.compile(rf"(?:{_DIGIT})(?!\w)|[ ,.-]+", re.I)
#: " at ", "[at]", "(at)" and the like, and the same for dot; between word characters.
AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\s{0,2}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,2}|\sat\s)(?=[A-Za-z0-9])", re.I)
DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\s{0,2}[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s{0,2}|\sdot\s)(?=[A-Za-z0-9])", re.I)
#: What stands before and after an " at ".
LOCAL, LABEL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z"), re.compile(r"[A-Za-z0-9-]+")
#: English words that stand before an " at ", or before a full stop behind one, in prose that names no mailbox.
COMMON = frozenset(
    "a about aimed all am an and any are arrive arrived as available away back based be began begin best but buy call came can check click close closed come comes do dinner done down due early eat else end ended ends error "
    "every find first for found from go going good goods had half happened has have he held her here him his home hosted house i in is it its join just keep last late least leave leaves left lies line listed listen live lived long look "
    "looked looking lunch many me meet meeting met midnight more most much night no noon not now of off on once one online only open opened opens or order our out over page parked play posted price prices priced read ready "
    "register right sale school see seen sell shop site sits sitting sold stand stands start started starts stay stayed still stood stop stopped store sun that the their them there these they thing things this those time times to today "
    "together tomorrow tonight two up us valued version versions visit visited was we web website well went were what when where which while who will with work worked working works yesterday you your".split()
)
#: What file names end in.
FILES = frozenset("txt md csv json xml yaml yml html htm pdf doc png jpg jpeg gif py js ts java cpp hpp exe log sh zip tar gz".split())
#: A disguise is looked for only where one of these shows; whatever is rewritten into an identifier has one of them, so
#: that what is found of a stretch does not depend on the text elsewhere. An " at " counts before a domain only.
HINT = re.compile(
    rf"[\[({{<]\s?(?:at|@|dot|punkt|point|punto|\.)\s?[\])}}>]|\s(?:dot\s|at\s[a-z0-9][a-z0-9-]*\.[a-z0-9-])"
    rf"|(?<!\w)(?:{_DIGIT})[ ,.-]{{1,2}}(?:{_DIGIT})(?!\w)|(?<=[0-9])[ ,.-]{{1,2}}(?:{_DIGIT})[ ,.-]", re.I
)
INVISIBLE = frozenset("\u200b\u200c\u200d\u2060\ufeff")


def plain(c: str) -> str:
    """The ASCII that a character stands for, or the character; nothing for an invisible one."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "\u2010" <= c <= "\u2015":
        return "-"
    if (digit := unicodedata.digit(c, None)) is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() else c


@cache
def foreign() -> re.Pattern:
    """Every character beyond ASCII that stands for some of it; by the Unicode tables at hand."""
    ranges, last = [], -1
    for code in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= code < 0xE000 and plain(chr(code)) != chr(code):
            if code != last + 1 or not ranges:
                ranges.append([code, code])
            ranges[-1][1] = last = code
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


class Rewriting:
    """A text, and what it becomes when each of `edits` (start, end, what comes instead), in order, is made."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, done, shift = [], 0, 0
        self.old, self.new = [], []  # spans of what was replaced, and of what came instead
        for a, b, by in edits:
            parts += [text[done:a], by]
            self.old.append((a, b))
            self.new.append((a + shift, a + shift + len(by)))
            shift += len(by) - (b - a)
            done = b
        self.text = "".join([*parts, text[done:]])
        self.starts = [a for a, _ in self.new]

    def source(self, start: int, end: int) -> Span:
        """The span that the characters from `start` to `end` stand for; of what came instead, any part stands for all."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        if i >= 0:
            start = self.old[i][0] if start < self.new[i][1] else self.old[i][1] + start - self.new[i][1]
        if j >= 0:
            end = self.old[j][1] if end <= self.new[j][1] else self.old[j][1] + end - self.new[j][1]
        return start, end


def matches(pattern: re.Pattern, text: str, by) -> list[tuple[int, int, str]]:
    return [(*m.span(), by(m[0])) for m in pattern.finditer(text)]


def names_mailbox(text: str, start: int, end: int) -> bool:
    """Whether what stands before and after the plain " at " from `start` to `end` can be a mailbox and its host: the host ends
    in a label of two letters or more, and where its dots are not disguised, neither side is a number or a common word, and
    the label is in one case and not that of a file."""
    local = LOCAL.search(text, max(0, start - 64), start)
    if local is None or not any(c.isalpha() for c in local[0]):
        return False
    labels, hidden, at = [], False, end
    while label := LABEL.match(text, at):
        labels.append(label[0])
        at = label.end()
        if text[at : at + 1] == "." and LABEL.match(text, at + 1):
            at += 1
        elif dot := DOT.match(text, at):
            hidden, at = True, dot.end()
        else:
            break
    tops = [x for x in labels[1:] if x.isalpha() and len(x) > 1]
    if hidden or not tops:
        return bool(tops)
    if local[0].lower() in COMMON or labels[0].isdigit() or any(x.lower() in COMMON or x.lower() in DIGIT_WORDS for x in labels[:2]):
        return False
    return any((x.islower() or x.isupper()) and x.lower() not in FILES for x in tops)


def at_signs(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "@") for m in AT.finditer(text) if not m[0].strip().isalpha() or names_mailbox(text, *m.span())]


def spelled(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits, word by word, so each digit keeps its own word's span; the separators between them go."""
    runs = [m.span() for m in SPELLED.finditer(text)]
    ends = [b for _, b in runs]
    for m in BETWEEN.finditer(text):
        a, b = m.span(1)
        i = bisect_right(ends, a)  # the first run that ends beyond it
        if i == len(ends) or runs[i][0] >= b:
            runs.append((a, b))
    edits = []
    for a, b in sorted(runs):
        for m in ONE_DIGIT.finditer(text, a, b):
            if digit := DIGIT_WORDS.get(m[0].lower()):
                edits.append((*m.span(), digit))
            elif m.end() == b:  # what follows the last digit is not a separator of digits
                break
            else:
                edits.append((*m.span(), ""))
    return edits


#: The transducers, in order: each gives the edits of a text.
TRANSDUCERS = (
    lambda text: [] if text.isascii() else matches(foreign(), text, plain),
    at_signs,  # before the dots, while it shows which of them are disguised
    lambda text: matches(DOT, text, lambda m: "."),
    spelled,
)


def rewritten(text: str) -> list[Rewriting]:
    """What the transducers do to `text`, one after another; none where it has no disguises."""
    edits = TRANSDUCERS[0](text)
    if not edits and not HINT.search(text):
        return []
    done = [Rewriting(text, edits)] if edits else []
    for edits_of in TRANSDUCERS[1:]:
        now = done[-1].text if done else text
        if edits := edits_of(now):
            done.append(Rewriting(now, edits))
    return done


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: FIND[kind](text) for kind in KINDS}


def all_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """The base spans, and those of disguised identifiers that overlap none of their kind."""
    out = {kind: list(spans) for kind, spans in base.items()}
    if not (done := rewritten(text)):
        return out
    new = done[-1].text
    for kind in KINDS:
        ends = [b for _, b in base[kind]]
        for a, b in FIND[kind](new):
            start, end = a, b
            for step in reversed(done):
                start, end = step.source(start, end)
            i = bisect_right(ends, start)  # the first base span that ends beyond the start
            if (i == len(ends) or end <= base[kind][i][0]) and text[start:end] != new[a:b]:
                out[kind].append((start, end))
        out[kind].sort()
    return out


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of `docs`; the numbers count base spans."""

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text in part["text"]:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                rows.append([*(len(base[k]) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(text, base))])
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInPandas(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(text: str) -> str:
    """`text` with every span replaced by its kind in brackets."""
    spans = sorted((a, b, k) for k, own in all_spans(text, base_spans(text)).items() for a, b in own)
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join([*out, text[done:]])
