"""Personal data with offset-preserving deobfuscation.

Base identifiers are found in the source text itself.  Then transducers rewrite
the text -- look-alike characters to ASCII, words for at and dot signs, spelled
digits -- and keep where every written character came from; the same detectors
run over the result, and spans that involve a rewritten place are mapped back
to source characters.  Base spans always stay; spans found by rewriting are
added where they overlap no base span of their kind.

Offsets count code points, ends are exclusive.  Every detector is linear in the
text, also for very long runs of digits or of one character.

Defined results: null and empty texts have no spans; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

KINDS = ("email", "ip", "card", "phone")

# Look-alikes of ASCII letters, in order of their code points.
LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹫": "@",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
#: Full-width forms and decimal digits of other scripts follow a rule.
LOOKALIKES |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
LOOKALIKES |= {chr(zero + d): str(d) for zero in (0x660, 0x6F0, 0x966, 0x9E6, 0xE50) for d in range(10)}
LOOKALIKE = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")

# English, German, French and Spanish words for digits, from zero on, and for plus.
DIGITS = {
    word: str(d)
    for d, words in enumerate(["zero oh null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"])
    for word in words.split()
}
#: English words for ten to nineteen, and for the tens from twenty on.
TEENS = {w: str(10 + k) for k, w in enumerate("ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
TENS = {w: str(2 + k) for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split())}
PLUS = ("plus", "más", "mas")
# Words for the at sign and the dot; a bare English at goes with the first dots only, as others are words of English sentences.
AT, OTHER_AT, DOT, OTHER_DOT = ("at",), ("ät", "arroba", "arobase"), ("dot", "punkt"), ("point", "punto", "ponto")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]")

#: Disguised signs: in brackets, or as words of their own.
any_of = "|".join
BRACKET_AT = re.compile(rf"\s?[\[({{<]\s?(?:{any_of(AT + OTHER_AT)}|@)\s?[\])}}>]\s?", re.I)
WORD_AT = re.compile(rf"\s(?:{any_of(AT + OTHER_AT)})\s", re.I)
BRACKET_DOT = re.compile(rf"\s?[\[({{<]\s?(?:{any_of(DOT + OTHER_DOT)}|\.)\s?[\])}}>]\s?", re.I)
WORD_DOT = re.compile(rf"\s(?:{any_of(DOT + OTHER_DOT)})\s", re.I)
PLAIN_DOT = re.compile(rf"\s(?:{any_of(DOT)})\s", re.I)
#: Four numbers between which at least one dot may be disguised.
HIDDEN_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{BRACKET_DOT.pattern}|{WORD_DOT.pattern}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
HIDDEN_DOT = re.compile(rf"{BRACKET_DOT.pattern}|{WORD_DOT.pattern}", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
NUMBERS = DIGITS | TEENS | {w: d + "0" for w, d in TENS.items()}
LONGER = sorted(NUMBERS, key=len, reverse=True)
SPELLED = re.compile(rf"(?<![^\W\d_])(?:{any_of(PLUS)}|\+)?[\s-]?(?:(?:{any_of(LONGER)}|[0-9]+)(?![^\W\d_])[\s,-]{{0,2}})+", re.I)
TOKEN = re.compile(rf"{any_of(PLUS)}|\+|[0-9]+|{any_of(LONGER)}", re.I)
WORD = re.compile(any_of(LONGER), re.I)
#: Digits of the shortest number that is searched for besides those of IP addresses.
LEAST_DIGITS = 10

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(c) - 9 * (c > "4") for c in even)) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        end = 0
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = done = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[Span]:
    """Base spans: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = list(emails(text)) if "@" in text else []
    if NUMBER.search(text):
        if text.count(".") > 2:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(NUMBER.findall(m[0])) <= 15]
    return out


class Rewritten:
    """A text with edits applied, and the way back to source offsets."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.at, self.source, self.fixed, here, done = [], [], [], [], 0, 0
        for start, end, new in edits:
            for a, b, s, fixed in ((done, start, text[done:start], False), (start, end, new, True)):
                self.at.append(here)
                self.source.append((a, b))
                self.fixed.append(fixed)
                parts.append(s)
                here += len(s)
            done = end
        self.at.append(here)
        self.source.append((done, len(text)))
        self.fixed.append(False)
        parts.append(text[done:])
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source offsets of a span, and whether it touches an edit."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[i][0] if self.fixed[i] else self.source[i][0] + start - self.at[i]
        b = self.source[j][1] if self.fixed[j] else self.source[j][0] + end - self.at[j]
        return a, b, any(self.fixed[i : j + 1])


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn ``name (at) host (dot) org`` and ``name at host dot org``
    into an address.  A bare ``at`` counts only before a bare or bracketed dot, and
    a bare English one only before words that no English sentence has there."""
    out: list[tuple[int, int, str]] = []
    marks = sorted({(m.start(), m.end(), bare) for bare, r in ((False, BRACKET_AT), (True, WORD_AT)) for m in r.finditer(text)} | ({(i, i + 1, False) for i in (m.start() for m in re.finditer("@", text))} if "@" in text else set()))
    for start, end, bare in marks:
        if out and start < out[-1][1] or not start or text[start - 1] not in LOCAL:
            continue
        word_dot = PLAIN_DOT if bare and text[start + 1 : end - 1].lower() in AT else WORD_DOT
        host = LABEL.match(text, end)
        dots: list[tuple[int, int, str]] = []
        plain = False
        while host:
            dot = BRACKET_DOT.match(text, host.end()) or word_dot.match(text, host.end())
            real = not dot and host.end() < len(text) and text[host.end()] == "."
            after = LABEL.match(text, dot.end() if dot else host.end() + 1) if dot or real else None
            if not after:
                break
            plain |= real
            if dot:
                dots.append((dot.start(), dot.end(), "."))
            host = after
        if dots or plain and not bare:
            # Dots of the name that are disguised, too.
            names: list[tuple[int, int, str]] = []
            at = start
            while True:
                while at and text[at - 1] in LOCAL:
                    at -= 1
                m = next((m for m in (r.search(text, max(0, at - 11), at) for r in (BRACKET_DOT, word_dot)) if m and m.end() == at and m.start()), None)
                if not m or text[m.start() - 1] not in LOCAL or out and m.start() < out[-1][1]:
                    break
                names.insert(0, (m.start(), m.end(), "."))
                at = m.start()
            out += names + ([(start, end, "@")] if text[start:end] != "@" else []) + dots
    return out


def ip_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that undo the disguised dots of ``192[.]168 dot 0.1``."""
    return [(d.start(), d.end(), ".") for m in HIDDEN_IP.finditer(text) for d in HIDDEN_DOT.finditer(text, m.start(), m.end())]


def digits_of(tokens: list[str]) -> str:
    """The number that tokens say; tens and a unit behind them are one number."""
    out, tens = [], False
    for t in tokens:
        if tens and t in DIGITS and DIGITS[t] != "0":
            out[-1] = out[-1][0] + DIGITS[t]
            tens = False
        else:
            out.append("+" if t in (*PLUS, "+") else NUMBERS.get(t, t))
            tens = t in TENS
    return "".join(out)


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of numbers that hold a word for digits and, whole, as many digits as a
    phone number or a card has."""
    out = []
    for m in SPELLED.finditer(text):
        if len(m[0]) < LEAST_DIGITS or not WORD.search(m[0]):
            continue
        number = digits_of([t.lower() for t in TOKEN.findall(m[0])])
        if len(number) >= LEAST_DIGITS:
            said = m[0].rstrip(" \t\n,-")
            lead = len(said) - len(said.lstrip(" \t\n,-"))
            out.append((m.start() + lead, m.start() + len(said), number))
    return out


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that show only after rewriting."""
    steps: list[Rewritten] = []
    now = text
    if not text.isascii() and LOOKALIKE.search(text):
        steps.append(Rewritten(now, [(m.start(), m.end(), LOOKALIKES[m[0]]) for m in LOOKALIKE.finditer(now)]))
        now = steps[-1].text
    low = now.lower()
    bracket = any(map(now.__contains__, "[({<"))
    dotted = any(map(low.__contains__, DOT + OTHER_DOT)) and WORD_DOT.search(now) or bracket and BRACKET_DOT.search(now)
    if dotted and (edits := ip_edits(now)):
        steps.append(Rewritten(now, edits))
        now = steps[-1].text
    # All that sign_edits can act on: a disguised dot with any at sign, or a bracketed at with any dot.
    if dotted and ("@" in now or WORD_AT.search(now)) or bracket and (dotted or "." in now) and BRACKET_AT.search(now):
        if edits := sign_edits(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
            low = now.lower()
    if WORD.search(low) and (edits := digit_edits(now)):
        steps.append(Rewritten(now, edits))
        now = steps[-1].text
    if not steps:
        return []
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    out = []
    for kind, s, e in detect(now):
        touched = False
        for r in reversed(steps):
            s, e, t = r.back(s, e)
            touched |= t
        if touched and all(e <= a or b <= s for a, b in taken[kind]):
            out.append((kind, s, e))
            taken[kind].append((s, e))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>, base_sha256, joined) of every row."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, sha, said = [], [], []
            for t in b.column(1).to_pylist():
                base = detect(t) if t else []
                more = added(t, base) if t else []
                spans.append([{"kind": k, "start": s, "end": e, "base": x} for some, x in ((base, True), (more, False)) for k, s, e in some])
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                said.append(joined(base + more))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(spans, SPANS), pa.array(sha, pa.string()), pa.array(said, pa.string())], ["id", "spans", "base_sha256", "joined"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>, base_sha256 string, joined string")


def mask(text: str | None) -> str | None:
    """The text with every span, base or added, replaced by its kind; overlapping
    spans are replaced as one, by the kind of the first."""
    if not text:
        return text
    base = detect(text)
    out, done = [], 0
    for kind, s, e in sorted(base + added(text, base), key=lambda x: (x[1], KINDS.index(x[0]), x[2])):
        if s >= done:
            out += [text[done:s], f"<{kind.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``df`` with its texts masked, and their lengths counted anew; all columns stay."""
    bound_batches(df.sparkSession)
    run = F.pandas_udf(lambda s: s.map(mask, na_action="ignore"), "string")
    out = df.withColumn(text_col, run(F.col(text_col)))
    if length_col and length_col in df.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out
