"""Personal data in texts, also when disguised, with spans in characters of the source.

Base detectors run on the text itself. Texts with a disguise then pass through a transducer that
rewrites homoglyphs, spelled digits and at/dot words, keeps where each piece came from, and runs the
same detectors on the rewritten text. Their spans are mapped back and added, base spans stay.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonloom.llm.common import as_id, as_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a chain of numbers in dots; base matches are its parts four by four
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping spans per kind; a match that fails its test is dropped."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if _DIGIT.search(text):
        found |= {"ip": list(_ips(text)), "card": list(_cards(text)), "phone": list(_phones(text)) if "+" in text else []}
    return found


# fixed values: letters of other scripts that look like ASCII letters
_LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρυ", "ABESIJKMHOPCTXYaesijopcxyhdqwABEZHIKMNOPTYXoaivpu"))
# fixed values: marks that stand for an at sign or a dot, and characters without width
_MARKS = {"﹫": "@", "。": ".", "｡": ".", "․": ".", "﹒": ".", "‐": "-", "‑": "-", "﹣": "-", "−": "-", "⁺": "+", "﹢": "+", " ": " ", " ": " ", " ": " "}
_WIDTHLESS = "­​‌‍⁠﻿"


def _glyphs() -> dict[str, str]:
    """Compatibility forms of ASCII (full-width, mathematical, circled) and digits of all scripts, by Unicode's own tables."""
    table = {}
    for code in (*range(0x2070, 0x2100), *range(0x2460, 0x24EA), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x1FBF0, 0x1FBFA)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and "!" <= plain <= "~":
            table[chr(code)] = plain
    for code in range(0x80, 0x1FBF0):
        if unicodedata.category(chr(code)) == "Nd":
            table[chr(code)] = str(unicodedata.decimal(chr(code)))
    return table | _LOOKALIKES | _MARKS | dict.fromkeys(_WIDTHLESS, "")


GLYPHS = _glyphs()
# fixed values: digits as words in English, German, French and Spanish, in order from 0
_WORDS = ("zero oh null cero zéro", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve")
SPELLED = {w: str(d) for d, row in enumerate(_WORDS) for w in row.split()}
_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DOT = r"(?:dot|point|punkt|punto)(?!\w)"
_WORD += r"(?!\w)"
# digits and spelled digits with white space, commas or hyphens of any length between them, and dot and plus words among them
_GAP = r"[\s,-]++"
_RUN = re.compile(rf"(?<!\w)(?:plus(?!\w)[\s-]++|\+\s*+)?(?:{_WORD}|[0-9]++)(?:{_GAP}(?:{_DOT}{_GAP})?{_WORD}|(?:{_GAP}{_DOT}{_GAP}|[\s-]++)[0-9]++)*+", re.I)
_RUN_PART = re.compile(rf"({_WORD})|([0-9]+)|({_DOT})|(plus(?!\w)|\+)", re.I)
# fixed values: spelled digits that are also articles
_ARTICLES = frozenset("un uno".split())
_DOTS = frozenset("dot point punkt punto".split())
# a plus and what may follow it in a phone number, brackets and dots between the digits included
_PLUS_RUN = re.compile(rf"(?:(?<!\w)plus(?!\w)|\+)[\s().-]*+(?:{_WORD}|[0-9]++)(?:[\s(),.-]++{_WORD}|[\s().-]++[0-9]++)*+", re.I)
#: Digits of a phone number, and of a whole one of country code 1, after which no digit follows.
_PHONE_DIGITS, _WHOLE_ONE = range(8, 16), 11
_RUN_WORDS, _ALL_WORDS = _DOTS | SPELLED.keys(), re.compile(r"\w+")
#: Fewest digits of a run that is rewritten, as an IP address has four, and fewest spelled ones where no dot word is.
_LEAST_DIGITS, _LEAST_SPELLED = 4, 2
# brackets make at and dot words certain; bare ones count only as name at (or @) host dot end, or around a spaced @
_OPEN, _SHUT = r"(?<!\s)\s*+[\[({<]\s*+", r"\s*+[\])}>]\s*+"
_BRACKET_HINT = re.compile(rf"[\[({{<]\s*+(?:at|@|{_DOT}|\.)\s*+[\])}}>]", re.I)
_BRACKETED = re.compile(rf"(?P<at>{_OPEN}(?:at|@){_SHUT})|(?P<dot>{_OPEN}(?:{_DOT}|\.){_SHUT})", re.I)
_BARE_HINT = re.compile(r"\sdot\s|\s@\s", re.I)
_BARE_AT = re.compile(r"(?<!\s)\s*+(?:(?<=\s)at(?=\s)|@)\s*+", re.I)
# a dot in white space only before a small letter, as it may end a sentence
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\s++dot\s++|\s++\.\s++(?=(?-i:[a-z])))[A-Za-z0-9-]++)++", re.I)
_DOT_WORD = re.compile(r"\sdot\s", re.I)
# the name before an at word, read backwards
_EMAN = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:\.|\s++tod\s++)[A-Za-z0-9_%+-]++)*+", re.I)
_BARE_WORD = re.compile(r"(?<!\s)\s++(at|dot|[@.])\s++", re.I)

Edit = tuple[int, int, str]


class Rewritten:
    """A text after edits, which knows the source span of each of its own spans."""

    def __init__(self, text: str, edits: list[Edit]):
        pieces, self.own, self.source = [], [0], [(0, 0, False)]
        at = length = 0
        for start, end, new in edits:
            for piece, frm, to, edited in ((text[at:start], at, start, False), (new, start, end, True)):
                if piece:
                    self.own.append(length)
                    self.source.append((frm, to, edited))
                    pieces.append(piece)
                    length += len(piece)
            at = end
        self.own.append(length)
        self.source.append((at, len(text), False))
        pieces.append(text[at:])
        self.text = "".join(pieces)

    def back(self, start: int, end: int) -> Span:
        k = bisect_right(self.own, start) - 1
        frm, _, edited = self.source[k]
        first = frm if edited else frm + start - self.own[k]
        k = bisect_right(self.own, end - 1) - 1
        frm, to, edited = self.source[k]
        return first, to if edited else frm + end - self.own[k]


def _glyph_edits(text: str) -> list[Edit]:
    found = () if text.isascii() else GLYPHS.keys() & set(text)
    return [(m.start(), m.end(), GLYPHS[m.group()]) for m in re.finditer("[" + "".join(map(re.escape, found)) + "]", text)] if found else []


def _may_hold_run(text: str) -> bool:
    """Whether a spelled digit or a dot word is next to a spelled digit, number or dot word: a quick test of all words."""
    words = _ALL_WORDS.findall(text.lower())
    for k, w in enumerate(words):
        if w in _RUN_WORDS and any(n in _RUN_WORDS or n.isdecimal() for n in (*words[k - 1 : k], *words[k + 1 : k + 2])):
            return True
    return False


def _part_edits(parts: list[re.Match]) -> list[Edit]:
    """An edit for each part of a run, so that a span may begin or end within it; what is between them goes."""
    edits: list[Edit] = []
    for k, p in enumerate(parts):
        if k and p.start() > parts[k - 1].end():
            edits.append((parts[k - 1].end(), p.start(), ""))
        edits.append((p.start(), p.end(), _digits(p) or ("." if p[3] else "+")))
    return edits


def _digits(part: re.Match) -> str:
    return SPELLED[part[1].lower()] if part[1] else part[2] or ""


def _phone_edits(text: str) -> list[Edit]:
    """Edits of phone numbers with spelled digits: after a plus one is enough.

    A number of country code 1 ends with its last digit, so words after it stay words. Elsewhere a single
    spelled digit at the end counts, unless a comma is before it or it is an article.
    """
    edits: list[Edit] = []
    for run in _PLUS_RUN.finditer(text):
        parts = list(_RUN_PART.finditer(text, run.start(), run.end()))
        count, ends = 0, [0]
        for p in parts[1:]:
            count += len(_digits(p))
            ends.append(count)
        if _digits(parts[1])[0] == "1" and _WHOLE_ONE in ends:
            parts = parts[: ends.index(_WHOLE_ONE) + 1]
        elif sum(bool(p[1]) for p in parts) == 1 and parts[-1][1] and (parts[-1][1].lower() in _ARTICLES or "," in text[parts[-2].end() : parts[-1].start()]):
            continue
        if any(p[1] for p in parts) and sum(len(_digits(p)) for p in parts) in _PHONE_DIGITS:
            edits += _part_edits(parts)
    return edits


def _digit_edits(text: str) -> list[Edit]:
    """Edits of phone numbers, and of all other runs of spelled digits and numbers that do not meet one."""
    if not _may_hold_run(text):
        return []
    edits = _phone_edits(text)
    taken = [(e[0], e[1]) for e in edits]
    for run in _RUN.finditer(text):
        k = bisect_right(taken, (run.end(),))
        if run.group().isdecimal() or k and taken[k - 1][1] > run.start():
            continue
        parts = list(_RUN_PART.finditer(text, run.start(), run.end()))
        spelled, digits = sum(bool(p[1]) for p in parts), "".join(map(_digits, parts))
        # a single spelled digit is often a word beside a number, but not where it completes a card number
        enough = spelled >= _LEAST_SPELLED or any(p[3] for p in parts) or spelled and 16 <= len(digits) <= 19 and _luhn(digits)
        if enough and len(digits) >= _LEAST_DIGITS:
            edits += _part_edits(parts)
    return sorted(edits)


def _bare_edits(text: str) -> list[Edit]:
    """Edits of name at host dot end, with any number of dots on both sides and any white space around the words,
    and of name @ host with white space on both sides of the sign. One pass: each name and host is read once."""
    if "@" not in text and "dot" not in text.lower() or not _BARE_HINT.search(text):
        return []
    edits, done, reverse = [], 0, text[::-1]
    for at in _BARE_AT.finditer(text):
        sign = at.group().strip() == "@"
        spaced = sign and at.group()[0] != "@" and at.group()[-1] != "@"
        if sign and not spaced and len(at.group()) > 1:
            continue
        name = _EMAN.match(reverse, len(text) - at.start(), len(text) - done) if at.start() > done else None
        host = _HOST.match(text, at.end()) if name else None
        # beside a plain at sign a dot word in the name is enough
        if host and (spaced or _DOT_WORD.search(text, len(text) - name.end() if sign else host.start(), host.end())):
            edits += [(w.start(), w.end(), "@" if w[1].lower() in ("at", "@") else ".") for w in _BARE_WORD.finditer(text, len(text) - name.end(), host.end())]
            done = host.end()
    return edits


def _at_dot_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(text)] if _BRACKET_HINT.search(text) else []


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of the source that only the rewritten text shows. One that lies within a base span of its kind adds nothing and is left out."""
    steps, now = [], text
    for rule in (_glyph_edits, _digit_edits, _at_dot_edits, _bare_edits):
        if edits := rule(now):
            steps.append(Rewritten(now, edits))
            now = steps[-1].text
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not steps:
        return added
    for kind, spans in base_spans(now).items():
        own, k = base[kind], 0
        for start, end in spans:
            for step in reversed(steps):
                start, end = step.back(start, end)
            while k < len(own) and own[k][1] < end:
                k += 1
            if k == len(own) or own[k][0] > start:
                added[kind].append((start, end))
    return added


def detect(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and added spans per kind; a null text has none."""
    text = text or ""
    base = base_spans(text)
    return base, added_spans(text, base)


def _listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


def with_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of the base spans, base and spans as kind:start:end lists, n_added).

    Offsets count code points, the end is exclusive. An added span may hold or overlap base spans of its kind;
    of equal or longer base spans only these are listed. Null and empty texts have no span; very long texts
    are read whole, in time proportional to their length; repeated rows and null ids each keep their row;
    other columns, of whatever name, are ignored; an empty table gives an empty result.
    """


    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for t in x["text"]:
                base, added = detect(t)
                both = {k: base[k] + added[k] for k in KINDS}
                rows.append((*(len(base[k]) for k in KINDS), _listed(base), _listed(both), sum(map(len, added.values()))))
            yield pd.concat([x[["id"]], pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base", "spans", "n_added"], index=x.index)], axis=1)

    out = f"id string, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, n_added long"
    found = df.select(as_text(df, id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, out)
    return found.withColumn("id", as_id(df, id_col))


def masked(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if text is None:
        return None
    base, added = detect(text)
    spans = sorted((s, e, k) for k in KINDS for s, e in base[k] + added[k])
    pieces, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            pieces += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(pieces) + text[at:] if spans else text


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its text column masked; rows, null texts and other columns, of whatever name, stay as they are."""


    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(masked, na_action="ignore")

    return df.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col)))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = with_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
