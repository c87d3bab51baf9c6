"""Personal data in whole texts, plain and disguised, with spans of the source text.

Plain finds are those of four patterns.  Disguised ones pass through transducers: each rewrites a
text and keeps, for every character it puts out, where in the source that came from.  Characters
that only look like ASCII become ASCII and invisible ones go; bracketed or spelled at and dot become
signs; spelled digits become digits.  The patterns then run over the rewritten text and the spans
are mapped back.  Only texts that show signs of a disguise are rewritten."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tectra.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where its run of digits begins: from within the run it would fail or end alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """The finds of the four patterns: leftmost, not overlapping within a kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


@dataclass
class Traced:
    """A rewritten text; character i came from source[starts[i]:ends[i]]."""

    text: str
    starts: list[int]
    ends: list[int]

    def rewrite(self, changes) -> Traced:
        """changes: (start, end, put), put a list of (string, start, end) in this text's places."""
        pieces, starts, ends, at = [], [], [], 0
        for start, end, put in changes:
            pieces.append(self.text[at:start])
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            for string, a, b in put:
                pieces.append(string)
                starts += [self.starts[a]] * len(string)
                ends += [self.ends[b - 1]] * len(string)
            at = end
        if not at:
            return self
        pieces.append(self.text[at:])
        return Traced("".join(pieces), starts + self.starts[at:], ends + self.ends[at:])


# Letters of other scripts that look like ASCII ones, signs, and invisible characters.
_LOOKS = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХУІЈЅαοορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ․。．｡٫‐‑‒–−﹣＿﹢﹫٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९",
        "aeopcyxijshdqwABEKMHOPCTXYIJSaoopvikABEZHIKMNOPTYX.....-----" + "-_+@" + "0123456789" * 3,
        strict=True,
    )
)
_INVISIBLE = "­​‌‍‎‏⁠﻿"
_WIDE = "！-～\U0001d400-\U0001d7ff①-⑳Ⓐ-ⓩ²³¹⁰-⁹₀-₉"
_STRANGE = re.compile(f"[{re.escape(''.join(_LOOKS))}{_INVISIBLE}{_WIDE}]")

_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT_WORD, _DOT_WORD = r"(?:at|arroba)", r"(?:dot|punkt|punto|point)"
_AT_SIGN = rf"\s*{_OPEN}\s*(?:{_AT_WORD}|@)\s*{_SHUT}\s*"
_DOT_SIGN = rf"\s*{_OPEN}\s*(?:{_DOT_WORD}|\.)\s*{_SHUT}\s*"
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_JOIN = rf"(?P<at_b>{_AT_SIGN})|(?P<dot_b>{_DOT_SIGN})|(?P<at_w>\s+{_AT_WORD}\s+)|(?P<dot_w>\s+{_DOT_WORD}\s+)|(?P<at_r>\s*@\s*)|(?P<dot_r>\.)"
_BARE = re.sub(r"\?P<\w+>", "?:", _JOIN)
_JOINTS = re.compile(_JOIN, re.IGNORECASE)
# Words with signs between them, as many as there are: each place of a text belongs to one such run at most.
_CHAIN = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:{_BARE})[A-Za-z0-9_%+-]+)+", re.IGNORECASE)
_MAIL_SIGN = re.compile(rf"{_OPEN}\s*(?:{_AT_WORD}|{_DOT_WORD}|@|\.)\s*{_SHUT}|\s{_DOT_WORD}\s", re.IGNORECASE)
# Names of the digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NAMED = "|".join(_DIGITS)
_SPELLED = re.compile(rf"\b(?:plus[\s-]+)?(?:{_NAMED}|[0-9])(?:[\s-]+(?:{_NAMED}|[0-9]|dot|point))*[\s-]+(?:{_NAMED}|[0-9])\b", re.IGNORECASE)
_SPELLED_SIGN = re.compile(rf"\b(?:{_NAMED})(?:[\s-]+(?:{_NAMED}|dot|point)\b){{2}}", re.IGNORECASE)
_PART = re.compile(rf"{_NAMED}|plus|dot|point|[0-9]", re.IGNORECASE)


def _looks(text: str):
    for m in _STRANGE.finditer(text):
        c = m[0]
        yield m.start(), m.end(), [("" if c in _INVISIBLE else _LOOKS.get(c) or unicodedata.normalize("NFKC", c), *m.span())]


def _mails(text: str):
    """Disguised addresses: a bracketed at with dots of any form; a spelled or real at with disguised dots
    only; or a real at with plain dots and then a bracketed one.  Each chain of words is walked once."""
    for chain in _CHAIN.finditer(text):
        signs = [(m.lastgroup, m.start(), m.end()) for m in _JOINTS.finditer(text, chain.start(), chain.end())]
        free, first, i = chain.start(), 0, 0  # where the name of the next address may begin, and its first sign
        while i < len(signs):
            kind, at, after = signs[i]
            if kind[0] == "d":
                i += 1
                continue
            end, last = _domain(text, signs, i, chain.end())
            if not end or free >= at:
                i += 1
                free, first = after, i
                continue
            put, here = [], free
            for k, a, b in signs[first : last + 1]:
                put += [(c, p, p + 1) for p, c in enumerate(text[here:a], here)]
                put.append(("@" if k[0] == "a" else ".", a, b))
                here = b
            yield free, end, put + [(c, p, p + 1) for p, c in enumerate(text[here:end], here)]
            i = last + 1
            free = signs[i][2] if i < len(signs) else end
            i += 1
            first = i


def _domain(text: str, signs: list, i: int, stop: int) -> tuple[int, int]:
    """End of the domain after the at signs[i], and its last dot's number; (0, 0) if there is none."""
    kind, _, here = signs[i]
    end, last, seen = 0, i, []
    while m := _LABEL.match(text, here, stop):
        plain, brackets = "dot_r" in seen, "dot_b" in seen
        if kind == "at_b":
            fits = bool(seen)
        elif kind == "at_w" or not plain:
            fits = bool(seen) and not plain
        else:
            fits = brackets and seen[0] == "dot_r"
        if fits:
            end, last = m.end(), i + len(seen)
        j = i + len(seen) + 1
        if j >= len(signs) or signs[j][0][0] != "d" or signs[j][1] != m.end():
            break
        if kind == "at_w" and signs[j][0] == "dot_r" or kind == "at_r" and (signs[j][0] == "dot_w" if plain else signs[j][0] == "dot_r" and seen):
            break
        seen.append(signs[j][0])
        here = signs[j][2]
    return (end, last) if end else (0, 0)


def _digits(text: str):
    value = _DIGITS | {"plus": "+", "dot": ".", "point": "."}
    for m in _SPELLED.finditer(text):
        words = list(_PART.finditer(m[0]))
        if sum(w[0].lower() in _DIGITS for w in words) >= 4:
            yield m.start(), m.end(), [(value.get(w[0].lower(), w[0]), m.start() + w.start(), m.start() + w.end()) for w in words]


def disguised_spans(text: str) -> list[Span]:
    """Spans of disguised finds, in places of the source text."""
    strange = bool(_STRANGE.search(text))
    if not (strange or _MAIL_SIGN.search(text) or _SPELLED_SIGN.search(text)):
        return []
    traced = Traced(text, list(range(len(text))), list(range(1, len(text) + 1)))
    if strange:
        traced = traced.rewrite(_looks(traced.text))
    if _SPELLED_SIGN.search(traced.text):
        traced = traced.rewrite(_digits(traced.text))
    if _MAIL_SIGN.search(traced.text):
        traced = traced.rewrite(_mails(traced.text))
    out = []
    for kind, a, b in plain_spans(traced.text):
        start, end = traced.starts[a], traced.ends[b - 1]
        if text[start:end] != traced.text[a:b]:
            out.append((kind, start, end))
    return out


def ordered(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and the disguised ones that lie within no plain span of their kind."""
    base = plain_spans(text)
    more = [s for s in disguised_spans(text) if not any(s[0] == k and a <= s[1] and s[2] <= b for k, a, b in base)]
    return base, more


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (plain finds), base_sha256 (of the
    plain spans), spans (all, as kind:start:end in code points), n_added.

    Null text counts as empty and has no spans; null or repeated doc_ids are ordinary rows; an empty
    table gives an empty result; time and memory are in proportion to a text's length, however long;
    other columns, whatever their names, are not read."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                base, more = all_spans(text or "")
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc_id, *n, hashlib.sha256(ordered(base).encode()).hexdigest(), ordered(base + more), len(more)))
            types = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str | None) -> str | None:
    """The text with every find replaced by its kind in brackets."""
    if text is None:
        return None
    base, more = all_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])
