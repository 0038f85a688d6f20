"""Personal data with offsets: plain patterns, and disguised identifiers found in normalised text."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: A run of digits that starts no address has no later digit that starts one, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(
    zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХУІЈЅαορυνικτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTXYIJSaopuviktABEZHIKMNOPTYX", strict=True)
)
#: Digits by name.
NUMBERS = dict(zip(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"), "0123456789", strict=True)) | {"oh": "0"}

#: Characters that are shown as nothing.
_HIDDEN = "­​‌‍⁠﻿"
_PLAIN = LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {"　": " ", " ": " "}
_PLAIN |= dict.fromkeys("‐‑‒–", "-") | dict.fromkeys("。․﹒", ".") | {"﹫": "@"}
_PLAIN |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966) for d in range(10)}
_ODD = re.compile("[" + re.escape("".join(_PLAIN) + _HIDDEN) + "]")

_SPELLED = "|".join(NUMBERS)
_DIGITS = re.compile(rf"(?i)\b(?:{_SPELLED}|double|triple)(?:[\s,-]+(?:{_SPELLED}|double|triple|dot|point|dash|[0-9]+)){{2,}}\b")
_PLUS = re.compile(r"(?i)\bplus(?=\s+[0-9])")
#: The marks alone; what is blank around them goes with them, see ``_with_blanks``.
_AT = re.compile(r"(?i)\(\s*(?:at|@)\s*\)|\[\s*(?:at|@)\s*\]|\{\s*(?:at|@)\s*\}|<\s*at\s*>|(?<=\s)_at_(?=\s)")
_DOT = re.compile(r"(?i)\(\s*(?:dot|point|\.)\s*\)|\[\s*(?:dot|point|\.)\s*\]|\{\s*(?:dot|point|\.)\s*\}|<\s*dot\s*>")
_SPOKEN = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(\s++at\s++)[A-Za-z0-9-]+(?:(?:\s+dot\s+|\.)[A-Za-z0-9-]+)*?(\s+dot\s+[A-Za-z]{2,6})\b")
_BARE_DOT = re.compile(r"(?i)(?<=\s)dot(?=\s)")
#: A text without any of these holds no disguise: every transducer's pattern holds one of them.
_HINT = re.compile(rf"(?i)[(\[{{<]\s*(?:at|dot|point|@|\.)\s*[)\]}}>]|_at_|\sdot\s|\b(?:{_SPELLED}|double|triple)[\s,-]+(?:{_SPELLED}|double|triple|dot|point|dash|[0-9])|\bplus\s+[0-9]|\+\s+[0-9]|{_ODD.pattern}")


def _passes(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in found.split("."))
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if not 16 <= len(digits) <= 19:
        return False
    twice = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost, non-overlapping: every @ is tried once, so a long run of letters costs no more than its length."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        stop = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            stop = free = m.end()
            found.append((start, free))
        elif start < at:
            free = max(free, start)
        at = text.find("@", stop)
    return found


def plain_spans(text: str) -> dict[str, list[Span]]:
    """The spans of every kind by the plain patterns, in code points, end exclusive."""
    spans: dict[str, list[Span]] = {"email": _emails(text), "ip": [], "card": [], "phone": []}
    if _DIGIT.search(text):
        for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
            if kind != "phone" or "+" in text:
                spans[kind] = [m.span() for m in pattern.finditer(text) if _passes(kind, m[0])]
    return spans


class Mapped:
    """A text under rewriting; for every character the span of the source that it stands for."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace each [a, b) by a string whose characters all stand for the whole replaced source."""
        if not edits:
            return
        parts, starts, ends, done = [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[done:a], new]
            starts += self.start[done:a] + [self.start[a]] * len(new)
            ends += self.end[done:a] + [self.end[b - 1]] * len(new)
            done = b
        self.text = "".join(parts) + self.text[done:]
        self.start, self.end = starts + self.start[done:], ends + self.end[done:]


def _spelled(found: str) -> str:
    out, times = "", 1
    for word in re.split(r"[\s,-]+", found.lower()):
        if word in ("double", "triple"):
            times = 2 if word == "double" else 3
            continue
        out += {"dot": ".", "point": ".", "dash": "-"}.get(word) or NUMBERS.get(word, word) * times
        times = 1
    return out


def _with_blanks(text: str, spans: list[Span], new: str) -> list[tuple[int, int, str]]:
    """Edits that replace each span and the blanks on both sides; a run of blanks is read once from either side."""
    edits, done = [], 0
    for a, b in spans:
        while a > done and text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        edits.append((a, b, new))
        done = b
    return edits


def normalised(text: str) -> Mapped:
    """The transducers in turn: look-alikes and hidden characters, digits by name, at and dot."""
    m = Mapped(text)
    m.rewrite([(x.start(), x.end(), _PLAIN.get(x[0], "")) for x in _ODD.finditer(m.text)])
    m.rewrite([(x.start(), x.end(), _spelled(x[0])) for x in _DIGITS.finditer(m.text)])
    m.rewrite([(x.start(), x.end(), "+") for x in _PLUS.finditer(m.text)])
    m.rewrite(_with_blanks(m.text, [x.span() for x in _AT.finditer(m.text)], "@"))
    m.rewrite(_with_blanks(m.text, [x.span() for x in _DOT.finditer(m.text)], "."))
    edits = []
    for x in _SPOKEN.finditer(m.text):
        edits.append((*x.span(1), "@"))
        edits += _with_blanks(m.text, [d.span() for d in _BARE_DOT.finditer(m.text, x.end(1), x.end(2))], ".")
    m.rewrite(edits)
    dots = _with_blanks(m.text, [x.span() for x in _BARE_DOT.finditer(m.text)], ".") if "@" in m.text else []
    m.rewrite([(a, b, new) for a, b, new in dots if re.search(r"@[A-Za-z0-9.-]+\Z", m.text[max(0, a - 64) : a]) and re.match(r"[A-Za-z]{2,6}\b", m.text[b : b + 7])])
    # "+1 5 5 5": a sign that was spelled stands before its digits.
    m.rewrite([(x.start(), x.end(), "+") for x in re.finditer(r"\+\s+(?=[0-9])", m.text)])
    return m


def all_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(plain, added): the plain spans, and those of disguised identifiers, mapped back to the source.

    An added span never overlaps a plain one of any kind.
    """
    plain = plain_spans(text)
    added: dict[str, list[Span]] = {k: [] for k in KINDS}
    if _HINT.search(text):
        m = normalised(text)
        taken = sorted(s for spans in plain.values() for s in spans)
        starts = [s for s, _ in taken]
        reach = max((e - s for s, e in taken), default=0)
        for kind, spans in plain_spans(m.text).items():
            for a, b in spans:
                span = min(m.start[a:b]), max(m.end[a:b])
                near = taken[bisect_left(starts, span[0] - reach) : bisect_left(starts, span[1])]
                if not any(s < span[1] and span[0] < e for s, e in near):
                    added[kind].append(span)
    return plain, added


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find_pii(docs: DataFrame, mask: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added[, masked]) of every row.

    The counts and base_sha256 are of the plain spans; ``spans`` lists these and the added ones as
    kind:start:end, by kind and start. ``mask`` adds the text with each span replaced by [KIND]; where
    spans of two kinds overlap, their union is replaced and named after the earlier kind. A null text
    counts as empty; a null doc_id is returned as such. Every whole text is read, in time that grows with its
    length; repeated rows give repeated results. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).to_pylist():
                plain, added = all_spans(text or "")
                for i, kind in enumerate(KINDS):
                    out[i].append(len(plain[kind]))
                both = {k: plain[k] + added[k] for k in KINDS}
                out[4].append(hashlib.sha256(_joined(plain).encode()).hexdigest())
                out[5].append(_joined(both))
                out[6].append(sum(map(len, added.values())))
                if mask:
                    out[7].append(masked(text or "", both))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
            arrays = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)][: 8 if mask else 7]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "masked"][: 9 if mask else 8])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, schema + ", masked string" * mask)


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    merged: list[list] = []
    for a, b, rank in sorted((a, b, i) for i, k in enumerate(KINDS) for a, b in spans[k]):
        if merged and a < merged[-1][1]:
            merged[-1][1:] = max(b, merged[-1][1]), min(rank, merged[-1][2])
        else:
            merged.append([a, b, rank])
    parts, done = [], 0
    for a, b, rank in merged:
        parts += [text[done:a], f"[{KINDS[rank].upper()}]"]
        done = b
    return "".join(parts) + text[done:]
