"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are confirmed by their own rule (parts, Luhn, digit counts) and
always stay; the added kinds iban (its country's length, mod 97) and ssn need a score of at least `threshold`, which starts
at the kind's prior and rises with words like "account" within `CONTEXT_CHARS` before the span.

Defined results: null text is empty and has no spans; repeated rows and null doc_ids keep a row each;
columns other than id and text are ignored by `find`, and kept by `redact`; an empty table gives an
empty table. Offsets count code points. The proposers run in time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import per_batch

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social", "security"),
}
CONTEXT_CHARS, CONTEXT_GAIN = 48, 0.3

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# Digits are possessive: giving digits back never lets the next dot or separator match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_NEXT = re.compile(r"\x20?[A-Z0-9]")
_ALNUM = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")

#: Lengths of IBANs by country: the registry's, and those in use in countries outside it.
IBAN_LENGTHS = {
    c: n for n, every in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
        28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for c in every.split()
}


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part's class has no @, so the leftmost match of an @ starts where the run before it does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> list[tuple[int, int]]:
    """Of each start, the ending at its country's length; beside those, of other codes the longest of 15 to 34 characters that confirms."""
    known, other = [], []
    for m in _IBAN.finditer(text):
        length, ends, at = IBAN_LENGTHS.get(m[0][:2]), [], m.end()
        for n in range(5, (length or 34) + 1):
            following = _IBAN_NEXT.match(text, at)
            if not following:
                break
            at = following.end()
            if n >= (length or 15) and not _ALNUM.match(text, at):
                ends.append(at)
        for at in reversed(ends):
            found = known if length else other
            if (not found or m.start() >= found[-1][1]) and mod97(text[m.start() : at]):
                found.append((m.start(), at))
                break
    i, out = 0, list(known)
    for a, b in other:
        while i < len(known) and known[i][1] <= a:
            i += 1
        if i == len(known) or known[i][0] >= b:
            out.append((a, b))
    return out


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind index, end) of confirmed spans of every kind, before context is seen."""
    for a, b in _emails(text):
        yield a, 0, b
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield m.start(), 1, m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), 2, m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                yield m.start(), 3, m.end()
    for a, b in _ibans(text):
        yield a, 4, b
    if "-" in text:
        for m in _SSN.finditer(text):
            yield m.start(), 5, m.end()


def spans(text: str | None, threshold: float = 0.5) -> list[tuple[int, int, int, float]]:
    """(start, kind index, end, score) by start, then kind."""
    out = []
    for a, k, b in sorted(proposals(text or "")):
        kind = KINDS[k]
        near = set(_WORD.findall(text[max(0, a - CONTEXT_CHARS) : a].lower()))
        score = min(1.0, PRIOR[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind]))
        if k < 4 or score >= threshold:
            out.append((a, k, b, score))
    return out


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, scores: a row for each row of docs."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base, every, scores = [[] for _ in range(4)], [], [], []
        for text in batch.column("text").to_pylist():
            found = spans(text, threshold)
            shown = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found]
            for k in range(4):
                counts[k].append(sum(f[1] == k for f in found))
            base.append(hashlib.sha256(",".join(s for s, f in zip(shown, found) if f[1] < 4).encode()).hexdigest())
            every.append(",".join(shown))
            scores.append([f[3] for f in found])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array(scores, pa.list_(pa.float64()))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(per_batch(step, size_of="text"), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def redacted(text: str | None, threshold: float = 0.5) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    out, done = [], 0
    for a, k, b, _ in spans(text, threshold):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with personal data replaced in `text` (and `n_chars` counted anew where it is an integer); other columns stay."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [redacted(t, threshold) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        at = batch.schema.get_field_index("n_chars")
        if at >= 0 and pa.types.is_integer(batch.schema.field(at).type):
            old = batch.column(at).to_pylist()
            batch = batch.set_column(at, batch.schema.field(at), pa.array([o if t is None else len(t) for o, t in zip(old, new)], batch.schema.field(at).type))
        return batch

    return docs.mapInArrow(per_batch(step, size_of="text"), docs.schema)
