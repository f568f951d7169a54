"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and words that announce an identifier. Around each anchor a small parser
expands to the left and right as far as its kind allows and validates what it
has found. The text between anchors is never looked at again, and no parser
starts before the end of the last match of its kind, so the work is linear.

Base kinds, with the results of their patterns (leftmost, not overlapping):

    email   at-sign; local part to the left, labels with dots to the right
    ip      digit before a dot; four numbers of at most 255
    card    digit; digits with single spaces or hyphens, 12 to 19, Luhn
    phone   plus sign; 9 to 15 digits with separators

Further kinds, each validated, so that plain prose yields none:

    login     a scheme followed by ``user:password@host``
    iban      the word IBAN, then a country's account number, checked modulo 97;
              capital words right after it do not belong to it
    national  the words SSN or NINO, then a number of that form

Defined results: a null or empty text has no spans; offsets are code points with
an exclusive end; spans of different kinds may overlap and all stay; equal rows
give equal results; other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructType

from tidewatch.llm.shared import pieces, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "national")
Span = tuple[int, int, int]  # start, number of the kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = frozenset("0123456789")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
_IBAN = re.compile(r"[\s:#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
#: Characters of an account number by country; other countries go by modulo 97 alone.
_IBAN_LENGTHS = {
    name[:2]: int(name[2:])
    for name in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18"
        " FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20"
        " LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24"
        " SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
_NATIONAL = re.compile(r"[\s:#]*([0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2} ?(?:[0-9]{2} ?){3}[A-D])(?![A-Za-z0-9])")
_CUES = {
    "@": "email",
    "+": "phone",
    **{d: "digit" for d in "0123456789"},
    **{f"{scheme}://": "login" for scheme in ("http", "https", "ftp", "sftp", "ssh", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp")},
    **{cue: "iban" for cue in ("IBAN", "iban", "Iban")},
    **{cue: "national" for cue in ("SSN", "ssn", "NINO", "nino")},
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    moved = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _account_end(text: str, start: int, end: int) -> int | None:
    """Where the account number in a run ends: at its country's length if valid there, else at the last valid gap."""
    ends = [end, *(at for at in range(end - 1, start, -1) if text[at] == " ")]
    wanted = _IBAN_LENGTHS.get(text[start : start + 2])
    ends.sort(key=lambda at: at - start - text.count(" ", start, at) != wanted)
    return next((at for at in ends if _iban_valid(text[start:at])), None)


def cue_automaton():
    """The anchors; longer cues that end in the same place come as well."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for cue, kind in _CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def find_spans(text: str, cues) -> list[Span]:
    """All spans of a text by start, then kind."""
    spans: list[Span] = []
    email_end = ip_end = card_end = login_end = 0
    run_end = 0  # of the run of digits looked at last
    for last, (kind, length) in cues.iter(text):
        if kind == "email":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            match = _DOMAIN.match(text, last + 1) if start < last else None
            if match:
                spans.append((start, 0, match.end()))
                email_end = match.end()
        elif kind == "digit":
            if last >= card_end:
                match = _CARD.match(text, last)
                if match:
                    card_end = match.end()
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((last, 2, card_end))
            if last >= ip_end and last >= run_end:
                match = _QUAD.match(text, last)
                if match:
                    ip_end = match.end()
                    # Leading zeros do not count; four digits are more than 255.
                    parts = [part.lstrip("0") for part in match[0].split(".")]
                    if all(len(part) < 4 and int(part or 0) <= 255 for part in parts):
                        spans.append((last, 1, ip_end))
                else:
                    run_end = last + 1
                    while text[run_end : run_end + 1] in _DIGITS:
                        run_end += 1
        elif kind == "phone":
            match = _PHONE.match(text, last)
            if match and 9 <= sum(c in _DIGITS for c in match[0]) <= 15:
                spans.append((last, 3, match.end()))
        elif kind == "login":
            if last >= login_end and (match := _LOGIN.match(text, last + 1)):
                start = last + 1 - length
                spans.append((start, 4, match.end()))
                login_end = match.end()
        else:
            before = last - length
            if before >= 0 and text[before].isalnum():
                continue
            pattern, number = (_IBAN, 5) if kind == "iban" else (_NATIONAL, 6)
            match = pattern.match(text, last + 1)
            if match:
                start, end = match.span(1)
                if number == 5:
                    end = _account_end(text, start, end)
                if end is not None:
                    spans.append((start, number, end))
    spans.sort()
    return spans


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans])


def redacted(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    out, at = [], 0
    stop, kind = -1, 0
    for start, number, end in spans:
        if start >= stop:
            if stop >= 0:
                out.append(f"[{KINDS[kind].upper()}]")
                at = stop
            out.append(text[at:start])
            kind = number
        stop = max(stop, end)
    if stop >= 0:
        out.append(f"[{KINDS[kind].upper()}]")
        at = stop
    return "".join(out) + text[at:]


def _mapped(schema: pa.Schema, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = cue_automaton()
        for batch in pieces(batches):
            texts = texts_of(batch)
            found = [find_spans(text, cues) for text in texts]
            made: dict[str, list] = {}
            if digest:
                made["spans"] = [written(spans) for spans in found]
                base = [[s for s in spans if s[1] < len(BASE_KINDS)] for spans in found]
                for number, kind in enumerate(BASE_KINDS):
                    made[f"n_{kind}"] = [sum(s[1] == number for s in spans) for spans in base]
                made["base_sha256"] = [sha256(written(spans).encode()).hexdigest() for spans in base]
            else:
                whole = batch.column("text").to_pylist()
                made["text"] = [
                    redacted(text, spans) if spans else raw for raw, text, spans in zip(whole, texts, found)
                ]
            arrays = [
                pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    out = StructType([docs.schema["doc_id"]])
    for kind in BASE_KINDS:
        out = out.add(f"n_{kind}", LongType())
    out = out.add("base_sha256", StringType()).add("spans", StringType())
    return docs.select("doc_id", "text").mapInArrow(_mapped(to_arrow_schema(out), True), out)


def redact(docs: DataFrame) -> DataFrame:
    """All columns of the input, with personal data in ``text`` replaced by its kind."""
    return docs.mapInArrow(_mapped(to_arrow_schema(docs.schema), False), docs.schema)
