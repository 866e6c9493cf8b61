"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues. A deterministic parser at each anchor expands it
to both sides and checks the result. Base kinds are email, ip, card and phone;
the method adds ``account`` (an identifier after a cue such as "IBAN" or
"account no") and ``link`` (an address after a scheme that names a user).
Spans count code points, the end is exclusive.

Cases: a null or empty text has no spans. Texts of any length are scanned
whole, in one pass that grows with the text. Repeated rows are scanned alike. An empty table gives an
empty result. Columns other than doc_id and text are kept by ``redact`` and
ignored by ``find``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "link")
SPANS = "array<struct<kind:string,start:int,end:int>>"
#: Words before an identifier of a person or an account.
CUES = ("iban", "account", "acct", "ssn", "passport", "routing", "tax id", "national id")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
#: Least digits of an identifier after a cue.
LEAST_DIGITS = 6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile("[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
_PHONE_REST = re.compile(r"[ ().0-9-]*")
_AFTER_CUE = re.compile(r"(?: ?(?:no\.?|number|nr\.?|#))? ?[:=#]? ?([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z]{0,2}[0-9][A-Za-z0-9]*)*)", re.I)
_AFTER_IBAN = re.compile(r"(?: ?(?:no\.?|number|nr\.?|#))? ?[:=#]? ?([A-Za-z]{2}[ -]?[0-9]{2})", re.I)
#: Characters of an IBAN by country.
_IBAN_SIZES = {c: int(n) for n, cs in {
    "15": "NO", "16": "BE", "18": "DK FI FO GL NL FK SD", "19": "MK SI", "20": "AT BA EE KZ LT LU XK MN", "21": "CH HR LI LV", "22": "BG BH CR DE GB GE IE ME RS VA",
    "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG", "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV",
    "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU",
}.items() for c in cs.split()}
_ADDRESS = re.compile(r"[^\s\"'<>]+")
_AUTOMATON: list = []
#: A-Z lowered alone, so that places stay.
_LOWERED = {k: k + 32 for k in range(65, 91)}


def automaton():
    import ahocorasick

    if not _AUTOMATON:
        a = ahocorasick.Automaton()
        for mark in ("@", "+"):
            a.add_word(mark, (mark, 1))
        for digit in "0123456789":
            a.add_word(digit, ("0", 1))
        for cue in CUES:
            a.add_word(cue, ("cue", len(cue)))
        for scheme in SCHEMES:
            a.add_word(scheme, ("scheme", len(scheme)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    """Whether the check digits fit: the number that the characters spell is 1 modulo 97."""
    rest = 0
    for c in text[4:] + text[:4]:
        value = int(c, 36)
        rest = (rest * (10 if value < 10 else 100) + value) % 97
    return rest == 1


def iban_end(text: str, start: int) -> int:
    """Where the valid IBAN at a place ends, by its country's length (any, if that is unknown) and check digits; 0 if there is none."""
    size, plain, out = _IBAN_SIZES.get(text[start : start + 2].upper()), "", 0
    for at in range(start, len(text)):
        c = text[at]
        if c.isascii() and c.isalnum():
            plain += c
            whole = len(plain) == size if size else len(plain) >= 15
            if whole and not text[at + 1 : at + 2].isalnum() and iban(plain):
                out = at + 1
        elif c not in " -":
            break
        if len(plain) >= (size or 34):
            break
    return out


def after_cue(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier that follows a cue, from and to: a valid IBAN after its cue, or enough digits."""
    if cue == "iban" and (m := _AFTER_IBAN.match(text, at)):
        end = iban_end(text, m.start(1))
        return (m.start(1), end) if end else None
    m = _AFTER_CUE.match(text, at)
    return m.span(1) if m and sum(c in "0123456789" for c in m[1]) >= LEAST_DIGITS else None


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then by kind in the order of KINDS."""
    found: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = account_end = link_end = 0
    for last, (what, size) in automaton().iter(text.lower() if text.isascii() else text.translate(_LOWERED)):
        at = last - size + 1
        if what == "0":
            if at < run_end:
                continue
            run_end = _DIGITS.match(text, at).end()
            if at >= ip_end and text[run_end : run_end + 1] == "." and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
                    found.append((at, 1, ip_end))
            if at >= card_end:
                m = _CARD.match(text, at)
                if m.end() - at > 1:
                    card_end = m.end()
                    if 14 <= card_end - at <= 37:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.append((at, 2, card_end))
        elif what == "@":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append((start, 0, email_end))
        elif what == "+":
            if at >= phone_end and text[at + 1 : at + 2] in tuple("0123456789"):
                rest = _PHONE_REST.match(text, at + 2)[0].rstrip(" ().-")
                if len(rest) > 1:
                    phone_end = at + 2 + len(rest)
                    if 10 <= 1 + sum(c.isdigit() for c in rest) <= 15:
                        found.append((at, 3, phone_end))
        elif what == "cue":
            word = (at == 0 or not text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalnum()
            if word and at >= account_end and (m := after_cue(text, last + 1, text[at : last + 1].lower())):
                account_end = m[1]
                found.append((m[0], 4, account_end))
        elif at >= link_end and (m := _ADDRESS.match(text, last + 1)):
            # What follows a further scheme in it ends where it ends, so it is looked at once.
            link_end = m.end()
            if "@" in m[0]:
                found.append((at, 5, link_end))
    found.sort()
    return [(KINDS[k], start, end) for start, k, end in found]


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.give_back()
    for batch in common.slices(batches):
        rows = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(t)] for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, _SPAN_TYPE)], ["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each document's whole text."""
    return common.doc_texts(docs).mapInArrow(_finder, f"doc_id long, spans {SPANS}")


def masked(text: str) -> str:
    """The text with each stretch of overlapping spans replaced by the name of its first kind."""
    out, at, name, until = [], 0, "", -1
    for kind, start, end in [*spans(text), ("", len(text), len(text))]:
        if start >= until or not kind:
            if until >= 0:
                out.append(f"[{name}]")
                at = until
            out.append(text[at:start])
            name, until = kind.upper(), end
        else:
            until = max(until, end)
    return "".join(out)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in ``text`` masked; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.give_back()
        for batch in common.slices(batches):
            texts = pa.array([None if t is None else masked(t) for t in batch["text"].to_pylist()], pa.string())
            k = batch.schema.get_field_index("text")
            yield pa.RecordBatch.from_arrays([texts if i == k else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.filter("spans", common.of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    extra = [F.size(F.filter("spans", common.of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[len(BASE) :]]
    return found.select("doc_id", *count, F.sha2(common.joined_spans(base).cast("binary"), 256).alias("base_sha256"), common.joined_spans(F.col("spans")).alias("spans"), *extra)
