"""Personal data by anchor expansion, in one narrow pass.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, plus
signs, schemes, digits and identifier cues.  From each anchor a deterministic local
parser expands to the boundaries of an email, network address or account number and
validates it.  Text without anchors is read once by the automaton and never parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import as_text, text_pass
from corpusmill.llm.spans import Span, digest, joined

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

#: Anchors by what they call for.
ANCHORS = {
    "email": ("@",),
    "phone": ("+",),
    "digit": tuple("0123456789"),
    "url": ("http://", "https://", "ftp://"),
    "cue": ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT", "ssn", "SSN", "passport", "Passport", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta"),
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").match
_URL = re.compile(r"[^\s<>\"'{}|\\^`]+").match
#: A cue's word may go on for this many letters: "accounts", "Kontonummer".
_REST = re.compile(r"[A-Za-z]{0,16}").match
_IBAN = re.compile(r"[\s:#=]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])").match
_ACCOUNT = re.compile(r"[\x20]?(?:no|nr|number|num|id)?\.?[\x20]{0,2}[:#=][\x20]{0,2}([0-9][0-9-]{5,38}[0-9])(?![0-9A-Za-z])").match


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _iban_holds(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


class Scanner:
    """Finds the spans of a text; holds the automaton."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, strings in ANCHORS.items():
            for s in strings:
                self.automaton.add_word(s, (kind, len(s)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans: base kinds exactly as leftmost non-overlapping matching finds them, then the method's own.

        A dotted or a spaced run of digits is maximal from its first digit on, so each
        run is parsed once, at its first anchor, and later anchors inside it are passed by.
        A cue's word and what follows it are parsed up to a fixed distance, and cues inside
        that word are passed by, so the time follows the text's length.
        """
        found: list[Span] = []
        email_end = phone_end = dotted_end = digits_end = url_end = cue_end = 0
        for last, (kind, length) in self.automaton.iter(text):
            at = last - length + 1
            if kind == "digit":
                if at >= dotted_end:
                    m = _DOTTED(text, at)
                    dotted_end = m.end()
                    if m.group().count(".") >= 3:
                        self._ips(m.group(), at, found)
                if at >= digits_end:
                    m = _DIGITS(text, at)
                    digits_end = m.end() if m else at + 1
                    if m and digits_end - at >= 14:
                        digits = m.group().replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            found.append(Span("card", at, digits_end))
            elif kind == "email":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN(text, at + 1)):
                    found.append(Span("email", start, m.end()))
                    email_end = m.end()
            elif kind == "phone":
                if at >= phone_end and (m := _PHONE(text, at)):
                    phone_end = m.end()
                    if 10 <= sum(map(m.group().count, "0123456789")) <= 15:
                        found.append(Span("phone", at, phone_end))
            elif kind == "url":
                if at >= url_end and (m := _URL(text, last + 1)):
                    end = m.end()
                    while end > last + 1 and text[end - 1] in ".,;:!?)]":
                        end -= 1
                    if end > last + 1:
                        found.append(Span("url", at, end))
                        url_end = end
            elif at >= cue_end:
                cue_end = _REST(text, last + 1).end()
                if m := _IBAN(text, cue_end):
                    if _iban_holds(m.group(1)):
                        found.append(Span("iban", *m.span(1)))
                elif m := _ACCOUNT(text, cue_end):
                    found.append(Span("account", *m.span(1)))
        return found

    @staticmethod
    def _ips(run: str, at: int, found: list[Span]) -> None:
        """Each four parts of a dotted run in turn are one candidate."""
        parts, start = run.split("."), at
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                found.append(Span("ip", start, end))
            start = end + 1


def pii_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_other, base_sha256, spans.

    Whole texts are scanned, in a time that follows their length.  A null or empty text has
    no spans: zeros, the hash of the empty string and an empty list.  Repeated rows give
    repeated results; an empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = Scanner()
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "n_other", "base_sha256", "spans")}
            for text in as_text(batch.column(1)):
                spans = scanner.spans(text)
                base = [s for s in spans if s.kind in BASE]
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(s.kind == kind for s in base))
                out["n_other"].append(len(spans) - len(base))
                out["base_sha256"].append(digest(joined(base, KINDS)))
                out["spans"].append(joined(spans, KINDS))
            yield out | {"doc_id": batch.column(0)}

    return text_pass(docs, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_other bigint, base_sha256 string, spans string", work)
