"""Secret scans with multipart credential linking, in one narrow pass.

Strong findings stand alone: assignments, access identifiers and hexadecimal runs.
Weak candidates (a user or client name, a short value, a base64 run, an endpoint)
are common in clean text, so a weak candidate is reported only where parts that
complement it lie in the same scope, which is its paragraph.  Scopes and parts are
intervals; the nearest starts and ends among the sorted ones of identifiers, secrets and
endpoints answer which of them meet.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import as_text, row_pass, text_pass
from corpusmill.llm.spans import Span, digest, joined, masked

BASE = ("assign", "access", "hex")
#: Weak kinds, by the part of a credential that they may be.
WEAK = ("identifier", "secret", "endpoint")
KINDS = BASE + tuple(f"linked_{k}" for k in WEAK)

_ASSIGN = re.compile(r"""(?ai)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_CUE = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

_WEAK = {
    "identifier": re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:access_?key_?id|client_?id|user_?name|login|account_?id|user|uid)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9_.@-]{3,}|\bA[SRG][IO]A[A-Z0-9]{12,}"""),
    "secret": re.compile(r"""(?ai)(?<![A-Za-z0-9])(?:pwd|pass|secret|password|passwd|token|api_?key|client_?secret|private_?key)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9+/_.=-]{4,}|(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,38}[0-9])(?=[A-Za-z0-9+/]{0,38}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"""),
    "endpoint": re.compile(r"""(?ai)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|s3)://[^\s"'<>]{4,}|(?<![A-Za-z0-9])(?:host|endpoint|server|database_?url)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9_.:/-]{4,}"""),
}
#: The only identifier that needs neither ":" nor "=", as endpoints do.
_BARE = re.compile(r"(?ai)\bA[SRG][IO]A[A-Z0-9]{12,}")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind that are long enough."""
    found = []
    if _ASSIGN_CUE.search(text):
        found += [Span("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [Span("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [Span("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that a complementary part in their scope confirms.

    A weak identifier or endpoint needs a secret (weak or strong) in its paragraph; a weak
    secret needs an identifier or an endpoint.  Candidates inside a base span add nothing.
    """
    if ":" not in text and "=" not in text and not any(s.kind == "access" for s in base) and not _BARE.search(text):
        return []
    weak = [Span(kind, m.start(), m.end()) for kind, pattern in _WEAK.items() for m in pattern.finditer(text)]
    if not weak:
        return []
    strong = [Span("identifier" if s.kind == "access" else "secret", s.start, s.end) for s in base]
    breaks = [-1, *(m.start() for m in _PARAGRAPH.finditer(text)), len(text)]
    starts_of = {kind: sorted(s.start for s in (*weak, *strong) if s.kind == kind) for kind in WEAK}
    ends_of = {kind: sorted(s.end for s in (*weak, *strong) if s.kind == kind) for kind in WEAK}

    def meets(span: Span, kind: str) -> bool:
        """Whether a part of this kind ends before or starts after the span in its paragraph; no part crosses lines."""
        paragraph = bisect_right(breaks, span.start)
        starts, ends = starts_of[kind], ends_of[kind]
        before, after = bisect_right(ends, span.start), bisect_left(starts, span.end)
        return before > 0 and ends[before - 1] > breaks[paragraph - 1] or after < len(starts) and starts[after] < breaks[paragraph]

    needs = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
    by_start = sorted(base, key=lambda s: s.start)
    starts = [s.start for s in by_start]
    furthest = list(accumulate((s.end for s in by_start), max))  # of base spans that start up to here

    def inside(span: Span) -> bool:
        at = bisect_right(starts, span.start)
        return at > 0 and furthest[at - 1] >= span.end

    return [Span(f"linked_{s.kind}", s.start, s.end) for s in weak if not inside(s) and any(meets(s, k) for k in needs[s.kind])]


def secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans.

    Whole texts are scanned, in a time that follows their length.  A null or empty text has
    no spans: zeros, the hash of the empty string and an empty list.  Repeated rows give
    repeated results; an empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans")}
            for text in as_text(batch.column(1)):
                base = base_spans(text)
                linked = linked_spans(text, base)
                for kind in BASE:
                    out[f"n_{kind}"].append(sum(s.kind == kind for s in base))
                out["n_linked"].append(len(linked))
                out["base_sha256"].append(digest(joined(base, KINDS)))
                out["spans"].append(joined(base + linked, KINDS))
            yield out | {"doc_id": batch.column(0)}

    return text_pass(docs, "n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string", work)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by a mark that names its kind.

    No document goes.  Texts without a finding, nulls and all other columns stay as
    they are, but for an integer column ``n_chars``, which follows the new text.
    """
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index("text"))
            texts, changed = column.to_pylist(), {}
            for i, text in enumerate(texts):
                if text and (spans := base_spans(text)) + (linked := linked_spans(text, spans)):
                    changed[i] = masked(text, spans + linked)
            if changed:
                texts = [changed.get(i, t) for i, t in enumerate(texts)]
                columns = batch.columns
                columns[names.index("text")] = pa.array(texts, column.type)
                if "n_chars" in names and pa.types.is_integer(batch.column(names.index("n_chars")).type):
                    old = batch.column(names.index("n_chars"))
                    columns[names.index("n_chars")] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old.to_pylist())], old.type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return row_pass(docs, work)
