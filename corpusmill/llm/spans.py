"""Typed spans of a text and their one-line forms, shared by the scanners."""

from __future__ import annotations

import hashlib
from typing import NamedTuple


class Span(NamedTuple):
    """``kind`` from ``start`` to ``end`` (exclusive), in code points."""

    kind: str
    start: int
    end: int


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end of each span, by start, then by the kind's place in ``kinds``."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, order[s.kind], s.end)))


def digest(line: str) -> str:
    return hashlib.sha256(line.encode()).hexdigest()


def masked(text: str, spans: list[Span], mark: str = "[{}]") -> str:
    """The text with each run of overlapping spans replaced by the mark of its first kind."""
    out, at, end, kind = [], 0, -1, ""
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= end:
            if end >= 0:
                out.append(mark.format(kind))
                at = end
            out.append(text[at : span.start])
            end, kind = span.end, span.kind
        else:
            end = max(end, span.end)
    if end >= 0:
        out.append(mark.format(kind))
        at = end
    return "".join(out) + text[at:]
