"""License scans: ordered signature rules behind a keyword prefilter.

Texts are reduced to lower-cased words joined by single spaces, which hold the license
wordings whatever their line breaks and punctuation.  An Aho-Corasick automaton finds
the rules' keywords in one reading; only rules of which a keyword occurs are matched, and
whatever a rule matches has one of its keywords at a word's start.
Overlapping detections are resolved by priority: one that lies within the interval of a
stronger one is suppressed.  Detections of the base phrases are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.llm.common import as_bytes, text_pass
from corpusmill.llm.license_clauses import ADDRESSES, CLAUSES

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, keywords of which every title and id has one (by commas), title as a pattern over normalised words, SPDX id as normalised words.
LICENSES = (
    ("0bsd", "bsd,0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?", "0bsd"),
    ("afl", "academic free", r"academic free license(?: (?:version |v)?[123] \d)?", "afl 3 0"),
    ("agpl", "affero", r"(?:gnu )?affero general public license(?: (?:version |v)?[13](?: 0)?)?", "agpl 3 0(?: only| or later)?"),
    ("apache-1.1", "apache", r"apache (?:software )?license (?:version |v)?1 1", "apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license (?:version |v)?2(?: 0)?", "apache 2 0"),
    ("artistic", "artistic", r"(?:perl )?artistic license(?: (?:version |v)?[12] 0)?", "artistic [12] 0"),
    ("blueoak", "blue oak", r"blue oak model license(?: 1 0 0)?", "blueoak 1 0 0"),
    ("bsd-2-clause", "bsd,freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd 4 clause"),
    ("bsl-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", r"business source license(?: (?:version )?1 1)?", "busl 1 1"),
    ("cc-by", "attribution", r"(?:creative commons )?attribution(?: (?:[1234] 0))? (?:international|unported|generic)(?: (?:public )?license)?", "cc by [1234] 0"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution noncommercial(?: [1234] 0)?(?: international)?(?: (?:public )?license)?", "cc by nc [1234] 0"),
    ("cc-by-nc-nd", "noderivatives", r"(?:creative commons )?attribution noncommercial noderivatives(?: [1234] 0)?(?: international)?(?: (?:public )?license)?", "cc by nc nd [1234] 0"),
    ("cc-by-nc-sa", "noncommercial", r"(?:creative commons )?attribution noncommercial sharealike(?: [1234] 0)?(?: international)?(?: (?:public )?license)?", "cc by nc sa [1234] 0"),
    ("cc-by-nd", "noderivatives", r"(?:creative commons )?attribution noderivatives(?: [1234] 0)?(?: international)?(?: (?:public )?license)?", "cc by nd [1234] 0"),
    ("cc-by-sa", "sharealike", r"(?:creative commons )?attribution sharealike(?: [1234] 0)?(?: international)?(?: (?:public )?license)?", "cc by sa [1234] 0"),
    ("cc0", "cc0", r"(?:creative commons (?:zero )?)?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cddl", "common development", r"common development and distribution license(?: (?:version )?1 [01])?", "cddl 1 [01]"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: free software)? license(?: agreement)?", r"cecill(?: [abc])?(?: [12] \d)?"),
    ("cpl", "common public", r"common public license(?: (?:version )?1 0)?", "cpl 1 0"),
    ("ecl-2.0", "educational community", r"educational community license(?: (?:version )?2 0)?", "ecl 2 0"),
    ("epl", "eclipse", r"eclipse public license(?: (?:version |v)?[12](?: 0)?)?", "epl [12] 0"),
    ("eupl", "european union public", r"european union public licen[cs]e(?: (?:version |v)?1 [012])?", "eupl 1 [012]"),
    ("fdl", "free documentation", r"(?:gnu )?free documentation license(?: (?:version )?1 [123])?", "gfdl 1 [123](?: only| or later)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license (?:as published by the free software foundation either )?(?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license (?:as published by the free software foundation either )?(?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("isc", "isc,internet systems consortium", r"(?:internet systems consortium|isc) license", "isc"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license (?:version |v)?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license (?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser general,library general", r"(?:gnu )?(?:lesser|library) general public license", "lgpl 2 0(?: only| or later)?"),
    ("lppl", "latex project", r"latex project public license(?: (?:version )?1 \d)?", r"lppl 1 \d"),
    ("mit-0", "mit no attribution", r"mit no attribution(?: license)?", "mit 0"),
    ("mpl-1.1", "mozilla", r"mozilla public license (?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license (?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("ms-pl", "microsoft public", r"microsoft public license", "ms pl"),
    ("mulan", "mulan", r"mulan (?:permissive software|psl)(?: license)?(?: (?:version |v)?[12])?", "mulanpsl [12] 0"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", "ncsa"),
    ("ofl", "open font", r"(?:sil )?open font license(?: (?:version )?1 [01])?", "ofl 1 [01]"),
    ("osl", "open software", r"open software license(?: (?:version |v)?[123] \d)?", "osl 3 0"),
    ("postgresql", "postgresql", r"postgresql license", "postgresql"),
    ("psf", "python software", r"python software foundation license(?: (?:version )?2)?", "psf 2 0"),
    ("ruby", "ruby", r"ruby license", "ruby"),
    ("sspl", "server side public", r"server side public license(?: (?:version |v)?1)?", "sspl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("upl", "universal permissive", r"universal permissive license(?: (?:version |v)?1 0)?", "upl 1 0"),
    ("vim", "vim", r"vim license", "vim"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public license", "wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib"),
    ("zpl", "zope", r"zope public license(?: (?:version )?2 [01])?", "zpl 2 [01]"),
)

#: How a license is named: a rule for each title, priority and weight. Keywords replace those of the title.
FORMS = (
    (r"spdx license identifier {spdx}", "spdx license identifier", 9, 1.0),
    (r"(?:re|dual )?licensed under (?:the )?(?:terms of )?(?:the )?{title}", None, 8, 0.98),
    (r"(?:released|distributed|available|published|covered|governed|provided) (?:\S+ ){{0,3}}under (?:the )?(?:terms of )?(?:the )?{title}", None, 7, 0.95),
    (r"(?:see|under|with|subject to|according to) the {title}", None, 6, 0.9),
    (r"{title}", None, 5, 0.8),
    (r"licen[cs]e (?:is )?{spdx}", "license,licence", 4, 0.8),
)


class Rule(NamedTuple):
    label: str
    keywords: str
    pattern: re.Pattern
    priority: int
    weight: float
    base: bool = False


def _pattern(words: str) -> re.Pattern:
    return re.compile(f"(?<= )(?:{words})(?= )")


def rules() -> list[Rule]:
    """All signature rules, in order of priority: base phrases, clauses, addresses, and each title and id in each form.

    Written by hand are the titles, ids, clauses and addresses; forms say how sure a mention of a title is.
    """
    out = [Rule(label, phrase, _pattern(phrase), 3, 0.7, True) for phrase, label in BASE]
    for label, keywords, title, spdx in LICENSES:
        out += [Rule(label, need or keywords, _pattern(form.format(title=title, spdx=f"(?:{spdx})")), priority, weight) for form, need, priority, weight in FORMS]
    for phrase, label in BASE:
        out += [Rule(label, phrase, _pattern(form.format(title=phrase, spdx=label)), priority - 1, weight - 0.05) for form, need, priority, weight in FORMS[1:4]]
    out += [Rule(label, keywords, _pattern(clause), 2, 0.75) for label, keywords, clause in (*CLAUSES, *ADDRESSES)]
    out.append(Rule("mit", "spdx license identifier", _pattern("spdx license identifier mit"), 9, 1.0))
    return sorted(out, key=lambda r: -r.priority)


class Detection(NamedTuple):
    start: int
    end: int
    rule: Rule


class Scanner:
    """Matches the rules against normalised texts; holds the automaton."""

    def __init__(self) -> None:
        import ahocorasick

        by_keyword: dict[str, list[int]] = {}
        self.rules = rules()
        for i, rule in enumerate(self.rules):
            for keyword in rule.keywords.split(","):
                by_keyword.setdefault(keyword, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for keyword, numbers in by_keyword.items():
            self.automaton.add_word(f" {keyword}", numbers)
        self.automaton.make_automaton()

    def detections(self, normalised: str) -> list[Detection]:
        """Matches of the rules of which a keyword occurs, in order of rules; ``normalised`` begins and ends with a space."""
        gated: set[int] = set()
        for _, numbers in self.automaton.iter(normalised):
            gated.update(numbers)
        return [Detection(*m.span(), self.rules[i]) for i in sorted(gated) for m in self.rules[i].pattern.finditer(normalised)]


def resolved(found: list[Detection]) -> list[Detection]:
    """Without detections inside the interval of one of higher priority, or of the same priority and longer or first.

    Kept intervals are sorted by start with the furthest end so far, so that each
    containment question is one search.
    """
    from bisect import bisect_right, insort

    kept: list[Detection] = []
    starts: list[tuple[int, int]] = []  # kept intervals that no other kept one contains: starts and ends both rise
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start)):
        at = bisect_right(starts, (d.start, float("inf")))
        if at and starts[at - 1][1] >= d.end:
            continue
        while at < len(starts) and starts[at][1] <= d.end:
            del starts[at]
        insort(starts, (d.start, d.end))
        kept.append(d)
    return kept


def scanned(scanner: Scanner, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """What ``license_scan`` returns of a text."""
    words = text.translate(_WORD_BYTES).split()
    normalised = f" {b' '.join(words).decode()} "
    found = scanner.detections(normalised)
    kept = resolved(found)
    base = sorted((d for d in found if d.rule.base), key=lambda d: d.start)
    first, last = (normalised.count(" ", 0, d.start) - 1 for d in (base[0], base[-1])) if base else (None, None)
    left = 1.0
    for d in kept:
        left *= 1 - d.rule.weight
    base_labels = {d.rule.label for d in base}
    labels = base_labels | {d.rule.label for d in kept}
    return len(words), len(base), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - left


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``first_word`` and ``last_word`` are the smallest and largest start of a base phrase,
    in words from 0, null without one.  ``score`` is how sure it is that the text names a
    license: one less the product of what its detections leave open.  A null or empty
    text has no words, no labels and score 0.  The time follows a text's length and how many
    rules its keywords call.  Repeated rows give repeated results; an empty table gives none.
    """

    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = Scanner()
        for batch in batches:
            rows = [scanned(scanner, text) for text in as_bytes(batch.column(1))]
            yield {"doc_id": batch.column(0), **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

    return text_pass(docs, "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", work)
