"""Personal data and secrets by ordered patterns: scan, redact, count.

Fixed values: the patterns below, their order, kinds and severities are what results
depend on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.shared import bounded, importable


class Pattern(NamedTuple):
    type: str
    category: str
    severity: str
    description: str
    regex: str
    flags: int = 0


# Fixed values, in order of priority.
PATTERNS = (
    Pattern("email", "pii", "medium", "Email address", r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)*\.[a-zA-Z]{2,}"),
    Pattern("phone_us", "pii", "medium", "US phone number", r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"),
    Pattern("phone_intl", "pii", "medium", "International phone number", r"\+(?:[0-9]{1,3})[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}"),
    Pattern("ssn", "pii", "critical", "Social Security Number", r"\b(?!000|666|9[0-9]{2})([0-8][0-9]{2}|7[0-5][0-9]|76[0-6])[-](?!00)[0-9]{2}[-](?!0000)[0-9]{4}\b"),
    Pattern("credit_card", "pii", "critical", "Credit card number", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35[0-9]{3})[0-9]{11})\b"),
    Pattern("private_ip", "pii", "low", "Private/internal IP address", r"\b(?:10\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.(?:[0-9]{1,3}\.)[0-9]{1,3}|192\.168\.(?:[0-9]{1,3}\.)[0-9]{1,3}|127\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}|169\.254\.(?:[0-9]{1,3}\.)[0-9]{1,3}|0\.0\.0\.0|::1|fc[0-9a-f]{2}:|fd[0-9a-f]{2}:)\b"),
    Pattern("dob", "pii", "medium", "Date of birth", r"\b(?:birth\s*(?:date|day)\s*[:#]?\s*|dob\s*[:#]?\s*)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", re.I),
    Pattern("aws_access_key", "secret", "critical", "AWS Access Key ID", r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b"),
    Pattern("aws_secret_key", "secret", "critical", "AWS Secret Access Key", r"aws.{0,20}?(?:secret|key|token).{0,20}?[:\s=]+[A-Za-z0-9/+=]{40}\b", re.I),
    Pattern("github_token", "secret", "critical", "GitHub personal access token", r"(?:ghp_|gho_|ghu_|ghs_|ghf_|github_pat_)[a-zA-Z0-9_]{36,}"),
    Pattern("gitlab_token", "secret", "critical", "GitLab personal access token", r"\bglpat-[a-zA-Z0-9_\-]{20,}\b"),
    Pattern("hf_token", "secret", "critical", "Hugging Face token", r"\bhf_[a-zA-Z0-9]{32,}\b"),
    Pattern("slack_token", "secret", "critical", "Slack token", r"\bxox[abeprs]-[a-zA-Z0-9-]{24,}\b"),
    Pattern("stripe_key", "secret", "critical", "Stripe API key", r"\b(?:sk|pk)_(?:live|test)_[a-zA-Z0-9]{24,}\b"),
    Pattern("anthropic_key", "secret", "critical", "Anthropic API key", r"\bsk-ant-[a-zA-Z0-9\-_]{32,}\b"),
    Pattern("openai_key", "secret", "critical", "OpenAI API key", r"\bsk-(?:proj-)?[a-zA-Z0-9\-_]{20,}\b"),
    Pattern("openrouter_key", "secret", "critical", "OpenRouter API key", r"\bsk-or-[a-zA-Z0-9\-_]{16,}\b"),
    Pattern("bearer_token", "secret", "high", "Bearer token / API key", r"(?:(?:bearer|token|apikey|api_key|api-key|secret)[:\s=]+)[a-zA-Z0-9_\-\.]{16,64}", re.I),
    Pattern("jwt_token", "secret", "high", "JWT token", r"\beyJ[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+\b"),
    Pattern("ssh_private_key", "secret", "critical", "SSH private key", r"-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|SSH)\s+PRIVATE\s+KEY-----[A-Za-z0-9+/=\s]+?-----END\s+(?:RSA|DSA|EC|OPENSSH|SSH)\s+PRIVATE\s+KEY-----", re.S),
    Pattern("google_api_key", "secret", "critical", "Google API key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    Pattern("connection_string", "secret", "high", "Connection string with password", r"(?:password|pwd|passwd|connection)[:\s=]+[^\s,;'\"]{8,100}", re.I),
)
# A line with one of these has no findings.
FALSE_POSITIVES = (r"@example\.(?:com|org|net)\b", r"\b192\.168\.\d{1,3}\.\d{1,3}\b")
SEVERITIES = ("critical", "high", "medium", "low")

# What every match of a pattern holds, lower-cased: texts without it are not searched for the pattern.
GATES = {
    "email": "@",
    "phone_us": "[0-9]{3}",
    "phone_intl": r"\+[0-9]",
    "ssn": "[0-9]-[0-9]{2}-[0-9]",
    "credit_card": "[0-9]{13}",
    "private_ip": r"10\.|172\.|192\.168|127\.|169\.254|0\.0\.0|::1|f[cd][0-9a-f]{2}:",
    "dob": "birth|dob",
    "aws_access_key": "akia|asia|abia|acca",
    "aws_secret_key": "aws",
    "github_token": "gh[poushf]_|github_pat_",
    "gitlab_token": "glpat-",
    "hf_token": "hf_",
    "slack_token": "xox",
    "stripe_key": "_live_|_test_",
    "anthropic_key": "sk-",
    "openai_key": "sk-",
    "openrouter_key": "sk-",
    "bearer_token": "bearer|token|api_?-?key|secret",
    "jwt_token": "eyj",
    "ssh_private_key": "-----begin",
    "google_api_key": "aiza",
    "connection_string": "password|pwd|passwd|connection",
}

FINDINGS = "array<struct<type:string,value:string,start:int,end:int,severity:string,category:string,description:string>>"


@dataclass(frozen=True)
class PiiOptions:
    pii: bool = True
    secrets: bool = True
    redact: bool = True
    placeholder: str = "[REDACTED: {type}]"
    validate_cards: bool = True


class Finder:
    """Scans texts with the patterns that the options turn on."""

    def __init__(self, options: PiiOptions | None = None) -> None:
        self.options = options or PiiOptions()
        wanted = {c for c, on in (("pii", self.options.pii), ("secret", self.options.secrets)) if on}
        self.patterns = [(p, re.compile(p.regex, p.flags), re.compile(GATES[p.type]).search) for p in PATTERNS if p.category in wanted]
        self.safe = re.compile("|".join(FALSE_POSITIVES), re.I)

    def findings(self, text: str) -> list[tuple[Pattern, int, int]]:
        """In order of patterns: a match stands unless its line is excluded, its checksum fails or it meets one that stands; sorted by start."""
        from bisect import bisect_left, insort

        kept: list[tuple[int, int]] = []
        breaks = [m.start() for m in re.finditer("\n", text)]
        excluded: dict[tuple[int, int], bool] = {}  # by first and last line
        out: list[tuple[Pattern, int, int]] = []
        # Case folding of the ignoring patterns goes beyond ASCII for these letters.
        low = text.lower().replace("\u017f", "s").replace("\u0131", "i")
        for pattern, regex, gate in self.patterns:
            if not gate(low):
                continue
            for m in regex.finditer(text):
                start, end = m.span()
                lines = bisect_left(breaks, start), bisect_left(breaks, end)
                if lines not in excluded:
                    a, b = lines
                    excluded[lines] = bool(self.safe.search(text, breaks[a - 1] + 1 if a else 0, breaks[b] if b < len(breaks) else len(text)))
                if excluded[lines]:
                    continue
                if pattern.type == "credit_card" and self.options.validate_cards and not luhn(m[0]):
                    continue
                # Kept spans are disjoint, so only the neighbours by start can meet this one.
                place = bisect_left(kept, (start, end))
                if place < len(kept) and kept[place][0] < end or place and kept[place - 1][1] > start:
                    continue
                insort(kept, (start, end))
                out.append((pattern, start, end))
        return sorted(out, key=lambda f: f[1])

    def redacted(self, text: str, found: list[tuple[Pattern, int, int]]) -> str:
        if not self.options.redact:
            return text
        parts, at = [], 0
        for pattern, start, end in found:
            parts += [text[at:start], self.options.placeholder.format(type=pattern.type)]
            at = end
        return "".join(parts) + text[at:]


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return len(digits) >= 13 and sum(doubled) % 10 == 0


def scan(rows: DataFrame, text: str, options: PiiOptions | None = None) -> DataFrame:
    """Adds findings and redacted_text to ``rows``, in one Arrow pass; a null text has none and stays null."""
    from pyspark.sql import types as T

    importable(rows.sparkSession)
    at = rows.columns.index(text)
    added = T.StructType.fromDDL(f"findings {FINDINGS}, redacted_text string").fields
    fields = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, finder = to_arrow_schema(fields), Finder(options)
        for batch in bounded(batches):
            found, texts = [], batch.column(at).to_pylist()
            redacted = []
            for t in texts:
                f = finder.findings(t) if t else []
                found.append([{"type": p.type, "value": t[a:b], "start": a, "end": b, "severity": p.severity, "category": p.category, "description": p.description} for p, a, b in f])
                redacted.append(finder.redacted(t, f) if t else t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, schema.field("findings").type), pa.array(redacted, pa.string())], names=schema.names)

    return rows.mapInArrow(run, fields)


def _count(findings: Column, severity: str) -> Column:
    return F.size(F.filter(findings, lambda f: f["severity"] == severity))


def severity_counts(findings: Column) -> dict[str, Column]:
    """A column for each severity's count, the total, and has_critical and has_high."""
    counts = {f"{s}_count": _count(findings, s) for s in SEVERITIES}
    return {"total": F.size(findings), **counts, "has_critical": counts["critical_count"] > 0, "has_high": counts["high_count"] > 0}


def summary(findings: Column) -> Column:
    """A line such as: PII scan: 3 findings (1 critical, 2 medium)."""
    parts = F.array_compact(F.array(*[F.when((n := _count(findings, s)) > 0, F.concat(n.cast("string"), F.lit(f" {s}"))) for s in SEVERITIES]))
    return F.concat(F.lit("PII scan: "), F.size(findings).cast("string"), F.lit(" findings ("), F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("none"), F.lit(")"))


def pattern_hits(text: Column, type: str) -> Column:
    """Matches of one pattern, native; all but one pattern mean the same in both dialects, given Unicode classes."""
    pattern = next(p for p in PATTERNS if p.type == type)
    flags = "(?U)" + ("(?i)" if pattern.flags & re.I else "") + ("(?s)" if pattern.flags & re.S else "(?d)")
    return F.regexp_extract_all(text, F.lit(flags + pattern.regex), F.lit(0))


def pattern_count(text: Column, type: str) -> Column:
    """How many matches of one pattern, native; texts without what every match holds are not searched for it."""
    low = F.translate(F.lower(text), "\u017f\u0131", "si")
    return F.when(F.regexp_like(low, F.lit(GATES[type])), F.size(pattern_hits(text, type))).otherwise(0)


def safe_line(line: Column) -> Column:
    """Whether findings on this line would be suppressed."""
    return F.regexp_like(line, F.lit("(?iU)" + "|".join(FALSE_POSITIVES)))
