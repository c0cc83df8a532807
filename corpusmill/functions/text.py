"""Text functions with the semantics of the source language's string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that count as white space in ``strip`` and ``split``.
SPACE = r"\t-\r\x1c-\x20\x85\xa0  -     　"


def strip(text: Column) -> Column:
    """Without white space at both ends; all of Unicode's, not only the space."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def split_words(text: Column) -> Column:
    """Words between runs of white space; no empty ones."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def collapse_space(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.array_join(split_words(text), " ")


def lines(text: Column) -> Column:
    """Lines as a universal-newline splitter gives them; no empty line after a final break."""
    return F.split(F.regexp_replace(text, r"(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])\z", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def short_hash(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def chunk_id(path: Column, line_start: Column, content: Column) -> Column:
    """First 16 hex digits of sha256 of ``path:line:content``; a missing line is 0."""
    return short_hash(F.concat_ws(":", path, F.coalesce(line_start, F.lit(0)).cast("string"), content))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def strip_code_fences(text: Column) -> Column:
    """What lies inside a fence that wraps the whole reply, else the reply; stripped."""
    bare = strip(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"\A```[^\n]*(?:\n|\z)", ""), r"(?:\A|\n)[ \t]*```[^\n]*\z", "")
    return F.when(bare.startswith("```"), strip(inner)).otherwise(bare)


def count_of(text: Column, needle: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("bigint")


def luhn_valid(digits: Column, least: int = 13) -> Column:
    """Luhn's checksum over the digits of a text that has ``least`` of them."""
    only = F.regexp_replace(digits, "[^0-9]", "")
    return (F.length(only) >= least) & F.call_function("luhn_check", only)


def unfenced(text: str) -> str:
    """``strip_code_fences`` of a plain string."""
    import re

    fenced = re.fullmatch(r"```[^\n]*(?:\n(.*?))?(?:\n[ \t]*```[^\n]*)?", text.strip(), re.S)
    return (fenced[1] or "").strip() if fenced else text.strip()
