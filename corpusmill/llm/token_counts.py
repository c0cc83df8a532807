"""Token counts by a two-tier lookup of pre-token lengths, in one narrow pass.

Tier one is a compact hash table of frequent pre-tokens with their lengths in tokens,
counted on a bounded sample and given to every worker by broadcast.  Tier two is a bounded
cache in each worker for what the table lacks; what the cache lacks is encoded by the
library.  No pre-token is ever shuffled.  The sample decides how many words the table
answers, never a count: the pass itself covers every whole text.
"""

from __future__ import annotations

import re
from collections import Counter as Tally
from collections.abc import Iterator
from itertools import chain, repeat
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_text, id_and_text, text_pass

#: Unicode's White_Space characters, which never lie inside a pre-token.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Fixed value: how the tokenizer's file splits normalised text.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Entries that a worker's cache may hold before it starts anew.
CACHE_ENTRIES = 700_000


#: The sample that frequent pre-tokens are counted on: the first rows that a scan gives, of texts up to this long.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 20_000
#: Entries of the broadcast table, and how long one may be.
FREQUENT = 20_000
FREQUENT_CHARS = 40


def frequent_lengths(docs: DataFrame, vocabulary: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> dict[str, int]:
    """The sample's most frequent words between white space, and pre-tokens in them, with their lengths in tokens.

    ``rows`` texts of bounded length come to the driver, whatever the size of the table,
    and the scan ends with them.
    """
    counter = Counter(vocabulary, {})
    sample = id_and_text(docs).select("text").where(F.length("text") <= SAMPLE_CHARS).take(rows)
    words = Tally(chain.from_iterable(counter.split_words(r["text"]) for r in sample))
    tally = Tally({w: n for w, n in words.items() if len(w) <= FREQUENT_CHARS and not counter.special(w)})
    for word, n in list(tally.items()):
        if counter.plain(word) and (parts := counter.split_word(word.lower())) != [word]:
            for part in parts:
                tally[part] += n
    frequent = sorted(tally, key=lambda w: (-tally[w], w))[:most]
    return dict(zip(frequent, counter.count(frequent), strict=True))


class Counter:
    """Counts tokens of texts as the tokenizer in ``vocabulary`` does."""

    def __init__(self, vocabulary: str, frequent: dict[str, int], entries: int = CACHE_ENTRIES) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.table = frequent
        self.entries = entries
        self.pre_tokens = self._known()
        self.words: dict[str, int] = {}
        self.split_words = re.compile(f"[^{WHITE_SPACE}]+").findall
        self.split_word = regex.compile(PRE_TOKEN).findall
        self.split_lines = regex.compile(f"{PRE_TOKEN}|\n").findall
        #: Up to here lower-casing and composition act on single characters, and classes are the same in every Unicode version.
        self.plain = re.compile("[\x00-ɏ]*").fullmatch
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())).search

    def _encode(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Put the counts of words without white space into the cache.

        Words meet the splitting expression together, a line each, since most are short.
        """
        if len(self.words) + len(words) > self.entries:
            self.words.clear()
        plain = [w for w in words if self.plain(w)]
        odd = list(words.difference(plain))
        self.words.update(zip(odd, self._encode(odd), strict=True))
        parts = self.split_lines("\n".join(plain).lower())
        distinct = set(parts)
        new = list(distinct.difference(self.pre_tokens))
        if len(self.pre_tokens) + len(new) > self.entries:
            self.pre_tokens = self._known()
            new = list(distinct.difference(self.pre_tokens))
        self.pre_tokens.update(zip(new, self._encode(new), strict=True))
        sums = np.cumsum(np.fromiter(map(self.pre_tokens.__getitem__, parts), np.int64, len(parts)))
        ends = np.append(np.flatnonzero(np.fromiter(map("\n".__eq__, parts), bool, len(parts))), len(parts)) - 1
        if plain:
            upto = np.where(ends >= 0, sums[ends], 0) if len(sums) else np.zeros(len(plain), np.int64)
            self.words.update(zip(plain, np.diff(upto, prepend=0).tolist(), strict=True))

    def _known(self) -> dict[str, int]:
        """The pre-tokens that the table has, and the line break, which stands between words and counts nothing."""
        return self.table | {"\n": 0}

    def count(self, texts: list[str]) -> list[int]:
        # A special string inside a text is one token by the library's default; such texts go to it whole.
        whole = {i for i, t in enumerate(texts) if self.special(t)}
        split = [[] if i in whole else self.split_words(t) for i, t in enumerate(texts)]
        words = list(chain.from_iterable(split))
        lengths = np.fromiter(map(self.table.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(lengths < 0)
        if len(rare):
            missed = [words[i] for i in rare.tolist()]
            cached = np.fromiter(map(self.words.get, missed, repeat(-1)), np.int64, len(missed))
            unknown = np.flatnonzero(cached < 0).tolist()
            if unknown:
                self._learn({missed[i] for i in unknown})
                cached[unknown] = [self.words[missed[i]] for i in unknown]
            lengths[rare] = cached
        ends = np.cumsum([len(x) for x in split])
        sums = np.concatenate(([0], np.cumsum(lengths)))
        out = (sums[ends] - sums[np.concatenate(([0], ends[:-1]))]).tolist() if texts else []
        for i in whole:
            out[i] = self._encode([texts[i]])[0]
        return out


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, entries: int = CACHE_ENTRIES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), one row per document.

    Whole texts are counted, with neither begin, end nor padding.  A null text is empty:
    0 bytes, 0 tokens.  Very long texts and words take a time that follows their length.
    Repeated rows give repeated results; an empty table gives none.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, vocabulary))

    def work(batches: Iterator[Any]) -> Iterator[dict]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = Counter(vocabulary, broadcast.value, entries)
        for batch in batches:
            texts = as_text(batch.column(1))
            tokens = counter.count(texts)
            yield {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return text_pass(docs, "n_bytes bigint, n_tokens bigint, over_limit boolean", work)
