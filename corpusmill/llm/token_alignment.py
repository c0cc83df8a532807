"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

Both tokenizations spell the same bytes.  Reading them side by side, one side is ahead of
the other by a suffix of its latest token, the residual.  A state is which side leads and
its residual; the lagging side's next token moves it to the next state.  Each move but a
group's first links that token with the leading one, and an empty residual closes the group.
Moves are memoised by state and token in a table of fixed size, so bytes are compared once for
each kind of move.

Where a space follows a byte that no token of either vocabulary has before a space, tokens of
both sides begin, so a group ends there.  The transducer therefore reads all such words of a
slice of documents at once, a move of each in one array step.

The first pass writes for each document its counts and how often it links each pair of ids.
Links are then counted corpus-wide, summed per batch before they are shuffled.  The highest
count of each id of the second vocabulary is broadcast, a row for each id.  Of the pairs, at
most ``FREQUENT`` of the highest counts are broadcast too and looked up where documents lie;
links of the rarer ones, which by then no pair has many of, meet in a join.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_text, cut, drop_cut, importable, text_pass

#: Moves that a worker remembers, as a power of two, and states it numbers before it starts anew.
MEMO_BITS = 18
STATES = 200_000
#: With fewer words than this left, moves are made one by one.
FEW = 32
#: Pairs of ids that are broadcast with their counts.
FREQUENT = 400_000
#: A pair is the first id times this and the second.
SECOND = 1 << 20

#: Fixed value: the 188 bytes that byte-level vocabularies write as the character of the same number.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    hidden = [b for b in range(256) if b not in _SHOWN]
    return {**{chr(b): b for b in _SHOWN}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class First:
    """Ids of the byte-level tokenizer, special strings taken as plain text, and each id's bytes."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The rank file of the same vocabulary is several times faster for characters whose classes are the same in every Unicode version.
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.plain = re.compile("[\x00-\u024f]*").fullmatch
        shown = byte_characters()
        self.bytes = [b""] * self.tokenizer.get_vocab_size(with_added_tokens=True)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(map(shown.__getitem__, token)) if all(c in shown for c in token) else token.encode()

    def ids(self, text: str) -> list[int]:
        """The ids of ``text``, none where they don't spell it."""
        if self.plain(text):
            return self.fast(text)
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return ids if b"".join(map(self.bytes.__getitem__, ids)) == text.encode() else []


class Second:
    """Ids of the sentence-piece tokenizer, which puts a space before the text, and each id's bytes."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class Words:
    """Where words start: at a space after a byte that no token of either side has before a space."""

    def __init__(self, vocabularies: tuple[list[bytes], list[bytes]]) -> None:
        inside = {t[i] for v in vocabularies for t in v for i in range(len(t) - 1) if t[i + 1] == 32}
        self.opens = [np.array([t[:1] == b" " for t in v]) for v in vocabularies]
        self.closes = [np.array([bool(t) and t[-1] not in inside for t in v]) for v in vocabularies]

    def starts(self, side: int, ids: np.ndarray, documents: np.ndarray) -> np.ndarray:
        """Whether each token starts a word; the first of each document, at ``documents``, does."""
        flags = np.zeros(len(ids), bool)
        flags[1:] = self.opens[side][ids[1:]] & self.closes[side][ids[:-1]]
        flags[documents] = True
        return flags


class Transducer:
    """Moves from state to state by the lagging side's next token.

    State 0 is the empty residual, where the first side reads.  Other even states are led by
    the first side, odd ones by the second.  A move to state -1 means that the bytes differ.
    """

    def __init__(self, first: list[bytes], second: list[bytes], memo_bits: int = MEMO_BITS, few: int = FEW) -> None:
        self.bytes, self.few = (first, second), few
        self.words = Words(self.bytes)
        self.shift = np.uint64(64 - memo_bits)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple[int, bytes], int] = {}
        self.residuals = {0: b""}
        size = 1 << (64 - int(self.shift))
        self.keys, self.moves = np.full(size, -1, np.int64), np.zeros(size, np.int64)

    def move(self, state: int, token: int) -> int:
        leader = state & 1
        residual = self.residuals[state]
        more = self.bytes[1 - leader if state else 0][token]
        if not state:
            leads, left = 0, more
        elif residual.startswith(more):
            leads, left = leader, residual[len(more) :]
        elif more.startswith(residual):
            leads, left = 1 - leader, more[len(residual) :]
        else:
            return -1
        if not left:
            return 0
        if (number := self.numbers.get((leads, left))) is None:
            number = self.numbers[leads, left] = 2 * len(self.numbers) + 2 + leads
            self.residuals[number] = left
        return number

    def _remembered(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The state after each move; those that the memo lacks are made once for each kind and take their place in it."""
        key = state << 20 | token
        place = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift
        after = self.moves[place]
        missed = np.flatnonzero(self.keys[place] != key)
        if len(missed):
            kinds, back = np.unique(key[missed], return_inverse=True)
            made = np.array([self.move(k >> 20, k & 0xFFFFF) for k in kinds.tolist()], np.int64)
            after[missed] = made[back]
            self.keys[place[missed]], self.moves[place[missed]] = key[missed], made[back]
        return after

    def read(self, a: np.ndarray, b: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(state after each move, whether the first side made it, documents whose sides differ).

        ``a`` and ``b`` are the sides' ids of several documents, ``a_starts`` and ``b_starts``
        where each document's begin; each has ids on both sides.  Moves are in reading
        order; of documents that differ they mean nothing.
        """
        if len(self.numbers) > STATES:
            self._forget()
        a_words, b_words = self.words.starts(0, a, a_starts), self.words.starts(1, b, b_starts)
        counted = np.add.reduceat(a_words, a_starts, dtype=np.int64), np.add.reduceat(b_words, b_starts, dtype=np.int64)
        states, by_first = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), bool)
        unlike = counted[0] != counted[1]
        if unlike.any():
            return states, by_first, np.flatnonzero(unlike)
        document = np.repeat(np.arange(len(a_starts)), counted[0])
        at, bt = np.flatnonzero(a_words), np.flatnonzero(b_words)
        a_end, b_end = np.append(at[1:], len(a)), np.append(bt[1:], len(b))
        place, state = at + bt, np.zeros(len(at), np.int64)
        differ: set[int] = set()
        while len(at) > self.few:
            first = (state & 1 == 1) | (state == 0)
            spent = np.where(first, at == a_end, bt == b_end)
            if spent.any():
                differ.update(document[spent].tolist())
                going = ~spent
                at, bt, a_end, b_end, place, state, document, first = (x[going] for x in (at, bt, a_end, b_end, place, state, document, first))
            state = self._remembered(state, np.where(first, a[np.minimum(at, len(a) - 1)], b[np.minimum(bt, len(b) - 1)]))
            states[place], by_first[place] = state, first
            at, bt, place = at + first, bt + ~first, place + 1
            going = (state > 0) | (state == 0) & ((at < a_end) | (bt < b_end))
            if not going.all():
                differ.update(document[state < 0].tolist())
                at, bt, a_end, b_end, place, state, document = (x[going] for x in (at, bt, a_end, b_end, place, state, document))
        for i, j, a_to, b_to, k, now, of in zip(*(x.tolist() for x in (at, bt, a_end, b_end, place, state, document)), strict=True):
            while now > 0 or now == 0 and (i < a_to or j < b_to):
                first = now & 1 == 1 or now == 0
                if i == a_to if first else j == b_to:
                    now = -1
                    break
                now = self.move(now, int(a[i] if first else b[j]))
                states[k], by_first[k] = now, first
                i, j, k = i + first, j + (not first), k + 1
            if now < 0:
                differ.add(of)
        return states, by_first, np.array(sorted(differ), np.int64)


class Writer:
    """Lines of groups: ids joined by commas, a bar between the sides, groups joined by semicolons.

    A token is a cell of a fixed number of bytes, zeros before its digits; the zeros then go.
    """

    def __init__(self, first: int, second: int) -> None:
        self.first = first
        width = len(str(max(first, second))) + 1
        cells = [f"{i}{c}".encode().rjust(width, b"\0") for n, last in ((first, "|"), (second, ";")) for i in range(n) for c in (",", last)]
        self.cells = np.frombuffer(b"".join(cells), np.uint8).reshape(-1, width)
        self.sizes = (self.cells != 0).sum(1)

    def lines(self, a: np.ndarray, b: np.ndarray, ends: tuple[np.ndarray, np.ndarray], to: np.ndarray) -> list[bytes]:
        """The line of each document; ``ends`` are the groups' ends on both sides, ``to`` the documents' ends in tokens of both."""
        x, y = 2 * a, 2 * (b + self.first)
        x[ends[0] - 1] += 1
        y[ends[1] - 1] += 1
        # A token's place: after its side's earlier tokens and the other side's of the groups before, or of its own.
        sizes = np.diff(ends[0], prepend=0), np.diff(ends[1], prepend=0)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.repeat(np.concatenate(([0], ends[1][:-1])), sizes[0])] = x
        code[np.arange(len(b)) + np.repeat(ends[0], sizes[1])] = y
        cells = self.cells[code].ravel()
        line = cells[cells != 0].tobytes()
        upto = np.cumsum(self.sizes[code])[to - 1].tolist()
        return [line[i : j - 1] for i, j in zip([0, *upto[:-1]], upto, strict=True)]


class Slice:
    """The alignment of a slice of documents: numbers of those that have tokens, and their groups and links."""

    def __init__(self, transducer: Transducer, first: list[list[int]], second: list[list[int]]) -> None:
        rows = [i for i, (a, b) in enumerate(zip(first, second, strict=True)) if a and b]
        while True:
            self.rows = np.array(rows, np.int64)
            self.n = tuple(np.array([len(x[i]) for i in rows], np.int64) for x in (first, second))
            if not rows:
                return
            self.a, self.b = (np.concatenate([np.array(x[i], np.int64) for i in rows]) for x in (first, second))
            starts = tuple(np.cumsum(n) - n for n in self.n)
            states, by_first, differ = transducer.read(self.a, self.b, *starts)
            if not len(differ):
                break
            # A document whose sides spell different bytes has no tokens; the others are read without it.
            gone = set(differ.tolist())
            rows = [r for i, r in enumerate(rows) if i not in gone]
        self.to = np.cumsum(self.n[0] + self.n[1])
        read = np.cumsum(by_first), np.cumsum(~by_first)
        closing = np.flatnonzero(states == 0)
        self.ends = read[0][closing], read[1][closing]
        self.groups = np.diff(np.searchsorted(closing, self.to), prepend=0)
        linked = np.flatnonzero(np.concatenate(([0], states[:-1])) != 0)
        pair = self.a[read[0][linked] - 1] * SECOND + self.b[read[1][linked] - 1]
        upto = np.searchsorted(linked, self.to)
        self.links = np.diff(upto, prepend=0)
        # Distinct pairs of each document and how often it links them.
        order = np.sort(np.repeat(np.arange(len(rows)) << 40, self.links) | pair)
        new = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        self.pairs, self.times = order[new] & ((1 << 40) - 1), np.diff(np.append(new, len(order)))
        self.distinct = np.bincount(order[new] >> 40, minlength=len(rows))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def aligned(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, model: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct pairs with their times, of each document, in one narrow pass."""

    def work(batches: Iterator[Any]) -> Iterator[dict]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first, second = First(vocabulary, ranks, pattern), Second(model)
        transducer, writer = Transducer(first.bytes, second.bytes), Writer(len(first.bytes), len(second.bytes))
        for batch in batches:
            texts = as_text(batch.column(1))
            found = Slice(transducer, [first.ids(" " + t) if t else [] for t in texts], second.ids(texts))
            out = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links", "distinct")}
            digests, pairs, times = [""] * len(texts), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if len(found.rows):
                for name, values in zip(out, (*found.n, found.groups, found.links, found.distinct), strict=True):
                    out[name][found.rows] = values
                for row, line in zip(found.rows.tolist(), writer.lines(found.a, found.b, found.ends, found.to), strict=True):
                    digests[row] = hashlib.sha256(line).hexdigest()
                pairs, times = found.pairs, found.times
            sizes = out.pop("distinct")
            columns = {name: pa.array(values) for name, values in out.items()}
            yield {"doc_id": batch.column(0), **columns, "groups_sha256": digests, "pairs": _lists(pairs, sizes), "times": _lists(times, sizes)}

    return text_pass(docs, "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>", work)


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, b, n): how many links of all ``rows`` hold each pair, summed per batch before the shuffle."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, at = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
            n = np.bincount(at, weights=batch.column(1).flatten().to_numpy(), minlength=len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n)], names=["pair", "n"])

    some = rows.select("pairs", "times").mapInArrow(summed, "pair bigint, n bigint")
    return some.groupBy("pair").agg(F.sum("n").alias("n")).select("pair", (F.col("pair") % SECOND).alias("b"), "n")


def token_alignment(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, model: str, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The first tokenizer encodes a space and the text, the second the text, to which it adds a space.  A
    text that is null, empty, or that a tokenizer does not spell back whole has no tokens:
    zeros and an empty ``groups_sha256``.  Whole texts are read, in a time that follows
    their length.  Repeated rows count and are given as often as they come; an empty table gives none.
    """
    importable(docs.sparkSession)
    rows = aligned(docs, vocabulary, ranks, pattern, model).withColumn("number", F.monotonically_increasing_id())
    rows = cut(rows, "aligned")
    counts = cut(_pair_counts(rows), "pairs")
    # A row for each id of the second vocabulary at most.
    highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("highest")))
    ranked = cut(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "ranked")
    drop_cut(counts)
    least = _least_frequent(ranked, frequent)
    top = ranked.where(F.col("n") >= least).toPandas()
    order = np.argsort(top["pair"].to_numpy())
    # A pair below all others stands for none.
    table = tuple(np.concatenate(([-1], top[c].to_numpy()[order].astype(np.int64))) for c in ("pair", "n", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(lists)), sizes)
            pair, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            known = pairs[at] == pair
            n_best, count_sum = np.zeros((2, len(lists)), np.int64)
            np.add.at(n_best, row[known], times[known] * best[at[known]])
            np.add.at(count_sum, row[known], times[known] * n[at[known]])
            rare = np.bincount(row[~known], minlength=len(lists))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_best), pa.array(count_sum), _lists(pair[~known], rare), _lists(times[~known], rare)], names=["number", "n_best", "count_sum", "rare", "times"])

    known = rows.select("number", "pairs", "times").mapInArrow(looked_up, "number bigint, n_best bigint, count_sum bigint, rare array<bigint>, times array<bigint>")
    known = cut(known, "looked-up")
    rare = known.where(F.size("rare") > 0).select("number", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("number", F.col("x.rare").alias("pair"), F.col("x.times").alias("times"))
    found = rare.join(ranked.where(F.col("n") < least), "pair").groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    whole = rows.join(known.select("number", "n_best", "count_sum"), "number").join(found, "number", "left")
    zero = F.lit(0).cast("bigint")
    best, total = (F.col(a) + F.coalesce(F.col(b), zero) for a, b in (("n_best", "more_best"), ("count_sum", "more")))
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", best.alias("n_best"), total.alias("count_sum"), "groups_sha256")


def _least_frequent(ranked: DataFrame, most: int) -> int:
    """A power of two that at most ``most`` pairs have as many links as."""
    power = F.floor(F.log2(F.col("n").cast("double"))).cast("int").alias("power")
    # A row for each power of two.
    sizes = {r["power"]: r["count"] for r in ranked.groupBy(power).count().collect()}
    total, least = 0, 1 << (max(sizes, default=0) + 1)
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > most:
            break
        least = 1 << p
    return least
