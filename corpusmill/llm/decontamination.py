"""Benchmark decontamination by winnowing.

Words are hashed; of every ``SPAN`` - k + 1 neighbouring k-gram hashes the smallest is
kept.  Two texts that share a span of ``SPAN`` words keep at least one k-gram of it in
common, so joining the kept ones finds every such span.  Each hit is then extended: of
the windows of ``SPAN`` words around it those count that an item has, word for word, and
windows side by side make up the longest shared span.

A benchmark of up to ``BLOCK_BYTES`` is broadcast and documents pass by it in one narrow
pass.  A larger one stays a table: a filter of bounded size with its kept hashes is
broadcast, documents pass by that, once, and the windows around what passes meet the
items' windows in a join.  Documents' texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import as_bytes, cut, drop_cut, drop_suspects, hot_join, id_and_text, importable, pick, plain_names, slices, text_hash

SPAN = 13
K = 8
#: Bytes of texts and names that a broadcast benchmark may have.
BLOCK_BYTES = 16_000_000

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, digits and all characters above ASCII."""
    return text.translate(_WORD_BYTES).split()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring words."""
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i]
    return out ^ (out >> np.uint64(29))


def winnow(hashes: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the rightmost smallest k-gram hash of every window of span - k + 1; none for under ``span`` words."""
    if len(hashes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g, size = grams(hashes, k), span - k + 1
    n = len(g) - size + 1
    least, place = g[:n].copy(), np.arange(n)
    for i in range(1, size):
        here = g[i : i + n]
        lower = here <= least
        least = np.where(lower, here, least)
        place = np.where(lower, np.arange(i, i + n), place)
    place = np.unique(place)
    return place, g[place]


def hashes_of(split: list[bytes]) -> np.ndarray:
    """A hash of each word, this process's own."""
    return np.fromiter(map(hash, split), np.int64, len(split)).view(np.uint64)


class Index:
    """Fingerprints and windows of a block of items; word hashes are this process's own, so it is built in each worker."""

    def __init__(self, items: list[tuple[object, bytes]], span: int = SPAN, k: int = K) -> None:
        self.span, self.k = span, k
        self.names = [name for name, _ in items]
        self.items = [words(text) for _, text in items]
        kept, windows, owners, starts = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int32, np.int32))
        #: Items of fewer words are one window each: their whole hash, by number of words.
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, item in enumerate(self.items):
            if 0 < len(item) < span:
                self.short[len(item)][tuple(item)].append(number)
            elif item:
                h = hashes_of(item)
                kept.append(winnow(h, span, k)[1])
                windows.append(grams(h, span))
                owners.append(np.full(len(item) - span + 1, number, np.int32))
                starts.append(np.arange(len(item) - span + 1, dtype=np.int32))
        self.kept = np.unique(np.concatenate(kept))
        # A table of the hashes' low bits turns most k-grams away before the search.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.kept & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        #: Each item's distinct windows, sorted by hash: hash, item, place of its first word.
        window, owner, start = map(np.concatenate, (windows, owners, starts))
        order = np.lexsort((owner, window))
        window, owner = window[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1]) | (owner[1:] != owner[:-1])))) if len(window) else order
        self.windows, self.owner, self.start = window[first], owner[first], start[order][first]
        self.short_hashes = {n: np.unique(np.concatenate([grams(hashes_of(list(t)), n) for t in table])) for n, table in self.short.items()}

    def hits(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans of ``doc`` inside occurrences of windows, apart and in order, and the numbers of the items that have one.

        The time follows the words of the document and what the index has of its windows,
        not pairs of places, however often a word is repeated.
        """
        hashes = hashes_of(doc)
        touched = np.zeros(len(doc) + 1, np.int64)
        items: set[int] = set()
        for at in self._windows(doc, hashes, items):
            touched[at] += 1
            touched[at + self.span] -= 1
        for n, table in self.short.items():
            known: dict[tuple[bytes, ...], bool] = {}
            for at in np.flatnonzero(np.isin(grams(hashes, n), self.short_hashes[n])).tolist() if len(doc) >= n else ():
                window = tuple(doc[at : at + n])
                if window not in known:
                    known[window] = window in table
                    items.update(table.get(window, ()))
                if known[window]:
                    touched[at] += 1
                    touched[at + n] -= 1
        inside = np.concatenate(([False], np.cumsum(touched)[:-1] > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
        return list(zip(edges[::2], edges[1::2], strict=True)), items

    def _windows(self, doc: list[bytes], hashes: np.ndarray, items: set[int]) -> list[int]:
        """Where windows of ``span`` words start that an item has; adds the items' numbers to ``items``."""
        if len(doc) < self.span or not len(self.kept):
            return []
        place, g = winnow(hashes, self.span, self.k)
        likely = self.filter[(g & np.uint64((1 << 20) - 1)).astype(np.int64)]
        place, g = place[likely], g[likely]
        place = place[self.kept[np.minimum(np.searchsorted(self.kept, g), len(self.kept) - 1)] == g]
        if not len(place):
            return []
        # The windows around a hit are those that contain its k-gram.
        around = np.zeros(len(doc) + 1, np.int64)
        np.add.at(around, np.maximum(place - (self.span - self.k), 0), 1)
        np.add.at(around, place + 1, -1)
        starts = np.flatnonzero(np.cumsum(around)[: len(doc) - self.span + 1] > 0)
        g = grams(hashes, self.span)[starts]
        left = np.minimum(np.searchsorted(self.windows, g), len(self.windows) - 1)
        same = self.windows[left] == g
        found = []
        for at, where in zip(starts[same].tolist(), left[same].tolist(), strict=True):
            there = self.start[where]
            if doc[at : at + self.span] == self.items[self.owner[where]][there : there + self.span]:
                found.append((at, where))
        for where in {w for _, w in found}:
            items.update(self.owner[where : np.searchsorted(self.windows, self.windows[where], "right")].tolist())
        return [at for at, _ in found]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in the union of spans."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id as a string, text) of all items; a null id is the name "" and a null text has no words."""
    return pick(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _hit(ends: list[int]) -> int:
    """Words in spans, given as starts and ends in turn."""
    return covered(list(zip(ends[::2], ends[1::2], strict=True)))


def _contaminated(n: list[int], hit: list[int]) -> list[bool]:
    return [h > 0 and 20 * h >= k for k, h in zip(n, hit, strict=True)]


# A benchmark of one block: broadcast whole


#: The index that this worker process built last, and the items it is of.
_built: list = []


def _index(items: list[tuple[str, bytes]]) -> Index:
    """The index of a broadcast block, built once a worker process and not once a task."""
    if not _built or _built[0] is not items:
        _built[:] = [items, Index(items)]
    return _built[1]


def _past_block(docs: DataFrame, items: DataFrame, finish: Callable, schema: T.StructType) -> DataFrame:
    """One narrow pass of ``docs`` with finish(batch, words, words hit, names of items)."""
    at = docs.columns.index("text")
    importable(docs.sparkSession)
    block = docs.sparkSession.sparkContext.broadcast([(r["name"], r["text"].encode()) for r in items.collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(block.value)
        for batch in slices(batches, at):
            split = [words(t) for t in as_bytes(batch.column(at))]
            hit, names = [], []
            for doc in split:
                found, numbers = index.hits(doc) if doc else ((), ())
                hit.append(covered(list(found)))
                names.append(sorted({index.names[n] for n in numbers}))
            yield finish(batch, [len(w) for w in split], hit, names)

    return docs.mapInArrow(run, schema)


# A larger benchmark: fingerprints in a filter, windows in a join


#: 64-bit words of the filter at most, and bits for each fingerprint where they suffice for that.
FILTER_WORDS = 1 << 21
BITS_EACH = 32
PROBES = 4


def stable_hashes(split: list[bytes]) -> np.ndarray:
    """A hash of each word, the same in every process."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, split), np.uint64, len(split))


def _window_hashes(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every n neighbouring words."""
    other = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return grams(hashes, n), grams(other, n)


def _probes(keys: np.ndarray, words_: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bit) of each probe of the filter."""
    for i in range(PROBES):
        mixed = (keys ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        yield (mixed >> np.uint64(6)) % np.uint64(words_), mixed & np.uint64(63)


def _passes(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for word, bit in _probes(keys, len(filled)):
        out &= (filled[word.astype(np.int64)] >> bit) & np.uint64(1) == 1
    return out


def _short_key(h: np.ndarray, n: int) -> np.ndarray:
    """Filter keys of windows of ``n`` words, fewer than a span."""
    return h + np.uint64(n)


def _filter(items: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter of all fingerprints of the items and of their short windows, and how many words short items have."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for text in as_bytes(batch.column(1)):
                h = stable_hashes(words(text))
                n = min(len(h), SPAN)
                found = winnow(h)[1] if n == SPAN else _short_key(grams(h, n), n) if n else h
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(found).view(np.int64)), pa.array(np.full(len(np.unique(found)), n, np.int32))], names=["key", "n"])

    found = cut(items.mapInArrow(keys, "key bigint, n int").distinct(), "fingerprints")
    # At most as many rows as a span has words.
    lengths = [r["n"] for r in found.where(F.col("n") < SPAN).select("n").distinct().collect()]
    size = max(1024, min(FILTER_WORDS, found.count() * BITS_EACH // 64))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, bit in _probes(batch.column(0).to_numpy().view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "mark"])

    # A row for each word of the filter.
    filled = found.select("key").mapInArrow(marks, "word bigint, mark bigint").groupBy("word").agg(F.bit_or("mark").alias("filled")).toPandas()
    drop_cut(found)
    out = np.zeros(size, np.uint64)
    out[filled["word"].to_numpy()] = filled["filled"].to_numpy(np.int64).view(np.uint64)
    return out, sorted(lengths)


def _item_windows(items: DataFrame) -> DataFrame:
    """n, h, g, names: each window of the items and the names of those that have it."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for name, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                hashes = stable_hashes(words(text))
                if n := min(len(hashes), SPAN):
                    h, g = _window_hashes(hashes, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), n, np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array([name] * len(h), pa.string())], names=["n", "h", "g", "name"])

    return items.mapInArrow(windows, "n int, h bigint, g bigint, name string").groupBy("n", "h", "g").agg(F.collect_set("name").alias("names"))


def _candidates(docs: DataFrame, filled: np.ndarray, lengths: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, and of windows that an item may have the first word, n, h and g: one narrow pass."""
    importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filled, lengths))
    source = id_and_text(docs).select("doc_id", "text", text_hash())
    ddl = "text_hash bigint, n_words bigint, start array<int>, n array<int>, h array<bigint>, g array<bigint>"
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(ddl).fields])
    names = schema.fieldNames()

    def of(doc: list[bytes]) -> tuple[np.ndarray, ...]:
        filled, lengths = shared.value
        hashes, found = stable_hashes(doc), []
        if len(doc) >= SPAN:
            place, g = winnow(hashes)
            place = place[_passes(filled, g)]
            around = np.zeros(len(doc) + 1, np.int64)
            np.add.at(around, np.maximum(place - (SPAN - K), 0), 1)
            np.add.at(around, place + 1, -1)
            found.append((SPAN, np.flatnonzero(np.cumsum(around)[: len(doc) - SPAN + 1] > 0)))
        found += [(n, np.flatnonzero(_passes(filled, _short_key(grams(hashes, n), n)))) for n in lengths if len(doc) >= n]
        parts = [(at, np.full(len(at), n), *(x[at].view(np.int64) for x in _window_hashes(hashes, n))) for n, at in found if len(at)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros((4, 0), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            split = [words(t) for t in as_bytes(batch.column(1))]
            columns = list(zip(*map(of, split), strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
            lists = [pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(w) for w in split], pa.int64()), *lists], names=names)

    return source.mapInArrow(run, schema)


def _past_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, names of each document; documents are read once and their texts not moved.

    Of documents only those windows are shuffled that lie around a fingerprint which the filter lets
    pass; they meet the items' windows by two hashes of 64 bits.
    """
    importable(docs.sparkSession)
    rows = cut(_candidates(docs, *_filter(items)).withColumn("number", F.monotonically_increasing_id()), "candidates")
    windows = cut(_item_windows(items), "windows")
    each = rows.select("number", F.explode(F.arrays_zip("start", "n", "h", "g")).alias("w")).select("number", "w.*")
    # One key for the three; hot ones, which very many documents have, are joined where the documents' windows lie.
    key = F.struct("n", "h", "g").alias("key")
    each = cut(each.select("number", "start", "n", key), "each")
    copies = each.groupBy("key").agg(F.count("*").alias("copies"))
    table = cut(windows.select(key, "names").join(copies, "key"), "met")
    found = hot_join(each, table, "key", "copies", each.count())
    spans = F.flatten(F.array_sort(F.collect_list(F.array("start", F.col("start") + F.col("n"))))).alias("spans")
    hits = found.groupBy("number").agg(spans, F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [_hit(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.int64()), batch.column(2)], names=["number", "n_hit", "names"])

    hits = hits.mapInArrow(counted, "number bigint, n_hit bigint, names array<string>")
    drop_cut(windows)
    base = rows.select("number", "doc_id", "text_hash", "n_words").join(hits, "number", "left")
    return base.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def _one_block(items: DataFrame, most: int) -> bool:
    """Whether the benchmark's texts and names are small enough to be broadcast."""
    return (items.agg(F.sum(F.octet_length("text") + F.octet_length("name") + 16)).first()[0] or 0) <= most


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Whole texts are read, once, in a time that follows their length.  An item of under 13 words is
    one window; one without words is none.  A null or empty text has no words and is clean,
    as is every text where the benchmark is empty.  Repeated rows give repeated results; an
    empty table gives none.  A benchmark of more than ``block_bytes`` meets documents in
    a join, with the same result.
    """
    items = _items(benchmark)
    if not _one_block(items, block_bytes):
        judged = _past_join(docs, items)
        hit = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
        digest = F.sha2(F.array_join("names", ",").cast("binary"), 256)
        return judged.select("doc_id", "n_words", "n_hit", F.size("names").cast("bigint").alias("n_items"), digest.alias("items_sha256"), hit.alias("contaminated"))
    source = id_and_text(docs)
    more = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    schema = T.StructType([source.schema["doc_id"], *T.StructType.fromDDL(more).fields])
    columns = schema.fieldNames()

    def finish(batch: pa.RecordBatch, n: list[int], hit: list[int], names: list[list[str]]) -> pa.RecordBatch:
        hashes = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
        numbers = (pa.array(x, pa.int64()) for x in (n, hit, map(len, names)))
        return pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(hashes, pa.string()), pa.array(_contaminated(n, hit), pa.bool_())], names=columns)

    return _past_block(source, items, finish, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns as they are.

    Rows with a null or empty text have no words and stay; repeated rows stay or go together.
    """
    items = _items(benchmark)
    if not _one_block(items, block_bytes):
        gone = _past_join(docs, items).where("n_hit > 0 and 20 * n_hit >= n_words").select("doc_id", "text_hash", F.lit(False).alias("stays")).distinct()
        return drop_suspects(docs, cut(gone, "contaminated"), null_ids=True, repeated=True)

    def finish(batch: pa.RecordBatch, n: list[int], hit: list[int], names: list[list[str]]) -> pa.RecordBatch:
        return batch.filter(pa.array([not c for c in _contaminated(n, hit)], pa.bool_()))

    plain = plain_names(docs)
    return _past_block(plain, items, finish, plain.schema).toDF(*docs.columns)


def oracle_sql() -> str:
    """``contamination`` as DuckDB SQL over ``documents`` and ``benchmark``: every window of every text as a string."""
    split = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {split} AS w FROM documents
), items AS (
  SELECT row_number() OVER () AS iid, coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark
), sized AS (
  SELECT iid, item, w, least({SPAN}, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT iid, item, n, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT iid, item, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), places AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT rid, i, n, item FROM places JOIN windows USING (n, span)
), covered AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS names FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)"""
