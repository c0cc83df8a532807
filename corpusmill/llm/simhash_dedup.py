"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 8 positional bytes.  Two fingerprints that differ in at most d bits
differ in at most d bytes, so they share at least 8 - d positional bytes: for d = 4 the
guaranteed minimum is 4 of 8.  A list for one positional byte would hold a 256th of the
corpus, so the index that is shuffled has lists for sets of positional bytes: two
fingerprints that share at least t of p positions share at least t - (8 - p) of the p
positions ``_keys`` looks at, and there is one list for each such set of positions.

Within a list, an inverted index of the other positional bytes is built.  Its hits are
tallied per pair, on top of the bytes that the list itself stands for; pairs whose tally
reaches the guaranteed minimum are verified by their bits.  A list emits a spanning
forest of its links, so one of m fingerprints gives at most m - 1 rows.

Exact copies share a fingerprint and are one entry of the index.  A list longer than
``BLOCK`` is refined: its rows are listed again under one more positional byte.  What is
still longer with all guaranteed bytes in its key is dealt out as pairs of blocks, each
a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, cut, drop_cut, drop_suspects, hot_join, importable, text_pass
from corpusmill.llm.components import components

BYTES = 8
#: Bits that two linked fingerprints may differ in.
BITS = 4
SHINGLE = 4
#: A list's key has as many positional bytes as make lists of uniform fingerprints this long at most.
LIST = 32
#: Fingerprints of a list that one task compares at most with one another.
BLOCK = 4096
#: Index hits that are tallied at once.
HITS = 2_000_000


def fingerprints(texts: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """SimHash of each text, from whole texts; texts without words have zero."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        split = text.lower().split()
        if not split:
            continue
        line = b" ".join(split)
        n = len(split) - words + 1
        if n <= 1:
            hashes.append(xxh64_intdigest(line, 42))
            sizes[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in split])
        starts = np.concatenate(([0], ends[: n - 1])).tolist()
        hashes += [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
        sizes[i] = n
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(sizes)
    values = np.array(hashes, dtype=">u8")
    at = np.concatenate(([0], np.cumsum(sizes[full])))
    for k, i in enumerate(full):
        bits = np.unpackbits(values[at[k] : at[k + 1]].view(np.uint8).reshape(-1, 8), axis=1)
        out[i] = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > sizes[i]).view(">u8")[0]
    return out


def with_fingerprints(docs: DataFrame, hashes: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long; with ``hashes`` also text_hash, Spark's xxhash64 of the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            texts = as_bytes(batch.column(1))
            out = {"doc_id": batch.column(0), "fp": pa.array(fingerprints(texts).view(np.int64))}
            if hashes:
                out["text_hash"] = pa.array(np.array([xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64))
            yield out

    return text_pass(docs, "fp bigint, text_hash bigint" if hashes else "fp bigint", work)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _keys(fp: Column, bits: int, key_bytes: int) -> Column:
    """(key, mask) for each set of positions: the set's number above its bytes, and the set as bits."""
    keys = []
    for number, chosen in enumerate(combinations(range(bits + key_bytes), key_bytes)):  # of these, at least key_bytes are shared
        key = F.lit(number).cast("long")
        for p in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, p))
        keys.append(F.struct(key.alias("key"), F.lit(sum(1 << p for p in chosen)).alias("mask")))
    return F.explode(F.array(*keys))


def _finer(fp: Column, key: Column, mask: Column, bits: int) -> Column:
    """(key, mask) with one more positional byte, for each of the first bits + 1 positions that are free: linked pairs share one of these."""
    free = F.filter(F.array(*[F.lit(p) for p in range(BYTES)]), lambda p: F.getbit(mask, p) == 0)
    byte = F.array(*[_byte(fp, p) for p in range(BYTES)])
    flag = F.array(*[F.lit(1 << p) for p in range(BYTES)])
    return F.explode(F.transform(F.slice(free, 1, bits + 1), lambda p: F.struct(F.xxhash64(key, p, F.get(byte, p)).alias("key"), mask.bitwiseOR(F.get(flag, p)).alias("mask"))))


def _joined_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give rows a and b one label, the smallest row of all they are joined with; ``label`` holds roots before and after."""
    while len(apart := np.flatnonzero(label[a] != label[b])):
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _forest(run: np.ndarray, mask: np.ndarray, fp: np.ndarray, bits: int, hits: int = HITS) -> np.ndarray:
    """Pairs of fingerprints that connect what links inside runs of equal ``run`` connect, a row for each.

    ``mask`` has the positions that a run's rows are known to share.  Rows are taken some at
    a time, so that the hits that are tallied at once are bounded.
    """
    n = len(fp)
    first = np.concatenate(([True], run[1:] != run[:-1]))
    number = np.cumsum(first) - 1
    known = np.bitwise_count(mask)
    # Where the key has all guaranteed bytes the list itself is the one index entry.
    whole = known >= BYTES - bits
    need = np.where(whole, 1, BYTES - bits - known.astype(np.int64))
    entries = []
    for p in range(BYTES + 1):
        rows = np.flatnonzero(whole) if p == BYTES else np.flatnonzero(~whole & (mask >> p & 1 == 0))
        code = number[rows] << 8
        if p < BYTES:
            code |= ((fp[rows] >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64)
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
        lengths = np.diff(np.concatenate(([0], ends))) if len(code) else ends[:0]
        place, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place[rows] = np.arange(len(rows))
        left[rows] = np.repeat(ends[: len(lengths)], lengths) - np.arange(len(rows)) - 1  # rows of the entry that follow
        entries.append((rows, place, left))
    total = np.cumsum(sum(left for _, _, left in entries))
    label = np.arange(n)
    at = 0
    while at < n:
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + hits, "right")))
        found = [np.zeros(0, np.int64)]
        for rows, place, left in entries:
            own, many = np.arange(at, end), left[at:end]
            a = np.repeat(own, many)
            b = rows[np.repeat(place[at:end] + 1, many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)]
            new = label[a] != label[b]
            found.append(a[new] * n + b[new])
        pair, tally = np.unique(np.concatenate(found), return_counts=True)
        a, b = np.divmod(pair, n)
        enough = tally >= need[a]
        a, b = a[enough], b[enough]
        linked = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        _joined_up(label, a[linked], b[linked])
        at = end
    moved = np.flatnonzero(label != np.arange(n))
    return np.column_stack([fp[moved], fp[label[moved]]]).view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], block: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of whole runs of the first column, over batches of one sorted partition.

    Runs come many at a time.  A run of over ``block`` rows comes by itself, in pieces, with true.
    """
    kept: list[np.ndarray] | None = None
    long_key = None

    def out(columns: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], bool]]:
        key = columns[0]
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lengths = np.diff(np.concatenate((at, [len(key)])))
        long = lengths > block
        if (~long).any():
            keep = np.repeat(~long, lengths)
            yield [c[keep] for c in columns], False
        for a, n in zip(at[long], lengths[long], strict=True):
            yield [c[a : a + n] for c in columns], True

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
        key = columns[0]
        if long_key is not None:  # the long run goes on
            n = int(np.searchsorted(key, long_key, "right")) if key[0] == long_key else 0
            if n:
                yield [c[:n] for c in columns], True
            columns = [c[n:] for c in columns]
            key = columns[0]
            kept = None
            if not len(key):
                continue
            long_key = None
        last = int(np.searchsorted(key, key[-1]))
        if last:
            yield from out([c[:last] for c in columns])
        kept = [c[last:] for c in columns]
        if len(kept[0]) > block:
            yield kept, True
            long_key, kept = key[-1], None
    if kept is not None and len(kept[0]):
        yield from out(kept)


def _edges_of_lists(batches: Iterator[pa.RecordBatch], bits: int, block: int) -> Iterator[pa.RecordBatch]:
    """From postings sorted by key: edges (a, b), and the rows of lists over ``block`` as postings that keep their key."""
    for (key, mask, fp), long in _runs(batches, ("key", "mask", "fp"), block):
        if long:
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64()), pa.array(key), pa.array(mask)], names=["a", "b", "key", "mask"])
        elif len(pairs := _forest(key, mask, fp.view(np.uint64), bits)):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64()), pa.nulls(len(pairs), pa.int32())], names=["a", "b", "key", "mask"])


def _edges_of_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """As above, for pairs of blocks of one long list; each has at most two blocks' rows."""
    for (pair, mask, fp), _ in _runs(batches, ("pair", "mask", "fp"), 1 << 62):
        if len(pairs := _forest(pair, mask, fp.view(np.uint64), bits)):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def key_size(n: int, bits: int = BITS) -> int:
    """Positional bytes in a key for n fingerprints: more make shorter lists, of which each fingerprint is in more.

    Any number from 1 to 8 - bits finds the same links.
    """
    return next((k for k in range(1, BYTES - bits) if n <= LIST << (8 * k)), BYTES - bits)


def links(prints: DataFrame, bits: int = BITS, key_bytes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect just what all links between the distinct fingerprints ``fp`` connect."""
    importable(prints.sparkSession)
    key_bytes = key_bytes or key_size(prints.count(), bits)
    postings = prints.select("fp", _keys(F.col("fp"), bits, key_bytes).alias("at")).select("fp", "at.*")
    edges = None
    for size in range(key_bytes, BYTES - bits + 1):
        listed = postings.repartition("key").sortWithinPartitions("key")
        found = cut(listed.mapInArrow(lambda it: _edges_of_lists(it, bits, block), "a bigint, b bigint, key bigint, mask int"), "links")
        own, long = found.where("key is null").select("a", "b"), found.where("key is not null").select(F.col("a").alias("fp"), "key", "mask")
        edges = own if edges is None else edges.unionByName(own)
        if long.isEmpty():
            return edges
        if size < BYTES - bits:
            postings = long.select("fp", _finer(F.col("fp"), F.col("key"), F.col("mask"), bits).alias("at")).select("fp", "at.*")
    # Deal the rows of a long list over blocks by hash; each pair of blocks meets in one task.
    sizes = long.groupBy("key").agg(F.ceil(F.count("*") / (block / 2)).cast("int").alias("blocks"))
    dealt = long.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    mate = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mate")
    pairs = dealt.select("key", "mask", "fp", "own", mate).select("fp", "mask", F.xxhash64("key", F.least("own", "mate"), F.greatest("own", "mate")).alias("pair"))
    more = pairs.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda it: _edges_of_blocks(it, bits), "a bigint, b bigint")
    return edges.unionByName(more)


def near_duplicates(docs: DataFrame, bits: int = BITS, key_bytes: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id that links reach, the document's own
    included.  A null or empty text has no words: fingerprint zero, which links like any
    other.  A null doc_id never is a component_id, which is null only where all reachable
    ids are.  Repeated rows give repeated results; an empty table gives none.
    """
    prints = cut(with_fingerprints(docs), "fingerprints")
    return _classified(prints, bits, key_bytes, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classified(prints: DataFrame, bits: int, key_bytes: int | None, block: int) -> DataFrame:
    """``prints`` with component_id and root, a fingerprint that names the component."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    roots = cut(components(links(nodes.select("fp"), bits, key_bytes, block)), "components")
    classes = nodes.join(roots, nodes.fp == roots.node, "inner").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    # Most fingerprints have no link: those need no row here, their component is their own least id.
    linked = hot_join(roots, classes, "root", "nodes", roots.count()).select(F.col("node").alias("fp"), "component_id", "root")
    each = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root"), "copies")
    classes = cut(each, "classes")
    drop_cut(roots)
    return hot_join(prints, classes, "fp", "copies", prints.count())


def drop_near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id.

    Of a component's rows with that doc_id the one whose text has the smallest hash stays,
    and of rows equal in both the one with the smallest hash of all its columns, so a doc_id
    that repeats stays in every component of which it is the smallest.  Rows with a null doc_id can't be told apart and all stay; null texts are
    copies of empty ones.  Columns are as before, whatever their names; an empty table
    stays empty.

    Only ids and hashes are shuffled to find who goes.  Documents that a filter of bounded
    size, broadcast, rules out as ones to go stay where they are; the others, few but for
    the filter's errors, are looked up by a join, which makes the result exact.
    """
    prints = cut(with_fingerprints(docs, True), "fingerprints")
    rows = _classified(prints.where("doc_id is not null"), bits, None, BLOCK).groupBy("doc_id", "text_hash", "root", "component_id").agg(F.count("*").alias("n"))
    rows = cut(rows, "rows")
    kept = rows.where("doc_id = component_id").groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash"), "text_hash").alias("kept")).select("root", "kept.*", F.lit(True).alias("stays"))
    judged = rows.join(kept, ["root", "doc_id", "text_hash"], "left").where("stays is null or n > 1")
    suspects = cut(judged.select("doc_id", "text_hash", F.coalesce("stays", F.lit(False)).alias("stays")), "suspects")
    drop_cut(prints)
    drop_cut(rows)
    return drop_suspects(docs, suspects)
