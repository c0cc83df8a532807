"""Embeddings: the hash embedder, cosine similarity, near-duplicate pairs and greedy deduplication."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.shared import bounded, cut, drop_cut, importable

DIM = 256
#: Vectors a block holds; a task compares two blocks.
BLOCK = 2048


def embed(rows: DataFrame, key: str, text: str, embedder: Any) -> DataFrame:
    """``key``, embedding, tokens, embedder, by any embedder: an Arrow pass, one call a batch, no shuffle.

    ``embedder`` names what made a row's vector, so that those of a service that failed can be
    told from its own, made anew or left out: vectors of two embedders are not comparable.
    """
    importable(rows.sparkSession)
    source = rows.select(key, F.col(text).alias("text"))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for batch in bounded(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors = [[float(x) for x in v] for v in embedder.embed(texts)] if texts else []
            made_by = pa.array([getattr(embedder, "made_by", type(embedder).__name__)] * len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array([max(1, len(t) // 4) for t in texts], pa.int32()), made_by], names=[key, "embedding", "tokens", "embedder"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, embedding array<double>, tokens int, embedder string")


def hash_embed(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """``key``, embedding, tokens: trigram counts by md5 modulo ``dim``, of length 1; an Arrow pass, no shuffle."""
    importable(rows.sparkSession)
    source = rows.select(key, F.col(text).alias("text"))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        embed = HashEmbedder(dim).embed
        for batch in bounded(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            vectors = pa.ListArray.from_arrays(pa.array(range(0, (len(texts) + 1) * dim, dim), pa.int32()), pa.array(embed(texts).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors, pa.array([max(1, len(t) // 4) for t in texts], pa.int32())], names=[key, "embedding", "tokens"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, embedding array<double>, tokens int")


def hash_counts(rows: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """``key``, bucket, n: how many trigrams of the lower-cased text fall into each bucket; an Arrow pass, no shuffle."""
    importable(rows.sparkSession)
    source = rows.select(key, F.lower(text).alias("text"))

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        embedder = HashEmbedder(dim)
        for batch in bounded(batches):
            counts = embedder._counts([t or "" for t in batch.column(1).to_pylist()])
            row, bucket = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(counts[row, bucket].astype(np.int64))], names=[key, "bucket", "n"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, bucket int, n bigint")


#: Code points below this have their trigrams' buckets in one table.
NARROW = 256
#: Characters that are embedded at once.
CHARS = 2_000_000


class HashEmbedder:
    """Deterministic embedder without a model; anything with ``embed(list[str])`` can take its place.

    A gram is hashed once: buckets of grams of narrow characters are looked up in a table by
    their three code points, others in a dictionary.
    """

    made_by = "hash"

    def __init__(self, dim: int = DIM) -> None:
        import numpy as np

        self.dim = dim
        self._table = np.full(NARROW**3, -1, np.int32)
        self._wide: dict[str, int] = {}

    def bucket(self, gram: str) -> int:
        from hashlib import md5

        return int(md5(gram.encode("utf-8", "surrogatepass")).hexdigest(), 16) % self.dim

    def _wide_bucket(self, gram: str) -> int:
        if gram not in self._wide:
            if len(self._wide) > 1_000_000:
                self._wide.clear()
            self._wide[gram] = self.bucket(gram)
        return self._wide[gram]

    def _counts(self, lows: list[str]) -> Any:
        """Grams by bucket of each text; a text of one or two characters is one gram."""
        import numpy as np

        joined = "".join(lows)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.array([len(x) for x in lows])
        grams = np.maximum(lengths - 2, 0)
        owner = np.repeat(np.arange(len(lows)), grams)
        first = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(grams) - grams), grams) + np.arange(len(owner))
        a, b, c = points[first], points[first + 1], points[first + 2]
        narrow = np.maximum(np.maximum(a, b), c) < NARROW
        bucket = np.zeros(len(first), np.int64)
        code = (a[narrow] * NARROW + b[narrow]) * NARROW + c[narrow]
        for new in np.unique(code[self._table[code] < 0]).tolist():
            self._table[new] = self.bucket(chr(new // NARROW**2) + chr(new // NARROW % NARROW) + chr(new % NARROW))
        bucket[narrow] = self._table[code]
        bucket[~narrow] = [self._wide_bucket(joined[i : i + 3]) for i in first[~narrow].tolist()]
        counts = np.bincount(owner * self.dim + bucket, minlength=len(lows) * self.dim).astype(float).reshape(len(lows), self.dim)
        for i in np.flatnonzero((lengths > 0) & (lengths < 3)).tolist():
            counts[i, self._wide_bucket(lows[i])] = 1
        return counts

    def embed(self, texts: list[str]) -> Any:
        """A row of length 1 for each text; zeros for an empty one."""
        import numpy as np

        out = np.zeros((len(texts), self.dim))
        at = 0
        while at < len(texts):
            lows: list[str] = []
            size = 0
            while at + len(lows) < len(texts) and (not lows or size + len(texts[at + len(lows)]) <= CHARS):
                lows.append(texts[at + len(lows)].lower())
                size += len(lows[-1])
            counts = self._counts(lows)
            norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            out[at : at + len(lows)] = counts / np.where(norm > 0, norm, 1)
            at += len(lows)
        return out


class RemoteEmbedder:
    """Embeddings of a service with the usual ``/embeddings`` call; where the call fails, those of the hash embedder."""

    def __init__(self, model: str = "text-embedding-3-small", base_url: str = "https://api.openai.com/v1", key: str | None = None, timeout: float = 60.0) -> None:
        self.model, self.base_url, self.key, self.timeout = model, base_url.rstrip("/"), key, timeout
        #: Calls that failed so far, and what made the last call's vectors.
        self.failures = 0
        self.made_by = self.model

    def embed(self, texts: list[str]) -> Any:
        import logging

        import numpy as np

        from corpusmill.operators.clients import post

        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        try:
            data = post(f"{self.base_url}/embeddings", {"model": self.model, "input": texts}, headers, self.timeout)["data"]
            made = np.array([row["embedding"] for row in sorted(data, key=lambda row: row.get("index", 0))], float).reshape(len(texts), -1)
            self.made_by = self.model
            return made
        except Exception as failure:  # noqa: BLE001 - the fall-back is the contract
            self.failures += 1
            self.made_by = "hash"
            logging.getLogger(__name__).warning("embeddings failed (%s): hashed ones are used", failure)
            return HashEmbedder().embed(texts)


def get_embedder(model: str = "", base_url: str | None = None, key: str | None = None) -> HashEmbedder | RemoteEmbedder:
    """A service's embedder where a model is named, else the hash embedder."""
    if model in ("", "hash"):
        return HashEmbedder()
    return RemoteEmbedder(model, base_url or "https://api.openai.com/v1", key)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def _similar(table: Any, threshold: float) -> Any:
    """Similar pairs of rows of two blocks, or of any two where the pair of blocks is one: ids, the smaller first, and similarity.

    Two visitors (a column that may be missing) are not compared: they meet elsewhere or are known to be far apart.
    """
    import numpy as np
    import pyarrow as pa

    ids, rows = table["id"].to_numpy(), table["v"].to_pylist()
    same = table["low"][0].as_py() == table["high"][0].as_py()
    home = table["own"].to_numpy() == table["low"][0].as_py()
    guest = table["visitor"].to_numpy() if "visitor" in table.column_names else np.zeros(len(ids), bool)
    widths = np.array([len(r) if r is not None else 0 for r in rows])
    out = [(ids[:0], ids[:0], np.zeros(0))]
    # Vectors of unequal width have similarity 0: each width is a matrix of its own.
    for width in np.unique(widths[widths > 0]):
        at = np.nonzero(widths == width)[0]
        matrix = np.array([rows[i] for i in at], float).reshape(-1, width)
        norm = np.sqrt((matrix * matrix).sum(axis=1))
        ok = norm > 0
        matrix, at = matrix[ok] / norm[ok, None], at[ok]
        left, right = home[at], home[at] if same else ~home[at]
        # Hosts of the one block meet all of the other, its guests the other's hosts.
        for one, other in ((left & ~guest[at], right), (left & guest[at], right & ~guest[at])):
            if not one.any() or not other.any():
                continue
            sims = matrix[one] @ matrix[other].T
            i, j = np.nonzero(sims >= threshold)
            a, b, s = ids[at][one][i], ids[at][other][j], sims[i, j]
            if same:
                # Within a block hosts meet each other twice and guests once from either side.
                once = (a < b) & ~guest[at][other][j] if not guest[at][one].any() else np.ones(len(a), bool)
                a, b, s = a[once], b[once], s[once]
            out.append((np.minimum(a, b), np.maximum(a, b), s))
    return pa.table(dict(zip(("a", "b", "similarity"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


#: Vectors that pivots are chosen from, and pivots at most: both bound what the driver holds.
PIVOT_SAMPLE = 4096
MOST_PIVOTS = 512
#: Added to angles that are compared, for what rounding takes off.
SLACK = 1e-6


def _pivots(sample: list[list[float]], most: int) -> Any:
    """Directions far from one another: each next one is the farthest from those before."""
    import numpy as np

    matrix = np.array(sample, float)
    matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    chosen = [0]
    nearest = matrix @ matrix[0]
    while len(chosen) < min(most, len(matrix)):
        following = int(nearest.argmin())
        if nearest[following] > 1 - 1e-9:
            break
        chosen.append(following)
        nearest = np.maximum(nearest, matrix @ matrix[following])
    return matrix[chosen]


def _angles(rows: list, pivots: Any) -> Any:
    import numpy as np

    matrix = np.array(rows, float)
    matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.arccos(np.clip(matrix @ pivots.T, -1, 1))


def _sampled(vectors: DataFrame, key: str, vector: str, block: int) -> tuple[DataFrame, int, int, dict[int, list]]:
    """(id, v) without null, empty and zero vectors; their number; pivots to choose; a sample by width, empty where one cell will do."""
    own = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")).where(F.exists("v", lambda x: x != 0))
    n = own.count()
    # What fits into one block is one cell.
    most = min(MOST_PIVOTS, -(-2 * n // block)) if n > block else 1
    # The smallest hashes are a sample that does not depend on how rows are dealt.
    # Each task sends its smallest ones, so those that cannot be among them by far are left out before.
    turn = own.select("v", F.xxhash64("id").alias("turn"))
    few = turn.where(F.col("turn") <= -(2**63) + 2**64 * 2 * PIVOT_SAMPLE // n) if n > 2 * PIVOT_SAMPLE else turn
    sample = [r["v"] for r in few.orderBy("turn").limit(PIVOT_SAMPLE).collect()] if most > 1 else []
    return own, n, most, {w: [x for x in sample if len(x) == w] for w in {len(x) for x in sample}}


def _limit(threshold: float) -> float:
    """The angle of two vectors at the threshold."""
    from math import acos

    return acos(max(-1.0, min(1.0, threshold))) + SLACK


def _visited(angles: Any, radius: Any, limit: float) -> tuple[Any, Any]:
    """The home of each vector, and as a matrix the later cells that it visits."""
    import numpy as np

    home = angles.argmin(axis=1)
    nearest = angles[np.arange(len(home)), home]
    later = np.arange(angles.shape[1]) > home[:, None]
    return home, later & (angles - radius <= limit) & (angles - nearest[:, None] <= 2 * limit)


def _copies(sample: dict[int, list], most: int, n: int, limit: float, block: int) -> float:
    """How often a vector would be copied, by the sample: once for each block of each of its cells."""
    import numpy as np

    total = sum(map(len, sample.values()))
    made = 0.0
    for rows in sample.values():
        pivots = _pivots(rows, most)
        angles = _angles(rows, pivots)
        radius = np.full(len(pivots), -np.inf)
        np.maximum.at(radius, angles.argmin(axis=1), angles.min(axis=1))
        home, near = _visited(angles, radius, limit)
        held = (near.sum(axis=0) + np.bincount(home, minlength=len(pivots))) * n / total
        made += float((held * np.ceil(held / block)).sum())
    return made / max(1, n)


def placed(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, known: tuple | None = None) -> DataFrame:
    """id, v, cell, visitor: each vector in the cell of its nearest pivot, and as a visitor in each later cell that may hold a similar one.

    Angles keep the triangle inequality, so a cell holds nothing within t of a vector whose
    angle to its pivot exceeds the cell's largest by more than t, nor if that angle
    exceeds the one to the vector's own pivot by more than 2 t.  The cells of one vector
    follow from its own angles and a radius for each pivot, which are broadcast.  Vectors
    that are null, empty or zero are similar to none and left out.  ``known`` is what
    ``_sampled`` gave, if it was called before.
    """
    spark = vectors.sparkSession
    importable(spark)
    kind = vectors.schema[key].dataType.simpleString()
    own, _, most, sample = known or _sampled(vectors, key, vector, block)
    by_width = {w: _pivots(rows, most) for w, rows in sample.items()}
    shared = spark.sparkContext.broadcast(by_width)
    limit = _limit(threshold)

    def each_width(batch: Any) -> Iterator[tuple[int, Any, Any]]:
        """(width, places in the batch, angles to that width's pivots or None where it has none)."""
        import numpy as np

        rows = batch.column(1).to_pylist()
        widths = np.array([len(r) for r in rows])
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            pivots = shared.value.get(width)
            yield width, at, None if pivots is None else _angles([rows[i] for i in at], pivots)

    def measured(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for width, _, angles in each_width(batch):
                if angles is not None:
                    home = angles.argmin(axis=1)
                    cells, at = np.unique(home, return_inverse=True)
                    far = np.zeros(len(cells))
                    np.maximum.at(far, at, angles[np.arange(len(home)), home])
                    yield pa.RecordBatch.from_arrays([pa.array([width] * len(cells), pa.int64()), pa.array(cells.astype(np.int64)), pa.array(far)], names=["width", "cell", "far"])

    # A row for each pivot.
    radii: dict[int, dict[int, float]] = {}
    for r in own.mapInArrow(measured, "width bigint, cell bigint, far double").groupBy("width", "cell").agg(F.max("far").alias("far")).collect() if by_width else ():
        radii.setdefault(r["width"], {})[r["cell"]] = r["far"]

    def dealt(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for width, at, angles in each_width(batch):
                row, cell, visitor = at, np.zeros(len(at), np.int64), np.zeros(len(at), bool)
                if angles is not None:
                    # A cell that no vector has for home has no radius and no visitors.
                    radius = np.array([radii.get(width, {}).get(i, -np.inf) for i in range(angles.shape[1])])
                    home, near = _visited(angles, radius, limit)
                    i, j = np.nonzero(near)
                    row, cell, visitor = np.concatenate((at, at[i])), np.concatenate((home, j)), np.concatenate((visitor, np.ones(len(i), bool)))
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(width * MOST_PIVOTS + cell, pa.int64()), pa.array(visitor)], names=["id", "v", "cell", "visitor"])

    return own.mapInArrow(dealt, f"id {kind}, v array<double>, cell bigint, visitor boolean")


#: Copies of a vector that cells may make on average; where they would make more, blocks are compared without copies.
MOST_COPIES = 2.0


def similar_pairs(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """a, b (a < b), similarity of all pairs at ``threshold`` or more: exact.

    Vectors meet in the cells of ``placed``, so a pair is compared in one cell and far cells
    never meet.  A cell over a block is dealt to blocks by hash; each pair of its blocks is
    compared in one task as two matrices, and only similar pairs leave it.
    How much is saved follows the threshold: at low ones, as between unrelated vectors of
    many dimensions, no cell is far, and each vector would be copied to all.  Where a sample
    tells so, ``_by_blocks`` compares them: the work is the square, what is moved is not.
    """
    kind = vectors.schema[key].dataType.simpleString()
    known = _sampled(vectors, key, vector, block)
    own, n, most, sample = known
    if _copies(sample, most, n, _limit(threshold), block) > MOST_COPIES:
        return _by_blocks(own, n, sample, threshold, block)
    cells = placed(vectors, threshold, key, vector, block, known)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = _met(cells, sizes, "cell", "visitor")
    return met.groupBy("cell", "low", "high").applyInArrow(lambda table: _similar(table, threshold), f"a {kind}, b {kind}, similarity double")


#: Directions that vectors are projected on to tell far ones cheaply; vectors that lie together and are told apart as one;
#: bytes of a file of blocks, and of a block; halvings of the sample that order vectors over files.
DIRECTIONS = 32
TOGETHER = 64
BLOCK_FILE = 16_000_000
BLOCK_BYTES = 2_000_000
HALVINGS = 9
#: Pairs that are compared, and that leave a task, at once.
PAIRS = 4096
SENT_PAIRS = 100_000


def _unit(lists: Any, width: int) -> Any:
    """Vectors of one width, an Arrow array of lists, as a matrix with rows of length 1."""
    import numpy as np

    matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _basis(rows: list, width: int) -> tuple[Any, Any, Any]:
    """The directions in which a sample differs most, and a tree that halves it: of each node the direction and the border."""
    import numpy as np

    matrix = np.array(rows, float).reshape(-1, width)
    matrix = matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    directions = np.zeros((DIRECTIONS, width))
    found = np.linalg.svd(matrix - matrix.mean(axis=0), full_matrices=False)[2][:DIRECTIONS] if len(matrix) else directions[:0]
    directions[: len(found)] = found
    along, border = np.zeros(2**HALVINGS, np.int64), np.zeros(2**HALVINGS)
    parts = {1: matrix @ directions.T}
    for node in range(1, 2**HALVINGS):
        p = parts.pop(node)
        if len(p):
            along[node] = p.var(axis=0).argmax()
            border[node] = np.median(p[:, along[node]])
        above = p[:, along[node]] > border[node]
        parts[2 * node], parts[2 * node + 1] = p[~above], p[above]
    return directions, along, border


def _together(p: Any, size: int) -> Any:
    """An order of rows in which each ``size`` that follow one another lie together: halved where they differ most."""
    import numpy as np

    waiting, out = [np.arange(len(p))], []
    while waiting:
        at = waiting.pop()
        if len(at) <= size:
            out.append(at)
            continue
        q = p[at]
        half = -(-len(at) // (2 * size)) * size
        halved = np.argpartition(q[:, q.var(axis=0).argmax()], half - 1)
        waiting += [at[halved[half:]], at[halved[:half]]]
    return np.concatenate(out)


def _gaps(p: Any, q: Any) -> Any:
    """Squared distances between the bounds of each ``TOGETHER`` rows of two projections."""
    import numpy as np

    bounds = [[f.reduceat(x, np.arange(0, len(x), TOGETHER)) for f in (np.minimum, np.maximum)] for x in (p, q)]
    (low, high), (other_low, other_high) = bounds
    total = np.zeros((len(low), len(other_low)))
    for k in range(p.shape[1]):
        gap = np.maximum(low[:, k, None] - other_high[:, k], other_low[:, k] - high[:, k, None])
        total += np.maximum(gap, 0) ** 2
    return total


def _near(p: Any, q: Any, near: float, same: bool) -> Iterator[tuple[Any, Any, bool]]:
    """Places of rows of two projections that are within ``near``, for some rows of the first at a time, and whether most of them are.

    A projection shortens a distance; 32 bits tell it to within the slack that is added.
    """
    import numpy as np

    one = lambda x: np.ones((len(x), 1), np.float32)
    square = lambda x: (x * x).sum(axis=1, keepdims=True)
    # The product of these is the squared distance, its sign turned.
    a, b = np.hstack([2 * p, -square(p), one(p)]), np.hstack([q, one(q), -square(q)])
    close = _gaps(p, q) <= near * near + 1e-5
    if same:
        close = np.triu(close)
    for x in np.flatnonzero(close.any(axis=1)).tolist():
        rows = (np.flatnonzero(close[x])[:, None] * TOGETHER + np.arange(TOGETHER)).ravel()
        rows = rows[rows < len(q)]
        for at in range(0, len(rows), PAIRS):
            some = rows[at : at + PAIRS]
            hit = np.flatnonzero((a[x * TOGETHER : (x + 1) * TOGETHER] @ b[some].T >= -near * near - 1e-5).ravel())
            if len(hit):
                yield x * TOGETHER + hit // len(some), some[hit % len(some)], len(hit) * 20 > TOGETHER * len(some)


class _File:
    """A file of blocks: projections first, vectors when they are asked for."""

    def __init__(self, path: str) -> None:
        import numpy as np
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.files, self.path = fs.FileSystem.from_uri(path)
        with self.files.open_input_file(self.path) as stream:
            table = pq.ParquetFile(stream).read(columns=["width", "ids", "p"]).combine_chunks()
        widths, sizes = table["width"].to_numpy(), table["ids"].combine_chunks().value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        self.ids = table["ids"].combine_chunks().flatten()
        p = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(x.as_buffer(), np.float32) for x in table["p"])]).reshape(-1, DIRECTIONS)
        #: By width: first row, projections, first block and the block after the last.
        self.parts = {}
        for w in np.unique(widths).tolist():
            at = np.flatnonzero(widths == w)
            first = int(ends[at[0]] - sizes[at[0]])
            self.parts[w] = (first, p[first : ends[at[-1]]], int(at[0]), int(at[-1]) + 1)
        self._vectors: dict[int, Any] = {}

    def vectors(self, width: int) -> Any:
        import numpy as np
        import pyarrow.parquet as pq

        if width not in self._vectors:
            with self.files.open_input_file(self.path) as stream:
                held = pq.ParquetFile(stream).read(columns=["v"])["v"]
            _, _, first, after = self.parts[width]
            self._vectors[width] = np.concatenate([np.frombuffer(held[k].as_buffer(), float) for k in range(first, after)]).reshape(-1, width)
        return self._vectors[width]


def _met_files(one: _File, other: _File, threshold: float, same: bool) -> Iterator[tuple[Any, Any, Any]]:
    """Ids of similar vectors of two files, and their similarity; of one file, each pair once."""
    import numpy as np
    import pyarrow as pa

    near = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    for w in one.parts.keys() & other.parts.keys():
        (start, p, *_), (other_start, q, *_) = one.parts[w], other.parts[w]
        if near < 1:
            found = _near(p, q, near, same)
        else:
            found = ((np.arange(x, min(x + BLOCK, len(p))), np.arange(y, min(y + BLOCK, len(q))), True) for x in range(0, len(p), BLOCK) for y in range(x if same else 0, len(q), BLOCK))
        for i, j, many in found:
            a, b = one.vectors(w), other.vectors(w)
            if many:
                rows, columns = np.unique(i), np.unique(j)
                sims = a[rows] @ b[columns].T
                at, to = np.nonzero(sims >= threshold)
                i, j, s = rows[at], columns[to], sims[at, to]
            else:
                s = np.concatenate([np.einsum("ij,ij->i", a[i[x : x + PAIRS]], b[j[x : x + PAIRS]]) for x in range(0, len(i), PAIRS)])
            ok = (s >= threshold) & (i < j) if same else s >= threshold
            if ok.any():
                left, right = (f.ids.take(pa.array(first + x[ok])).to_numpy(zero_copy_only=False) for f, first, x in ((one, start, i), (other, other_start, j)))
                ok_ids = left != right
                yield np.minimum(left, right)[ok_ids], np.maximum(left, right)[ok_ids], s[ok][ok_ids]


def _by_blocks(own: DataFrame, n: int, sample: dict[int, list], threshold: float, block: int) -> DataFrame:
    """a, b, similarity of all pairs of (id, v): every file of vectors with every other, group by group where their bounds are not apart.

    Vectors are ordered by where they lie and packed into a table of blocks, with what projects them.  Its files are
    paired in a table of their names; a task reads the projections of its pairs, and the vectors where some are near.
    Nothing is copied to disk, and a task holds two files.
    """
    spark = own.sparkSession
    importable(spark)
    kind = own.schema["id"].dataType.simpleString()
    width = max([1, *sample])
    block = max(1, min(block, BLOCK_BYTES // (8 * width)))
    block = block // TOGETHER * TOGETHER or block
    in_file = max(1, BLOCK_FILE // (8 * width) // block) * block
    shared = spark.sparkContext.broadcast({w: _basis(rows, w) for w, rows in sample.items()})

    def turned(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            turn = np.zeros(len(widths), np.int64)
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                if w in shared.value:
                    directions, along, border = shared.value[w]
                    p = _unit(batch.column(1).take(pa.array(at)), w) @ directions.T
                    node = np.ones(len(at), np.int64)
                    for _ in range(HALVINGS):
                        node = 2 * node + (p[np.arange(len(at)), along[node]] > border[node])
                    turn[at] = node - 2**HALVINGS
                turn[at] += w * 2**HALVINGS
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turn)], names=["id", "v", "turn"])

    def packed(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(waiting: list[Any], w: int) -> Iterator[Any]:
            ids = pa.concat_arrays([x.column(0) for x in waiting])
            unit = _unit(pa.concat_arrays([x.column(1) for x in waiting]), w)
            p = unit @ shared.value[w][0].T if w in shared.value else np.zeros((len(unit), DIRECTIONS))
            order = _together(p, TOGETHER)
            for x in range(0, len(order), block):
                at = order[x : x + block]
                held = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at)))
                binary = [pa.array([m.tobytes()], pa.binary()) for m in (unit[at], p[at].astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int64()), held, *binary], names=["width", "ids", "v", "p"])

        waiting: list[Any] = []
        held, of = 0, -1
        for batch in batches:
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                if waiting and (widths[at] != of or held == in_file):
                    yield from rows(waiting, of)
                    waiting, held = [], 0
                of = int(widths[at])
                other = np.flatnonzero(widths[at : at + in_file - held] != of)
                part = batch.slice(at, int(other[0]) if len(other) else in_file - held)
                waiting.append(part)
                held, at = held + part.num_rows, at + part.num_rows
        if waiting:
            yield from rows(waiting, of)

    def compare(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        one: tuple[str, Any] = ("", None)
        waiting: list[tuple[Any, Any, Any]] = []
        held = 0

        def given() -> Any:
            a, b, s = (np.concatenate(x) for x in zip(*waiting, strict=True))
            kind = one[1].ids.type
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(s)], names=["a", "b", "similarity"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if one[0] != a:
                    one = (a, _File(a))
                for found in _met_files(one[1], one[1] if a == b else _File(b), threshold, a == b):
                    waiting.append(found)
                    held += len(found[0])
                    if held >= SENT_PAIRS:
                        yield given()
                        waiting, held = [], 0
        if waiting:
            yield given()

    cores = spark.sparkContext.defaultParallelism
    parts = max(-(-n // in_file), min(cores, -(-n // block)), 1)
    ordered = own.mapInArrow(turned, f"id {kind}, v array<double>, turn bigint").repartitionByRange(parts, "turn", F.xxhash64("id")).sortWithinPartitions("turn").select("id", "v")
    blocks = cut(ordered.mapInArrow(packed, f"width bigint, ids array<{kind}>, v binary, p binary"), "blocks")
    files = blocks.select(F.col("_metadata.file_path").alias("path")).distinct()
    pairs = files.select(F.col("path").alias("one")).join(files.select(F.col("path").alias("other")), F.col("one") <= F.col("other"))
    # Some of a file's pairs in one task, which reads it once for them.
    dealt = pairs.repartition(max(4 * cores, parts), "one", F.pmod(F.xxhash64("other"), F.lit(8))).sortWithinPartitions("one")
    return dealt.mapInArrow(compare, f"a {kind}, b {kind}, similarity double")


def _met(rows: DataFrame, sizes: DataFrame, group: str, *more: str) -> DataFrame:
    """Rows of a group dealt to its ``blocks`` by hash, a copy for each pair of blocks they are in."""
    dealt = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("id", "v", group, *more, "own", F.least("own", "mate").alias("low"), F.greatest("own", "mate").alias("high"))


#: Part of the pairs at the threshold that ``approximate_pairs`` aims to find; pairs above it are found more often.
RECALL = 0.97


def approximate_pairs(vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, recall: float = RECALL, seed: int = 1) -> DataFrame:
    """a, b (a < b), similarity of most pairs at ``threshold`` or more, by random hyperplanes.

    A table of hyperplanes puts vectors on the same sides of all of them into one bucket;
    two vectors at an angle t agree on one side with probability 1 - t / pi, which gives
    the number of tables for the wanted ``recall``.  More vectors have more planes a table,
    so buckets stay about half a block long.  Pairs of a bucket are compared exactly; a
    bucket over a block is dealt out as pairs of blocks, so none is cut.  What is shuffled
    follows the vectors times the tables, not their square.
    """
    from math import acos, ceil, log, log2, pi

    spark = vectors.sparkSession
    importable(spark)
    n = vectors.count()
    side = 1 - acos(max(-1.0, min(1.0, threshold))) / pi
    planes = max(2, min(30, ceil(log2(max(n, 2) / (block / 2)))))
    tables = max(1, ceil(log(1 - recall) / log(max(1e-9, 1 - side**planes))))
    own = vectors.select(F.col(key).alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    kind = vectors.schema[key].dataType.simpleString()

    def listed(batches: Iterator[Any]) -> Iterator[Any]:
        import numpy as np
        import pyarrow as pa

        normals: dict[int, Any] = {}
        for batch in batches:
            rows = batch.column(1).to_pylist()
            buckets = []
            for row in rows:
                width = len(row or ())
                if width not in normals:
                    normals[width] = np.random.default_rng((seed, width)).normal(size=(tables, planes, width))
                bits = normals[width] @ np.array(row or (), float) > 0
                # An empty or a zero vector is similar to none.
                buckets.append(((bits @ (1 << np.arange(planes))) * tables + np.arange(tables)) * 4096 + width % 4096 if width and any(row) else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets, pa.list_(pa.int64()))], names=["id", "v", "buckets"])

    exploded = own.mapInArrow(listed, f"id {kind}, v array<double>, buckets array<bigint>").select("id", "v", F.explode("buckets").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = _met(exploded, sizes, "bucket")
    pairs = met.groupBy("bucket", "low", "high").applyInArrow(lambda table: _similar(table, threshold), f"a {kind}, b {kind}, similarity double")
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def greedy_keep(vectors: DataFrame, pairs: DataFrame, key: str = "vec_id", most_rounds: int = 1000) -> DataFrame:
    """Keys that are kept: those with no kept smaller neighbour among ``pairs`` (a, b).

    In rounds: an undecided node all of whose smaller neighbours are dropped is kept, and
    drops its larger neighbours.  Each round is cut to a table, edges are used up as their
    ends are decided, and the rounds needed are the length of the longest chain of
    decisions, not the number of vectors.
    """
    edges = cut(pairs.select("a", "b").where("a < b").distinct(), "greedy")
    dropped: list[DataFrame] = []
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        blocked = edges.select(F.col("b").alias("n")).distinct()
        kept = edges.select(F.col("a").alias("n")).distinct().join(blocked, "n", "left_anti")
        out = cut(edges.join(kept, edges.a == kept.n, "left_semi").select(F.col("b").alias("n")).distinct(), "greedy-out")
        dropped.append(out)
        rest = edges.join(out, edges.a == out.n, "left_anti")
        rest = cut(rest.join(out, rest.b == out.n, "left_anti"), "greedy")
        drop_cut(edges)
        edges = rest
    else:
        raise RuntimeError(f"not decided after {most_rounds} rounds")
    result = vectors.select(key)
    if not dropped:
        return result
    gone = reduce(DataFrame.unionByName, dropped)
    return result.join(gone, result[key] == gone.n, "left_anti")


def _unlike(vectors: DataFrame, kept: DataFrame, threshold: float) -> DataFrame:
    """(key, vector) of vectors that are similar to none of ``kept``, a table that is bounded and broadcast."""
    import numpy as np

    spark = vectors.sparkSession
    importable(spark)
    by_width: dict[int, list] = {}
    for row in kept.collect():
        by_width.setdefault(len(row[1]), []).append(row[1])
    unit = lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    shared = spark.sparkContext.broadcast({w: unit(np.array(rows, float)) for w, rows in by_width.items()})

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            widths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            stays = np.ones(len(widths), bool)
            for w in set(np.unique(widths).tolist()) & set(shared.value):
                at = np.flatnonzero(widths == w)
                rows = _unit(batch.column(1).take(pa.array(at)).cast(pa.list_(pa.float64())), w)
                stays[at] = (rows @ shared.value[w].T).max(axis=1) < threshold
            yield batch.filter(pa.array(stays))

    return vectors.mapInArrow(run, vectors.schema)


def distinct_keep(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Keys that are kept when each vector in turn goes that is similar to a kept one before it.

    Identical vectors are one: the smallest key stands for all and the others go with it or
    because of it.  A null, empty or zero vector is similar to none, so each is kept.

    In rounds: a bounded number of vectors with the smallest keys is decided by ``greedy_keep``, and all later ones that
    are similar to those kept go in one pass.  So pairs are held for one round's vectors only, never for all; the table
    of those left is written anew each round and the one before deleted.
    """
    alone = ~F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    first = vectors.where(~alone).groupBy(vector).agg(F.min(key).alias(key)).select(key, vector)
    left, size = cut(first, "distinct"), max(1, block // 2)
    result = vectors.where(alone).select(key)
    while (last := left.select(key).orderBy(key).limit(size).agg(F.max(key)).first()[0]) is not None:
        head = cut(left.where(F.col(key) <= F.lit(last)), "head")
        kept = cut(greedy_keep(head, similar_pairs(head, threshold, key, vector, block), key), "kept")
        rest = cut(_unlike(left.where(F.col(key) > F.lit(last)), head.join(kept, key, "left_semi").select(key, vector), threshold), "distinct")
        drop_cut(head)
        drop_cut(left)
        result, left, size = result.unionByName(kept), rest, min(2 * size, 4 * block)
    drop_cut(left)
    return result


def breakpoints(sims: DataFrame, mode: str, threshold: float = 75.0, group: str = "doc_id", index: str = "i", sim: str = "sim") -> DataFrame:
    """group, index of the gaps to cut at.

    fixed: similarity below a hundredth of the threshold.  percentile: at or below the
    sorted similarity at ``int(n * threshold / 100)``.  gradient: of the drops from the
    similarity before, the n // 6 largest (one at least, earlier first) that exceed 0.02.
    """
    from pyspark.sql import Window

    each = Window.partitionBy(group)
    if mode == "fixed":
        return sims.where(F.col(sim) < threshold / 100).select(group, index)
    if mode == "percentile":
        ordered = F.sort_array(F.collect_list(sim).over(each))
        at = F.least(F.size(ordered) - 1, F.floor(F.size(ordered) * (threshold / 100)).cast("int"))
        return sims.withColumn("_cut", F.get(ordered, at)).where(F.col(sim) <= F.col("_cut")).select(group, index)
    if mode == "gradient":
        before = F.lag(sim).over(each.orderBy(index))
        drops = sims.withColumn("_drop", F.coalesce(F.greatest(F.lit(0.0), before - F.col(sim)), F.lit(0.0))).withColumn("_n", F.count("*").over(each))
        ranked = drops.withColumn("_rank", F.row_number().over(each.orderBy(F.col("_drop").desc(), F.col(index).asc())))
        return ranked.where((F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 6))) & (F.col("_drop") > 0.02)).select(group, index)
    raise ValueError(f"unknown breakpoint mode: {mode}")
