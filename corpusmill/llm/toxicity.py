"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and L1 keeps all weights at zero that the
labels do not call for, so what is broadcast for scoring are the few that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import as_bytes, held_out, text_pass, training_rows

#: Labelled documents that the classifier is fitted on at most, and distinct features of theirs: what the one task that learns holds.
MOST_TRAINING_ROWS = 15_000
MOST_TRAINING_FEATURES = 40_000_000
#: Hash space of the features; bounds the weights.
SPACE_BITS = 20
ALPHA, BETA, L2 = 4.0, 1.0, 0.1
#: L1 is this times the square root of the rows: so grows what chance adds up to in a coordinate.
L1_PER_ROOT = 0.12
EPOCHS = 8
#: Documents whose gradients are taken at the same weights; their steps are then made together.
STEP = 16
#: Bytes of a word that count as its stem, a further word feature; words of one stem share what is learnt.
STEM = 5

_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def features(texts: list[bytes], bits: int = SPACE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and stem, every pair of neighbours and every pair with one word between.

    Words are runs of ASCII letters and digits and all other characters above ASCII;
    whole texts are read.
    """
    split = [t.translate(_WORD_BYTES).split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    h = np.fromiter(map(crc32, chain.from_iterable(split)), np.uint64, int(lengths.sum()))
    owner = np.repeat(np.arange(len(texts)), lengths)
    stem = np.fromiter((crc32(w[:STEM]) for w in chain.from_iterable(split)), np.uint64, len(h))
    ids, owners = [h * np.uint64(0x9E3779B97F4A7C15), stem * np.uint64(0xD6E8FEB86659FD93)], [owner, owner]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            ids.append(((h[:-gap] * np.uint64(31) + h[gap:] + np.uint64(gap)) * np.uint64(salt))[same])
            owners.append(owner[gap:][same])
    return np.concatenate(owners), (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """The weights that are not zero."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int = SPACE_BITS

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.index] = self.weight
        return dense


def scores(texts: list[bytes], table: np.ndarray, model: Model) -> np.ndarray:
    """Probability of each text; a feature counts once a text."""
    owner, feature = features(texts, model.bits)
    used = np.flatnonzero(table[feature])
    pairs = np.unique(owner[used] * (1 << model.bits) + feature[used])
    total = np.bincount(pairs >> model.bits, table[pairs & ((1 << model.bits) - 1)].astype(float), len(texts)) if len(pairs) else np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))


class Ftrl:
    """FTRL-proximal with a per-coordinate rate, L1 and L2; the last coordinate is the constant and has no L1."""

    def __init__(self, size: int, l1: float) -> None:
        self.l1 = l1
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)

    def weights(self, z: np.ndarray, n: np.ndarray, constant: np.ndarray) -> np.ndarray:
        """Of coordinates whose z has passed L1."""
        return (np.copysign(np.where(constant, 0.0, self.l1), z) - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def passed(self, z: np.ndarray, last: int) -> np.ndarray:
        """Places where z has passed L1, and ``last``, the constant's."""
        out = np.abs(z) > self.l1
        out[last] = True
        return np.flatnonzero(out)

    def learn(self, at: np.ndarray, place: np.ndarray, owner: np.ndarray, label: np.ndarray) -> None:
        """One step on a few documents.

        ``at`` are their distinct coordinates, the constant's last; each entry is a
        document's (``owner``) use of one of them (``place``).  Only coordinates that have
        passed L1 have a weight, so the others only add up.
        """
        last = len(at) - 1
        z, n = self.z[at], self.n[at]
        live = self.passed(z, last)
        w = self.weights(z[live], n[live], live == last)
        dense = np.zeros(len(at))
        dense[live] = w
        g = 1 / (1 + np.exp(-np.clip(np.bincount(owner, dense[place], len(label)), -35, 35))) - label
        grown = n + np.bincount(place, (g * g)[owner], len(at))
        z += np.bincount(place, g[owner], len(at))
        z[live] -= (np.sqrt(grown[live]) - np.sqrt(n[live])) / ALPHA * w
        self.z[at], self.n[at] = z, grown

    def model(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates with a weight, and the weights; the constant's come last."""
        last = len(self.z) - 1
        live = self.passed(self.z, last)
        return live, self.weights(self.z[live], self.n[live], live == last)


def learned(rows: list[tuple[np.ndarray, int]], bits: int = SPACE_BITS, epochs: int = EPOCHS, step: int = STEP) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the constant's, from rows of distinct features and a label, learnt from in their order.

    A gradient is under 1, so a feature of k documents has |z| < k * epochs: where that
    cannot pass L1, its weight stays zero throughout, and it is left out beforehand.
    """
    l1 = L1_PER_ROOT * len(rows) ** 0.5
    count = np.zeros(1 << bits, np.int64)
    for feature, _ in rows:
        count[feature] += 1
    names = np.flatnonzero(count * epochs > l1)
    place_of = np.full(1 << bits, -1, np.int32)
    place_of[names] = np.arange(len(names))
    steps = []
    for i in range(0, len(rows), step):
        some = rows[i : i + step]
        places = [np.append(p[p >= 0], len(names)) for f, _ in some for p in (place_of[f],)]
        at, place = np.unique(np.concatenate(places), return_inverse=True)
        owner = np.repeat(np.arange(len(some), dtype=np.int16), list(map(len, places)))
        steps.append((at.astype(np.int32), place.astype(np.int32), owner, np.array([y for _, y in some], float)))
    model = Ftrl(len(names), l1)
    for _ in range(epochs):
        for at, place, owner, label in steps:
            model.learn(at, place, owner, label)
    live, w = model.model()
    return names[live[:-1]], w[:-1], float(w[-1])


def packed(rising: np.ndarray) -> bytes:
    """Rising numbers as their compressed differences."""
    return compress(np.diff(rising, prepend=0).astype("<u4").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(decompress(data), "<u4"), dtype=np.int32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_TRAINING_ROWS, bits: int = SPACE_BITS, most_features: int = MOST_TRAINING_FEATURES) -> Model:
    """Fit on labelled documents outside the held-out third, one row each.

    Texts are hashed where they lie.  One task learns from the distinct features of at most
    ``most`` documents and, of those, of the first in the order of a hash of doc_id whose
    features number at most ``most_features``.  With no such rows every score is 1/2.
    """

    def measure(texts: list[bytes]) -> list[bytes]:
        return [packed(np.unique(features([t], bits)[1])) for t in texts]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        size = 0
        for batch in batches:
            for data, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = unpacked(data)
                size += len(at)
                if size <= most_features:
                    rows.append((at, y))
        at, weight, constant = learned(rows, bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, 1 << bits), pa.int32()), pa.array(np.append(weight, constant))], names=["at", "weight"])

    chosen = training_rows(docs, labels, label, most, "binary", measure).withColumn("turn", F.xxhash64("doc_id", F.lit(1)))
    found = chosen.repartition(1).sortWithinPartitions("turn", "doc_id").select("measured", "label").mapInArrow(train, "at int, weight double").toArrow()
    at, weight = found["at"].to_numpy(), found["weight"].to_numpy()
    constant = at == 1 << bits
    return Model(at[~constant], weight[~constant].astype(np.float32), float(weight[constant].sum()), bits)


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Whole texts are scored, in one narrow pass and a time that follows their length.  A
    null or empty text has the constant's score.  A null doc_id is not held out.  Repeated
    rows give repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = shared.value.table()
        for batch in batches:
            score = scores(as_bytes(batch.column(1)), table, shared.value)
            yield {"doc_id": batch.column(0), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return text_pass(docs, "score double, predicted int", work).select("doc_id", held_out().alias("held_out"), "score", "predicted")
