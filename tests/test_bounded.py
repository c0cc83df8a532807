"""Passes that hold little at once, and pairs without copies."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from corpusmill.operators import vectors as W
from corpusmill.operators.shared import bounded
from corpusmill.sources import structure


def test_pairs_at_a_low_threshold_copy_no_vectors(spark, monkeypatch):
    """Unrelated vectors would visit every cell: each is in one block instead, and all pairs are found."""
    draw = np.random.default_rng(6)
    rows = draw.normal(size=(700, 12))
    tables = {}
    monkeypatch.setattr(W, "_met", lambda *_: (_ for _ in ()).throw(AssertionError("copied")))
    monkeypatch.setattr(W, "cut", lambda df, name, real=W.cut: tables.setdefault(name, real(df, name)))
    frame = spark.createDataFrame([(f"v{i:03}", r) for i, r in enumerate(rows.tolist())], "vec_id string, embedding array<double>").repartition(4)
    got = {(r["a"], r["b"]): r["similarity"] for r in W.similar_pairs(frame, 0.35, block=50).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sims = unit @ unit.T
    a, b = np.nonzero(np.triu(sims >= 0.35, 1))
    assert set(got) == {(f"v{i:03}", f"v{j:03}") for i, j in zip(a, b, strict=True)} and len(got) > 1000
    assert all(abs(got[f"v{i:03}", f"v{j:03}"] - sims[i, j]) < 1e-9 for i, j in zip(a, b, strict=True))
    held = [x for r in tables["blocks"].select("ids").collect() for x in r["ids"]]
    assert sorted(held) == [f"v{i:03}" for i in range(700)]


def test_greedy_rounds_hold_a_bounded_number_of_vectors(spark, monkeypatch):
    draw = np.random.default_rng(7)
    rows = draw.normal(size=(600, 8))
    seen = []
    monkeypatch.setattr(W, "greedy_keep", lambda vectors, *more, real=W.greedy_keep: seen.append(vectors.count()) or real(vectors, *more))
    frame = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    unit, kept = rows / np.linalg.norm(rows, axis=1, keepdims=True), []
    for i in range(600):
        if not kept or (unit[kept] @ unit[i]).max() < 0.8:
            kept.append(i)
    assert sorted(r["vec_id"] for r in W.distinct_keep(frame, 0.8, block=40).collect()) == kept
    assert len(seen) > 1 and max(seen) <= 160


def test_the_sample_of_pivots_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(W, "PIVOT_SAMPLE", 50)
    frame = spark.range(3000).selectExpr("id AS vec_id", "array(1.0D + id % 7, id % 11, id % 13) AS embedding")
    _, n, _, sample = W._sampled(frame, "vec_id", "embedding", 100)
    assert n == 3000 and sum(map(len, sample.values())) == 50


def test_batches_are_cut_by_rows_and_bytes():
    texts = ["x" * 10] * 5 + ["y" * 1000, None, "z" * 10]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts), pa.array([b""] * 8, pa.binary())], names=["id", "text", "data"])
    parts = list(bounded(iter([batch, batch.slice(0, 0)]), rows=3, most=100))
    assert [p.num_rows for p in parts] == [3, 2, 1, 2]
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert [p.num_rows for p in bounded(iter([pa.RecordBatch.from_arrays([pa.array(range(600))], names=["id"])]))] == [256, 256, 88]


def test_blocks_leave_by_amount_of_text():
    rows = iter([("p", i, "paragraph", 0, None, "x" * 900_000, None, []) for i in range(7)] + [("p", 7, "table", 0, None, "", [["a", "b"]], [])])
    some = []
    while part := structure._some(rows):
        some.append([r[1] for r in part])
    assert some == [[0, 1, 2], [3, 4, 5], [6, 7]]


def test_counts_of_grams(spark):
    rows = [(1, "ABCabc\u20ac"), (2, "xy"), (3, ""), (4, None)]
    got = {}
    for r in W.hash_counts(spark.createDataFrame(rows, "id bigint, text string"), "id", "text").collect():
        got.setdefault(r["id"], {})[r["bucket"]] = r["n"]
    bucket = W.HashEmbedder().bucket
    want = {}
    for gram in ("abc", "bca", "cab", "abc", "bc\u20ac"):
        want[bucket(gram)] = want.get(bucket(gram), 0) + 1
    assert got == {1: want, 2: {bucket("xy"): 1}}


def test_files_of_vectors_that_are_apart_are_not_read(spark, monkeypatch):
    """Projections tell which files hold near vectors: only of those vectors are read, and all pairs are found."""
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(8, 48))
    rows = np.array([centres[i % 8] + (0.002 if i % 3 else 0.3) * draw.normal(size=48) for i in range(1200)])
    tables = {}
    monkeypatch.setattr(W, "MOST_COPIES", -1.0)
    monkeypatch.setattr(W, "BLOCK_FILE", 64 * 48 * 8)
    monkeypatch.setattr(W, "cut", lambda df, name, real=W.cut: tables.setdefault(name, real(df, name)))
    got = {(r["a"], r["b"]): r["similarity"] for r in W.similar_pairs(spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>"), 0.999, block=64).collect()}
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    sims = unit @ unit.T
    a, b = np.nonzero(np.triu(sims >= 0.999, 1))
    assert set(got) == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 1000
    assert all(abs(s - sims[pair]) < 1e-9 for pair, s in got.items())
    paths = sorted(r[0] for r in tables["blocks"].select("_metadata.file_path").distinct().collect())
    assert len(paths) > 8
    read = 0
    for one in paths:
        for other in paths:
            files = W._File(one), W._File(other)
            list(W._met_files(*files, 0.999, False))
            read += bool(files[1]._vectors)
    assert len(paths) <= read < len(paths) ** 2 / 2
