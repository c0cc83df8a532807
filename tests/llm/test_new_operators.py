"""Exact dedup, periodic runs and token alignment against their definitions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pytest

from corpusmill.llm import exact_dedup, periodic_runs, token_alignment
from corpusmill.llm import queries as Q
from tests.llm.test_operators import documents, empty, hard, hard_rows, key, same  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
ELEVEN = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plainly_deduplicated(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["text"] or ""].append(r["doc_id"])
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), at == 0, sha(text)) for at, i in enumerate(ids)]
    return out


def test_exact_dedup(spark, sf_dir, documents, hard, hard_rows, empty):  # noqa: F811
    same(Q.op11_exact_dedup(spark, sf_dir), ELEVEN, plainly_deduplicated(documents))
    same(exact_dedup.exact_groups(hard, digest_all=True), ELEVEN, plainly_deduplicated(hard_rows))
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_sql_of_exact_dedup(spark, sf_dir):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = connection.execute(exact_dedup.oracle_sql())
    assert [c[0] for c in result.description] == list(ELEVEN)
    same(Q.op11_exact_dedup(spark, sf_dir), ELEVEN, result.fetchall())


@pytest.fixture(scope="module")
def alike(spark):
    """Texts of equal length, of equal prefix, copies, nulls, repeated rows."""
    long = "p" * 300
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "a"), (4, "q" * 301), (5, "x"), (6, "y"), (7, "only one as long"), (8, None), (9, ""), (None, ""), (None, ""), (3, long + "a"), (None, "null ids"), (None, "null ids"), (10, "ß" * 2), (11, "abcd")]
    rows += [(100 + i, "hot") for i in range(300)]
    return [{"doc_id": i, "text": t} for i, t in rows], spark.createDataFrame([(i, t, n % 3) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, DOC_ID int")


def test_exact_dedup_refines_step_by_step(alike):
    rows, frame = alike
    for parts in (1, 7):
        same(exact_dedup.exact_groups(frame.repartition(parts), digest_all=True), ELEVEN, plainly_deduplicated(rows))
    survivors = {(r["length"], r["n"]) for r in exact_dedup.surviving(frame).collect()}
    # Of length 301 the three equal texts and the one that differs in its last byte go on, the one of another prefix does not.
    assert survivors == {(301, 4), (0, 4), (8, 2), (3, 300)}
    read = {r["text_sha256"] for r in exact_dedup.exact_groups(frame).collect()}
    assert sha("only one as long") not in read and sha("hot") in read


def test_exact_dedup_is_whole_when_its_filter_is_full(alike, monkeypatch):
    from corpusmill.llm import common

    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    rows, frame = alike
    same(exact_dedup.exact_groups(frame, digest_all=True), ELEVEN, plainly_deduplicated(rows))


def test_drop_exact_duplicates_keeps_the_largest_id(alike):
    rows, frame = alike
    got = [sorted((tuple(r) for r in exact_dedup.drop_exact_duplicates(frame.repartition(n)).collect()), key=key) for n in (1, 6)]
    assert got[0] == got[1]
    want = {(keep, digest) for _, keep, _, kept, digest in plainly_deduplicated(rows) if kept}
    assert {(r[0], sha(r[1] or "")) for r in got[0]} == want and len(got[0]) == len(want)


# 12
TWELVE = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def plain_runs(w):
    """Maximal stretches of each period, less those that have a smaller one."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        at = 0
        while at < len(w) - p:
            to = at
            while to < len(w) - p and w[to] == w[to + p]:
                to += 1
            length = to + p - at
            if to > at and length >= max(6, 4 * p) and not any(all(w[i] == w[i + q] for i in range(at, at + length - q)) for q in range(1, p)):
                out.append((at, length, p))
            at = max(to, at + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plainly_collapsed(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    line = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    left = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(line), hashlib.sha256(left).hexdigest()


def test_periodic_runs(spark, sf_dir, documents, hard, hard_rows, empty):  # noqa: F811
    short = [d for d in documents if len((d["text"] or "").split()) <= 1500]
    got = {r["doc_id"]: tuple(r[c] for c in TWELVE) for r in Q.op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(documents) and sum(r[1] > 0 for r in got.values()) > 10
    for d in short:
        assert got[d["doc_id"]] == plainly_collapsed(d["doc_id"], d["text"])
    some = [r for r in hard_rows if r["doc_id"] != 4]
    same(periodic_runs.periodic_runs(hard.where("doc_id is null or doc_id <> 4"), plant=True), TWELVE, [plainly_collapsed(r["doc_id"], r["text"]) for r in some])
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_collapsed_text_is_given(spark):
    frame = spark.createDataFrame([(1, "x " + "a b " * 5 + "y"), (2, None)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["collapsed_text"] for r in periodic_runs.periodic_runs(frame).collect()}
    assert got == {1: "x a b y", 2: ""}


def random_words(rng):
    kinds, words = rng.choice([1, 2, 2, 3, 5]), []
    most = rng.choice([0, 5, 12, 40, 150])
    while len(words) < most:
        kind = rng.random()
        if kind < 0.4:
            words += [rng.randrange(kinds) for _ in range(rng.randint(1, 6))]
        elif kind < 0.9:
            unit = [rng.randrange(kinds) for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
            words += unit * rng.randint(2, 7) + unit[: rng.randrange(len(unit))]
        else:
            words += words[-rng.randint(1, 40) :] * rng.randint(1, 5)
    return words


@pytest.mark.parametrize("points", [1, 64, 1 << 13])
def test_runs_of_random_words(monkeypatch, points):
    monkeypatch.setattr(periodic_runs, "POINTS", points)
    rng = random.Random(points)
    for _ in range(1500):
        words = random_words(rng)
        assert [tuple(r) for r in periodic_runs.runs(np.array(words, np.int32))] == plain_runs(words)


@pytest.mark.parametrize("kind", ["same", "two", "odd ones", "whole", "spaced"])
def test_time_of_runs_follows_the_words(kind):
    import time

    n = 300_000
    at = np.arange(n)
    words = {"same": at * 0, "two": at % 2, "odd ones": np.isin(at, np.random.default_rng(1).choice(n, 10)), "whole": at % 1013, "spaced": at % 707 == 0}[kind].astype(np.int32)
    begin = time.process_time()
    assert periodic_runs.runs(words)
    assert time.process_time() - begin < 10


# 13
THIRTEEN = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def plainly_aligned(rows):
    """Byte offsets of both tokenizations, every pair of tokens held against the other."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    with open(PATHS[0]) as file:
        vocabulary = {i: t for t, i in json.load(file)["model"]["vocab"].items()}
    shown = token_alignment.byte_characters()
    a_bytes = lambda i: bytes(shown[c] for c in vocabulary[i]) if i in vocabulary else b"<|endoftext|>"
    b_bytes = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    def offsets(ids, spelt):
        out, at = [], 0
        for i in ids:
            out.append((i, at, at + len(spelt(i))))
            at += len(spelt(i))
        return out

    found, counts = [], Counter()
    for r in rows:
        text = r["text"] or ""
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        if not text or not b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == b" " + text.encode():
            found.append(None)
            continue
        a, b = offsets(a, a_bytes), offsets(b, b_bytes)
        links, j = [], 0
        for i, at, to in a:
            while b[j][2] <= at:
                j += 1
            k = j
            while k < len(b) and b[k][1] < to:
                links.append((i, b[k][0]))
                k += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = []
        for at, to in zip([0, *ends[:-1]], ends, strict=True):
            groups.append("|".join(",".join(str(i) for i, x, _ in side if at <= x < to) for side in (a, b))) if len(a) < 3000 else groups.append("")
        found.append((len(a), len(b), len(ends), links, ";".join(groups)))
        counts.update(links)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for r, x in zip(rows, found, strict=True):
        if x is None:
            out.append((r["doc_id"], 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, line = x
            out.append((r["doc_id"], n_a, n_b, n_groups, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), sha(line)))
    return out


def check_alignment(df, rows):
    got, want = ([r if r[1] < 3000 else r[:-1] for r in rows] for rows in ([tuple(r) for r in df.select(*THIRTEEN).collect()], plainly_aligned(rows)))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("frequent", [0, 300, 1 << 20])
def test_token_alignment(spark, sf_dir, documents, frequent):  # noqa: F811
    check_alignment(token_alignment.token_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3), *PATHS, frequent=frequent), documents)


ODD = ["<|endoftext|> and <s> <unk> </s>", "a▁b", "a     b", "   three   spaces   ", "tab\tnew\n\nlines \n x", "中文字符 and ß İ 😀👩‍👩‍👧 \U0001f9ff", "\x00\x1c\x85 ﻿", "x" * 400, " ", "  ", "é à ù ", "don't we'll it's", "1234567890" * 9, "a" + "́" * 50]


def test_token_alignment_of_odd_texts(spark, hard, hard_rows, empty):  # noqa: F811
    check_alignment(token_alignment.token_alignment(hard, *PATHS), hard_rows)
    rows = [{"doc_id": i, "text": t} for i, t in enumerate(ODD)] + [{"doc_id": 3, "text": ODD[3]}, {"doc_id": None, "text": None}]
    frame = spark.createDataFrame([(r["doc_id"], r["text"], 1) for r in rows], "doc_id bigint, text string, pairs int").repartition(2)
    check_alignment(token_alignment.token_alignment(frame, *PATHS, frequent=20), rows)
    assert token_alignment.token_alignment(empty, *PATHS).count() == 0


@pytest.mark.parametrize(("memo_bits", "few"), [(2, 0), (18, 10_000), (10, 3)])
def test_transducer_by_memo_size_and_scalar_moves(memo_bits, few):
    first, second = token_alignment.First(*PATHS[:3]), token_alignment.Second(PATHS[3])
    rng = random.Random(7)
    letters = "ab e\n é ß中😀'1 "
    texts = [t for t in (*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(300))) if t]
    a, b = [first.ids(" " + t) for t in texts], second.ids(texts)
    plain = token_alignment.Slice(token_alignment.Transducer(first.bytes, second.bytes), a, b)
    other = token_alignment.Slice(token_alignment.Transducer(first.bytes, second.bytes, memo_bits, few), a, b)
    for name in ("rows", "groups", "links", "pairs", "times", "distinct"):
        assert np.array_equal(getattr(plain, name), getattr(other, name))
    assert texts.index("a▁b") not in plain.rows and len(plain.rows) == len(texts) - 1


def test_first_tokenizer_equals_the_library():
    from tokenizers import Tokenizer

    first, library = token_alignment.First(*PATHS[:3]), Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    rng = random.Random(3)
    letters = "ab  e\n\t\r\x0b\x1c\x85é ßİɏ'sт中😀1_ "
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert first.ids(" " + text) == library.encode(" " + text, add_special_tokens=False).ids
