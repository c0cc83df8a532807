"""Big files read by many tasks give what one reader gives."""

import csv
import io
import json
import random

import pytest

from corpusmill.sources import records as R

CELLS = ["", "a", "two words", "with, comma", 'with "quotes"', "line\nbreak", "\n\n", '"', '",\n"', "ünï", "5\" pipe", "tab\t", "  spaces  ", "{[", "x" * 300]


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)

    def to(size):
        spark.conf.set(name, str(size))

    yield to
    spark.conf.set(name, before)


def read(spark, path, kind, **more):
    return {r["i"]: r["text"] for r in R.record_texts(R.read_records(spark, str(path), kind, **more), kind, **more).collect()}


def plain_csv(text, delimiter=","):
    out = {}
    for i, row in enumerate(csv.DictReader(io.StringIO(text, newline=""), delimiter=delimiter), 1):
        out[i] = "\n".join([f"[Row {i}]", *(f"{k}: {v.strip()}" for k, v in row.items() if k and isinstance(v, str) and v.strip())])
    return out


@pytest.mark.parametrize("size", [150, 1500])
@pytest.mark.parametrize(("delimiter", "end"), [(",", "\n"), (";", "\r\n")])
def test_csv(spark, tmp_path, small_blocks, size, delimiter, end):
    rng = random.Random(size)
    out = io.StringIO(newline="")
    writer = csv.writer(out, delimiter=delimiter, lineterminator=end)
    writer.writerow(["id", "name\nof it", "text"])
    for i in range(60):
        writer.writerow([i, rng.choice(CELLS), rng.choice(CELLS)])
        if i % 20 == 7:
            out.write(end)
    # A quote inside a plain cell opens nothing.
    out.write(f'7{delimiter}5" pipe{delimiter}x{end}8{delimiter}"q" more{delimiter}y')
    (tmp_path / "t.csv").write_bytes(out.getvalue().encode())
    small_blocks(size)
    assert read(spark, tmp_path / "t.csv", "csv", delimiter=delimiter) == plain_csv(out.getvalue(), delimiter)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 3:
        return rng.choice(CELLS + ["\\", "\\\"", "a\\", "],[", "}{", "\u2028"])
    if kind < 5:
        return rng.choice([None, True, 1, 2.5, -3])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(CELLS): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize(("size", "indent"), [(100, None), (400, 1)])
def test_json_array(spark, tmp_path, small_blocks, size, indent):
    rng = random.Random(size)
    rows = [value(rng) for _ in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=size == 100) + "\n")
    small_blocks(size)
    assert read(spark, tmp_path / "a.json", "json") == {i: f"[Entry {i + 1}]\n{json.dumps(v, indent=2, ensure_ascii=False)}" for i, v in enumerate(rows)}


def test_json_that_is_no_array(spark, tmp_path, small_blocks):
    small_blocks(60)
    one = {"a": [1, 2, {"b": "x, y"}], "c": "z" * 80, "d": [[], {}]}
    for name, content in (("o", json.dumps(one)), ("e", "[]"), ("f", " [ ] "), ("n", ""), ("s", "[1]"), ("bad", '[1, {"a": }, 3]')):
        (tmp_path / f"{name}.json").write_text(content)
    got = {}
    for r in R.record_texts(R.read_records(spark, str(tmp_path), "json"), "json").collect():
        got.setdefault(r["file_path"].rpartition("/")[2], []).append((r["i"], r["text"], r["error"] is None))
    assert sorted(got) == ["bad.json", "o.json", "s.json"]
    assert got["o.json"] == [(0, f"[Entry 1]\n{json.dumps(one, indent=2)}", True)] and got["s.json"] == [(0, "[Entry 1]\n1", True)]
    assert [(i, ok) for i, _, ok in sorted(got["bad.json"])] == [(0, True), (1, False), (2, True)]


def test_json_lines(spark, tmp_path, small_blocks):
    small_blocks(100)
    lines = ['{"a": 1}', "", "not json", '["x", "y"]', "   ", '"last"']
    (tmp_path / "l.jsonl").write_text("\n".join(lines * 8))
    full = [x for x in lines * 8 if x.strip()]
    want = {i: f"[Line {i + 1}] not json" if x == "not json" else f"[Entry {i + 1}]\n{json.dumps(json.loads(x), indent=2)}" for i, x in enumerate(full)}
    assert read(spark, tmp_path / "l.jsonl", "jsonl") == want


def test_a_folder_of_files_by_many_tasks(spark, tmp_path, small_blocks):
    small_blocks(20_000)
    want = {}
    for f in range(3):
        rows = [{"id": i, "text": f"line\n{i}, \"{f}\""} for i in range(2000)]
        out = io.StringIO(newline="")
        writer = csv.DictWriter(out, ["id", "text"])
        writer.writeheader()
        writer.writerows(rows)
        (tmp_path / f"{f}.csv").write_text(out.getvalue(), newline="")
        want |= {(f"{f}.csv", i): t for i, t in plain_csv(out.getvalue()).items()}
    records = R.read_records(spark, str(tmp_path), "csv")
    got = {(r["file_path"].rpartition("/")[2], r["i"]): r["text"] for r in R.record_texts(records, "csv").collect()}
    assert got == want


@pytest.mark.parametrize("kind", ["csv", "json"])
def test_states_equal_reading_from_the_start(kind):
    rng = random.Random(5)
    letters = 'a,"\\{}[]\n' if kind == "json" else 'a",,\n'
    for _ in range(2000):
        line = "".join(rng.choice(letters) for _ in range(rng.randrange(12))).replace("\n", "")
        if kind == "csv":
            rows = list(csv.reader(io.StringIO(line + "\nend", newline="")))
            assert R.csv_after(line, 0, ",") == (len(rows) < 2)
        else:
            state, escaped, depth = 0, False, 0
            for c in line:
                if escaped:
                    escaped = False
                elif c == "\\" and (state or True):
                    escaped = True
                elif c == '"':
                    state ^= 1
                elif not state:
                    depth += (c in "[{") - (c in "]}")
            if not escaped and '\\' not in line:
                assert R.json_after(line, 0) == 2 * depth + state
