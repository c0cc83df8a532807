"""Calls of a generator: limits over all tasks, order, results kept, jobs taken up again."""

import json
import os
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import generation as N
from corpusmill.operators import synthesis as G
from corpusmill.operators.clients import HttpClient, Providers
from corpusmill.operators.generation import Limits


@pytest.fixture
def busy_server():
    """A server that takes a while for each answer and notes how many it has at once, and when they came; ``plan`` is what it answers first."""
    state = {"now": 0, "most": 0, "times": [], "plan": []}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][-1]["content"]
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["times"].append(time.monotonic())
                status = state["plan"].pop(0) if state["plan"] else 200
            time.sleep(0.03)
            with lock:
                state["now"] -= 1
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": asked[::-1]}}]}).encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", state
    server.shutdown()


def prompts(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("prompt "), "id").alias("p"))


@pytest.mark.parametrize("concurrency", [1, 3, 9])
def test_calls_in_flight_are_bounded_over_all_tasks(spark, busy_server, concurrency):
    url, state = busy_server
    rows = {r["k"]: r["response"] for r in N.generate(prompts(spark, 60), "k", F.lit(""), F.col("p"), HttpClient(url, "m"), Limits(concurrency)).collect()}
    assert rows == {i: f"prompt {i}"[::-1] for i in range(60)}
    assert state["most"] <= concurrency and (concurrency == 1 or state["most"] > 1)


def test_calls_a_minute_are_bounded_over_all_tasks(spark, busy_server):
    url, state = busy_server
    assert N.generate(prompts(spark, 40), "k", F.lit(""), F.col("p"), HttpClient(url, "m"), Limits(8, rpm=1200)).count() == 40
    times = sorted(state["times"])
    # 20 a second over all tasks, each of which may start with one.
    assert all(sum(t <= x < t + 1 for x in times) <= 20 + 8 for t in times) and times[-1] - times[0] > 1


def test_a_provider_s_limits_hold_unless_others_are_given():
    providers = Providers()
    client = providers.get("anthropic").client(key="k")
    assert (client.concurrency, client.rpm) == (10, 50) and N.limits_of(client, None) == Limits(10, 50)
    assert N.limits_of(client, Limits(2)) == Limits(2) and N.limits_of(G.OfflineGenerator(), None) == Limits()
    with pytest.raises(ValueError):
        Limits(0)


@pytest.mark.parametrize("concurrency,tasks", [(10, 4), (3, 3), (9, 2), (16, 7)])
def test_shares_add_up(concurrency, tasks):
    shares = [Limits(concurrency, 90).share(i, tasks) for i in range(tasks)]
    assert sum(s.concurrency for s in shares) == concurrency and sum(s.rpm for s in shares) == pytest.approx(90)
    assert min(s.concurrency for s in shares) >= 1


def test_rate_limits_are_waited_out(spark, busy_server):
    url, state = busy_server
    state["plan"] += [429, 429, 500]
    began = time.monotonic()
    row = N.generate(prompts(spark, 1), "k", F.lit(""), F.col("p"), HttpClient(url, "m"), Limits(second=0.1)).first()
    assert row["attempts"] == 4 and row["error"] is None
    # 1 and 2 units after rate limits, 2 after the other error.
    assert time.monotonic() - began >= 0.5


class Slow:
    """Answers after a moment, later prompts sooner; notes each call in a file and dies at one of them, once."""

    def __init__(self, folder, dies_at=None):
        self.folder, self.dies_at = str(folder), dies_at

    def generate(self, system, user):
        with open(f"{self.folder}/calls", "a") as calls:
            calls.write(user + "\n")
        number = int(user.split()[1])
        if number == self.dies_at and not os.path.exists(f"{self.folder}/died"):
            open(f"{self.folder}/died", "w").close()
            time.sleep(0.2)
            os._exit(1)
        time.sleep(0.002 * (7 - number % 7))
        return user.upper()


def made(folder):
    with open(f"{folder}/calls") as calls:
        return calls.read().splitlines()


def test_order_is_that_of_the_rows():
    caller = N.Caller(type("Late", (), {"generate": lambda self, s, u: time.sleep(0.01 * (5 - int(u) % 5)) or u})(), Limits(4), 1, None)
    assert [(k, c.response) for k, c in caller.calls((i, "", str(i)) for i in range(40))] == [(i, str(i)) for i in range(40)]


def test_a_task_that_runs_again_repeats_only_calls_in_flight(spark, tmp_path):
    job = N.generate(prompts(spark, 200), "k", F.lit(""), F.col("p"), Slow(tmp_path, 150), Limits(6), str(tmp_path / "log"))
    with pytest.raises(Exception, match="(?i)python worker|crashed"):
        job.collect()
    before = len(made(tmp_path))
    # A frame keeps its failed plan; one made of it has the same tasks over the same log.
    rows = {r["k"]: r["response"] for r in job.select("*").collect()}
    assert rows == {i: f"PROMPT {i}" for i in range(200)}
    # Spark stops the other tasks when one dies, so each may lose what it had in flight, six in all.
    assert before > 20 and len(made(tmp_path)) <= 200 + 6
    assert job.select("*").count() == 200 and len(made(tmp_path)) <= 200 + 6


def test_a_log_is_taken_up_by_a_later_job(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = prompts(spark, 50)
    assert N.resumed(rows.where("k < 30"), "k", F.lit(""), F.col("p"), Slow(tmp_path), log).count() == 30
    assert {r["k"]: r["response"] for r in N.resumed(rows, "k", F.lit(""), F.col("p"), Slow(tmp_path), log).collect()} == {i: f"PROMPT {i}" for i in range(50)}
    assert len(made(tmp_path)) == 50
    # A line that was cut off is none.
    part = next(p for p in (tmp_path / "log").rglob("*.json"))
    part.write_text(part.read_text()[:-5])
    assert N.resumed(rows, "k", F.lit(""), F.col("p"), Slow(tmp_path), log).count() == 50
    assert len(made(tmp_path)) == 51


def test_empty_tables_and_null_prompts(spark, tmp_path):
    rows = spark.createDataFrame([("a", None), (None, "x")], "k string, p string")
    got = N.generate(rows, "k", F.lit(None).cast("string"), F.col("p"), G.OfflineGenerator(), log=str(tmp_path / "log")).collect()
    assert {r["k"] for r in got} == {"a", None}
    assert N.generate(rows.limit(0), "k", F.lit(""), F.col("p"), G.OfflineGenerator()).count() == 0


def test_synthesis_over_a_log_calls_once(spark, tmp_path):
    chunks = spark.range(20).selectExpr("cast(id as string) chunk_id", "concat('prompt ', id) content", "'' title", "'text' source_type")

    class Counting(G.OfflineGenerator):
        def generate(self, system, user):
            with open(tmp_path / "calls", "a") as calls:
                calls.write("x\n")
            return super().generate(system, user)

    for _ in range(2):
        conversations, entries = G.synthesize(chunks, generator=Counting(), log=str(tmp_path / "log"))
        assert conversations.count() == entries.count() == 20
    assert len(made(tmp_path)) == 20


def test_two_judges(spark):
    class Rates:
        def __init__(self, overall):
            self.overall = overall

        def generate(self, system, user):
            return json.dumps({"overall": self.overall}) if self.overall is not None else "no"

    turns = "array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], f"conv_id bigint, turns {turns}")
    row = G.judge_twice(rows, F.lit("s"), Rates(8), Rates(5)).first()
    assert (row["judge_overall"], row["audit_overall"], row["judge_agreement"]) == (8, 5, 0.7)
    row = G.judge_twice(rows, F.lit("s"), Rates(8), Rates(None)).first()
    assert row["audit_overall"] is None and row["judge_agreement"] is None and row["audit_error"]
    row = G.judge_twice(rows, F.lit("s"), Rates(3), Rates(5), F.col("judge_overall") > 6).first()
    assert row["judge_overall"] == 3 and row["audit_overall"] is None and row["audit_error"] is None


def test_calls_as_tables(spark):
    from corpusmill.operators.clients import HttpClient, replies, requests

    ddl = "id int, provider string, messages array<struct<role:string,content:string>>"
    rows = spark.createDataFrame([(1, "a", [("system", "s"), ("user", None), ("system", "t")]), (2, "b", []), (3, "b", None), (4, "x", [("user", "u")]), (5, None, [("user", "u")]), (6, "b", [("user", "é")])], ddl)
    clients = {"a": HttpClient("http://h/", "m", key="secret", wire="anthropic"), "b": HttpClient("http://h", "o1-x", wire="openai")}
    got = {r["id"]: (r["url"], r["body"]) for r in requests(rows, clients, "id", max_tokens=5).collect()}
    assert got[1] == ("http://h/messages", '{"model":"m","messages":[{"role":"user","content":""}],"temperature":0.7,"max_tokens":5,"system":"t"}')
    assert got[6] == ("http://h/chat/completions", '{"model":"o1-x","messages":[{"role":"user","content":"é"}],"temperature":0.7,"max_completion_tokens":5}')
    assert all(got[i] == (None, None) for i in (2, 3, 4, 5)) and "secret" not in str(got)

    bodies = [(1, "a", '{"content":[{"text":"x"},{"type":"tool"},{"text":"y"}],"usage":{"input_tokens":2}}'), (2, "b", '{"choices":[]}'), (3, "b", None), (4, "x", "{}"), (5, "b", '{"choices":[{"message":null}]}')]
    read = {r["id"]: (r["content"], r["tokens_in"], r["finish"], r["error"]) for r in replies(spark.createDataFrame(bodies, "id int, provider string, body string"), {"a": "anthropic", "b": "openai"}, "id").collect()}
    assert read == {1: ("xy", 2, "stop", None), 2: (None, None, None, "IndexError"), 3: (None, None, None, "JSONDecodeError"), 4: (None, None, None, "KeyError"), 5: ("", 0, "stop", None)}


def test_spent_tables_are_a_threads_own(spark):
    import threading

    from corpusmill.operators.shared import cut, spent_tables

    begun, go = threading.Event(), threading.Event()

    def other():
        with spent_tables(spark):
            begun.set()
            go.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    assert begun.wait(60)
    kept = cut(spark.range(3), "kept")
    go.set()
    thread.join()
    assert kept.count() == 3


def test_offline_conversations_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    """Fences in a text, empty texts, wide spaces at its ends, rows that are repeated: one conversation a row, on the row's own text."""
    import duckdb

    from corpusmill.plans.queries import ORACLE_SQL, QUERIES

    texts = ["plain", "  ends \n", 'code ```json\n{"a": 1}\n``` after', "a ``` b", "```", "", "   ", "x ", "\x0bv\x0b", "\x85n\x85", "　wide", '{"conversation": 1}', "Content:\nabc", "\\ \"q\" \x01", "\U0001f600" * 600, " " * 3500 + "late"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, "twice")] * 2 + [(101, "three times")] * 3 + [(102, "one"), (102, "other")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in QUERIES["synthesize_turns"](spark, str(tmp_path)).collect())
    assert got == sorted(connection.execute(ORACLE_SQL["synthesize_turns"]).fetchall()) and len(got) == len(rows)
