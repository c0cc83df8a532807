"""Queries on cost, cache, jobs, prompts, synthesis and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import cost as K
from corpusmill.operators import state as H
from corpusmill.operators import synthesis as G
from corpusmill.operators.shared import scratch
from corpusmill.operators.versioned import ResultCache
from corpusmill.plans import adapters as A
from corpusmill.plans.registry import query

_NOW = "timestamp '2024-02-10 00:00:00'"


@query(f"WITH {A.CONV} SELECT conv_id, list_sum(list_transform(turns, lambda t: greatest(1, length(t.content) // 4) + 4))::BIGINT AS tokens FROM conv")
def message_tokens(spark, d):
    return A.conversations(spark, d).select("conv_id", K.message_tokens(F.col("turns")).alias("tokens"))


_PRICES = "prices(model, input_price, output_price, status) AS (VALUES " + ", ".join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE, '{s}')" for m, _, i, o, _, s in K.CATALOG) + ")"
_MODEL = "(['gpt-4o', 'vendor/gpt-4.1', 'GPT-4O-mini', 'gpt-4o-my-deployment', 'x:o3-mini', 'nothing', 'team@mistral-large-latest'])[user_id % 7 + 1]"
_USED = f"used AS (SELECT event_id, user_id, {_MODEL} AS model, CAST(floor(abs(value)) AS BIGINT) AS tokens_in, CAST(floor(abs(value) / 2) AS BIGINT) AS tokens_out FROM events)"
_PRICED = f"""resolved(model, price_model) AS (VALUES ('gpt-4o', 'gpt-4o'), ('vendor/gpt-4.1', 'gpt-4.1'), ('GPT-4O-mini', 'gpt-4o-mini'), ('gpt-4o-my-deployment', 'gpt-4o'), ('x:o3-mini', 'o3-mini'), ('nothing', NULL), ('team@mistral-large-latest', 'mistral-large-latest')),
priced AS (SELECT used.*, r.price_model, coalesce(p.input_price, 0) AS input_price, coalesce(p.output_price, 0) AS output_price FROM used LEFT JOIN resolved r ON r.model = used.model LEFT JOIN prices p ON p.model = r.price_model)"""


def _used(spark, d):
    names = F.array(*[F.lit(x) for x in ("gpt-4o", "vendor/gpt-4.1", "GPT-4O-mini", "gpt-4o-my-deployment", "x:o3-mini", "nothing", "team@mistral-large-latest")])
    return A.table(spark, d, "events").select("event_id", "user_id", F.get(names, (F.col("user_id") % 7).cast("int")).alias("model"), F.floor(F.abs("value")).cast("bigint").alias("tokens_in"), F.floor(F.abs("value") / 2).cast("bigint").alias("tokens_out"))


@query(f"WITH {_PRICES}, {_USED}, {_PRICED} SELECT event_id, model, price_model, input_price, output_price FROM priced")
def price_resolve(spark, d):
    return K.resolve_prices(_used(spark, d), K.catalog(spark)).select("event_id", "model", "price_model", "input_price", "output_price")


_ESTIMATE = "count(*) AS requests, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(tokens_in / 1e6 * input_price + tokens_out / 1e6 * output_price), 6) AS cost_usd, sum(tokens_in + tokens_out)::BIGINT AS tokens, round(sum(tokens_in + tokens_out) / count(*), 6) AS avg_tokens"


@query(f"WITH {_PRICES}, {_USED}, {_PRICED} SELECT model, {_ESTIMATE} FROM priced GROUP BY model")
def cost_by_model(spark, d):
    return K.batch_estimate(K.resolve_prices(_used(spark, d), K.catalog(spark)), ["model"])


@query(f"WITH {_PRICES}, {_USED}, {_PRICED} SELECT {_ESTIMATE} FROM priced")
def batch_cost(spark, d):
    return K.batch_estimate(K.resolve_prices(_used(spark, d), K.catalog(spark)))


@query("""SELECT event_id, CASE event_id % 3 WHEN 2 THEN 0 ELSE floor(abs(value))::BIGINT END AS tokens_in, CASE event_id % 3 WHEN 2 THEN 0 ELSE event_id END AS tokens_out FROM events""")
def usage_extract(spark, d):
    n, value = F.col("event_id") % 3, F.floor(F.abs("value")).cast("string")
    payload = F.when(n == 0, F.format_string('{"prompt_tokens": %s, "completion_tokens": %d}', value, "event_id")).when(n == 1, F.format_string('{"prompt_tokens": 0, "input_tokens": %s, "output_tokens": %d}', value, "event_id")).otherwise("{}")
    return A.table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in K.usage(payload).items()])


@query(f"""WITH {_PRICES}, {_USED}, {_PRICED} SELECT p.model, p.input_price, p.output_price, count(u.event_id) AS uses, coalesce(sum(u.tokens_in), 0)::BIGINT AS tokens_in
  FROM prices p LEFT JOIN priced u ON u.price_model = p.model WHERE p.status = 'current' GROUP BY ALL""")
def catalog_current(spark, d):
    """Models that are current, with what the events used of them."""
    used = K.resolve_prices(_used(spark, d), K.catalog(spark)).groupBy(F.col("price_model").alias("model")).agg(F.count("*").alias("uses"), F.sum("tokens_in").alias("tokens_in"))
    current = K.current_models(K.catalog(spark)).select("model", "input_price", "output_price").join(used, "model", "left")
    return current.fillna(0, ["uses", "tokens_in"])


_CREATED = "1704067200 + doc_id % 60 * 86400"


@query(f"""WITH d AS (SELECT DISTINCT doc_id FROM documents), e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS value, CASE WHEN doc_id % 5 = 0 THEN 1709251200 ELSE {_CREATED} END AS created,
    CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS access_count FROM d WHERE doc_id % 7 <> 0)
  SELECT CAST(doc_id AS VARCHAR) AS cache_key, value, CAST(created AS BIGINT) AS created, CAST(CASE WHEN access_count > 0 THEN 1709337600 ELSE created END AS BIGINT) AS accessed, CAST(access_count AS BIGINT) AS access_count FROM e WHERE created >= 1709596800 - 30 * 86400""")
def cache_versions(spark, d):
    """A cache of all documents: put, replaced in part, touched, deleted in part, pruned by age, compacted."""
    cache = ResultCache(spark, scratch(spark, "cache"))
    docs = A.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("cache_key")).distinct()
    entry = lambda value: (F.lit(value).alias("value"), F.lit("m").alias("model"), F.lit("p").alias("provider"), F.lit(1).alias("tokens_used"))
    at = lambda seconds: F.timestamp_seconds(seconds)
    cache.put(docs.select("doc_id", "cache_key", *entry("old")), at(F.expr(_CREATED)))
    cache.put(docs.where("doc_id % 5 = 0").select("cache_key", *entry("new")), at(F.lit(1709251200)))
    cache.touch(docs.where("doc_id % 3 = 0").unionByName(docs.where("doc_id % 6 = 0")), at(F.lit(1709337600)))
    cache.delete(docs.where("doc_id % 7 = 0"))
    cache.prune(at(F.lit(1709596800)))
    cache.compact()
    return cache.read().select("cache_key", "value", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("accessed_at").alias("accessed"), "access_count")


# Cache and jobs, over the event log


@query("SELECT event_id, sha256(event_type || '|m|' || props) AS key FROM events")
def cache_key(spark, d):
    return A.table(spark, d, "events").select("event_id", H.cache_key(F.col("event_type"), F.lit("m"), F.col("props")).alias("key"))


def _cache(spark, d):
    log = A.table(spark, d, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("cache_key"), F.col("ts").alias("created_at"), F.col("ts").alias("accessed_at"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("model"), F.floor(F.abs("value")).cast("bigint").alias("tokens_used"))
    return H.latest(log, by="at").withColumn("accessed_at", F.col("at.ts")).drop("at")


_CACHE = """cache AS (SELECT user_id || '-' || event_type AS cache_key, min(ts) AS created_at, max(ts) AS accessed_at, count(*) - 1 AS access_count, event_type AS model, arg_max(floor(abs(value))::BIGINT, (ts, event_id)) AS tokens_used FROM events GROUP BY user_id, event_type)"""


@query(f"WITH {_CACHE} SELECT cache_key, floor(epoch(created_at))::BIGINT AS created, floor(epoch(accessed_at))::BIGINT AS accessed, access_count, model, tokens_used FROM cache")
def cache_upsert(spark, d):
    return _cache(spark, d).select("cache_key", F.unix_timestamp("created_at").alias("created"), F.unix_timestamp("accessed_at").alias("accessed"), "access_count", "model", "tokens_used")


def _items(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", F.concat((F.col("c_custkey") % 1500).cast("string"), F.lit("-click")).alias("cache_key"))


_ITEMS = "items AS (SELECT c_custkey, (c_custkey % 1500) || '-click' AS cache_key FROM customer)"
_LIVE = f"created_at >= {_NOW} - INTERVAL 30 DAY"


@query(f"WITH {_CACHE}, {_ITEMS} SELECT c_custkey, tokens_used, cache.cache_key IS NOT NULL AS hit FROM items LEFT JOIN cache ON cache.cache_key = items.cache_key AND {_LIVE}")
def cache_lookup_ttl(spark, d):
    return H.lookup(_items(spark, d), _cache(spark, d), F.expr(_NOW)).select("c_custkey", "tokens_used", "hit")


@query(f"WITH {_CACHE}, {_ITEMS} SELECT c_custkey, cache_key FROM items WHERE cache_key NOT IN (SELECT cache_key FROM cache WHERE {_LIVE})")
def cache_misses(spark, d):
    return H.misses(_items(spark, d), _cache(spark, d), F.expr(_NOW)).select("c_custkey", "cache_key")


@query(f"WITH {_CACHE} SELECT model, count(*) AS entries FROM cache WHERE NOT ({_LIVE}) GROUP BY model")
def cache_expired(spark, d):
    return H.expired(_cache(spark, d), F.expr(_NOW)).groupBy("model").agg(F.count("*").alias("entries"))


@query(f"WITH {_CACHE} SELECT count(*) AS entries, count(DISTINCT model) AS models, sum(tokens_used)::BIGINT AS tokens, sum(access_count)::BIGINT AS accesses FROM cache")
def cache_stats(spark, d):
    return H.cache_stats(_cache(spark, d)).drop("oldest", "newest")


def _job_items(spark, d):
    log = A.table(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), (F.col("event_id") % 40).alias("item_id"), (F.col("event_type") == "error").alias("failed"), F.struct("ts", "event_id").alias("ts"))
    return H.job_items(log)


_JOB = "item AS (SELECT user_id % 50 AS job_id, event_id % 40 AS item_id, arg_max(event_type = 'error', (ts, event_id)) AS failed FROM events GROUP BY 1, 2)"
_ALL = "everything AS (SELECT j AS job_id, i AS item_id FROM range(50) a(j), range(40) b(i))"


def _all_items(spark):
    return spark.range(50 * 40).select((F.col("id") / 40).cast("bigint").alias("job_id"), (F.col("id") % 40).alias("item_id"))


@query(f"WITH {_JOB}, {_ALL} SELECT * FROM everything EXCEPT SELECT job_id, item_id FROM item")
def resume_unprocessed(spark, d):
    return H.unprocessed(_all_items(spark), _job_items(spark, d))


@query(f"WITH {_JOB}, {_ALL} SELECT * FROM everything EXCEPT SELECT job_id, item_id FROM item WHERE NOT failed")
def resume_retry_failed(spark, d):
    return H.unprocessed(_all_items(spark), _job_items(spark, d), retry_failed=True)


@query(f"""WITH {_JOB}, n AS (SELECT j AS job_id, count(item.item_id) FILTER (NOT failed) AS processed, count(item.item_id) FILTER (failed) AS failed FROM range(50) a(j) LEFT JOIN item ON job_id = j GROUP BY 1)
SELECT job_id, 40::BIGINT AS total, processed, failed, 40 - processed - failed AS remaining, round((processed + failed) * 100.0::DOUBLE / 40, 6) AS progress FROM n""")
def job_progress(spark, d):
    return H.jobs(_job_items(spark, d), spark.range(50).select(F.col("id").alias("job_id"), F.lit(40).cast("bigint").alias("total")))


@query("SELECT user_id AS job_id, floor(epoch(max(ts)))::BIGINT AS created FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY created DESC, job_id LIMIT 20")
def job_list_topk(spark, d):
    log = A.table(spark, d, "events").groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("status")).agg(F.unix_timestamp(F.max("ts")).alias("created_at"))
    return H.list_jobs(log, status="error", limit=20).select("job_id", F.col("created_at").alias("created"))


_TRIED = "tried AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth, ['rate_limit', 'client_error', 'other'][event_id % 3 + 1] AS kind FROM events WHERE event_type = 'error')"


@query(f"WITH {_TRIED} SELECT event_id, nth % 5 AS attempt, kind, CASE kind WHEN 'rate_limit' THEN pow(2.0, nth % 5) WHEN 'client_error' THEN 0.5 * pow(2.0, nth % 5) ELSE 0 END::DOUBLE AS seconds FROM tried")
def backoff_schedule(spark, d):
    """The pause after each error event, a user's errors being the attempts at a call."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    kinds = F.array(*map(F.lit, ("rate_limit", "client_error", "other")))
    tried = A.table(spark, d, "events").where("event_type = 'error'").select("event_id", (nth % 5).cast("bigint").alias("attempt"), F.get(kinds, (F.col("event_id") % 3).cast("int")).alias("kind"))
    return tried.withColumn("seconds", H.backoff(F.col("attempt"), F.col("kind")))


@query("""WITH u AS (SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS done, epoch(max(ts)) - epoch(min(ts)) AS elapsed FROM events GROUP BY user_id)
  SELECT user_id, round(CASE WHEN done > 0 THEN elapsed / done * (total - done) END, 3) AS seconds FROM u""")
def job_eta(spark, d):
    """Seconds that each user's remaining events would take at the pace of those done."""
    at = F.col("ts").cast("timestamp").cast("double")
    each = A.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("done"), (F.max(at) - F.min(at)).alias("elapsed"))
    return each.select("user_id", F.round(H.eta_seconds(F.col("elapsed"), F.col("done"), F.col("total")), 3).alias("seconds"))


# Prompts and synthesis


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"SELECT doc_id, {_sql(G.MODES['teach'])} || chr(10) || 'Source: text' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Title: ' || source || chr(10) ELSE '' END || 'Content:' || chr(10) || substr(text, 1, 3000) AS prompt FROM documents")
def prompt_mode(spark, d):
    title = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return A.table(spark, d, "documents").select("doc_id", G.mode_prompt(F.col("text"), title, F.lit("text"), F.lit("teach")).alias("prompt"))


@query("""SELECT doc_id, 'Lead a learner through this ' || CASE WHEN doc_id % 2 = 0 THEN 'code by questions about what it does and why.' ELSE 'text by questions about what it claims and why.' END || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Reply with JSON: {"conversation": [{"role": "...", "content": "..."}], "reasoning": "..."}' AS prompt FROM documents""")
def prompt_socratic(spark, d):
    return A.table(spark, d, "documents").select("doc_id", G.socratic_prompt(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "code").otherwise("text")).alias("prompt"))


@query(f"""WITH {A.CONV} SELECT conv_id, {_sql(f"Rate from 0 to 10: {', '.join(G.LEGACY_RUBRICS)}.")} || chr(10) || chr(10) || 'Source:' || chr(10) || 's' || chr(10) || chr(10) || 'Conversation:' || chr(10) || array_to_string(list_transform(turns, lambda t: t.role || ': ' || t.content), chr(10)) || chr(10) || chr(10) || 'Reply with JSON.' AS prompt FROM conv""")
def judge_prompt(spark, d):
    return A.conversations(spark, d).select("conv_id", G.judge_prompt(F.lit("s"), F.col("turns")).alias("prompt"))


# Streams


@query(f"WITH {A.CONV} SELECT conv_id AS id, CAST(len(turns) AS INT) AS n_turns FROM conv")
def stream_export(spark, d):
    """Conversations written as Parquet, read as a stream, exported as chatml and read back."""
    import uuid

    from corpusmill import streaming
    from corpusmill.operators.shared import cut, shared_folder

    at = f"{shared_folder(spark)}/corpusmill/stream-{uuid.uuid4().hex}"
    rows = cut(A.conversations(spark, d), "stream-in")
    folder = rows.inputFiles()[0].rpartition("/")[0]
    streaming.export(streaming.read(spark, folder, rows.schema), ["chatml"], f"{at}/out", f"{at}/checkpoint").awaitTermination()
    out = spark.read.schema("id bigint, messages array<struct<role:string,content:string>>").json(f"{at}/out/chatml")
    return out.select("id", F.size("messages").alias("n_turns"))


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_events(spark, d):
    """Events read as a stream, passed through a narrow operator to files, then aggregated."""
    import uuid

    from corpusmill import streaming
    from corpusmill.operators.shared import shared_folder

    at = f"{shared_folder(spark)}/corpusmill/stream-{uuid.uuid4().hex}"
    schema = A.table(spark, d, "events").schema
    rows = streaming.read(spark, d, schema, "events.parquet")
    streaming.transform(rows, lambda r: r.select("event_type", "value"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("event_type string, value double").parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
