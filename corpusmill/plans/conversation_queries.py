"""Queries on conversations: assembly, pruning, validation, deduplication, splits, layouts, preferences, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import strip_code_fences
from corpusmill.operators import conversations as V
from corpusmill.operators import evaluation as E
from corpusmill.operators import formats as X
from corpusmill.operators import preferences as P
from corpusmill.operators import splits as S
from corpusmill.operators import synthesis as G
from corpusmill.plans import adapters as A
from corpusmill.plans.registry import query
from corpusmill.schema import SplitConfig

#: Fixed text in SQL: the filler patterns, once more and by themselves.
_RULES = [
    r"^(Sure|Of course|Certainly|Absolutely|Here you go|Here''s)[\s!,.]+",
    r"^(I''d be happy to|I can help|Let me)[\s]+",
    r"^(Hope this helps|Let me know if)[\s]+.*$",
    r"^(Feel free to|Don''t hesitate to)[\s]+.*$",
    r"^(Great question|Interesting question)[\s!,.]+",
]
_CLEAN = "content"
for _r in _RULES[:4]:
    _CLEAN = f"regexp_replace({_CLEAN}, '(?im){_r}', '', 'g')"
_CLEAN = rf"regexp_replace(regexp_replace({_CLEAN}, '^\s+|\s+$', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')".replace("'^\\s+|\\s+$', 'g')", "'\\A\\s+|\\s+\\z', '', 'g')")
_FILLER = " OR ".join(rf"regexp_matches(content, '(?i)\A{r[1:]}')" for r in _RULES)
_PRUNE_FILLER = " OR ".join(rf"regexp_matches(content, '(?i)\A{r[1:]}')" for r in _RULES[:4])
_ROLES = "list_transform(turns, lambda t: t.role)"
_SPOKEN = f"list_filter({_ROLES}, lambda r: r <> 'system')"
_VALID = f"coalesce(len(turns) > 0 AND {_ROLES}[1] IN ('system', 'user') AND list_contains({_ROLES}, 'user') AND list_contains({_ROLES}, 'assistant') AND len(list_filter({_SPOKEN}, lambda r, i: i > 1 AND r = {_SPOKEN}[i - 1])) = 0, false)"
_HASH = "left(sha256(array_to_string(list_transform(turns, lambda t: t.content), '|')), 16)"


def _of(role: str) -> str:
    return f"list_transform(list_filter(turns, lambda t: t.role = '{role}'), lambda t: t.content)"


def _said(turns: str = "turns") -> F.Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")


_SAID = "array_to_string(list_transform(turns, lambda t: t.role || ':' || t.content), '|')"
_OF = {r: _of(r) for r in ("system", "user", "assistant")}
_SCORE = "coalesce(CASE WHEN judge_overall IS NOT NULL THEN greatest(0, least(1, judge_overall / 10)) END, confidence_score)"


@query(f"WITH {A.CONV} SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, {_SAID} AS said FROM conv")
def conv_assemble(spark, d):
    return A.conversations(spark, d).select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), _said().alias("said"))


@query("SELECT role, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY role")
def role_distribution(spark, d):
    return A.table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {A.CONV} SELECT conv_id, {_OF['system']}[1] AS system, {_OF['user']}[1] AS first_user, CAST(len({_OF['user']}) AS BIGINT) AS n_user, CAST(len({_OF['assistant']}) AS BIGINT) AS n_assistant FROM conv")
def conv_accessors(spark, d):
    t = F.col("turns")
    return A.conversations(spark, d).select("conv_id", V.first_content(t, "system").alias("system"), V.first_content(t, "user").alias("first_user"), F.size(V.contents(t, "user")).cast("bigint").alias("n_user"), F.size(V.contents(t, "assistant")).cast("bigint").alias("n_assistant"))


@query(f"WITH {A.DUPLICATED} SELECT conv_id, {_SAID} AS said FROM conv QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY conv_id) = 1")
def dedup_conversations(spark, d):
    return V.deduplicate(A.duplicated(spark, d)).select("conv_id", _said().alias("said"))


@query(f"WITH {A.DUPLICATED} SELECT min(conv_id) AS conv_id, count(*) AS copies FROM conv GROUP BY {_HASH}")
def stream_keep_first(spark, d):
    """Conversations read as a stream of files, a few at a time: the first of each content, and its copies."""
    from corpusmill import streaming
    from corpusmill.operators.shared import cut, scratch

    # Dealt so that copies lie in other files than what they are copies of.
    rows = cut(A.duplicated(spark, d).repartition(6, "conv_id"), "stream-in")
    folder, at = rows.inputFiles()[0].rpartition("/")[0], scratch(spark, "stream")
    streaming.keep_first(streaming.read(spark, folder, rows.schema, files_per_trigger=3), f"{at}/kept", f"{at}/checkpoint").awaitTermination()
    return streaming.kept_first(spark, f"{at}/kept", rows.schema).read().select("conv_id", "copies")


@query(f"WITH {A.DUPLICATED} SELECT conv_id, {_HASH} AS content_hash FROM conv QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY conv_id) > 1")
def duplicate_ids(spark, d):
    return V.duplicates(A.duplicated(spark, d)).select("conv_id", "content_hash")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def doc_exact_dedup(spark, d):
    return A.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query(f"WITH {A.FILLED}, turn AS (SELECT conv_id, generate_subscripts(turns, 1) - 1 AS i, unnest(turns).content AS content FROM conv) SELECT conv_id, CAST(i AS BIGINT) AS turn, {_CLEAN} AS content FROM turn")
def prune_clean_turns(spark, d):
    return A.filled(spark, d).select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), V.clean(F.col("t.content")).alias("content"))


_CLEANED = f"""turn AS (SELECT conv_id, generate_subscripts(turns, 1) AS i, unnest(turns).role AS role, unnest(turns).content AS content FROM conv),
cleaned AS (SELECT conv_id, i, role, {_CLEAN} AS content FROM turn),
pruned AS (SELECT conv_id, list({{'role': role, 'content': content}} ORDER BY i) AS turns FROM cleaned WHERE content <> '' GROUP BY conv_id)"""


@query(f"WITH {A.FILLED}, {_CLEANED} SELECT conv_id, {_SAID} AS said FROM pruned WHERE len(turns) >= 2 AND {_VALID}")
def prune_conversations(spark, d):
    return V.prune(A.filled(spark, d)).select("conv_id", _said().alias("said"))


@query(f"WITH {A.CONV} SELECT conv_id, {_VALID} AS valid FROM conv")
def structure_valid(spark, d):
    return A.conversations(spark, d).select("conv_id", V.structure_valid(F.col("turns")).alias("valid"))


@query(f"""WITH {A.FILLED}, measured AS (SELECT conv_id, turns, list_sum(list_transform(turns, lambda t: length(t.content))) AS chars,
  len(list_filter(list_transform(turns, lambda t: t.content), lambda content: {_PRUNE_FILLER})) / len(turns) AS ratio FROM conv),
tenths AS (SELECT conv_id, 10 - CASE WHEN len(turns) < 2 THEN 5 ELSE 0 END - CASE WHEN chars < 50 THEN 3 ELSE 0 END - CASE WHEN ratio > 0.3 THEN 2 ELSE 0 END - CASE WHEN NOT {_VALID} THEN 4 ELSE 0 END AS n FROM measured)
SELECT conv_id, greatest(n, 0) / 10 AS quality_score, n >= 5 AS quality_valid FROM tenths""")
def quality_tuple(spark, d):
    return V.quality(A.filled(spark, d)).select("conv_id", "quality_score", "quality_valid")


@query(f"WITH {A.CONV} SELECT conv_id, len(list_filter({_OF['user']}, lambda c: trim(c) <> '')) > 0 AND len(list_filter({_OF['assistant']}, lambda c: trim(c) <> '')) > 0 AS valid FROM conv")
def heuristic_valid(spark, d):
    return A.conversations(spark, d).select("conv_id", V.heuristic_valid(F.col("turns")).alias("valid"))


@query("SELECT event_id, props AS bare FROM events")
def strip_fences(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```\n"))
    return A.table(spark, d, "events").select("event_id", strip_code_fences(F.when(F.col("event_id") % 2 == 0, fenced).otherwise(F.concat(F.lit("  "), "props", F.lit("\n")))).alias("bare"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS found FROM events")
def extract_json(spark, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("I found "), "props", F.lit(" there."))).otherwise("nothing of that kind")
    return A.table(spark, d, "events").select("event_id", G.extract_json_column(wrapped).alias("found"))


_ISSUES = f"""short AS (SELECT conv_id, turns FROM conv),
issues AS (
  SELECT 'warning' AS severity, 'structure' AS category, 'Conversation ' || conv_id || ' has only ' || len(turns) || ' turns' AS message, conv_id FROM conv WHERE len(turns) < 3
  UNION ALL SELECT 'warning', 'structure', 'Conversation ' || conv_id || ' has no user turn', conv_id FROM conv WHERE NOT list_contains({_ROLES}, 'user')
  UNION ALL SELECT 'warning', 'structure', 'Conversation ' || conv_id || ' has no assistant turn', conv_id FROM conv WHERE NOT list_contains({_ROLES}, 'assistant'))"""


@query(f"WITH {A.FILLED}, {_ISSUES} SELECT * FROM issues")
def validate_structure_issues(spark, d):
    return V.structure_issues(A.filled(spark, d), min_turns=3)


_TURN = "turn AS (SELECT conv_id, unnest(turns).role AS role, unnest(turns).content AS content FROM conv)"


@query(f"""WITH {A.FILLED}, {_TURN}, ratio AS (SELECT sum(CASE WHEN {_FILLER} THEN 1 ELSE 0 END) / count(*) AS ratio FROM turn)
SELECT 'info' AS severity, 'quality' AS category, 'Conversation ' || conv_id || ' turn content is very short (' || length(content) || ' chars)' AS message, conv_id FROM turn WHERE length(content) < 20
UNION ALL SELECT 'warning', 'quality', printf('High filler ratio: %.1f%% (max: 30.0%%)', ratio * 100), NULL FROM ratio WHERE ratio > 0.3""")
def validate_quality_issues(spark, d):
    return V.quality_issues(A.filled(spark, d))


_STATS = f"""SELECT count(*) AS conversations, sum(len(turns))::BIGINT AS turns, min(len(turns))::BIGINT AS min_turns, max(len(turns))::BIGINT AS max_turns, round(avg(len(turns)), 6) AS avg_turns,
  sum(chars)::BIGINT AS chars, round(avg(chars), 6) AS avg_chars, sum(tokens)::BIGINT AS tokens, sum(len({_OF['system']}))::BIGINT AS system_turns, sum(len({_OF['user']}))::BIGINT AS user_turns,
  sum(len({_OF['assistant']}))::BIGINT AS assistant_turns, sum(len({_of('tool')}))::BIGINT AS tool_turns, count(*) FILTER (len({_OF['system']}) > 0) AS with_system, count(*) FILTER (len(turns) > 2) AS multi_turn,
  sum(filler)::BIGINT AS filler_turns, count(*) - count(DISTINCT {_HASH}) AS duplicates, count(DISTINCT {_HASH}) AS unique_conversations
FROM (SELECT *, list_sum(list_transform(turns, lambda t: length(t.content))) AS chars, list_sum(list_transform(turns, lambda t: length(t.content) // 4)) AS tokens,
  len(list_filter(list_transform(turns, lambda t: trim(t.content)), lambda content: {_FILLER})) AS filler FROM conv)"""


@query(f"WITH {A.DUPLICATED} {_STATS}")
def dataset_stats(spark, d):
    return V.statistics(A.duplicated(spark, d))


@query(f"WITH {A.FILLED} {_STATS}")
def dataset_stats_filler(spark, d):
    return V.statistics(A.filled(spark, d))


@query(f"WITH {A.CONV} SELECT (len(turns) // 5 * 5) || '-' || (len(turns) // 5 * 5 + 4) AS bucket, count(*) AS conversations FROM conv GROUP BY 1")
def turn_histogram(spark, d):
    return V.turn_histogram(A.conversations(spark, d))


@query(f"""WITH {A.DUPLICATED}, {_TURN}, s AS (SELECT count(*) - count(DISTINCT {_HASH}) AS duplicates, count(*) FILTER (len(turns) < 2) + count(*) FILTER (NOT list_contains({_ROLES}, 'user')) + count(*) FILTER (NOT list_contains({_ROLES}, 'assistant')) AS structure FROM conv),
q AS (SELECT count(*) FILTER (length(content) < 20) AS short, sum(CASE WHEN {_FILLER} THEN 1 ELSE 0 END) / count(*) AS ratio FROM turn)
SELECT true AS is_valid, 0::BIGINT AS errors, structure + CASE WHEN ratio > 0.3 THEN 1 ELSE 0 END + CASE WHEN duplicates > 0 THEN 1 ELSE 0 END AS warnings, short AS infos, duplicates,
  greatest(100 - structure * 5 - (short + CASE WHEN ratio > 0.3 THEN 1 ELSE 0 END) * 3 - least(duplicates, 20), 0) / 100 AS quality_score FROM s, q""")
def validation_report(spark, d):
    return V.report(A.duplicated(spark, d))


# Splits

_SPLIT = "CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END"
_CONFIG = SplitConfig(0.8, 0.1, 0.1)


@query(f"WITH ids AS (SELECT DISTINCT conv_id FROM conversations), ranked AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id || '42'), conv_id) AS r, count(*) OVER () AS n FROM ids) SELECT conv_id, {_SPLIT} AS split FROM ranked")
def split_random(spark, d):
    return S.random_split(A.conversations(spark, d), "conv_id", _CONFIG).select("conv_id", "split")


@query(f"WITH ranked AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, lang, {_SPLIT} AS split FROM ranked")
def split_stratified(spark, d):
    return S.stratified_split(A.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", _CONFIG)


@query("WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'train' AS split, floor(n * 0.8)::BIGINT AS rows FROM n UNION ALL SELECT 'val', floor(n * 0.1)::BIGINT FROM n UNION ALL SELECT 'test', (n - floor(n * 0.8) - floor(n * 0.1))::BIGINT FROM n")
def split_sizes(spark, d):
    return S.summary(S.random_split(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", _CONFIG))


@query("WITH n AS (SELECT o_orderpriority AS stratum, count(*) AS n FROM orders GROUP BY 1) SELECT stratum, 'train' AS split, floor(n * 0.8)::BIGINT AS rows FROM n UNION ALL SELECT stratum, 'val', floor(n * 0.1)::BIGINT FROM n UNION ALL SELECT stratum, 'test', (n - floor(n * 0.8) - floor(n * 0.1))::BIGINT FROM n")
def split_stratified_sizes(spark, d):
    split = S.stratified_split(A.table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", _CONFIG)
    return split.groupBy(F.col("o_orderpriority").alias("stratum"), "split").agg(F.count("*").alias("rows"))


# Layouts, flattened to plain columns


@query(f"WITH {A.CONV} SELECT conv_id AS id, array_to_string(list_transform(turns, lambda t: CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE t.role END || ':' || t.content), '|') AS conversations FROM conv")
def fmt_sharegpt(spark, d):
    return X.sharegpt(A.conversations(spark, d)).select("id", F.array_join(F.transform("conversations", lambda m: F.concat(m["from"], F.lit(":"), m["value"])), "|").alias("conversations"))


@query(f"WITH {A.CONV} SELECT {_OF['user']}[1] AS instruction, '' AS input, array_to_string({_OF['assistant']}, chr(10) || chr(10)) AS output, nullif({_OF['system']}[1], '') AS system FROM conv WHERE {_OF['user']}[1] <> '' AND len({_OF['assistant']}) > 0")
def fmt_alpaca(spark, d):
    return X.alpaca(A.conversations(spark, d))


@query(f"WITH {A.CONV} SELECT conv_id AS id, {_SAID} AS messages FROM conv")
def fmt_chatml(spark, d):
    return X.chatml(A.conversations(spark, d)).select("id", _said("messages").alias("messages"))


@query(f"WITH {A.CONV} SELECT conv_id AS id, source_chunk_id, {_SAID} AS turns, len(turns)::INT AS turn_count, confidence_score FROM conv")
def fmt_conversation(spark, d):
    return X.conversation(A.conversations(spark, d)).select("id", "source_chunk_id", _said().alias("turns"), "metadata.turn_count", "metadata.confidence_score")


@query(f"WITH {A.CONV} SELECT {_SAID} AS messages FROM conv")
def fmt_hf_messages(spark, d):
    return X.hf_messages(A.conversations(spark, d)).select(_said("messages").alias("messages"))


@query(f"WITH {A.CONV} SELECT conv_id AS id, source_chunk_id, {_SAID} AS messages, confidence_score, judge_overall AS overall FROM conv")
def fmt_jsonl(spark, d):
    return X.jsonl(A.conversations(spark, d)).select("id", "source_chunk_id", _said("messages").alias("messages"), "confidence_score", "judge_scores.overall")


@query(f"WITH {A.CONV} SELECT conv_id AS id, (generate_subscripts(turns, 1) - 1)::INT AS turn, unnest(turns).role AS role, unnest(turns).content AS content FROM conv")
def fmt_jsonl_flat(spark, d):
    return X.flat_jsonl(A.conversations(spark, d))


@query(f"WITH {A.CONV} SELECT conv_id AS id, source_chunk_id, {_SAID} AS messages, confidence_score, judge_overall AS overall FROM conv")
def fmt_parquet_rows(spark, d):
    return X.parquet_rows(A.conversations(spark, d)).select("id", "source_chunk_id", _said("messages").alias("messages"), "confidence_score", F.get_json_object("judge_scores", "$.overall").cast("double").alias("overall"))


_DPO = f"""answers AS (SELECT conv_id, {_OF['user']}[1] AS prompt, {_OF['assistant']} AS a, nullif({_OF['system']}[1], '') AS system, judge_overall, confidence_score, source_chunk_id FROM conv WHERE len({_OF['user']}) > 0 AND len({_OF['assistant']}) > 0)"""
_REJECTED = "CASE WHEN len(a) < 2 THEN '' WHEN judge_overall IS NOT NULL THEN a[-1] ELSE a[2] END AS rejected"


@query(f"WITH {A.CONV}, {_DPO} SELECT conv_id, prompt, a[1] AS chosen, {_REJECTED} FROM answers")
def fmt_dpo(spark, d):
    return X.dpo(A.conversations(spark, d))


@query(f"WITH {A.CONV}, {_DPO} SELECT conv_id, prompt, a[1] AS chosen, {_REJECTED}, CASE WHEN len(a) >= 2 THEN system END AS system FROM answers")
def fmt_orpo(spark, d):
    return X.orpo(A.conversations(spark, d))


@query(f"WITH {A.CONV}, {_DPO} SELECT conv_id, prompt, unnest(a) AS response, 1 - 0.5::DOUBLE * (generate_subscripts(a, 1) - 1) AS score, CASE WHEN generate_subscripts(a, 1) = 1 THEN 'chosen' ELSE 'rejected' END AS label FROM answers")
def fmt_preference_scored(spark, d):
    return X.preference_scored(A.conversations(spark, d)).select("conv_id", "prompt", F.inline("responses"))


@query(f"WITH {A.CONV}, {_DPO} SELECT conv_id, prompt, unnest(a) AS completion, CASE WHEN judge_overall IS NOT NULL THEN judge_overall >= 7 WHEN confidence_score IS NOT NULL THEN confidence_score >= 0.7 ELSE true END AS label, system FROM answers")
def fmt_kto(spark, d):
    return X.kto(A.conversations(spark, d))


@query(f"""WITH {A.CONV}, e AS (SELECT source_chunk_id, conv_id, {_OF['user']}[1] AS prompt, {_OF['assistant']}[1] AS completion, coalesce(round({_SCORE}, 4), 0.5) AS reward FROM conv),
g AS (SELECT source_chunk_id, list(prompt ORDER BY conv_id)[1] AS prompt, list(completion ORDER BY conv_id) FILTER (completion IS NOT NULL) AS completions, list(reward ORDER BY conv_id) FILTER (completion IS NOT NULL) AS rewards, arg_min(prompt, conv_id) AS p FROM e GROUP BY 1)
SELECT CAST(source_chunk_id AS VARCHAR) AS source_chunk_id, prompt, array_to_string(completions, '|') AS completions, round(list_sum(rewards), 6) AS reward_sum FROM g WHERE len(completions) >= 2 AND prompt IS NOT NULL""")
def fmt_grpo(spark, d):
    rows = X.grpo(A.conversations(spark, d))
    return rows.select("source_chunk_id", "prompt", F.array_join("completions", "|").alias("completions"), F.round(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 6).alias("reward_sum"))


@query(f"WITH {A.CONV} SELECT conv_id AS id, {_SAID} AS messages, 0::INT AS tools, source_chunk_id, reasoning_trace FROM conv")
def fmt_agent(spark, d):
    return X.agent(A.conversations(spark, d)).select("id", _said("messages").alias("messages"), F.size("tools").alias("tools"), "source_chunk_id", "reasoning_trace")


@query(f"WITH {A.CONV} SELECT {_OF['user']}[1] AS query, 0::INT AS contexts, {_OF['assistant']}[1] AS answer, true AS answerable, source_chunk_id FROM conv WHERE len({_OF['user']}) > 0 AND len({_OF['assistant']}) > 0")
def fmt_rag_qa(spark, d):
    return X.rag_qa(A.conversations(spark, d)).select("query", F.size("contexts").alias("contexts"), "answer", "answerable", "source_chunk_id")


_PROMPTED = f"{_OF['user']}[1] <> '' AND len({_OF['assistant']}) > 0"


@query(f"""WITH {A.CONV}, {_DPO}, e AS (SELECT source_chunk_id, conv_id, {_OF['user']}[1] AS prompt, {_OF['assistant']}[1] AS completion FROM conv),
g AS (SELECT source_chunk_id FROM e GROUP BY 1 HAVING count(completion) >= 2 AND list(prompt ORDER BY conv_id)[1] IS NOT NULL),
n AS (SELECT unnest(['sharegpt', 'chatml', 'conversation', 'hf_messages', 'jsonl', 'parquet', 'agent']) AS layout, count(*) AS rows FROM conv
  UNION ALL SELECT unnest(['dpo', 'orpo', 'preference', 'preference_scored', 'rag_qa']), count(*) FROM answers UNION ALL SELECT 'kto', sum(len(a))::BIGINT FROM answers
  UNION ALL SELECT 'alpaca', count(*) FROM conv WHERE {_PROMPTED} UNION ALL SELECT 'grpo', count(*) FROM g)
SELECT layout, rows, 0::BIGINT AS invalid, true AS valid FROM n""")
def format_validate(spark, d):
    conv = A.conversations(spark, d)
    out = None
    for layout, made in X.FORMATS.items():
        one = X.format_valid(made(conv), layout).select(F.lit(layout).alias("layout"), "rows", "invalid", "valid")
        out = one if out is None else out.unionByName(one)
    return out


# Preferences

_ROWS = f"s AS (SELECT conv_id, source_chunk_id, coalesce({_OF['user']}[1], '') AS prompt, coalesce({_OF['assistant']}[1], '') AS response, {_SCORE} AS score FROM conv)"
_PAIR = "CASE WHEN b.prompt <> '' THEN b.prompt ELSE w.prompt END AS prompt, b.response AS chosen, w.response AS rejected, round(b.score, 6) AS chosen_score, round(w.score, 6) AS rejected_score, b.conv_id AS best_conv_id, w.conv_id AS worst_conv_id"
_PASS = "b.score - w.score >= 0.1 AND (b.prompt <> '' OR w.prompt <> '') AND b.response <> '' AND w.response <> ''"
_IN = f"""WITH {A.CONV}, {_ROWS}, scored AS (SELECT * FROM s WHERE score IS NOT NULL),
best AS (SELECT *, count(*) OVER (PARTITION BY source_chunk_id) AS n FROM scored QUALIFY row_number() OVER (PARTITION BY source_chunk_id ORDER BY score DESC, conv_id) = 1),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY source_chunk_id ORDER BY score, conv_id DESC) = 1),
pairs AS (SELECT b.source_chunk_id, {_PAIR} FROM best b JOIN worst w USING (source_chunk_id) WHERE n >= 2 AND {_PASS})"""
_SHOWN = ("source_chunk_id", "prompt", "chosen", "rejected", "chosen_score", "rejected_score", "best_conv_id", "worst_conv_id")


def _rounded(pairs):
    return pairs.withColumns({c: F.round(c, 6) for c in ("chosen_score", "rejected_score")})


@query(f"{_IN} SELECT * FROM pairs")
def pref_pairs_in_source(spark, d):
    return _rounded(P.in_source_pairs(A.conversations(spark, d))).select(*_SHOWN)


@query(f"""WITH {A.CONV}, {_ROWS}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id) AS r, count(*) OVER () AS n FROM s WHERE score IS NOT NULL)
SELECT {_PAIR} FROM ranked b JOIN ranked w ON w.r = b.n + 1 - b.r AND b.r <= b.n // 2 WHERE {_PASS}""")
def pref_pairs_cross_source(spark, d):
    alone = A.conversations(spark, d).withColumn("source_chunk_id", F.col("conv_id"))
    return _rounded(P.cross_source_pairs(alone)).select(*_SHOWN[1:])


@query(f"{_IN} SELECT prompt, chosen, rejected, round(chosen_score, 4) AS score_chosen, round(rejected_score, 4) AS score_rejected FROM pairs")
def pref_to_dpo(spark, d):
    return P.to_dpo(P.in_source_pairs(A.conversations(spark, d)))


@query(f"{_IN} SELECT prompt, chosen AS completion, true AS label FROM pairs UNION ALL SELECT prompt, rejected, false FROM pairs")
def pref_to_kto(spark, d):
    return P.to_kto(P.in_source_pairs(A.conversations(spark, d)))


@query(f"{_IN} SELECT prompt, chosen || '|' || rejected AS completions, round(chosen_score, 4) AS first_reward FROM pairs")
def pref_to_grpo(spark, d):
    return P.to_grpo(P.in_source_pairs(A.conversations(spark, d))).select("prompt", F.array_join("completions", "|").alias("completions"), F.get("rewards", F.lit(0)).alias("first_reward"))


@query(f"{_IN} SELECT prompt, chosen, rejected FROM pairs")
def pref_to_orpo(spark, d):
    return P.to_orpo(P.in_source_pairs(A.conversations(spark, d))).select("prompt", "chosen", "rejected")


# Evaluation


@query(f"""WITH {A.CONV}, m AS (SELECT count(*) AS total, count(*) FILTER (len(list_filter({_OF['user']}, lambda c: trim(c) <> '')) > 0 AND len(list_filter({_OF['assistant']}, lambda c: trim(c) <> '')) > 0) AS valid, avg(confidence_score) AS conf, avg(judge_overall) AS judge FROM conv)
SELECT total, valid::BIGINT AS valid, round(valid / total, 6) AS valid_rate, round(conf, 6) AS mean_confidence, round(judge, 6) AS mean_judge_overall,
  array_to_string(list_filter([CASE WHEN valid / total < 0.8 THEN printf('valid_rate %.1f%% < 80.0%%', valid / total * 100) END, CASE WHEN conf < 0.5 THEN printf('mean_confidence %.3f < 0.500', conf) END, CASE WHEN judge < 5 THEN printf('mean_judge_overall %.2f < 5.00', judge) END], lambda x: x IS NOT NULL), '; ') AS failures,
  valid / total >= 0.8 AND conf >= 0.5 AND judge >= 5 AS passed FROM m""")
def eval_gate(spark, d):
    r = E.evaluate(A.conversations(spark, d))
    return r.select("total", F.col("valid").cast("bigint").alias("valid"), F.round("valid_rate", 6).alias("valid_rate"), F.round("mean_confidence", 6).alias("mean_confidence"), F.round("mean_judge_overall", 6).alias("mean_judge_overall"), "failures", "passed")


@query("""WITH s AS (SELECT event_id, value / 3 + 0.0013 AS first, value / 7 - 1.00037 AS second FROM events)
SELECT event_id, round(greatest(0, least(10, first)), 2) AS accuracy, round(greatest(0, least(10, second)), 2) AS clarity, round((greatest(0, least(10, first)) + greatest(0, least(10, second))) / 2, 2) AS overall FROM s""")
def judge_normalize(spark, d):
    scores = A.table(spark, d, "events").select("event_id", E.normalize_scores(F.create_map(F.lit("accuracy"), F.col("value") / 3 + 0.0013, F.lit("clarity"), F.col("value") / 7 - 1.00037)).alias("s"))
    return scores.select("event_id", *[F.col("s")[k].alias(k) for k in ("accuracy", "clarity", "overall")])


@query(f"WITH {A.CONV} SELECT conv_id, greatest(0, least(1, judge_overall / 10)) AS confidence FROM conv WHERE judge_overall IS NOT NULL")
def judge_confidence(spark, d):
    return A.conversations(spark, d).where("judge_overall is not null").select("conv_id", E.confidence(F.col("judge_overall")).alias("confidence"))


@query(f"WITH {A.CONV} SELECT conv_id, round(1 - abs(judge_overall - confidence_score * 10) / 10, 3) AS agreement FROM conv WHERE judge_overall IS NOT NULL AND confidence_score IS NOT NULL")
def judge_agreement(spark, d):
    return A.conversations(spark, d).where("judge_overall is not null and confidence_score is not null").select("conv_id", E.agreement(F.col("judge_overall"), F.col("confidence_score") * 10).alias("agreement"))


_GRAMS = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM documents),
r AS (SELECT item_id AS ref_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS w FROM benchmark),
k AS (SELECT unnest(range(1, 9)) AS k),
dg AS (SELECT DISTINCT doc_id, k, len(w) AS n, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN k ON k <= len(w) WHERE k = 8 OR len(w) = k OR k IN (SELECT len(w) FROM r))),
rg AS (SELECT DISTINCT ref_id, k, len(w) AS n, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT ref_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM r JOIN k ON k <= len(w))),
size AS (SELECT doc_id, k, count(*) AS grams FROM dg GROUP BY ALL),
pairs AS (SELECT dg.doc_id, ref_id, k, count(*) AS shared FROM dg JOIN rg USING (k, g) WHERE k = least(8, dg.n, rg.n) GROUP BY ALL),
overlap AS (SELECT doc_id, ref_id, round(shared / grams, 6) AS overlap FROM pairs JOIN size USING (doc_id, k))"""


def _references(spark, d):
    return A.table(spark, d, "benchmark").select(F.col("item_id").alias("ref_id"), "text")


@query(f"WITH {_GRAMS} SELECT * FROM overlap")
def ngram_contamination(spark, d):
    return E.ngram_overlap(A.table(spark, d, "documents").select("doc_id", "text"), _references(spark, d)).withColumn("overlap", F.round("overlap", 6))


@query(f"WITH {_GRAMS} SELECT doc_id, max(overlap) AS overlap FROM overlap GROUP BY doc_id HAVING max(overlap) >= 0.05")
def contaminated_docs(spark, d):
    return E.contaminated(A.table(spark, d, "documents").select("doc_id", "text"), _references(spark, d), 0.05).withColumn("overlap", F.round("overlap", 6))
