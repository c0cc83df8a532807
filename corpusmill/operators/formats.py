"""Export projections: one row-wise projection of conversations per training layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.conversations import contents, first_content


def _named(turns: Column, **names: str) -> Column:
    """Turns as structs with other field names: role=..., content=...."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias(names["role"]), t["content"].alias(names["content"])))


def messages(turns: Column) -> Column:
    return _named(turns, role="role", content="content")


def sharegpt(conversations: DataFrame) -> DataFrame:
    """id, conversations[{from, value}]; user is human, system and tool keep their names, anything else is gpt."""
    origin = lambda r: F.when(r == "user", "human").when(r.isin("system", "tool"), r).otherwise("gpt")
    return conversations.select(F.col("conv_id").alias("id"), F.transform("turns", lambda t: F.struct(origin(t["role"]).alias("from"), t["content"].alias("value"))).alias("conversations"))


def alpaca(conversations: DataFrame) -> DataFrame:
    """instruction, input, output, system: first user, empty, all assistants by blank lines; rows without user or assistant go."""
    answers = contents(F.col("turns"), "assistant")
    rows = conversations.select(
        first_content(F.col("turns"), "user").alias("instruction"),
        F.lit("").alias("input"),
        F.array_join(answers, "\n\n").alias("output"),
        F.nullif(first_content(F.col("turns"), "system"), F.lit("")).alias("system"),
        F.size(answers).alias("answers"),
    )
    return rows.where((F.col("instruction") != "") & (F.col("answers") > 0)).drop("answers")


def chatml(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("id"), messages(F.col("turns")).alias("messages"))


def conversation(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("id"), "source_chunk_id", messages(F.col("turns")).alias("turns"), "reasoning_trace", F.struct(F.size("turns").alias("turn_count"), "confidence_score").alias("metadata"))


def hf_messages(conversations: DataFrame) -> DataFrame:
    return conversations.select(messages(F.col("turns")).alias("messages"))


def jsonl(conversations: DataFrame, metadata: bool = True) -> DataFrame:
    """messages and, with ``metadata``, id, source_chunk_id and the scores; nulls are left out when written."""
    more = [F.col("conv_id").alias("id"), F.col("source_chunk_id"), F.col("confidence_score"), F.when(F.col("judge_overall").isNotNull(), F.struct(F.col("judge_overall").alias("overall"))).alias("judge_scores")]
    return conversations.select(messages(F.col("turns")).alias("messages"), *(more if metadata else []))


def flat_jsonl(conversations: DataFrame) -> DataFrame:
    """One row per turn: id, turn, role, content."""
    return conversations.select(F.col("conv_id").alias("id"), F.posexplode("turns").alias("turn", "t")).select("id", "turn", "t.role", "t.content")


def parquet_rows(conversations: DataFrame) -> DataFrame:
    """id, source_chunk_id, messages, confidence_score, judge_scores as JSON; both scores always have a column."""
    return conversations.select(F.col("conv_id").alias("id"), "source_chunk_id", messages(F.col("turns")).alias("messages"), "confidence_score", F.when(F.col("judge_overall").isNotNull(), F.to_json(F.struct(F.col("judge_overall").alias("overall")))).alias("judge_scores"))


def _answers(conversations: DataFrame) -> DataFrame:
    """prompt, answers, system, scores; rows without a prompt or an answer go."""
    rows = conversations.select("conv_id", "source_chunk_id", first_content(F.col("turns"), "user").alias("prompt"), contents(F.col("turns"), "assistant").alias("answers"), F.nullif(first_content(F.col("turns"), "system"), F.lit("")).alias("system"), "confidence_score", "judge_overall")
    return rows.where(F.col("prompt").isNotNull() & (F.size("answers") > 0))


def dpo(conversations: DataFrame) -> DataFrame:
    """prompt, chosen, rejected: first answer against the last where judged, else the second; "" if there is one answer."""
    other = F.when(F.size("answers") < 2, "").when(F.col("judge_overall").isNotNull(), F.try_element_at("answers", F.lit(-1))).otherwise(F.try_element_at("answers", F.lit(2)))
    return _answers(conversations).select("conv_id", "prompt", F.get("answers", F.lit(0)).alias("chosen"), other.alias("rejected"))


def orpo(conversations: DataFrame) -> DataFrame:
    """As dpo, with the system text where there are two answers or more."""
    system = _answers(conversations).select("conv_id", F.when(F.size("answers") >= 2, F.col("system")).alias("system"), "answers", "prompt", "judge_overall")
    other = F.when(F.size("answers") < 2, "").when(F.col("judge_overall").isNotNull(), F.try_element_at("answers", F.lit(-1))).otherwise(F.try_element_at("answers", F.lit(2)))
    return system.select("conv_id", "prompt", F.get("answers", F.lit(0)).alias("chosen"), other.alias("rejected"), "system")


def preference_scored(conversations: DataFrame) -> DataFrame:
    """prompt, responses[{response, score, label}]: the first is chosen; scores fall by a half."""
    rated = F.transform("answers", lambda a, i: F.struct(a.alias("response"), (1 - 0.5 * i).cast("double").alias("score"), F.when(i == 0, "chosen").otherwise("rejected").alias("label")))
    return _answers(conversations).select("conv_id", "prompt", rated.alias("responses"))


def kto(conversations: DataFrame, judge_cut: float = 7.0, confidence_cut: float = 0.7) -> DataFrame:
    """One row per answer: prompt, completion, label, system."""
    label = F.when(F.col("judge_overall").isNotNull(), F.col("judge_overall") >= judge_cut).when(F.col("confidence_score").isNotNull(), F.col("confidence_score") >= confidence_cut).otherwise(True)
    return _answers(conversations).select("conv_id", "prompt", F.explode("answers").alias("completion"), label.alias("label"), "system")


def score(judge: Column, confidence: Column) -> Column:
    """A tenth of the judge's overall, clamped to 0..1, else the confidence."""
    return F.coalesce(F.when(judge.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), judge / 10))), confidence)


#: Answers in a row of the grpo layout at most, about; a source with more gives several rows.
GROUP = 10_000


def grpo(conversations: DataFrame, default_reward: float = 0.5, order: str = "conv_id", most: int = GROUP) -> DataFrame:
    """prompt, completions[], rewards[] per source: the first conversation's prompt, everyone's first answer; two at least.

    A source of many answers is dealt over rows of about ``most`` by a hash, each with the
    source's prompt, so that no list grows without bound; none is dropped.
    """
    source = F.coalesce(F.col("source_chunk_id").cast("string"), F.col("conv_id").cast("string")).alias("source_chunk_id")
    reward = F.coalesce(F.bround(score(F.col("judge_overall"), F.col("confidence_score")), 4), F.lit(default_reward)).alias("reward")
    each = conversations.select(source, F.col(order).alias("ord"), first_content(F.col("turns"), "user").alias("prompt"), first_content(F.col("turns"), "assistant").alias("completion"), reward)
    sources = each.groupBy("source_chunk_id").agg(F.min_by(F.struct("prompt"), F.struct("ord", "prompt"))["prompt"].alias("prompt"), F.count("completion").alias("n"))
    wanted = sources.where("n >= 2 and prompt is not null").withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    dealt = each.where("completion is not null").drop("prompt").join(wanted.drop("n"), "source_chunk_id")
    part = F.pmod(F.xxhash64("ord", "completion"), F.col("parts"))
    grouped = dealt.groupBy("source_chunk_id", "prompt", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("ord", "completion", "reward"))).alias("all"))
    return grouped.select("source_chunk_id", "prompt", F.transform("all", lambda e: e["completion"]).alias("completions"), F.transform("all", lambda e: e["reward"]).alias("rewards"))


def agent(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").alias("id"), messages(F.col("turns")).alias("messages"), F.expr("cast(array() as array<string>)").alias("tools"), "source_chunk_id", "reasoning_trace")


def rag_qa(conversations: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """query, contexts, answer, answerable; contexts are empty unless ``chunks`` (chunk_id, content) are joined in."""
    rows = conversations.select(first_content(F.col("turns"), "user").alias("query"), first_content(F.col("turns"), "assistant").alias("answer"), F.lit(True).alias("answerable"), "source_chunk_id").where("query is not null and answer is not null")
    if chunks is None:
        return rows.select("query", F.expr("cast(array() as array<string>)").alias("contexts"), "answer", "answerable", "source_chunk_id")
    joined = rows.join(chunks.select(F.col("chunk_id").alias("source_chunk_id"), "content"), "source_chunk_id", "left")
    return joined.select("query", F.array_compact(F.array("content")).alias("contexts"), "answer", "answerable", "source_chunk_id")


FORMATS = {
    "sharegpt": sharegpt,
    "alpaca": alpaca,
    "chatml": chatml,
    "conversation": conversation,
    "hf_messages": hf_messages,
    "jsonl": jsonl,
    "parquet": parquet_rows,
    "dpo": dpo,
    "orpo": orpo,
    "preference": dpo,
    "preference_scored": preference_scored,
    "kto": kto,
    "grpo": grpo,
    "agent": agent,
    "rag_qa": rag_qa,
}

#: Columns that every row of a layout must fill.
REQUIRED = {
    "sharegpt": ("conversations",),
    "alpaca": ("instruction", "output"),
    "chatml": ("messages",),
    "conversation": ("turns",),
    "hf_messages": ("messages",),
    "jsonl": ("messages",),
    "parquet": ("id", "messages"),
    "dpo": ("prompt", "chosen"),
    "orpo": ("prompt", "chosen"),
    "preference": ("prompt", "chosen"),
    "preference_scored": ("prompt", "responses"),
    "kto": ("prompt", "completion", "label"),
    "grpo": ("prompt", "completions", "rewards"),
    "agent": ("id", "messages"),
    "rag_qa": ("query", "answer"),
}


def invalid_rows(rows: DataFrame, layout: str) -> DataFrame:
    """Rows of a layout with a required column null or empty."""
    bad = F.lit(False)
    for name in REQUIRED[layout]:
        kind = rows.schema[name].dataType.simpleString()
        empty = F.size(name) == 0 if kind.startswith("array") else F.col(name).cast("string") == ""
        bad = bad | F.col(name).isNull() | empty
    return rows.where(bad)


def format_valid(rows: DataFrame, layout: str) -> DataFrame:
    """One row: rows, invalid, valid."""
    marked = rows.select(F.lit(0).alias("bad")).unionByName(invalid_rows(rows, layout).select(F.lit(1).alias("bad")))
    return marked.agg(F.count_if(F.col("bad") == 0).alias("rows"), F.count_if(F.col("bad") == 1).alias("invalid")).withColumn("valid", F.col("invalid") == 0)
