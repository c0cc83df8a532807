"""Synthesis: chunks to conversations through a pluggable generator.

A generator is any object with ``generate(system, user) -> str``; the one given here needs
no network and always answers the same.  Prompts are native expressions.  Results are
written keyed by cache key, so only items that the cache lacks meet the generator.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import strip_code_fences
from corpusmill.operators import generation
from corpusmill.operators.clients import Providers
from corpusmill.operators.evaluation import agreement, confidence, normalize_scores
from corpusmill.operators.generation import Generator, Limits
from corpusmill.operators.shared import cut, scratch
from corpusmill.operators.state import item_key
from corpusmill.schema import TURNS

#: Instructions by mode; pass your own table to change them.
MODES = {
    "teach": "Teach the material step by step, from what it rests on to what follows from it.",
    "debug": "Present a fault that someone could meet here and find its cause together.",
    "review": "Review the material: what holds, what does not, what to change.",
    "qa": "Ask and answer the questions that the material settles.",
    "explain": "Explain the material in plain words, with an example.",
    "evol_instruct": "Start from a simple instruction and make it harder in each turn.",
    "rag_qa": "Answer from the material only, and say where it has no answer.",
    "tool_call": "Solve the task by calls to named tools and their results.",
    "constitutional": "Draft an answer, criticise it against stated principles, revise it.",
    "distill": "Give the shortest complete answer that keeps every fact.",
}
#: Rubrics of the judge.
RUBRICS = ("accuracy", "clarity", "completeness", "depth", "pedagogy", "faithfulness", "safety")
LEGACY_RUBRICS = RUBRICS[:5]
CONTENT_LIMIT = 3000
FALLBACK_LIMIT = 500


def mode_prompt(content: Column, title: Column, source_type: Column, mode: Column) -> Column:
    """User prompt: instruction of the mode, metadata lines that are filled, content up to its limit."""
    instruction = F.lit(MODES["explain"])
    for name, text in MODES.items():
        instruction = F.when(mode == name, text).otherwise(instruction)
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    return F.concat_ws("\n", instruction, line("Source", source_type), line("Title", title), F.lit("Content:"), F.coalesce(F.substring(content, 1, CONTENT_LIMIT), F.lit("")))


def socratic_prompt(content: Column, source_type: Column) -> Column:
    """Questions that lead to the content's ideas; code has a template of its own."""
    code = F.lit("Lead a learner through this code by questions about what it does and why.\n\n")
    other = F.lit("Lead a learner through this text by questions about what it claims and why.\n\n")
    return F.concat(F.when(source_type == "code", code).otherwise(other), content, F.lit('\n\nReply with JSON: {"conversation": [{"role": "...", "content": "..."}], "reasoning": "..."}'))


def scaffold_prompt(content: Column) -> Column:
    """The assistant's text is part of the prompt."""
    return F.concat(F.lit("Rewrite this answer so that each step is set out before its result:\n\n"), content)


def judge_prompt(source: Column, turns: Column, rubrics: tuple[str, ...] = LEGACY_RUBRICS) -> Column:
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")
    return F.concat(F.lit(f"Rate from 0 to 10: {', '.join(rubrics)}.\n\nSource:\n"), source, F.lit("\n\nConversation:\n"), said, F.lit("\n\nReply with JSON."))


def extract_json(text: str | None, strict: bool = False) -> Any:
    """The first fenced block that parses, else the first innermost flat object, else the whole text; None if nothing does.

    With ``strict`` the outermost braces are tried before the innermost ones.
    """
    text = text or ""
    tries = re.findall(r"```(?:json)?\s*\n?(.*?)\n?```", text, re.S)
    if strict and "{" in text:
        tries.append(text[text.index("{") : text.rindex("}") + 1] if "}" in text else "")
    for candidate in (*tries, *re.findall(r"\{[^{}]*\}", text), text):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def extract_json_column(text: Column) -> Column:
    """The same as a native expression: the JSON text that parses first; null if none does."""
    fenced = F.regexp_extract_all(text, F.lit(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"), F.lit(1))
    flat = F.regexp_extract_all(text, F.lit(r"(?s)\{[^{}]*\}"), F.lit(0))
    return F.get(F.filter(F.concat(fenced, flat, F.array(text)), lambda c: F.try_parse_json(c).isNotNull()), F.lit(0))


class OfflineGenerator:
    """Answers with a two-turn conversation on the prompt's own content, as fenced JSON: only so is an object with inner ones read whole."""

    def generate(self, system: str, user: str) -> str:
        _, found, content = user.partition("Content:\n")
        said = (content if found else user).strip(" \t\n\f\r")[:FALLBACK_LIMIT]
        answer = json.dumps({"conversation": [{"role": "user", "content": "What does this say?"}, {"role": "assistant", "content": said}], "reasoning": "offline"})
        # A fence in the content would end the answer's own.
        answer = answer.replace("`", "\\u0060")
        return f"```json\n{answer}\n```"


_REGISTRY: dict[str, Callable[[], Generator]] = {}
_ALIASES: dict[str, str] = {}


def register_generator(name: str, factory: Callable[[], Generator], aliases: tuple[str, ...] = ()) -> None:
    _REGISTRY[name] = factory
    _ALIASES.update(dict.fromkeys(aliases, name))


def get_generator(name: str, providers: Providers | None = None, **settings: Any) -> Generator:
    """A registered generator, else a client of the provider of that name, made with ``settings`` (model, base_url, key)."""
    name = _ALIASES.get(name, name)
    if name in _REGISTRY:
        return _REGISTRY[name]()
    providers = providers or Providers()
    try:
        provider = providers.get(name)
    except ValueError:
        raise ValueError(f"unknown generator: {name}; known: {', '.join([*sorted(_REGISTRY), *providers.names()])}") from None
    return provider.client(**settings)


register_generator("offline", OfflineGenerator, ("mock", "none"))


def generate(rows: DataFrame, key: str, system: Column, user: Column, generator: Generator | None = None, limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """``generation.generate``, by default with the generator that needs no network."""
    return generation.generate(rows, key, system, user, generator or OfflineGenerator(), limits, log)


def call_log(spark: SparkSession, name: str, generator: Generator | None) -> str | None:
    """A folder for the results of one job's calls, deleted with the tables of an open ``spent_tables`` block; none where calls cost nothing."""
    return None if generator is None or isinstance(generator, OfflineGenerator) else scratch(spark, f"calls-{name}")


def scaffold(conversations: DataFrame, generator: Generator | None = None, limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """Each assistant turn rewritten in steps by the generator; a turn whose call fails stays as it is.

    One pass over conversations; all other columns stay, scores included.
    """
    ask = "Rewrite this answer so that each step is set out before its result:\n\n"

    def prompts(turns: list[dict] | None) -> list[tuple[int, str]]:
        return [(i, ask + (t["content"] or "")) for i, t in enumerate(turns or ()) if t["role"] == "assistant"]

    def put(turns: list[dict] | None, answers: dict[int, str]) -> list[dict] | None:
        return turns and [{**t, "content": answers.get(i, t["content"])} for i, t in enumerate(turns)]

    log = log or call_log(conversations.sparkSession, "scaffold", generator)
    return generation.rewritten(conversations, "turns", prompts, put, generator or OfflineGenerator(), limits, log)


def judge(conversations: DataFrame, source: Column, generator: Generator, rubrics: tuple[str, ...] = LEGACY_RUBRICS, limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """conv_id, judge_scores (map), judge_overall, confidence_score, judge_error.

    Scores are clamped and the overall is their mean where the judge gives none; a reply
    without scores is an error of its own row.
    """
    replies = generate(conversations, "conv_id", F.lit("You rate conversations."), judge_prompt(source, F.col("turns"), rubrics), generator, limits, log or call_log(conversations.sparkSession, "judge", generator))
    text = extract_json_column(F.col("response"))
    scores = F.map_filter(F.from_json(text, "map<string,string>"), lambda k, _: ~k.isin("explanation", "error"))
    numbers = normalize_scores(F.transform_values(scores, lambda _, v: v.try_cast("double")))
    read = replies.select("conv_id", numbers.alias("judge_scores"), F.get_json_object(text, "$.error").alias("said"), "error")
    overall = F.element_at("judge_scores", "overall")
    return read.select("conv_id", "judge_scores", overall.alias("judge_overall"), confidence(overall).alias("confidence_score"), F.when(overall.isNull(), F.coalesce("error", "said", F.lit("no scores in the reply"))).alias("judge_error"))


def judge_twice(conversations: DataFrame, source: Column, gate: Generator, audit: Generator, audited: Column | None = None, rubrics: tuple[str, ...] = LEGACY_RUBRICS, limits: Limits | None = None) -> DataFrame:
    """``judge`` by ``gate``, and audit_scores, audit_overall, audit_error and judge_agreement of a second judge.

    ``audited`` says of ``judge``'s columns which conversations the second, dearer judge
    sees; without it, all.  Where it saw none or either gave no overall, the agreement is null.
    """
    rated = cut(judge(conversations, source, gate, rubrics, limits), "gate")
    chosen = conversations.select("conv_id", source.alias("source_text"), "turns")
    if audited is not None:
        chosen = chosen.join(rated.where(audited).select("conv_id"), "conv_id", "left_semi")
    again = judge(chosen, F.col("source_text"), audit, rubrics, limits)
    second = again.select("conv_id", *[F.col(f"judge_{c}").alias(f"audit_{c}") for c in ("scores", "overall", "error")])
    return rated.join(second, "conv_id", "left").withColumn("judge_agreement", agreement(F.col("judge_overall"), F.col("audit_overall")))


def conversation_turns(response: Column, content: Column) -> Column:
    """Turns from a reply's JSON, or two turns that ask for the content to be explained."""
    parsed = F.from_json(extract_json_column(response), f"conversation {TURNS}, reasoning string")
    fallback = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Explain the following:\n\n"), F.substring(content, 1, FALLBACK_LIMIT)).alias("content")), F.struct(F.lit("assistant").alias("role"), strip_code_fences(F.coalesce(response, F.lit(""))).alias("content")))
    return F.get(F.transform(F.array(parsed), lambda p: F.when(F.size(p["conversation"]) > 0, p["conversation"]).otherwise(fallback)), F.lit(0))


def socratic(chunks: DataFrame, generator: Generator | None = None, limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """chunk_id, turns, reasoning_trace, error: a dialogue of questions on each chunk; null turns where the call or its JSON fails."""
    replies = cut(generate(chunks, "chunk_id", F.lit("You teach by asking."), socratic_prompt(F.col("content"), F.col("source_type")), generator, limits, log or call_log(chunks.sparkSession, "socratic", generator)), "socratic")
    parsed = F.from_json(extract_json_column(F.col("response")), f"conversation {TURNS}, reasoning string")
    read = replies.select("chunk_id", "error", parsed.alias("p"))
    return read.select("chunk_id", F.when(F.size("p.conversation") > 0, F.col("p.conversation")).alias("turns"), F.col("p.reasoning").alias("reasoning_trace"), "error")


def synthesize(
    chunks: DataFrame, mode: str = "teach", model: str = "offline", generator: Generator | None = None, cache: DataFrame | None = None, limits: Limits | None = None, log: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(conversations, new cache entries) for chunks (chunk_id, content, title, source_type).

    Items that the cache has are joined, the others generated.  Ids are hashes, so a run
    can be repeated.  Failed items have an error in the cache entries and no conversation.
    ``log`` names a folder of results that outlives the job: a job that died is run again over the
    same folder and calls only for what it had not finished.
    """
    keyed = chunks.withColumn("cache_key", item_key(F.struct("chunk_id", "content"), F.lit(model), F.lit(mode)))
    missing = keyed if cache is None else keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    prompt = mode_prompt(F.col("content"), F.col("title"), F.col("source_type"), F.lit(mode))
    # Written once: later steps must not call the generator again.
    generator = generator or OfflineGenerator()
    call = generation.resumed if log else generation.generate
    log = log or call_log(chunks.sparkSession, "synthesize", generator)
    made = cut(call(missing, "cache_key", F.lit(MODES[mode]), prompt, generator, limits=limits, log=log), "generated")
    have = made.select("cache_key", "response", "error") if cache is None else made.select("cache_key", "response", "error").unionByName(cache.select("cache_key", "response", "error"))
    # Rows that are repeated have one key and an answer each: one of them is taken, so each row is one conversation.
    answered = keyed.join(have.where("error is null").groupBy("cache_key").agg(F.min("response").alias("response")), "cache_key")
    conversations = answered.select(
        F.sha2(F.concat_ws("|", "chunk_id", F.lit(mode)), 256).alias("conv_id"),
        F.col("chunk_id").alias("source_chunk_id"),
        conversation_turns(F.col("response"), F.col("content")).alias("turns"),
        F.get_json_object(extract_json_column(F.col("response")), "$.reasoning").alias("reasoning_trace"),
        F.lit(None).cast("double").alias("confidence_score"),
        F.lit(None).cast("double").alias("judge_overall"),
    )
    return conversations, made
