"""Operators on conversations: one row each, with an ordered array of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank, short_hash, strip

#: Openings and closings that add nothing.  Order matters: each acts on what the one before left.
PRUNE_FILLER = (
    r"^(Sure|Of course|Certainly|Absolutely|Here you go|Here's)[\s!,.]+",
    r"^(I'd be happy to|I can help|Let me)[\s]+",
    r"^(Hope this helps|Let me know if)[\s]+.*$",
    r"^(Feel free to|Don't hesitate to)[\s]+.*$",
)
#: Fixed value: what the validator counts besides.
REPORT_FILLER = (*PRUNE_FILLER, r"^(Great question|Interesting question)[\s!,.]+")

#: Java's dialect made equal to the source's: Unicode classes, only \n ends a line.
_FLAGS = "(?Ud"


def assemble(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of turns to one row per conversation: conv_id, turns in order of ``turn``."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), "role", F.col("text").alias("content"))))
    return rows.groupBy(conv_id).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("turns"))


def contents(turns: Column, role: str | None = None) -> Column:
    """Contents of all turns, or of one role's."""
    return F.transform(F.filter(turns, lambda t: t["role"] == role) if role else turns, lambda t: t["content"])


def first_content(turns: Column, role: str) -> Column:
    return F.try_element_at(contents(turns, role), F.lit(1))


def content_hash(turns: Column) -> Column:
    """First 16 hex digits of sha256 over the contents joined by ``|``; roles do not count."""
    return short_hash(F.array_join(contents(turns), "|"))


def clean(content: Column) -> Column:
    """Without filler, stripped, blank lines at most one in a row."""
    for pattern in PRUNE_FILLER:
        content = F.regexp_replace(content, f"{_FLAGS}im){pattern}", "")
    return F.regexp_replace(strip(content), r"\n{3,}", "\n\n")


def starts_with_filler(content: Column, patterns: tuple[str, ...]) -> Column:
    return F.regexp_like(content, F.lit(f"{_FLAGS}i)\\A(?:" + "|".join(p.removeprefix("^").removesuffix("$") + (r"(?=\n?\z)" if p.endswith("$") else "") for p in patterns) + ")"))


def structure_valid(turns: Column) -> Column:
    """Begins with system or user, has user and assistant, and neighbours that are not system differ in role."""
    roles = F.transform(turns, lambda t: t["role"])
    spoken = F.filter(roles, lambda r: r != "system")
    differ = F.forall(F.zip_with(spoken, F.slice(spoken, 2, F.greatest(F.size(spoken), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNull() | (p["a"] != p["b"]))
    return F.coalesce((F.size(turns) > 0) & F.get(roles, 0).isin("system", "user") & F.array_contains(roles, "user") & F.array_contains(roles, "assistant") & differ, F.lit(False))


def prune(conversations: DataFrame) -> DataFrame:
    """Turns cleaned, blank ones gone; conversations of under two turns or of invalid structure dropped.

    All other columns stay, scores included.
    """
    cleaned = F.filter(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), clean(t["content"]).alias("content"))), lambda t: ~is_blank(t["content"]))
    # Bound once, null where it fails: a filter on its terms would be pushed below and clean every turn again for each of them.
    kept = F.get(F.transform(F.array(cleaned), lambda t: F.when((F.size(t) >= 2) & structure_valid(t), t)), F.lit(0))
    return conversations.withColumn("turns", kept).where(F.col("turns").isNotNull())


def heuristic_valid(turns: Column) -> Column:
    """A user and an assistant turn that are not blank."""
    return F.exists(turns, lambda t: (t["role"] == "user") & ~is_blank(t["content"])) & F.exists(turns, lambda t: (t["role"] == "assistant") & ~is_blank(t["content"]))


def quality(conversations: DataFrame, min_chars: int = 50, max_filler: float = 0.3) -> DataFrame:
    """Adds quality_score, quality_valid and quality_issues: a deduction for each of four faults."""
    turns = F.col("turns")
    n = F.size(turns)
    ratio = F.when(n > 0, F.size(F.filter(turns, lambda t: starts_with_filler(t["content"], PRUNE_FILLER))) / n).otherwise(0.0)
    faults = (
        (n < 2, 5, F.lit("Too few turns")),
        (F.aggregate(turns, F.lit(0), lambda a, t: a + F.length(t["content"])) < min_chars, 3, F.lit("Content too short")),
        (ratio > max_filler, 2, F.format_string("Too much filler: %.1f%%", ratio * 100)),
        (~structure_valid(turns), 4, F.lit("Invalid conversation structure")),
    )
    # Tenths are whole numbers, so that the comparison with a half is exact.
    tenths = F.lit(10)
    for holds, cost, _ in faults:
        tenths = tenths - F.when(holds, cost).otherwise(0)
    return conversations.withColumns({"quality_score": F.greatest(tenths, F.lit(0)) / 10, "quality_valid": tenths >= 5, "quality_issues": F.array_compact(F.array(*[F.when(h, text) for h, _, text in faults]))})


# Deduplication



def deduplicate(conversations: DataFrame, order: str = "conv_id") -> DataFrame:
    """The first conversation by ``order`` of each content hash.

    The least order per hash is found by an aggregate that combines before the shuffle,
    so a hash that very many conversations share does not gather in one task.
    """
    hashed = conversations.withColumn("content_hash", content_hash(F.col("turns")))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_hash", order], "left_semi").drop("content_hash")


def duplicates(conversations: DataFrame, order: str = "conv_id") -> DataFrame:
    """The conversations that ``deduplicate`` drops, with their content hash."""
    hashed = conversations.withColumn("content_hash", content_hash(F.col("turns")))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias(order))
    return hashed.join(first, ["content_hash", order], "left_anti")


# Validation report


def structure_issues(conversations: DataFrame, min_conversations: int = 1, min_turns: int = 2) -> DataFrame:
    """severity, category, message, conv_id: one row per structural issue.

    All issues of a conversation come from one pass over its row; only the count of
    conversations is an aggregate.
    """
    name, roles = F.col("conv_id").cast("string"), F.transform("turns", lambda t: t["role"])
    empty = F.filter(F.transform("turns", lambda t, i: F.when(is_blank(t["content"]), i)), lambda i: i.isNotNull())
    messages = F.concat(
        F.array(F.when(F.size("turns") < min_turns, F.format_string("Conversation %s has only %d turns", name, F.size("turns")))),
        F.transform(empty, lambda i: F.format_string("Conversation %s turn %d is empty", name, i)),
        F.array(F.when(~F.array_contains(roles, "user"), F.format_string("Conversation %s has no user turn", name))),
        F.array(F.when(~F.array_contains(roles, "assistant"), F.format_string("Conversation %s has no assistant turn", name))),
    )
    each = conversations.select("conv_id", F.explode(F.array_compact(messages)).alias("message"))
    warnings = each.select(F.lit("warning").alias("severity"), F.lit("structure").alias("category"), "message", "conv_id")
    few = conversations.agg(F.count("*").alias("n")).where(F.col("n") < min_conversations)
    errors = few.select(F.lit("error").alias("severity"), F.lit("structure").alias("category"), F.format_string(f"Too few conversations: %d < {min_conversations}", "n").alias("message"), F.lit(None).cast(conversations.schema["conv_id"].dataType).alias("conv_id"))
    return errors.unionByName(warnings)


def quality_issues(conversations: DataFrame, min_chars: int = 20, max_filler: float = 0.3) -> DataFrame:
    """severity, category, message, conv_id: short turns, and a high share of filler over all turns."""
    short = F.filter("turns", lambda t: F.length(t["content"]) < min_chars)
    name = F.col("conv_id").cast("string")
    infos = conversations.select("conv_id", F.explode(F.transform(short, lambda t: F.format_string("Conversation %s turn content is very short (%d chars)", name, F.length(t["content"])))).alias("message"))
    infos = infos.select(F.lit("info").alias("severity"), F.lit("quality").alias("category"), "message", "conv_id")
    ratio = conversations.agg(F.coalesce(F.try_divide(F.sum(_filler_turns()), F.sum(F.size("turns"))), F.lit(0.0)).alias("ratio")).where(F.col("ratio") > max_filler)
    high = F.format_string(f"High filler ratio: %.1f%% (max: {max_filler:.1%})".replace("%)", "%%)"), F.col("ratio") * 100)
    return infos.unionByName(ratio.select(F.lit("warning").alias("severity"), F.lit("quality").alias("category"), high.alias("message"), F.lit(None).cast(conversations.schema["conv_id"].dataType).alias("conv_id")))


def _filler_turns() -> Column:
    return F.size(F.filter("turns", lambda t: starts_with_filler(strip(t["content"]), REPORT_FILLER)))


def statistics(conversations: DataFrame) -> DataFrame:
    """One row of statistics over all conversations; averages are 0 for none."""
    turns, chars = F.size("turns"), F.aggregate("turns", F.lit(0), lambda a, t: a + F.length(t["content"]))
    tokens = F.aggregate("turns", F.lit(0), lambda a, t: a + F.floor(F.length(t["content"]) / 4).cast("int"))
    role = lambda r: F.size(contents(F.col("turns"), r))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    zero = lambda c: F.coalesce(c, F.lit(0))
    summed = conversations.agg(
        F.count("*").alias("conversations"),
        F.countDistinct(content_hash(F.col("turns"))).alias("unique_conversations"),
        total(turns).alias("turns"),
        zero(F.min(turns)).cast("bigint").alias("min_turns"),
        zero(F.max(turns)).cast("bigint").alias("max_turns"),
        F.round(zero(F.avg(turns)), 6).alias("avg_turns"),
        total(chars).alias("chars"),
        F.round(zero(F.avg(chars)), 6).alias("avg_chars"),
        total(tokens).alias("tokens"),
        *[total(role(r)).alias(f"{r}_turns") for r in ("system", "user", "assistant", "tool")],
        F.count_if(role("system") > 0).alias("with_system"),
        F.count_if(turns > 2).alias("multi_turn"),
        total(_filler_turns()).alias("filler_turns"),
    )
    return summed.withColumn("duplicates", F.col("conversations") - F.col("unique_conversations"))


def turn_histogram(conversations: DataFrame, width: int = 5) -> DataFrame:
    """bucket ("a-b"), conversations: how many have that many turns."""
    low = F.floor(F.size("turns") / width) * width
    return conversations.groupBy(low.alias("low")).agg(F.count("*").alias("conversations")).select(F.concat_ws("-", F.col("low").cast("string"), (F.col("low") + width - 1).cast("string")).alias("bucket"), "conversations")


def report(conversations: DataFrame, min_conversations: int = 1, min_turns: int = 2, min_chars: int = 20, max_filler: float = 0.3) -> DataFrame:
    """One row: is_valid, errors, warnings, infos, duplicates, quality_score."""
    issues = structure_issues(conversations, min_conversations, min_turns).unionByName(quality_issues(conversations, min_chars, max_filler))
    none = F.lit(0).cast("bigint").alias("duplicates")
    copies = statistics(conversations).select(*[F.lit(None).cast("string").alias(c) for c in ("severity", "category")], "duplicates")
    counted = issues.select("severity", "category", none).unionByName(copies).agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.count_if(F.col("category") == "structure").alias("structure"),
        F.count_if(F.col("category") == "quality").alias("quality"),
        F.max("duplicates").alias("duplicates"),
    )
    taken = F.col("structure") * 5 + F.col("quality") * 3 + F.least(F.col("duplicates"), F.lit(20))
    return counted.select((F.col("errors") == 0).alias("is_valid"), "errors", (F.col("warnings") + F.when(F.col("duplicates") > 0, 1).otherwise(0)).alias("warnings"), "infos", "duplicates", (F.greatest(100 - taken, F.lit(0)) / 100).alias("quality_score"))
