"""Tokens and cost: estimates, usage records and price resolution against a catalog table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import token_estimate
from corpusmill.operators.catalog import CATALOG, catalog, current_models
from corpusmill.operators.shared import importable

__all__ = ["CATALOG", "catalog", "current_models"]

#: Model families whose deployment names carry a suffix to strip.
SUFFIXED = ("gpt-", "o1", "o3", "o4")


def message_tokens(turns: Column) -> Column:
    """Estimate over turns, with 4 for each one's framing."""
    return F.aggregate(turns, F.lit(0).cast("bigint"), lambda a, t: a + token_estimate(t["content"]) + 4)


class TokenCounter:
    """Counts tokens by a rank file and the pattern that splits text before it; without one, by the estimate."""

    def __init__(self, ranks: str | None = None, pattern: str = r"\S+|\s+") -> None:
        self.ranks, self.pattern = ranks, pattern
        self._encode = None

    def count(self, text: str) -> int:
        if self.ranks is None:
            return max(1, len(text) // 4)
        if self._encode is None:
            import base64

            import tiktoken

            with open(self.ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._encode = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        return len(self._encode(text))

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "pattern": self.pattern, "_encode": None}


def counted_tokens(rows: DataFrame, text: str, counter: TokenCounter) -> DataFrame:
    """``rows`` with tokens, counted by ``counter``; a null text is empty.  Estimates stay native, counts are one Arrow pass."""
    if counter.ranks is None:
        return rows.withColumn("tokens", token_estimate(F.coalesce(F.col(text), F.lit(""))))
    importable(rows.sparkSession)

    @F.pandas_udf("bigint")
    def count(texts):
        return texts.map(lambda t: counter.count(t or ""))

    return rows.withColumn("tokens", count(text))


def counted_message_tokens(conversations: DataFrame, counter: TokenCounter, model: str = "") -> DataFrame:
    """``conversations`` with tokens of their turns as a chat: 3 a message (4 for gpt-3.5), its fields, 1 for the role, and 3 for the reply."""
    if counter.ranks is None:
        return conversations.withColumn("tokens", message_tokens(F.col("turns")))
    importable(conversations.sparkSession)
    framing = (4 if "gpt-3.5" in model else 3) + 1

    @F.pandas_udf("bigint")
    def count(turns):
        return turns.map(lambda row: 3 + sum(framing + counter.count(t["role"] or "") + counter.count(t["content"] or "") for t in row))

    return conversations.withColumn("tokens", count("turns"))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def candidates(model: Column) -> Column:
    """Names under which a model's price is looked for, in order: itself, after the last / : @, lower-cased, without suffixes."""
    last = lambda mark: F.substring_index(model, mark, -1)
    names = F.array_distinct(F.array(model, last("/"), last(":"), last("@")))
    both = F.array_distinct(F.concat(names, F.transform(names, F.lower)))
    family = F.filter(F.transform(both, F.lower), lambda n: F.regexp_like(n, F.lit("^(?:" + "|".join(SUFFIXED) + ")")))
    parts = lambda n: F.size(F.split(n, "-"))
    shorter = F.flatten(F.transform(family, lambda n: F.transform(F.sequence(parts(n) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(F.split(n, "-"), 1, k), "-"))))
    return F.array_distinct(F.concat(both, F.when(F.size(shorter) > 0, shorter).otherwise(F.array().cast("array<string>"))))


def resolve_prices(models: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """``models`` with price_model, input_price and output_price of the first candidate that the catalog has; zero without one.

    Only distinct model names meet the catalog, which is a dimension table.
    """
    names = models.select(model).distinct().select(model, F.posexplode(candidates(F.col(model))).alias("_rank", "_name"))
    found = names.join(prices.select(F.col("model").alias("_name"), "input_price", "output_price"), "_name")
    best = found.groupBy(model).agg(F.min_by(F.struct(F.col("_name").alias("price_model"), "input_price", "output_price"), "_rank").alias("p")).select(model, "p.*")
    return models.join(best, model, "left").withColumns({"input_price": F.coalesce("input_price", F.lit(0.0)), "output_price": F.coalesce("output_price", F.lit(0.0))})


def usage(payload: Column) -> dict[str, Column]:
    """tokens_in and tokens_out of a usage record as JSON, under any of the vendors' names; 0 counts as absent."""
    first = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(payload, f"$.{n}").cast("bigint"), F.lit(0).cast("bigint")) for n in names], F.lit(0).cast("bigint"))
    return {
        "tokens_in": first("prompt_tokens", "input_tokens", "promptTokenCount", "prompt_eval_count", "prompt_tokens_details.total_tokens"),
        "tokens_out": first("completion_tokens", "output_tokens", "candidatesTokenCount", "eval_count", "completion_tokens_details.total_tokens"),
    }


def batch_estimate(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """requests, tokens_in, tokens_out, tokens, cost_usd, avg_tokens of priced usage records, over all or by columns."""
    price = cost(F.col("tokens_in"), F.col("tokens_out"), F.col("input_price"), F.col("output_price"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    grouped = records.groupBy(*(by or [])).agg(F.count("*").alias("requests"), total("tokens_in").alias("tokens_in"), total("tokens_out").alias("tokens_out"), F.round(F.coalesce(F.sum(price), F.lit(0.0)), 6).alias("cost_usd"))
    tokens = F.col("tokens_in") + F.col("tokens_out")
    return grouped.withColumns({"tokens": tokens, "avg_tokens": F.round(F.coalesce(F.try_divide(tokens, F.col("requests")), F.lit(0.0)), 6)})
