"""Result cache, jobs and checkpoints as tables; nothing is rewritten in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def cache_key(content: Column, model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("|", content, model, prompt), 256)


def item_key(item: Column, model: Column, mode: Column) -> Column:
    """Version 2: over canonical JSON of the item with model and mode, so results of one mode never answer for another."""
    return F.sha2(F.concat(F.lit("v2:"), F.to_json(F.struct(item.alias("item"), mode.alias("mode"), model.alias("model")))), 256)


def latest(entries: DataFrame, key: str = "cache_key", by: str = "accessed_at") -> DataFrame:
    """One row per key from an append-only log: first creation, last access and value, accesses counted."""
    value = [c for c in entries.columns if c not in (key, "created_at", by, "access_count")]
    return entries.groupBy(key).agg(F.min("created_at").alias("created_at"), F.max(by).alias(by), (F.count("*") - 1).alias("access_count"), F.max_by(F.struct(*value), by).alias("v")).select(key, "created_at", by, "access_count", *[f"v.{c}" for c in value])


def lookup(items: DataFrame, cache: DataFrame, now: Column, ttl_days: int = 30, key: str = "cache_key") -> DataFrame:
    """Items with the cached columns and ``hit``: created within the time to live."""
    live = cache.where(F.col("created_at").cast("timestamp").cast("double") >= now.cast("timestamp").cast("double") - ttl_days * DAY).withColumn("hit", F.lit(True))
    return items.join(live, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(items: DataFrame, cache: DataFrame, now: Column, ttl_days: int = 30, key: str = "cache_key") -> DataFrame:
    live = cache.where(F.col("created_at").cast("timestamp").cast("double") >= now.cast("timestamp").cast("double") - ttl_days * DAY)
    return items.join(live.select(key), key, "left_anti")


def expired(cache: DataFrame, now: Column, ttl_days: int = 30) -> DataFrame:
    return cache.where(F.col("created_at").cast("timestamp").cast("double") < now.cast("timestamp").cast("double") - ttl_days * DAY)


def hit_rate(looked_up: DataFrame) -> DataFrame:
    """hits, misses, hit_rate of what ``lookup`` gave; a rate of 0 without lookups."""
    counted = looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return counted.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)))


def keys_of(cache: DataFrame, model: str | None = None, key: str = "cache_key") -> DataFrame:
    return (cache if model is None else cache.where(F.col("model") == model)).select(key)


def tokens_by_model(cache: DataFrame) -> DataFrame:
    """model, entries, tokens."""
    return cache.groupBy("model").agg(F.count("*").alias("entries"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens"))


def pruned(cache: DataFrame, now: Column, older_than_days: int = 30) -> DataFrame:
    """What a pruning leaves: entries created within so many days."""
    return cache.where(F.col("created_at").cast("timestamp").cast("double") >= now.cast("timestamp").cast("double") - older_than_days * DAY)


def cache_stats(cache: DataFrame) -> DataFrame:
    """entries, models, oldest, newest, tokens, accesses."""
    return cache.agg(F.count("*").alias("entries"), F.countDistinct("model").alias("models"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"), F.coalesce(F.sum("tokens_used"), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum("access_count"), F.lit(0)).cast("bigint").alias("accesses"))


def job_items(events: DataFrame) -> DataFrame:
    """job_id, item_id, failed: an item's last state; success after failure counts as success."""
    return events.groupBy("job_id", "item_id").agg(F.max_by("failed", F.struct("ts", (~F.col("failed")).alias("ok"))).alias("failed"))


def jobs(items: DataFrame, totals: DataFrame) -> DataFrame:
    """job_id, total, processed, failed, remaining, progress (percent)."""
    done = items.groupBy("job_id").agg(F.count_if(~F.col("failed")).alias("processed"), F.count_if("failed").alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return totals.join(done, "job_id", "left").select("job_id", "total", zero("processed").alias("processed"), zero("failed").alias("failed"), (F.col("total") - zero("processed") - zero("failed")).alias("remaining"), F.round(F.when(F.col("total") > 0, (zero("processed") + zero("failed")) * 100.0 / F.col("total")).otherwise(0.0), 6).alias("progress"))


def unprocessed(all_items: DataFrame, items: DataFrame, retry_failed: bool = False) -> DataFrame:
    """(job_id, item_id) still to do; with ``retry_failed`` only successes are taken off."""
    done = items.where(~F.col("failed")) if retry_failed else items
    return all_items.join(done.select("job_id", "item_id"), ["job_id", "item_id"], "left_anti")


def list_jobs(jobs: DataFrame, status: str | None = None, job_type: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; ``limit`` is the report's length."""
    for name, value in (("status", status), ("job_type", job_type)):
        if value is not None:
            jobs = jobs.where(F.col(name) == value)
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(limit)


def recent_jobs(jobs: DataFrame, now: Column, older_than_days: int = 30) -> DataFrame:
    """What a clean-up leaves: jobs created within so many days."""
    return jobs.where(F.col("created_at").cast("timestamp").cast("double") >= now.cast("timestamp").cast("double") - older_than_days * DAY)


def eta_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, elapsed / done * (total - done))


def backoff(attempt: Column, kind: Column) -> Column:
    """Seconds before the next attempt: 2^k after a rate limit, half of that after a client error, else none."""
    power = F.pow(F.lit(2.0), attempt)
    return F.when(kind == "rate_limit", power).when(kind == "client_error", 0.5 * power).otherwise(0.0)


def pause(attempt: int, kind: str) -> float:
    """``backoff`` of plain values."""
    return {"rate_limit": 2.0, "client_error": 1.0}.get(kind, 0.0) * 2.0**attempt / 2.0
