"""Train, validation and test splits of exact sizes, by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.schema import SplitConfig

#: Hex digits of the hash by which a split's rows are dealt: 4096 groups of equal size, whatever the ids.
_DIGITS = 3


def _order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(str(seed))))


def _named(rank: Column, n: Column, config: SplitConfig, lone_to_train: bool) -> Column:
    train = F.floor(n * F.lit(config.train))
    until = train + F.floor(n * F.lit(config.validation))
    name = F.when(rank <= train, "train").when(rank <= until, "val").otherwise("test")
    return F.when(n == 1, "train").otherwise(name) if lone_to_train else name


def random_split(rows: DataFrame, key: str, config: SplitConfig | None = None) -> DataFrame:
    """Adds ``split``: floor(n * ratio) rows for train and validation, the rest for test; one row alone is train.

    Rows are ranked by a hash of ``key`` and the seed.  The hash's first digits deal them to
    groups that are ranked each by itself; a small table of the groups' sizes does the rest.
    """
    config = config or SplitConfig()
    hashed = rows.withColumn("_order", _order(F.col(key), config.seed)).withColumn("_group", F.substring("_order", 1, _DIGITS))
    sizes = hashed.groupBy("_group").agg(F.count("*").alias("_n"))
    # At most 16 ** _DIGITS rows, so one task orders them.
    offsets = sizes.select("_group", (F.sum("_n").over(Window.orderBy("_group")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    ranked = hashed.withColumn("_local", F.row_number().over(Window.partitionBy("_group").orderBy("_order", key)))
    placed = ranked.join(F.broadcast(offsets), "_group")
    return placed.withColumn("split", _named(F.col("_before") + F.col("_local"), F.col("_total"), config, True)).drop("_order", "_group", "_n", "_before", "_local", "_total")


def stratified_split(rows: DataFrame, key: str, by: str, config: SplitConfig | None = None) -> DataFrame:
    """Adds ``split`` with the ratios holding in each group of ``by``; a group of one goes to test.

    Groups may be large: each is dealt over hash groups as ``random_split`` does, so the
    rows of one stratum are never ranked in one task.
    """
    config = config or SplitConfig()
    hashed = rows.withColumn("_order", _order(F.col(key), config.seed)).withColumn("_group", F.substring("_order", 1, _DIGITS))
    sizes = hashed.groupBy(by, "_group").agg(F.count("*").alias("_n"))
    offsets = sizes.select(F.col(by).alias("_by"), F.col("_group").alias("_of"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_group")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("_total"))
    ranked = hashed.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_group").orderBy("_order", key)))
    placed = ranked.join(offsets, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_group") == F.col("_of")))
    return placed.withColumn("split", _named(F.col("_before") + F.col("_local"), F.col("_total"), config, False)).drop("_order", "_group", "_local", "_by", "_of", "_before", "_total")


def summary(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("rows"))


def save(split: DataFrame, path: str) -> None:
    """One folder of JSON lines per split that has rows."""
    split.write.mode("overwrite").partitionBy("split").json(path)
