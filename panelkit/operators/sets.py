"""Ordering, top rows, unions, set operations, and samples that a hash of the key draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import key_hash
from ..sources import materialise
from .joins import without_keys
from .ordering import numbered


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.orderBy(*columns)


def top_n(df: DataFrame, metric: str, n: int, ties: list[str]) -> DataFrame:
    return df.orderBy(F.desc(metric), *ties).limit(n)


def union_labelled(presence: DataFrame, absence: DataFrame, keys: tuple[str, ...] = ("Grid_ID", "iso_year", "iso_week")) -> DataFrame:
    """Both panels by name, missing columns null. Raises ValueError where a key stands in both."""
    both = shared_keys(presence, absence, list(keys))
    if found := both.limit(1).collect():
        raise ValueError(f"a key stands in both panels: {found[0].asDict()}")
    return presence.unionByName(absence, allowMissingColumns=True)


def shared_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in both: none, where the panels are disjoint."""
    return a.select(*keys).intersect(b.select(*keys))


def stack(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """All frames by name, each row tagged with its frame."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn(tag, F.lit(k)) for k, f in frames.items()))


def keys_only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().exceptAll(b.select(*keys).distinct())


def _drawn(seed: int | str, key: list[str]) -> list[Column]:
    return [key_hash(seed, *map(F.col, key)), *map(F.col, key)]


def stratified_sample(df: DataFrame, n: int, target: str, key: list[str], seed: int = 42) -> DataFrame:
    """About n rows with the classes' shares kept, at least one of each; exact sizes, by a hash of the key.

    No class needs more than n + 1 rows, so every task hands on at most as many of each.
    """
    sizes = df.groupBy(target).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_k", F.greatest(F.lit(1), F.round(n * F.col("_n") / F.sum("_n").over(Window.partitionBy())).cast("long")))
    d = df.join(F.broadcast(sizes), target)
    rank = F.row_number().over(Window.partitionBy(target).orderBy(*_drawn(seed, key)))
    return d.withColumn("_r", rank).filter(F.col("_r") <= n + 1).filter(F.col("_r") <= F.col("_k")).select(*df.columns)


#: Rounds of the permutation of the cube's numbers.
ROUNDS = 4


def permuted(number: Column, rows: Column | int, columns: Column | int, seed: int) -> tuple[Column, Column]:
    """Row and column that a number from 0 to rows * columns - 1 comes to: a permutation of all of them, fixed by the seed.

    By turns the row is moved on by a hash of the column, and the column by one of the row.
    """
    rows, columns = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (rows, columns))
    a, b = F.floor(number / columns), F.pmod(number, columns)
    for k in range(ROUNDS):
        if k % 2:
            a = F.pmod(a + key_hash(seed, F.lit(k), b), rows)
        else:
            b = F.pmod(b + key_hash(seed, F.lit(k), a), columns)
    return a, b


def sample_background(cells: DataFrame, years: list[int], weeks: list[int], exclude: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n (where there are as many) distinct keys of cell, year and week that aren't in exclude.

    The cube of all keys isn't built: its numbers pass a keyed permutation, whose first values are
    decoded until n are left. The cost follows n and the share of the cube that exclude takes.
    """
    spark, keys = cells.sparkSession, ["Grid_ID", "iso_year", "iso_week"]
    order = materialise(numbered(cells.select("Grid_ID").distinct(), [F.col("Grid_ID")], "_cell"), "cell-numbers")
    count, slots = order.count(), len(years) * len(weeks)
    most, drawn = count * slots, 0
    free = exclude.select(*keys).distinct()
    while True:
        drawn = min(most, max(2 * drawn, n + n // 4 + 64))
        cell, slot = permuted(F.col("id"), max(count, 1), max(slots, 1), seed)
        d = spark.range(drawn).select("id", cell.alias("_cell"), slot.alias("_slot")).join(order, "_cell")
        at = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
        d = d.select("id", "Grid_ID", at(years or [None], F.floor(F.col("_slot") / max(len(weeks), 1))).alias("iso_year"), at(weeks or [None], F.pmod("_slot", F.lit(max(len(weeks), 1)))).alias("iso_week"))
        left = materialise(without_keys(d, free, keys), "background")
        if drawn == most or left.count() >= n:
            return left.orderBy("id").limit(n).select(*keys)


def group_shuffle_split(df: DataFrame, group: str, share: float = 0.25, seed: int = 42) -> DataFrame:
    """Adds part: calibration for the first ceil(share * groups) groups by hash, else train."""
    groups = df.select(group).distinct().withColumn("_hash", _drawn(seed, [group])[0])
    groups = numbered(groups, [F.col("_hash"), F.col(group)], "_place")
    total = groups.agg(F.count("*").alias("_total"))
    parts = groups.join(F.broadcast(total)).select(F.col(group).alias("_group"), F.when(F.col("_place") < F.ceil(share * F.col("_total")), "calibration").otherwise("train").alias("part"))
    return df.join(parts, df[group].eqNullSafe(parts["_group"])).drop("_group")


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Adds fold, 0 to k - 1: groups by size, dealt out to and fro."""
    sizes = numbered(df.groupBy(group).agg(F.count("*").alias("_n")), [F.desc("_n"), F.col(group)], "_at")
    turn, place = F.floor(F.col("_at") / k), F.col("_at") % k
    folds = sizes.select(F.col(group).alias("_group"), F.when(turn % 2 == 0, place).otherwise(k - 1 - place).cast("int").alias("fold"))
    return df.join(folds, df[group].eqNullSafe(folds["_group"])).drop("_group")


def prefer_complete(df: DataFrame, columns: list[str], n: int, key: list[str], seed: int = 42) -> DataFrame:
    """n rows: those where all columns are known come first, by a hash of the key."""
    complete = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return df.orderBy(F.desc(complete), *_drawn(seed, key)).limit(n)
