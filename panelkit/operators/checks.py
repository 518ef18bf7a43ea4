"""Data-quality checks: each gives rows of check, level (PASS, WARN, FAIL) and metric."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_cell_id

SENTINELS = (-3000, -9999, -32768)


def _row(df: DataFrame, name: str, metric: Column, fail: Column | None = None, warn: Column | None = None) -> DataFrame:
    level = F.when(fail if fail is not None else F.lit(False), "FAIL").when(warn if warn is not None else F.lit(False), "WARN").otherwise("PASS")
    return df.select(F.lit(name).alias("check"), level.alias("level"), metric.cast("double").alias("metric"))


def report(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)


def keys_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """FAIL where a key column is missing or a key has several rows; metric: such keys."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        return _row(df.sparkSession.range(1), "keys_unique", F.lit(float(len(missing))), F.lit(True))
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.count_if(F.col("_n") > 1).alias("_m"))
    return _row(many, "keys_unique", F.col("_m"), F.col("_m") > 0)


def cell_count(df: DataFrame, expected: int, key: str = "Grid_ID", within: float = 0.05) -> DataFrame:
    n = df.agg(F.countDistinct(key).alias("_n"))
    return _row(n, "cell_count", F.col("_n"), warn=~F.col("_n").between(expected * (1 - within), expected * (1 + within)))


def null_shares(df: DataFrame, columns: list[str], fail: float = 0.999, warn: float = 0.5) -> DataFrame:
    """One row for each column, from one pass."""
    wide = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    long = wide.unpivot([], columns, "_c", "_v")
    level = F.when(F.col("_v") >= fail, "FAIL").when(F.col("_v") >= warn, "WARN").otherwise("PASS")
    return long.select(F.concat(F.lit("null_share:"), "_c").alias("check"), level.alias("level"), F.col("_v").alias("metric"))


def surviving_sentinels(df: DataFrame, columns: list[str], sentinels: tuple = SENTINELS) -> DataFrame:
    wide = df.agg(*(F.count_if(F.col(c).isin(*sentinels)).alias(c) for c in columns))
    long = wide.unpivot([], columns, "_c", "_v")
    return long.select(F.concat(F.lit("sentinel:"), "_c").alias("check"), F.when(F.col("_v") > 0, "FAIL").otherwise("PASS").alias("level"), F.col("_v").cast("double").alias("metric"))


def value_ranges(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows outside open-ended bounds, for each column."""
    out = lambda c, lo, hi: F.count_if((F.col(c) < lo if lo is not None else F.lit(False)) | (F.col(c) > hi if hi is not None else F.lit(False)))
    wide = df.agg(*(out(c, lo, hi).alias(c) for c, (lo, hi) in bounds.items()))
    long = wide.unpivot([], list(bounds), "_c", "_v")
    return long.select(F.concat(F.lit("range:"), "_c").alias("check"), F.when(F.col("_v") > 0, "FAIL").otherwise("PASS").alias("level"), F.col("_v").cast("double").alias("metric"))


def date_span(df: DataFrame, first: str, last: str, day: str = "Date") -> DataFrame:
    """FAIL where the column is no date; WARN where days lie outside; metric: days from the first to the last."""
    if not isinstance(df.schema[day].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _row(df.sparkSession.range(1), "date_span", F.lit(0.0), F.lit(True))
    d = df.agg(F.min(day).cast("date").alias("_a"), F.max(day).cast("date").alias("_b"))
    return _row(d, "date_span", F.datediff("_b", "_a"), warn=(F.col("_a") < F.lit(first).cast("date")) | (F.col("_b") > F.lit(last).cast("date")))


def static_constant(df: DataFrame, columns: list[str], key: str = "Grid_ID") -> DataFrame:
    """Cells in which a static column takes several values, for each column."""
    cell = df.groupBy(key).agg(*(F.min(c).alias(f"_a_{c}") for c in columns), *(F.max(c).alias(f"_b_{c}") for c in columns))
    wide = cell.agg(*(F.count_if(F.col(f"_a_{c}") != F.col(f"_b_{c}")).alias(c) for c in columns))
    long = wide.unpivot([], columns, "_c", "_v")
    return long.select(F.concat(F.lit("static:"), "_c").alias("check"), F.when(F.col("_v") > 0, "FAIL").otherwise("PASS").alias("level"), F.col("_v").cast("double").alias("metric"))


def usable_cells(df: DataFrame, wetness: str, threshold: float, shares: list[str], vegetation: list[str], most_null: float = 0.05) -> DataFrame:
    """No cell too wet, none without land cover, and few nulls of vegetation."""
    empty = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in shares))
    wide = df.agg(F.count_if(F.col(wetness) > threshold).alias("_wet"), F.count_if(empty).alias("_empty"), *(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in vegetation))
    rows = [_row(wide, "too_wet", F.col("_wet"), F.col("_wet") > 0), _row(wide, "no_landcover", F.col("_empty"), F.col("_empty") > 0)]
    return report([*rows, *(_row(wide, f"vegetation:{c}", F.col(c), F.col(c) >= most_null) for c in vegetation)])


def cell_ids(df: DataFrame, key: str = "Grid_ID") -> DataFrame:
    n = df.agg(F.count_if(~F.coalesce(is_cell_id(F.col(key)), F.lit(False))).alias("_n"))
    return _row(n, "cell_ids", F.col("_n"), F.col("_n") > 0)


def panel_integrity(panel: DataFrame, block: str = "spatial_block") -> DataFrame:
    """No cell-week both present and absent, none twice, and no cell in two blocks."""
    keys = panel.groupBy("Grid_ID", "iso_year", "iso_week").agg(F.count("*").alias("_n"), F.countDistinct("presence").alias("_k"))
    k = keys.agg(F.count_if(F.col("_k") > 1).alias("_both"), F.count_if(F.col("_n") > 1).alias("_twice"))
    cells = panel.groupBy("Grid_ID").agg(F.countDistinct(block).alias("_b")).agg(F.count_if(F.col("_b") > 1).alias("_split"))
    return report([_row(k, "disjoint_classes", F.col("_both"), F.col("_both") > 0), _row(k, "unique_cell_weeks", F.col("_twice"), F.col("_twice") > 0), _row(cells, "cells_in_one_block", F.col("_split"), F.col("_split") > 0)])


def no_leak(features: DataFrame, filled: DataFrame, days: int = 7, column: str = "prcp", name: str = "prcp_sum_7d", least: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """Recomputes each row's trailing sum from the days strictly before it and counts the rows that differ."""
    d = filled.select("Grid_ID", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_add(F.col("Date"), k.cast("int")))).alias("Date"), column)
    again = d.groupBy("Grid_ID", "Date").agg(F.when(F.count(column) >= least, F.sum(column)).alias("_again"))
    j = features.select("Grid_ID", "Date", name).join(again, ["Grid_ID", "Date"], "left")
    same = F.coalesce(F.abs(F.col(name) - F.col("_again")) <= tolerance, F.col(name).isNull() & F.col("_again").isNull())
    n = j.agg(F.count_if(~same).alias("_n"))
    return _row(n, "no_leak", F.col("_n"), F.col("_n") > 0)


def same_rows(scores: DataFrame, by: list[str]) -> DataFrame:
    """All groups of predictions have as many rows."""
    g = scores.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    return _row(g, "same_rows", F.col("_b") - F.col("_a"), F.col("_a") != F.col("_b"))
