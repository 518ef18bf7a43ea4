"""Projections and filters that turn raw records into clean ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keep_present(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Those of the wanted columns that exist, and the names of those that don't."""
    return df.select(*(c for c in columns if c in df.columns)), [c for c in columns if c not in df.columns]


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text as doubles; what is no number is null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def to_days(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text or timestamps as dates; what is no date is null."""
    return df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"))) for c in columns})


def trimmed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.trim(c) for c in columns})


def drop_null(df: DataFrame, columns: list[str], how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=columns)


def at_most(column: str, most: float) -> Column:
    """True for null as well."""
    return F.col(column).isNull() | (F.col(column) <= most)


def clean_occurrences(df: DataFrame, box: tuple[float, float, float, float], years: tuple[int, int], most_uncertain: float = 5000.0) -> DataFrame:
    """Records with a place in the box (south, north, west, east), a positive count and a date in the years; unknown uncertainty stays."""
    south, north, west, east = box
    df = trimmed(to_days(to_numbers(df, ["individualCount", "decimalLatitude", "decimalLongitude"]), ["eventDate"]), ["species"])
    df = drop_null(df, ["species", "individualCount", "decimalLatitude", "decimalLongitude", "eventDate"])
    inside = F.col("decimalLatitude").between(south, north) & F.col("decimalLongitude").between(west, east)
    return df.filter(inside & (F.col("individualCount") > 0) & F.year("eventDate").between(*years) & at_most("coordinateUncertaintyInMeters", most_uncertain))


def nullify(df: DataFrame, sentinels: list[float], columns: list[str] | None = None) -> DataFrame:
    """Sentinels of numeric columns become null."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels), F.col(c)) for c in (columns or numeric)})


def to_floats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Doubles as 32-bit floats, for storage."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.col(c).cast("float") for c in (columns or doubles)})


def in_category(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column) == value)


def restrict_to(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is among keys; Spark sends small key sets to all tasks by their size."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def flag_above(df: DataFrame, column: str, threshold: float, flag: str) -> DataFrame:
    return df.withColumn(flag, F.coalesce(F.col(column) > threshold, F.lit(False)))


def drop_above(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows at or below the threshold; nulls go."""
    return df.filter(F.col(column) <= threshold)


def all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNull() for c in columns))


def drop_unusable_cells(df: DataFrame, wetness: str, threshold: float, shares: list[str]) -> DataFrame:
    """Drops rows that are too wet or have no land-cover share at all; unknown wetness stays."""
    return df.filter(~(F.coalesce(F.col(wetness) > threshold, F.lit(False)) | all_null(shares)))


def drop_warmup(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(how="all", subset=columns)


def with_prefix(columns: list[str], prefixes: tuple[str, ...], without: tuple[str, ...] = ()) -> list[str]:
    """Columns that begin with a prefix and don't end in one of `without`."""
    return [c for c in columns if c.startswith(prefixes) and not (without and c.endswith(without))]


def assert_parity(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Exactly keys and features, in that order; raises where one is missing. Reads no rows."""
    missing = [c for c in [*keys, *features] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*keys, *features)


def within_support(df: DataFrame, column: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Rows whose support is at least `least`, or whose distance is at most `most`."""
    return df.filter(F.col(column) >= least) if least is not None else df.filter(F.col(column) <= most)


def melt_scores(df: DataFrame, ids: list[str], prefix: str = "oof_") -> DataFrame:
    """Columns oof_<scheme> as rows of scheme and p; nulls go."""
    columns = [c for c in df.columns if c.startswith(prefix)]
    long = df.unpivot(ids, columns, "scheme", "p")
    return long.withColumn("scheme", F.substring("scheme", len(prefix) + 1, 1000)).filter(F.col("p").isNotNull())


def pivot_models(df: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """A column for each of the named models."""
    return df.groupBy(*keys).pivot("model", models).agg(F.first("p", ignorenulls=True))
