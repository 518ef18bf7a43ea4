"""Land-cover columns from histograms, and the grouping and ordering of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import LANDCOVER_GROUPS, histogram_total, parse_histogram


def engineer_landcover(df: DataFrame, names: dict[int, str], groups: dict[str, tuple[int, ...]] = LANDCOVER_GROUPS, key: str = "Grid_ID", unknown: tuple[int, ...] = ()) -> DataFrame:
    """key and pct_<name> of each declared class and group; one row for each key. Codes in `unknown` give pct_class_<code>.

    Shares of a histogram without pixels are null.
    """
    one = df.groupBy(key).agg(F.min("histogram").alias("histogram")).withColumn("_m", parse_histogram(F.col("histogram")))
    one = one.withColumn("_t", histogram_total(F.col("_m")))
    share = lambda codes: F.when(F.col("_t") > 0, sum((F.coalesce(F.element_at("_m", F.lit(c)), F.lit(0.0)) for c in codes), F.lit(0.0)) / F.col("_t"))
    classes = {**{c: f"pct_{n}" for c, n in names.items()}, **{c: f"pct_class_{c}" for c in unknown}}
    return one.select(key, *(share((c,)).alias(n) for c, n in classes.items()), *(share(cs).alias(f"pct_{g}") for g, cs in groups.items()))


def unknown_codes(df: DataFrame, names: dict[int, str]) -> list[int]:
    """Codes that stand in histograms without a declared name."""
    codes = df.select(F.explode(F.map_keys(parse_histogram(F.col("histogram")))).alias("c")).distinct()
    return sorted(r["c"] for r in codes.filter(~F.col("c").isin(*names)).collect())


def assign_blocks(features: DataFrame, blocks: dict[str, list[str]], prefixes: dict[str, str], other: str = "other") -> DataFrame:
    """feature, block: by name, else by prefix, else `other`."""
    f = F.col("feature")
    out = F.lit(other)
    for prefix, block in reversed(prefixes.items()):
        out = F.when(f.startswith(prefix), block).otherwise(out)
    for block, names in blocks.items():
        out = F.when(f.isin(*names), block).otherwise(out)
    return features.select("feature", out.alias("block"))


def category_places(categories: DataFrame, order: list[str]) -> DataFrame:
    """category, place: the given order, then all others."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    return categories.select("category", F.when(place > 0, place).otherwise(len(order) + 1).cast("int").alias("place"))
