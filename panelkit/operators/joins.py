"""Joins: daily products, static tables, nearest cells, lagged labels, reconciliation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import KM_PER_DEGREE, distance_km, week_neighbours
from ..sources import materialise


def merge_daily(products: list[DataFrame], keys: tuple[str, ...] = ("Grid_ID", "Date")) -> DataFrame:
    """Full outer join of all products on cell and day."""
    return reduce(lambda a, b: a.join(b, list(keys), "full_outer"), products)


def join_static(df: DataFrame, static: DataFrame, key: str = "Grid_ID", order: str | None = None) -> DataFrame:
    """Left join with one row of static for each key, the least by `order`."""
    columns = [c for c in static.columns if c != key]
    rank = F.struct(F.col(order).alias("_order"), *columns) if order else F.struct(*columns)
    one = static.groupBy(key).agg(F.min(rank).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))
    return df.join(one, key, "left")


def join_with_coverage(left: DataFrame, right: DataFrame, on: list[str], least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """The inner join, and one row of how many left rows found a partner, their share and whether it is enough."""
    keys = right.select(*on).distinct().withColumn("_there", F.lit(True))
    counts = left.select(*on).join(keys, on, "left").agg(F.count("*").alias("n_left"), F.count_if("_there").alias("n_matched"))
    share = F.when(F.col("n_left") > 0, F.col("n_matched") / F.col("n_left"))
    return left.join(right, on), counts.withColumn("coverage", share).withColumn("enough", F.coalesce(share >= least, F.lit(False)))


def _beside(targets: DataFrame, side: float, wide: float) -> DataFrame:
    """targets in the buckets of their own and the eight around: _bx, _by."""
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    bx, by = F.floor(F.col("cell_lat") / side) + F.col("_n.i"), F.floor(F.col("cell_lon") / wide) + F.col("_n.j")
    return targets.withColumn("_n", F.explode(near)).withColumn("_bx", bx).withColumn("_by", by).drop("_n")


#: Tables of so many rows at most are sent to all tasks; larger ones are shuffled.
SENT_ROWS = 100_000


def _pyramid(targets: DataFrame, on: list[str], step: float, wide: float, levels: int) -> DataFrame:
    """on, level, bx, by (a bucket that holds targets), px, py (the bucket that it lies in, one level up), and the bounds y0, y1, x0, x1 of its targets. Sides double from level to level; level 0 has sides step and wide."""
    bounds = [F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1")]
    one = targets.select(*on, F.floor(F.col("cell_lat") / step).alias("bx"), F.floor(F.col("cell_lon") / wide).alias("by"), *(F.col(c).alias(n) for n, c in (("y0", "cell_lat"), ("y1", "cell_lat"), ("x0", "cell_lon"), ("x1", "cell_lon"))))
    base = materialise(one.groupBy(*on, "bx", "by").agg(*bounds), "nearest-buckets")
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.floor(F.col("bx") / F.pow(F.lit(2.0), k)).alias("bx"), F.floor(F.col("by") / F.pow(F.lit(2.0), k)).alias("by"))))
    every = base.select(*on, up.alias("_k"), "y0", "y1", "x0", "x1").select(*on, "_k.*", "y0", "y1", "x0", "x1").groupBy(*on, "level", "bx", "by").agg(*bounds)
    return materialise(every.withColumn("px", F.floor(F.col("bx") / 2)).withColumn("py", F.floor(F.col("by") / 2)), "nearest-pyramid")


def _descended(far: DataFrame, lat: str, lon: str, targets: DataFrame, pyramid: DataFrame, on: list[str], step: float, wide: float, cos: float, levels: int) -> DataFrame:
    """_id, and the targets that may be a row's nearest: from the highest buckets down, only those are kept that may hold a target as near as the farthest place of some other one."""
    counts = {r["level"]: r["count"] for r in pyramid.groupBy("level").count().collect()}
    sent = lambda d, n: F.broadcast(d) if n <= SENT_ROWS else d
    y, x = F.col("_y"), F.col("_x")
    outside = lambda v, low, high: F.greatest(F.col(low) - v, v - F.col(high), F.lit(0.0))
    across = lambda v, low, high: F.greatest(v - F.col(low), F.col(high) - v)
    length = lambda dy, dx: F.sqrt(dy * dy + dx * dx * (cos * cos))
    at_least, at_most = length(outside(y, "y0", "y1"), outside(x, "x0", "x1")), length(across(y, "y0", "y1"), across(x, "x0", "x1"))
    state = far.select("_id", *on, F.col(lat).alias("_y"), F.col(lon).alias("_x"))
    own = ["_id", "_y", "_x", *on]
    for k in range(levels, -1, -1):
        nodes = sent(pyramid.filter(F.col("level") == k).drop("level"), counts.get(k, 0))
        if k < levels:
            state = state.withColumnsRenamed({"bx": "px", "by": "py"}).join(nodes, [*on, "px", "py"])
        else:  # the highest level has one bucket, or a few around an edge
            state = state.join(nodes, on) if on else state.join(nodes)
        most = F.min(at_most).over(Window.partitionBy("_id"))
        state = state.withColumns({"_least": at_least, "_most": most}).filter(F.col("_least") <= F.col("_most") * (1 + 1e-9) + 1e-12).select(*own, "bx", "by")
    leaf = targets.withColumn("bx", F.floor(F.col("cell_lat") / step)).withColumn("by", F.floor(F.col("cell_lon") / wide))
    return state.join(leaf, [*on, "bx", "by"])


def nearest(rows: DataFrame, lat: str, lon: str, targets: DataFrame, order: list[str], step: float, cos: float, on: tuple[str, ...] = ()) -> DataFrame:
    """rows with _best: km to the nearest target (cell_lat, cell_lon) of equal `on`, and its columns `order`, which also decide ties; null without a place or target.

    Rows meet the targets of their own bucket and those around it, which stand there as one array, by
    an equi-join. A find nearer than a bucket's side is the nearest of all. The other rows go down a
    pyramid of the buckets that hold targets, into the few that can hold their nearest.
    """
    keys, payload, on = [*on, "_bx", "_by"], list(dict.fromkeys([*order, "cell_lat", "cell_lon"])), list(on)
    targets = targets.select(*on, *payload).filter(F.col("cell_lat").isNotNull() & F.col("cell_lon").isNotNull())
    wide = step / max(cos, 0.1)
    best = lambda y, x, t: F.struct(distance_km(y, x, t("cell_lat"), t("cell_lon"), cos).alias("km"), *(t(c).alias(c) for c in payload))
    known = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    sure = F.coalesce(F.col("_best.km") < step * KM_PER_DEGREE * 0.999, F.lit(False)) | ~known

    grouped = _beside(targets, step, wide).groupBy(*keys).agg(F.collect_list(F.struct(*payload)).alias("_there"))
    first = rows.withColumns({"_bx": F.floor(F.col(lat) / step), "_by": F.floor(F.col(lon) / wide)}).join(grouped, keys, "left")
    first = first.withColumn("_best", F.array_min(F.transform("_there", lambda t: best(F.col(lat), F.col(lon), lambda c: t[c]))))
    # Row numbers are written down, since they would differ if a lost task ran again.
    first = materialise(first.select(*rows.columns, "_best").withColumn("_id", F.when(~sure, F.monotonically_increasing_id())), "nearest-first")
    far = first.filter("_id is not null").drop("_best")
    if not far.limit(1).count():
        return first.drop("_id")
    targets = materialise(targets, "nearest-targets")
    span = targets.agg(F.max("cell_lat") - F.min("cell_lat"), F.max("cell_lon") - F.min("cell_lon")).first()
    if span[0] is None:
        return first.drop("_id")
    levels = max(0, math.ceil(math.log2(max(span[0] / step, span[1] / wide, 1.0))))
    met = _descended(far, lat, lon, targets, _pyramid(targets, on, step, wide, levels), on, step, wide, cos, levels)
    found = met.groupBy("_id").agg(F.min(best(F.col("_y"), F.col("_x"), F.col)).alias("_best"))
    return first.filter("_id is null").drop("_id").unionByName(far.join(found, "_id", "left").drop("_id"))


def snap_to_cells(records: DataFrame, cells: DataFrame, step: float = 0.05, lat: str = "decimalLatitude", lon: str = "decimalLongitude", key: list[str] | None = None) -> DataFrame:
    """Adds Grid_ID, cell_lat, cell_lon and snap_km of the nearest cell; ties go to the lesser cell_ord.

    Distances take the cosine of the records' mean latitude. Records stay, far ones with their
    distance; those without a place keep nulls. key: not needed, since far records are numbered.
    """
    mean = records.agg(F.avg(lat)).first()[0]
    cos = math.cos(math.radians(mean)) if mean is not None else 1.0
    names = ("Grid_ID", "cell_lat", "cell_lon")
    out = nearest(records.drop(*names), lat, lon, cells, ["cell_ord", "Grid_ID"], step, cos)
    return out.select(*(c for c in records.columns if c not in names), *(F.col(f"_best.{c}").alias(c) for c in names), F.col("_best.km").alias("snap_km"))


def attach_features(weeks: DataFrame, features: DataFrame) -> DataFrame:
    """Weekly rows with the features of their Monday."""
    return weeks.join(features.withColumnRenamed("Date", "week_start"), ["Grid_ID", "week_start"], "left")


def without_keys(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, only left, only right, and the least example of either side."""
    x = a.select(F.col(key).alias("_k")).distinct().withColumn("_a", F.lit(True))
    y = b.select(F.col(key).alias("_k")).distinct().withColumn("_b", F.lit(True))
    j = x.join(y, "_k", "full_outer")
    only_a, only_b = F.col("_a").isNotNull() & F.col("_b").isNull(), F.col("_b").isNotNull() & F.col("_a").isNull()
    return j.agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("n_both"), F.count_if(only_a).alias("n_left_only"), F.count_if(only_b).alias("n_right_only"),
        F.min(F.when(only_a, F.col("_k"))).alias("left_example"), F.min(F.when(only_b, F.col("_k"))).alias("right_example"),
    )


def previous_label(panel: DataFrame, mode: str = "prev_week", label: str = "presence", order: str | None = None) -> DataFrame:
    """Adds `previous`: the label of the cell a week before (by date), or in the same week of the year before; of duplicates the first by `order`."""
    keys = {"prev_week": ["Grid_ID", "week_start"], "prior_year": ["Grid_ID", "iso_year", "iso_week"]}[mode]
    rank = F.struct(order, label) if order else F.struct(label)
    past = panel.groupBy(*keys).agg(F.min(rank)[label].alias("previous"))
    past = past.withColumn("week_start", F.date_add("week_start", 7)) if mode == "prev_week" else past.withColumn("iso_year", F.col("iso_year") + 1)
    return panel.join(past, keys, "left")


def climatology_forecast(train: DataFrame, test: DataFrame, least: int = 1, label: str = "presence") -> DataFrame:
    """test with p and tier: the mean label of the cell and week in train, else of the week, else of all."""
    cell = train.groupBy("Grid_ID", "iso_week").agg(F.avg(label).alias("_cw"), F.count(label).alias("_n"))
    week = train.groupBy("iso_week").agg(F.avg(label).alias("_w"))
    grand = train.agg(F.avg(label).alias("_g"))
    j = test.join(cell, ["Grid_ID", "iso_week"], "left").join(week, "iso_week", "left").join(F.broadcast(grand))
    own = F.coalesce((F.col("_n") >= least) & F.col("_cw").isNotNull(), F.lit(False))
    tier = F.when(own, 1).when(F.col("_w").isNotNull(), 2).otherwise(3)
    return j.select(*test.columns, F.when(own, F.col("_cw")).otherwise(F.coalesce("_w", "_g")).alias("p"), tier.alias("tier"))


def tier_usage(forecast: DataFrame) -> DataFrame:
    share = lambda t: (100 * F.avg((F.col("tier") == t).cast("double"))).alias(f"tier{t}_pct")
    return forecast.agg(share(1), share(2), share(3), F.count("*").alias("n_test"))


def support_distance(grid: DataFrame, sampled: DataFrame, window: int = 2, step: float = 0.1) -> DataFrame:
    """grid with support_km, the distance to the nearest cell sampled in a week at most `window` away on the circle of weeks; null without one.

    grid: Grid_ID, iso_week, lat, lon; sampled: cell_lat, cell_lon, iso_week. Distances take the
    cosine of the grid's mean latitude.
    """
    mean = grid.agg(F.avg("lat")).first()[0]
    cos = math.cos(math.radians(mean)) if mean is not None else 1.0
    near = sampled.select("cell_lat", "cell_lon", F.explode(week_neighbours(F.col("iso_week"), window)).alias("iso_week")).distinct()
    out = nearest(grid, "lat", "lon", near, [], step, cos, ("iso_week",))
    return out.select(*grid.columns, F.col("_best.km").alias("support_km"))


def join_week(predicted: DataFrame, observed: DataFrame, week: int) -> DataFrame:
    """Predictions and observations of one week, by cell."""
    return predicted.filter(F.col("iso_week") == week).join(observed.filter(F.col("iso_week") == week).drop("iso_week"), "Grid_ID")


def label_cells(df: DataFrame, labels: DataFrame, key: str = "Grid_ID") -> DataFrame:
    return df.join(labels, key, "left")


def guarded_skill(models: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """models with skill = 1 - brier / reference brier, where both scored as many rows; else null."""
    ref = reference.select(*on, F.col("n").alias("_n"), F.col("brier").alias("_b"))
    return models.join(ref, on, "left").withColumn("skill", F.when((F.col("n") == F.col("_n")) & (F.col("_b") > 0), 1 - F.col("brier") / F.col("_b"))).drop("_n", "_b")


def _differs(a: Column, b: Column, tolerance: float) -> Column:
    return ~F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull())


def reconcile(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """For each column: compared rows, rows that differ, keys that only one side has."""
    a = target.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(True).alias("_a"))
    b = source.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(True).alias("_b"))
    j = a.join(b, keys, "full_outer")
    both = F.col("_a") & F.col("_b")
    one = j.agg(
        F.count_if(both).alias("n_compared"), F.count_if(F.col("_b").isNull()).alias("only_target"), F.count_if(F.col("_a").isNull()).alias("only_source"),
        *(F.count_if(both & _differs(F.col(f"_a_{c}"), F.col(f"_b_{c}"), tolerance)).alias(c) for c in columns),
    )
    return one.unpivot(["n_compared", "only_target", "only_source"], columns, "column_name", "n_different")


def largest_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: shared keys and the largest absolute difference in each column."""
    j = a.select(key, *(F.col(c).alias(f"_a_{c}") for c in columns)).join(b.select(key, *columns), key)
    return j.agg(F.count("*").alias("n_shared"), *(F.max(F.abs(F.col(f"_a_{c}") - F.col(c))).alias(f"max_diff_{c}") for c in columns))


def assign_pixels(pixels: DataFrame, cells: DataFrame, half_m: float) -> DataFrame:
    """Pixels (x_m, y_m, ...) with the cell (cx_m, cy_m) in whose box they lie: by a bucket join, then the box itself. A pixel may lie in several boxes."""
    side = 2 * half_m
    bucket = lambda c: F.floor(F.col(c) / side)
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    c = cells.withColumn("_n", F.explode(near)).withColumn("_bx", bucket("cx_m") + F.col("_n.i")).withColumn("_by", bucket("cy_m") + F.col("_n.j")).drop("_n")
    p = pixels.withColumn("_bx", bucket("x_m")).withColumn("_by", bucket("y_m"))
    inside = (F.abs(F.col("x_m") - F.col("cx_m")) <= half_m) & (F.abs(F.col("y_m") - F.col("cy_m")) <= half_m)
    return p.join(c, ["_bx", "_by"]).filter(inside).drop("_bx", "_by")
