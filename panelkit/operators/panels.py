"""Aggregations: roll-ups, cell-week panels, fold reports, effort, correlations, grids."""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iso_monday, iso_week, iso_year, region_label
from ..sources import materialise
from .joins import without_keys
from .ordering import average_ranks, exact_percentiles, running
from .windows import top_per_group

WEEK = ["Grid_ID", "iso_year", "iso_week"]
HOW = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0))}


def summarise(df: DataFrame, keys: list[str], spec: dict[str, tuple[str, ...]]) -> DataFrame:
    """<variable>_<statistic> columns in one pass; the sum of nothing is 0."""
    return df.groupBy(*keys).agg(*(HOW[h](c).alias(f"{c}_{h}") for c, hs in spec.items() for h in hs))


def first_known(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Each column's first value that isn't null, by `order`."""
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns))


def aggregate_panel(records: DataFrame, keys: list[str], min_events: int = 5) -> DataFrame:
    """Abundance of each key: events, mean of log counts and counts, and a flag for few events."""
    n = F.count("*")
    return records.groupBy(*keys).agg(n.alias("n_events"), F.avg(F.log1p("individualCount")).alias("mean_log_count"), F.avg("individualCount").alias("mean_count"), F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"), (n < min_events).alias("low_n_flag"))


def with_week(records: DataFrame, day: str = "eventDate") -> DataFrame:
    return records.withColumn("iso_year", iso_year(F.col(day))).withColumn("iso_week", iso_week(F.col(day)))


def presence_panel(records: DataFrame, focal: str, min_events: int = 2) -> DataFrame:
    """Cell-weeks in which the focal species was caught."""
    n, c = F.count("*"), "individualCount"
    p = with_week(records.filter(F.col("species") == focal)).groupBy(*WEEK).agg(
        F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"), n.alias("n_events"), F.avg(F.log1p(c)).alias("mean_log_count"),
        F.avg(c).alias("mean_count"), F.sum(c).alias("total_count"), F.max(c).alias("max_count"), (n < min_events).alias("low_n_flag"),
    )
    return p.select(*WEEK, iso_monday(F.col("iso_year"), F.col("iso_week")).alias("week_start"), "cell_lat", "cell_lon", F.lit(1).alias("presence"), "n_events", "mean_log_count", "mean_count", "total_count", "max_count", "low_n_flag")


def cellweek_activity(records: DataFrame, focal: str) -> DataFrame:
    """Cell-weeks with a catch of other species, and how much of either was caught, in one pass."""
    other, c = F.col("species") != focal, F.col("individualCount")
    cw = with_week(records).groupBy(*WEEK).agg(
        F.sum(F.when(other, c)).alias("other_count"), F.count_if(other).alias("n_other_events"), F.countDistinct(F.when(other, F.col("species"))).alias("n_species"),
        F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"), F.coalesce(F.sum(F.when(~other, c)), F.lit(0.0)).alias("focal_count"),
    )
    return cw.filter(F.col("n_other_events") > 0)


def infer_absences(activity: DataFrame, presence: DataFrame, min_other: float = 3, cap: int | None = None) -> DataFrame:
    """Cell-weeks without the focal species where enough of others was caught, none of them in presence; at most `cap` a cell, the largest catches."""
    absent = activity.filter((F.col("focal_count") == 0) & (F.col("other_count") >= min_other))
    absent = without_keys(absent, presence, WEEK)
    return absent if cap is None else top_per_group(absent, ["Grid_ID"], [F.desc("other_count"), F.col("iso_year"), F.col("iso_week")], cap)


def as_absence_rows(absent: DataFrame, min_events: int = 2) -> DataFrame:
    """Absences in the columns of the presence panel, with their own two diagnostics."""
    zero = F.lit(0.0)
    return absent.select(*WEEK, iso_monday(F.col("iso_year"), F.col("iso_week")).alias("week_start"), "cell_lat", "cell_lon", F.lit(0).alias("presence"), F.col("n_other_events").alias("n_events"), zero.alias("mean_log_count"), zero.alias("mean_count"), zero.alias("total_count"), zero.alias("max_count"), (F.col("n_other_events") < min_events).alias("low_n_flag"), "other_count", "n_species")


def labelled_panel(records: DataFrame, focal: str, min_other: float = 3, cap: int | None = None, min_events: int = 2) -> DataFrame:
    """Presences and inferred absences as one panel, told apart in one aggregation: a cell-week is one or the other, or left out."""
    mine, c, zero = F.col("species") == focal, F.col("individualCount"), F.lit(0.0)
    other = F.col("species") != focal
    own = lambda f, x: f(F.when(mine, x))
    cw = with_week(records).groupBy(*WEEK).agg(
        F.count_if(mine).alias("_n"), own(F.avg, F.log1p(c)).alias("_log"), own(F.avg, c).alias("_mean"), own(F.sum, c).alias("_sum"), own(F.max, c).alias("_max"),
        F.sum(F.when(other, c)).alias("_other"), F.count_if(other).alias("_m"), F.countDistinct(F.when(other, F.col("species"))).alias("_species"),
        F.coalesce(own(F.min, F.col("cell_lat")), F.min("cell_lat")).alias("cell_lat"), F.coalesce(own(F.min, F.col("cell_lon")), F.min("cell_lon")).alias("cell_lon"),
        F.coalesce(F.sum(F.when(~other, c)), zero).alias("_focal"),
    )
    there = F.col("_n") > 0
    cw = cw.filter(there | (F.col("_m") > 0) & (F.col("_focal") == 0) & (F.col("_other") >= min_other))
    if cap is not None:
        rank = F.row_number().over(Window.partitionBy("Grid_ID", there).orderBy(F.desc("_other"), "iso_year", "iso_week"))
        cw = cw.withColumn("_rank", rank).filter(there | (F.col("_rank") <= cap))
    either = lambda a, b: F.when(there, a).otherwise(b)
    return cw.select(
        *WEEK, iso_monday(F.col("iso_year"), F.col("iso_week")).alias("week_start"), "cell_lat", "cell_lon", either(1, 0).alias("presence"), either(F.col("_n"), F.col("_m")).alias("n_events"),
        either(F.col("_log"), zero).alias("mean_log_count"), either(F.col("_mean"), zero).alias("mean_count"), either(F.col("_sum"), zero).alias("total_count"), either(F.col("_max"), zero).alias("max_count"),
        (either(F.col("_n"), F.col("_m")) < min_events).alias("low_n_flag"), F.when(~there, F.col("_other")).alias("other_count"), F.when(~there, F.col("_species")).alias("n_species"),
    )


def weekly_climatology(daily: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell's and ISO week's mean over the years of the Mondays' values."""
    mondays = daily.filter(F.weekday("Date") == 0)
    return mondays.withColumn("iso_week", iso_week(F.col("Date"))).groupBy("Grid_ID", "iso_week").agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n_years"))


def collapse_years(panel: DataFrame, dynamic: list[str], static: list[str], key: str = "Grid_ID", year: str = "year") -> DataFrame:
    """One row per cell: means of what changes, the first known value of what doesn't."""
    return panel.groupBy(key).agg(*(F.avg(c).alias(c) for c in dynamic), *(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(year))).alias(c) for c in static))


def winsorise(df: DataFrame, column: str, share: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """The column capped at an exact percentile, and one row of the cap and how many rows it cut."""
    cap = exact_percentiles(df, [column], [share]).select(F.get("values", F.lit(0)).alias("cap"))
    out = df.join(F.broadcast(cap)).withColumn(column, F.least(column, "cap")).drop("cap")
    cut = df.join(F.broadcast(cap)).agg(F.max("cap").alias("cap"), F.count_if(F.col(column) > F.col("cap")).alias("n_capped"))
    return out, cut


def fold_report(df: DataFrame, schemes: dict[str, str], label: str = "presence", min_n: int = 30, min_class: int = 5) -> DataFrame:
    """scheme, fold, n, pos, neg, prevalence, thin: for each scheme (name -> column), all in one aggregation."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("scheme"), F.col(c).cast("string").alias("fold")) for s, c in schemes.items())))
    n, pos = F.count("*"), F.count_if(F.col(label) == 1)
    r = df.select(label, pairs.alias("_f")).groupBy("_f.scheme", "_f.fold").agg(n.alias("n"), pos.alias("pos"), (n - pos).alias("neg"))
    thin = (F.col("n") < min_n) | (F.col("pos") < min_class) | (F.col("neg") < min_class)
    return r.withColumn("prevalence", F.col("pos") / F.col("n")).withColumn("thin", thin)


def sampling_effort(panel: DataFrame, all_cells: DataFrame | None = None) -> DataFrame:
    """One row: cells, median and 90th percentile of cell-weeks, share of the top tenth of the cells, coverage of all cells (percent)."""
    cell = panel.groupBy("Grid_ID").agg(F.count("*").alias("cell_weeks"))
    whole = cell.agg(F.count("*").alias("n_cells"), F.sum("cell_weeks").alias("_all"), F.percentile("cell_weeks", 0.5).alias("median_weeks"), F.percentile("cell_weeks", 0.9).alias("p90_weeks"))
    # Cells with as many weeks are alike: the tenth is found among the distinct numbers of weeks.
    sizes = cell.groupBy("cell_weeks").agg(F.count("*").alias("_n")).join(F.broadcast(whole))
    above = F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("cell_weeks")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.col("n_cells") / 10)) - F.col("_above")))
    top = sizes.withColumn("_above", above).agg(F.sum(take * F.col("cell_weeks")).alias("_top"))
    out = whole.join(F.broadcast(top)).withColumn("top_decile_pct", 100 * F.col("_top") / F.col("_all"))
    if all_cells is not None:
        out = out.join(F.broadcast(all_cells.select("Grid_ID").distinct().agg(F.count("*").alias("_cells")))).withColumn("coverage_pct", 100 * F.col("n_cells") / F.col("_cells"))
    return out.drop("_all", "_top", "_cells")


def block_effort(panel: DataFrame, block: str = "spatial_block") -> DataFrame:
    return panel.groupBy(block).agg(F.count("*").alias("cell_weeks"), F.countDistinct("Grid_ID").alias("cells"), F.avg("presence").alias("presence_rate"))


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the columns, in one job; of all nulls 0."""
    known = {r["column"]: r["values"][0] for r in exact_percentiles(df, columns, [0.5]).collect()}
    return {c: float(known.get(c, 0.0)) for c in columns}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    return df.fillna(medians)


def class_balance(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """n, pos, neg, the ratio of negatives to positives, and weights that balance both classes."""
    n, pos = F.count(label), F.count_if(F.col(label) == 1)
    g = df.groupBy(*(by or [])).agg(n.alias("n"), pos.alias("pos"), (n - pos).alias("neg"))
    return g.withColumn("neg_per_pos", F.try_divide(F.col("neg"), F.col("pos"))).withColumn("weight_pos", F.try_divide(F.col("n"), 2 * F.col("pos"))).withColumn("weight_neg", F.try_divide(F.col("n"), 2 * F.col("neg")))


def oof_summary(long: DataFrame) -> DataFrame:
    return long.groupBy("model", "scheme").agg(F.count("*").alias("n"), F.avg("presence").alias("prevalence"))


def seed_spread(scores: DataFrame, metrics: list[str], keys: list[str], base: int = 42) -> DataFrame:
    """keys, metric, and over the seeds: value at the base seed, least, median, greatest, range."""
    long = scores.unpivot([*keys, "seed"], metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.max(F.when(F.col("seed") == base, F.col("value"))).alias("at_base"), F.min("value").alias("least"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("greatest"), (F.max("value") - F.min("value")).alias("spread"))


def profile_panel(panel: DataFrame) -> DataFrame:
    """iso_year (null: all), n, positives, share of single-event rows, week with the most rows; by grouping sets, in one pass over week totals."""
    weeks = panel.groupBy("iso_year", "iso_week").agg(F.count("*").alias("n"), F.sum("presence").alias("pos"), F.count_if(F.col("n_events") == 1).alias("single"))
    totals = weeks.rollup("iso_year").agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), (F.sum("single") / F.sum("n")).alias("single_share"))
    peak = weeks.groupBy("iso_year").agg(F.max_by("iso_week", F.struct("n", -F.col("iso_week"))).alias("peak_week"))
    every = weeks.groupBy("iso_week").agg(F.sum("n").alias("n")).agg(F.max_by("iso_week", F.struct("n", -F.col("iso_week"))).alias("peak_week")).select(F.lit(None).cast("int").alias("iso_year"), "peak_week")
    peaks = peak.unionByName(every).withColumnRenamed("iso_year", "_y")
    return totals.join(peaks, F.col("iso_year").eqNullSafe(F.col("_y"))).drop("_y")


def zonal_mean(assigned: DataFrame, value: str, key: str = "Grid_ID") -> DataFrame:
    return assigned.groupBy(key).agg(F.avg(value).alias(f"{value}_mean"), F.count(value).alias("n_pixels"))


def zonal_histogram(assigned: DataFrame, code: str, area: str, key: str = "Grid_ID") -> DataFrame:
    """A map of code to summed area for each cell."""
    sums = assigned.groupBy(key, code).agg(F.sum(area).alias("_a"))
    return sums.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "_a")))).alias("histogram"))


def nearest_pixel_series(assigned: DataFrame, time: str, bands: list[str], key: str = "Grid_ID") -> DataFrame:
    """Each cell's and time's bands at the pixel nearest to the cell's centre; ties go to the lesser x, then y."""
    d2 = (F.col("x_m") - F.col("cx_m")) ** 2 + (F.col("y_m") - F.col("cy_m")) ** 2
    best = F.min(F.struct(d2.alias("d2"), "x_m", "y_m", *bands)).alias("_b")
    return assigned.groupBy(key, time).agg(best).select(key, time, *(F.col(f"_b.{b}").alias(b) for b in bands))


def corr_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r of every pair of columns over the rows where both are known (not null, not NaN): all pairs in one aggregation. With a constant column r is null.

    spearman: correlation of average ranks, which are taken over the rows of each pair.
    """
    d = df.select(*(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns))
    pairs = list(combinations_with_replacement(columns, 2))
    if method == "spearman":
        d, side = _pair_ranks(d, columns)
    else:
        side = {(a, b): F.when(F.col(b).isNotNull(), F.col(a)) for a in columns for b in columns}
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    wide = d.agg(*(r(side[a, b], side[b, a]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("_x")).select("_x.*")


def _pair_ranks(d: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """For each row the ranks of its values, and for each pair (a, b) the column that has the ranks of a over the rows where a and b are known.

    Where b is known wherever a is, that's the rank of a over all its rows. All ranks are taken in one ordered job.
    """
    rows = materialise(d.withColumn("_row", F.monotonically_increasing_id()), "ranked-rows")
    both = [(a, b) for a in columns for b in columns if a != b]
    found = rows.agg(*(F.count_if(F.col(a).isNotNull() & F.col(b).isNull()).alias(f"n{i}") for i, (a, b) in enumerate(both))).first() if both else []
    own = {(a, b): (a, b if n else a) for (a, b), n in zip(both, found)} | {(c, c): (c, c) for c in columns}
    sets = {x: i for i, x in enumerate(dict.fromkeys(own.values()))}
    values = F.array(*(F.struct(F.lit(i).alias("set"), F.when(F.col(b).isNotNull(), F.col(a)).alias("value")) for (a, b), i in sets.items()))
    long = rows.select("_row", F.explode(values).alias("_x")).select("_row", "_x.set", "_x.value").filter("value is not null")
    ranks = average_ranks(long, ["set"], "value", "_row", "rank").groupBy("_row").agg(*(F.max(F.when(F.col("set") == i, F.col("rank"))).alias(f"_r{i}") for i in sets.values()))
    return ranks, {x: F.col(f"_r{sets[s]}") for x, s in own.items()}


def strongest_pairs(corr: DataFrame, blocks: dict[str, str]) -> DataFrame:
    """scope, block, a, b, max_abs_r: the most correlated pair inside each block, and of different blocks."""
    block = F.create_map(*(F.lit(x) for kv in blocks.items() for x in kv))
    c = corr.filter("a <> b").withColumn("ba", block[F.col("a")]).withColumn("bb", block[F.col("b")])
    best = F.max_by(F.struct("a", "b", F.abs("r").alias("max_abs_r")), F.struct(F.abs("r"), F.col("a"), F.col("b"))).alias("_x")
    inside = c.filter("ba = bb").groupBy(F.lit("within").alias("scope"), F.col("ba").alias("block")).agg(best)
    across = c.filter("ba <> bb").groupBy(F.lit("between").alias("scope"), F.lit("ALL").alias("block")).agg(best)
    return inside.unionByName(across).select("scope", "block", "_x.*")


def correlated_groups(corr: DataFrame, columns: list[str], threshold: float = 0.9) -> list[list[str]]:
    """Greedy groups: the next free column takes all free ones correlated with it. Runs on a matrix of tens of columns."""
    strong = {frozenset((r["a"], r["b"])) for r in corr.filter((F.col("a") != F.col("b")) & (F.abs("r") >= threshold)).collect()}
    free, groups = list(columns), []
    while free:
        head, rest = free[0], free[1:]
        groups.append([head, *(c for c in rest if frozenset((head, c)) in strong)])
        free = [c for c in rest if c not in groups[-1]]
    return groups


def decorrelated(corr: DataFrame, columns: list[str], threshold: float = 0.9) -> list[str]:
    """Columns none of which is correlated with one kept before it."""
    strong = {frozenset((r["a"], r["b"])) for r in corr.filter((F.col("a") != F.col("b")) & (F.abs("r") > threshold)).collect()}
    kept: list[str] = []
    for c in columns:
        if not any(frozenset((c, k)) in strong for k in kept):
            kept.append(c)
    return kept


def importance(values: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """block, n_features, mean_abs, pct: signed sums of each row's attributions in a block, then the mean of their size."""
    sums = values.select(*(sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0)).alias(b) for b, cols in blocks.items()))
    wide = sums.agg(*(F.avg(F.abs(b)).alias(b) for b in blocks))
    rows = F.explode(F.array(*(F.struct(F.lit(b).alias("block"), F.lit(len(cols)).alias("n_features"), F.col(b).alias("mean_abs")) for b, cols in blocks.items())))
    total = F.sum("mean_abs").over(Window.partitionBy())
    return wide.select(rows.alias("_x")).select("_x.*").withColumn("pct", 100 * F.col("mean_abs") / total)


def rasterise(points: DataFrame, value: str, alpha: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """ix, iy, value, alpha: points binned by the median gap between neighbours of a row (and of a column), averaged in each bin."""
    gap = lambda along, across: points.select(along, across).distinct().withColumn("_g", F.col(along) - F.lag(along).over(Window.partitionBy(across).orderBy(along))).agg(F.coalesce(F.percentile("_g", 0.5), F.lit(1.0)))
    steps = gap(lon, lat).toDF("dx").join(F.broadcast(gap(lat, lon).toDF("dy"))).join(F.broadcast(points.agg(F.min(lon).alias("x0"), F.min(lat).alias("y0"))))
    p = points.join(F.broadcast(steps))
    ix, iy = F.round((F.col(lon) - F.col("x0")) / F.col("dx")).cast("int"), F.round((F.col(lat) - F.col("y0")) / F.col("dy")).cast("int")
    return p.groupBy(ix.alias("ix"), iy.alias("iy")).agg(F.avg(value).alias("value"), F.avg(alpha).alias("alpha"))


def _spread(cells: DataFrame, k: int = 1) -> DataFrame:
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)))
    return cells.select("ix", "iy", F.explode(near).alias("_n")).select((F.col("ix") + F.col("_n.i")).alias("ix"), (F.col("iy") + F.col("_n.j")).alias("iy")).distinct()


def closed_holes(known: DataFrame, times: int) -> DataFrame:
    """ix, iy of the cells that aren't known but that `times` dilations and as many erosions close."""
    closed = known
    for _ in range(times):
        closed = _spread(closed)
    for _ in range(times):
        near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        met = closed.select("ix", "iy", F.explode(near).alias("_n")).select((F.col("ix") + F.col("_n.i")).alias("ix"), (F.col("iy") + F.col("_n.j")).alias("iy")).groupBy("ix", "iy").count()
        closed = met.filter("count = 9").select("ix", "iy").join(closed, ["ix", "iy"], "left_semi")
    return closed.join(known, ["ix", "iy"], "left_anti")


def fill_gaps(grid: DataFrame, times: int = 2) -> DataFrame:
    """Adds the holes of closed_holes() with the value, and the alpha where there is one, of the nearest known cell (of equals that with the least ix, then iy); filled tells them.

    Two scans: along each row the nearest known cell on either side is carried to the places that
    holes ask for, then along each column the nearest of these is taken. A hole lies within `times`
    steps of a known cell, so that it asks in so many rows above and below as a nearest cell can lie
    away.
    """
    carried = [c for c in ("value", "alpha") if c in grid.columns]
    known = grid.select("ix", "iy")
    reach = math.isqrt(2 * times * times)
    asked = closed_holes(known, times).select("ix", F.col("iy").alias("_hy"), F.explode(F.sequence(F.col("iy") - reach, F.col("iy") + reach)).alias("iy"))
    cell = F.struct(F.col("ix").alias("ix"), *carried)
    both = grid.select("ix", "iy", F.lit(None).cast(known.schema["iy"].dataType).alias("_hy"), cell.alias("_own")).unionByName(asked, allowMissingColumns=True)
    row = Window.partitionBy("iy").orderBy("ix")
    left = F.last("_own", ignorenulls=True).over(row.rangeBetween(Window.unboundedPreceding, 0))
    right = F.first("_own", ignorenulls=True).over(row.rangeBetween(0, Window.unboundedFollowing))
    sides = both.withColumns({"_l": left, "_r": right}).filter("_hy is not null").withColumn("_c", F.explode(F.array("_l", "_r"))).filter("_c is not null")
    d2 = (F.col("_c.ix") - F.col("ix")) ** 2 + (F.col("iy") - F.col("_hy")) ** 2
    best = sides.groupBy("ix", F.col("_hy").alias("_iy")).agg(F.min_by("_c", F.struct(d2.alias("d2"), F.col("_c.ix").alias("x"), F.col("iy").alias("y"))).alias("_b"))
    return grid.select("ix", "iy", *carried, F.lit(False).alias("filled")).unionByName(best.select("ix", F.col("_iy").alias("iy"), *(F.col(f"_b.{c}").alias(c) for c in carried), F.lit(True).alias("filled")))


def row_bands(cells: DataFrame, around: int = 2, lat: str = "lat") -> DataFrame:
    """The row of cells with the fewest cells (the least latitude of equals) and its neighbours: latitude, cells, nulls, offset."""
    rows = cells.groupBy(lat).agg(F.count("*").alias("n_cells"), F.count_if(F.col("value").isNull()).alias("n_null"))
    rows = rows.withColumn("_at", F.row_number().over(Window.orderBy(lat)))
    thin = rows.agg(F.min_by("_at", F.struct("n_cells", lat)).alias("_thin"))
    r = rows.join(F.broadcast(thin)).withColumn("offset", F.col("_at") - F.col("_thin"))
    return r.filter(F.abs("offset") <= around).select(lat, "n_cells", "n_null", "offset")


def block_geography(cells: DataFrame, block: str = "spatial_block") -> DataFrame:
    """Cells, centroid, extent and region of each block."""
    g = cells.groupBy(block).agg(F.countDistinct("Grid_ID").alias("n_cells"), F.avg("cell_lat").alias("lat"), F.avg("cell_lon").alias("lon"), F.min("cell_lat").alias("lat_min"), F.max("cell_lat").alias("lat_max"), F.min("cell_lon").alias("lon_min"), F.max("cell_lon").alias("lon_max"))
    return g.withColumn("region", region_label(F.col("lat"), F.col("lon")))
