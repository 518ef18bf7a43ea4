"""Windows over daily series on a dense calendar, and ranks within groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import cold_day, degree_day

#: Days that a value is carried on: climate gaps, and the two satellites' revisit times.
CLIMATE_FILL, FILL = 3, {"EVI": 16, "NDWI": 8}


def by_day(key: str = "Grid_ID", day: str = "Date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def densify_daily(df: DataFrame, start: str, end: str, key: str = "Grid_ID", day: str = "Date") -> DataFrame:
    """A row for each key and day from start to end; days without data have nulls."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias(day)
    return df.select(key).distinct().select(key, days).join(df, [key, day], "left")


def forward_fill(column: str, limit: int, over: WindowSpec, shift: int = 0) -> Column:
    """The last value of at most `limit` days before; shift 1 leaves the day itself out."""
    return F.last(column, ignorenulls=True).over(over.rowsBetween(-limit - shift, -shift))


def rolling(column: str, how: str, days: int, over: WindowSpec, shift: int = 0, least: int | None = None) -> Column:
    """sum, mean, min or max of a window of days; null with fewer than `least` values (days - 2, 1 at least)."""
    frame = over.rowsBetween(-days + 1 - shift, -shift)
    value = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[how](column).over(frame)
    return F.when(F.count(column).over(frame) >= (max(1, days - 2) if least is None else least), value)


def climate_features(over: WindowSpec, shift: int = 1, ecological: bool = False) -> dict[str, Column]:
    """The trailing features; a shift of 1 ends every window on the day before."""
    out = {}
    for d in (7, 14, 28):
        out[f"prcp_sum_{d}d"] = rolling("prcp", "sum", d, over, shift)
        out[f"tmean_mean_{d}d"] = rolling("tmean", "mean", d, over, shift)
    out["tmax_max_14d"] = rolling("tmax", "max", 14, over, shift)
    out["tmin_mean_14d"] = rolling("tmin", "mean", 14, over, shift)
    out["tmin_min_14d"] = rolling("tmin", "min", 14, over, shift)
    if ecological:
        out["cold_days_14d"] = rolling("_cold", "sum", 14, over, shift)
        out["gdd_sum_14d"] = rolling("_dd", "sum", 14, over, shift)
        out["gdd_sum_28d"] = rolling("_dd", "sum", 28, over, shift)
    return out


def build_dynamic_features(daily: DataFrame, start: str, end: str, climate: tuple[str, ...] = ("tmax", "tmin", "tmean", "prcp"), ecological: bool = False, shift: int = 1) -> DataFrame:
    """Grid_ID, Date and the leak-proof trailing features of each day: dense calendar, bounded fill, windows.

    One exchange and one sort by cell and day serve the fill, the levels and all windows.
    """
    over = by_day()
    d = densify_daily(daily, start, end)
    d = d.withColumns({c: forward_fill(c, CLIMATE_FILL, over) for c in climate})
    if ecological:
        d = d.withColumn("_cold", cold_day(F.col("tmin"))).withColumn("_dd", degree_day(F.col("tmean")))
    levels = {f"{c.lower()}_level": forward_fill(c, n, over, shift) for c, n in FILL.items() if c in daily.columns}
    features = climate_features(over, shift, ecological) | levels
    return d.select("Grid_ID", "Date", *(v.alias(k) for k, v in features.items()))


def asof_features(daily: DataFrame, mondays: DataFrame, specs: dict[str, tuple[str, str, int]], key: str = "Grid_ID", day: str = "Date") -> DataFrame:
    """Aggregates of the days before each Monday (column monday): name -> (column, sum|mean|min|max, days). Any value counts, none gives null.

    A day meets the few Mondays in reach of it, one in seven of the days that follow.
    """
    most = max(n for _, _, n in specs.values())
    m = mondays.select("monday").distinct()
    first = F.next_day(day, "Mon")
    ahead = F.transform(F.sequence(F.lit(0), F.lit((most - 1) // 7)), lambda k: F.date_add(first, (7 * k).cast("int")))
    d = daily.withColumn("monday", F.explode(F.filter(ahead, lambda x: F.datediff(x, F.col(day)) <= most)))
    d = d.join(m, "monday")
    ago = F.datediff("monday", F.col(day))
    how = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
    return d.groupBy(key, "monday").agg(*(how[h](F.when(ago <= n, F.col(c))).alias(name) for name, (c, h, n) in specs.items()))


def state_features(daily: DataFrame, mondays: DataFrame, specs: dict[str, tuple[str, str, int]], fills: dict[str, int], levels: dict[str, str] | None = None, key: str = "Grid_ID", day: str = "Date") -> DataFrame:
    """The state of every key as of each Monday (column monday), with gaps filled: specs: name -> (column, sum|mean|min|max, days before); levels: name -> column whose last value still holds.

    A value holds on the days after it, fills[column] at most, until the next one. So each known
    value is an interval of days, and a trailing sum is a sum of values times the days that their
    intervals share with the window: no calendar is built, and a value meets only the Mondays in
    reach. A window without any value gives null; a key without any is missing. One row for each key
    and day is expected.
    """
    how, levels = {"min": F.min, "max": F.max}, levels or {}
    columns = list(dict.fromkeys([*(c for c, _, _ in specs.values()), *levels.values()]))
    after = Window.partitionBy(key).orderBy(day).rowsBetween(1, Window.unboundedFollowing)
    later = lambda c: F.min(F.when(F.col(c).isNotNull(), F.col(day))).over(after)
    ends = {f"_e_{c}": F.when(F.col(c).isNotNull(), F.least(F.date_add(day, fills.get(c, 0)), F.date_sub(later(c), 1))) for c in columns}
    reach = max([n + fills.get(c, 0) for c, _, n in specs.values()] + [1 + fills.get(c, 0) for c in levels.values()])
    d = daily.select(key, day, *columns).withColumns(ends)
    first = F.next_day(day, "Mon")
    ahead = F.transform(F.sequence(F.lit(0), F.lit((reach - 1) // 7)), lambda k: F.date_add(first, (7 * k).cast("int")))
    last = F.greatest(*(f"_e_{c}" for c in columns), F.lit(None).cast("date"))
    d = d.withColumn("monday", F.explode(F.filter(ahead, lambda m: F.datediff(m, last) <= max([n for _, _, n in specs.values()] + [1]))))
    d = d.join(mondays.select("monday").distinct(), "monday")

    def days(c: str, n: int) -> Column:
        """Days of the n before the Monday on which this row's value of c holds."""
        to = F.when(F.col(f"_e_{c}").isNotNull(), F.least(F.col(f"_e_{c}"), F.date_sub("monday", 1)))
        return F.greatest(F.datediff(to, F.greatest(F.col(day), F.date_sub("monday", n))) + 1, F.lit(0))

    out = []
    for name, (c, h, n) in specs.items():
        held = F.when(days(c, n) > 0, days(c, n))
        total = F.sum(F.col(c) * held)
        out.append((total if h == "sum" else total / F.sum(held) if h == "mean" else how[h](F.when(held.isNotNull(), F.col(c)))).alias(name))
    out += [F.max_by(c, F.when(days(c, 1) > 0, F.col(day))).alias(name) for name, c in levels.items()]
    # A long fill may reach a window that only the shorter ones are asked for: such a row tells nothing.
    used = reduce(lambda a, b: a | b, (days(c, n) > 0 for c, n in {(c, n) for c, _, n in specs.values()} | {(c, 1) for c in levels.values()}))
    return d.filter(used).groupBy(key, "monday").agg(*out)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def dedup_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by the given order; null keys are equal."""
    return top_per_group(df, keys, order, 1)


def expanding_mean(df: DataFrame, group: list[str], year: str, value: str) -> DataFrame:
    """group, year, n_before, mean_before: the mean over all earlier years of the group, without a loop over years."""
    years = df.groupBy(*group, year).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(year).rangeBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    s = F.sum("_s").over(earlier)
    return years.select(*group, year, n.alias("n_before"), F.when(n > 0, s / n).alias("mean_before"))
