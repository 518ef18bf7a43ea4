"""Queries of the windows over daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cold_day, degree_day
from ..operators import checks, windows as op
from ._tables import Registry, daily, nation_daily, panel, records, scores, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
FIRST, LAST = "2024-01-01", "2024-02-15"

_LAST = lambda c, n, shift=0: f'last_value({c} IGNORE NULLS) OVER (PARTITION BY Grid_ID ORDER BY "Date" ROWS BETWEEN {n + shift} PRECEDING AND {f"{shift} PRECEDING" if shift else "CURRENT ROW"})'


def _roll(how: str, c: str, n: int, shift: int) -> str:
    frame = f'OVER (PARTITION BY Grid_ID ORDER BY "Date" ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f"{shift} PRECEDING" if shift else "CURRENT ROW"})'
    return f"CASE WHEN count({c}) {frame} >= {max(1, n - 2)} THEN {how}({c}) {frame} END"


_FILLED = f'SELECT Grid_ID, "Date", {", ".join(f"{_LAST(c, 3)} AS {c}" for c in ("tmax", "tmin", "tmean", "prcp"))}, EVI, NDWI FROM dense'


def dense(spark, sf):
    return op.densify_daily(daily(spark, sf), FIRST, LAST)


@R.add("j13_densify", sql("dense", "SELECT * FROM dense"), "tmax tmin tmean prcp EVI NDWI")
def densified(spark, sf):
    return dense(spark, sf)


@R.add("w1_w2_forward_fill", sql("dense", f'SELECT Grid_ID, "Date", {_LAST("tmean", 3)} AS tmean, {_LAST("EVI", 16)} AS evi, {_LAST("NDWI", 8)} AS ndwi FROM dense'), "tmean evi ndwi")
def filled(spark, sf):
    o = op.by_day()
    return dense(spark, sf).select("Grid_ID", "Date", op.forward_fill("tmean", 3, o).alias("tmean"), op.forward_fill("EVI", 16, o).alias("evi"), op.forward_fill("NDWI", 8, o).alias("ndwi"))


@R.add("w3_rolling", sql("dense", f'SELECT Grid_ID, "Date", {_roll("sum", "prcp", 7, 0)} AS s, {_roll("avg", "prcp", 14, 0)} AS m, {_roll("max", "tmax", 14, 0)} AS hi, {_roll("min", "tmin", 14, 0)} AS lo FROM dense'), "s m hi lo")
def rolled(spark, sf):
    o = op.by_day()
    r = lambda c, h, n: op.rolling(c, h, n, o)
    return dense(spark, sf).select("Grid_ID", "Date", r("prcp", "sum", 7).alias("s"), r("prcp", "mean", 14).alias("m"), r("tmax", "max", 14).alias("hi"), r("tmin", "min", 14).alias("lo"))


@R.add("w4_leak_proof_shift", sql("dense", f'SELECT Grid_ID, "Date", {_roll("sum", "prcp", 7, 1)} AS s, {_LAST("EVI", 16, 1)} AS evi FROM dense'), "s evi")
def shifted(spark, sf):
    o = op.by_day()
    return dense(spark, sf).select("Grid_ID", "Date", op.rolling("prcp", "sum", 7, o, 1).alias("s"), op.forward_fill("EVI", 16, o, 1).alias("evi"))


@R.add("w5_degree_days", sql("dense", f'SELECT Grid_ID, "Date", {_roll("sum", "cold", 14, 1)} AS cold, {_roll("sum", "dd", 28, 1)} AS gdd FROM d', d="SELECT *, (tmin < 10)::INT::DOUBLE AS cold, CASE WHEN tmean IS NOT NULL THEN greatest(tmean - 10, 0) END AS dd FROM dense"), "cold gdd")
def ecological(spark, sf):
    o = op.by_day()
    d = dense(spark, sf).withColumn("cold", cold_day(F.col("tmin"))).withColumn("dd", degree_day(F.col("tmean")))
    return d.select("Grid_ID", "Date", op.rolling("cold", "sum", 14, o, 1).alias("cold"), op.rolling("dd", "sum", 28, o, 1).alias("gdd"))


_SPECS = {"prcp_7": ("prcp", "sum", 7), "tmean_14": ("tmean", "mean", 14), "tmax_28": ("tmax", "max", 28)}
_MONDAYS = "SELECT unnest([DATE '2024-01-15', DATE '2024-01-22', DATE '2024-02-05']) AS monday"


@R.add("w6_asof_features", sql("daily", 'SELECT Grid_ID, monday, sum(prcp) FILTER ("Date" >= monday - 7) AS prcp_7, avg(tmean) FILTER ("Date" >= monday - 14) AS tmean_14, max(tmax) AS tmax_28 FROM daily, m WHERE "Date" < monday AND "Date" >= monday - 28 GROUP BY 1, 2', m=_MONDAYS), "prcp_7 tmean_14 tmax_28")
def asof(spark, sf):
    m = spark.sql("SELECT explode(array(DATE'2024-01-15', DATE'2024-01-22', DATE'2024-02-05')) AS monday")
    return op.asof_features(daily(spark, sf), m, _SPECS)


_DYN = f"""SELECT Grid_ID, "Date", {", ".join(f"{_roll('sum', 'prcp', d, 1)} AS prcp_sum_{d}d, {_roll('avg', 'tmean', d, 1)} AS tmean_mean_{d}d" for d in (7, 14, 28))},
  {_roll("max", "tmax", 14, 1)} AS tmax_max_14d, {_roll("avg", "tmin", 14, 1)} AS tmin_mean_14d, {_roll("min", "tmin", 14, 1)} AS tmin_min_14d, {_LAST("EVI", 16, 1)} AS evi_level, {_LAST("NDWI", 8, 1)} AS ndwi_level FROM filled"""


@R.add("w7_dynamic_features", sql("dense", _DYN, filled=_FILLED), " ".join(f"prcp_sum_{d}d tmean_mean_{d}d" for d in (7, 14, 28)) + " tmax_max_14d tmin_mean_14d tmin_min_14d evi_level ndwi_level")
def dynamic(spark, sf):
    return op.build_dynamic_features(daily(spark, sf), FIRST, LAST)


@R.add("w8_top_per_cell", sql("panel", "SELECT Grid_ID, iso_year, iso_week, other_count FROM panel WHERE presence = 0 QUALIFY row_number() OVER (PARTITION BY Grid_ID ORDER BY other_count DESC, iso_year, iso_week) <= 3"), "other_count")
def top(spark, sf):
    p = panel(spark, sf).filter("presence = 0")
    return op.top_per_group(p, ["Grid_ID"], [F.desc("other_count"), F.col("iso_year"), F.col("iso_week")], 3).select("Grid_ID", "iso_year", "iso_week", "other_count")


@R.add("w9_dedup_first", sql("records", "SELECT species, Grid_ID, eventDate, min(gbifID) AS gbifID FROM records GROUP BY 1, 2, 3"))
def dedup(spark, sf):
    r = records(spark, sf)
    both = r.unionByName(r.filter("individualCount > 25"))
    return op.dedup_first(both, ["species", "Grid_ID", "eventDate"], [F.col("gbifID")]).select("species", "Grid_ID", "eventDate", "gbifID")


@R.add("w10_expanding_mean", sql("panel", "SELECT a.Grid_ID, a.iso_week, a.iso_year, count(b.presence) AS n_before, avg(b.presence) AS mean_before FROM (SELECT DISTINCT Grid_ID, iso_week, iso_year FROM panel) a LEFT JOIN panel b ON a.Grid_ID = b.Grid_ID AND a.iso_week = b.iso_week AND b.iso_year < a.iso_year GROUP BY 1, 2, 3"), "mean_before")
def expanding(spark, sf):
    return op.expanding_mean(panel(spark, sf), ["Grid_ID", "iso_week"], "iso_year", "presence")


_AGAIN = 'SELECT a.Grid_ID, a."Date", CASE WHEN count(b.prcp) >= 5 THEN sum(b.prcp) END AS again FROM filled a LEFT JOIN filled b ON a.Grid_ID = b.Grid_ID AND b."Date" < a."Date" AND b."Date" >= a."Date" - 7 GROUP BY 1, 2'
_LEAKS = """SELECT 'no_leak' AS "check", CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS level, n::DOUBLE AS metric FROM
  (SELECT count(*) AS n FROM feats JOIN again USING (Grid_ID, "Date") WHERE NOT coalesce(abs(prcp_sum_7d - again) <= 1e-6, prcp_sum_7d IS NULL AND again IS NULL))"""
_SUMS = lambda shift: f'SELECT Grid_ID, "Date", {_roll("sum", "prcp", 7, shift)} AS prcp_sum_7d FROM filled'


@R.add("q10_no_leak", sql("dense", _LEAKS, filled=_FILLED, feats=_SUMS(1), again=_AGAIN), "metric")
def leak(spark, sf):
    o = op.by_day()
    f = dense(spark, sf).withColumn("prcp", op.forward_fill("prcp", op.CLIMATE_FILL, o))
    return checks.no_leak(op.build_dynamic_features(daily(spark, sf), FIRST, LAST), f)


@R.add("q10_leak_found", sql("dense", _LEAKS, filled=_FILLED, feats=_SUMS(0), again=_AGAIN), "metric")
def leak_found(spark, sf):
    """The same check of features whose windows end on the day itself: they leak, and are told."""
    o = op.by_day()
    f = dense(spark, sf).withColumn("prcp", op.forward_fill("prcp", op.CLIMATE_FILL, o))
    return checks.no_leak(op.build_dynamic_features(daily(spark, sf), FIRST, LAST, shift=0), f)


@R.add("f14_multi_year_climatology", sql("nation_daily", 'SELECT Grid_ID, week("Date")::INT AS iso_week, avg(value) AS value, avg(qty) AS qty, count(*) AS n_years FROM nation_daily WHERE isodow("Date") = 1 GROUP BY 1, 2'), "value qty")
def climatology(spark, sf):
    from ..operators.panels import weekly_climatology

    return weekly_climatology(nation_daily(spark, sf), ["value", "qty"])
