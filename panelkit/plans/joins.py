"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import region_label
from ..operators import joins as op, panels, windows
from ._tables import Registry, cells, clean_records, daily, panel, records, scores, sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_COS = "(SELECT cos(radians(avg(decimalLatitude))) FROM records)"


@R.add("j1_merge_daily", sql("daily", 'SELECT coalesce(a.Grid_ID, b.Grid_ID) AS Grid_ID, coalesce(a."Date", b."Date") AS "Date", a.EVI, b.NDWI FROM (SELECT * FROM daily WHERE EVI IS NOT NULL) a FULL JOIN (SELECT * FROM daily WHERE NDWI IS NOT NULL) b ON a.Grid_ID = b.Grid_ID AND a."Date" = b."Date"'), "EVI NDWI")
def merged(spark, sf):
    d = daily(spark, sf)
    return op.merge_daily([d.filter("EVI is not null").select("Grid_ID", "Date", "EVI"), d.filter("NDWI is not null").select("Grid_ID", "Date", "NDWI")])


@R.add("j2_join_static", "SELECT s_suppkey, s_nationkey AS Grid_ID, c.bal FROM supplier LEFT JOIN (SELECT c_nationkey, min_by(c_acctbal, c_custkey) AS bal FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey", "bal")
def static(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("Grid_ID"))
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("Grid_ID"), "c_custkey", F.col("c_acctbal").alias("bal"))
    return op.join_static(s, c, order="c_custkey").drop("c_custkey")


@R.add("j3_coverage", "SELECT count(*) AS n_left, count(c_custkey) AS n_matched, count(c_custkey)::DOUBLE / count(*) AS coverage, count(c_custkey)::DOUBLE / count(*) >= 0.95 AS enough FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey", "coverage")
def covered(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return op.join_with_coverage(table(spark, sf, "orders"), c, ["o_custkey"])[1]


@R.add("j4_snap_to_cells", sql("records", f"SELECT gbifID, Grid_ID, 111 * sqrt((decimalLatitude - cell_lat) ** 2 + ((decimalLongitude - cell_lon) * {_COS}) ** 2) AS snap_km FROM records"), "snap_km")
def snapped(spark, sf):
    r = records(spark, sf).drop("Grid_ID", "cell_ord", "cell_lat", "cell_lon")
    return op.snap_to_cells(r, cells(spark, sf), key=["gbifID"]).select("gbifID", "Grid_ID", "snap_km")


@R.add("j5_attach_features", sql("panel daily", 'SELECT p.Grid_ID, p.week_start, d.tmean FROM (SELECT DISTINCT Grid_ID, date_trunc(\'week\', "Date")::DATE AS week_start FROM daily) p LEFT JOIN daily d ON d.Grid_ID = p.Grid_ID AND d."Date" = p.week_start'), "tmean")
def attached(spark, sf):
    d = daily(spark, sf)
    weeks = d.select("Grid_ID", F.to_date(F.date_trunc("week", "Date")).alias("week_start")).distinct()
    return op.attach_features(weeks, d).select("Grid_ID", "week_start", "tmean")


@R.add("j6_without_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def without(spark, sf):
    return op.without_keys(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@R.add("j7_key_overlap", "SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS n_left_only, count(*) FILTER (a IS NULL) AS n_right_only, min(a) FILTER (b IS NULL) AS left_example, min(b) FILTER (a IS NULL) AS right_example FROM (SELECT DISTINCT c_custkey AS a FROM customer) FULL JOIN (SELECT DISTINCT o_custkey * 2 AS b FROM orders) ON a = b")
def overlap(spark, sf):
    return op.key_overlap(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("k")), "k")


@R.add("j8_previous_label", sql("panel", "SELECT a.Grid_ID, a.week_start, a.presence, b.presence AS prev_week, c.presence AS prior_year FROM panel a LEFT JOIN panel b ON a.Grid_ID = b.Grid_ID AND a.week_start = b.week_start + 7 LEFT JOIN panel c ON a.Grid_ID = c.Grid_ID AND a.iso_year = c.iso_year + 1 AND a.iso_week = c.iso_week"))
def previous(spark, sf):
    p = panel(spark, sf)
    a = op.previous_label(p, "prev_week").withColumnRenamed("previous", "prev_week")
    return op.previous_label(a, "prior_year").select("Grid_ID", "week_start", "presence", "prev_week", F.col("previous").alias("prior_year"))


_CLIM = """SELECT te.Grid_ID, te.iso_year, te.iso_week, coalesce(cw.m, wk.m, (SELECT avg(presence) FROM panel WHERE iso_year < 1998)) AS p, (CASE WHEN cw.m IS NOT NULL THEN 1 WHEN wk.m IS NOT NULL THEN 2 ELSE 3 END)::INT AS tier
 FROM panel te LEFT JOIN (SELECT Grid_ID, iso_week, avg(presence) AS m FROM panel WHERE iso_year < 1998 GROUP BY 1, 2) cw ON te.Grid_ID = cw.Grid_ID AND te.iso_week = cw.iso_week
 LEFT JOIN (SELECT iso_week, avg(presence) AS m FROM panel WHERE iso_year < 1998 GROUP BY 1) wk ON te.iso_week = wk.iso_week WHERE te.iso_year >= 1998"""


@R.add("j9_climatology", sql("panel", _CLIM), "p")
def climatology(spark, sf):
    p = panel(spark, sf)
    return op.climatology_forecast(p.filter("iso_year < 1998"), p.filter("iso_year >= 1998")).select("Grid_ID", "iso_year", "iso_week", "p", "tier")


@R.add("j9_tier_usage", sql("panel", f"SELECT 100 * avg((tier = 1)::INT) AS tier1_pct, 100 * avg((tier = 2)::INT) AS tier2_pct, 100 * avg((tier = 3)::INT) AS tier3_pct, count(*) AS n_test FROM ({_CLIM})"), "tier1_pct tier2_pct tier3_pct")
def tiers(spark, sf):
    p = panel(spark, sf)
    return op.tier_usage(op.climatology_forecast(p.filter("iso_year < 1998"), p.filter("iso_year >= 1998")))


_GRID = "SELECT Grid_ID, cell_lat AS lat, cell_lon AS lon, w::INT AS iso_week FROM cells, (SELECT unnest(range(1, 54)) AS w)"
_SAMPLED = "SELECT DISTINCT cell_lat, cell_lon, iso_week FROM panel"


@R.add("j10_support_distance", sql("panel", "SELECT g.Grid_ID, g.iso_week, min(111 * sqrt((lat - cell_lat) ** 2 + ((lon - cell_lon) * (SELECT cos(radians(avg(lat))) FROM grid)) ** 2)) AS support_km FROM grid g LEFT JOIN sampled s ON least((g.iso_week - s.iso_week + 53) % 53, (s.iso_week - g.iso_week + 53) % 53) <= 2 GROUP BY 1, 2", grid=_GRID, sampled=_SAMPLED), "support_km")
def supported(spark, sf):
    g = cells(spark, sf).select("Grid_ID", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"), F.explode(F.sequence(F.lit(1), F.lit(53))).alias("iso_week"))
    s = panel(spark, sf).select("cell_lat", "cell_lon", "iso_week").distinct()
    return op.support_distance(g, s, 2).select("Grid_ID", "iso_week", "support_km")


@R.add("j11_join_week", sql("panel", "SELECT a.Grid_ID, a.iso_week, a.presence AS predicted, b.presence FROM panel a JOIN panel b ON a.Grid_ID = b.Grid_ID AND b.iso_year = 1998 AND b.iso_week = 20 WHERE a.iso_year = 1997 AND a.iso_week = 20"))
def week(spark, sf):
    p = panel(spark, sf)
    a = p.filter("iso_year = 1997").select("Grid_ID", "iso_week", F.col("presence").alias("predicted"))
    return op.join_week(a, p.filter("iso_year = 1998").select("Grid_ID", "iso_week", "presence"), 20)


@R.add("j12_label_cells", sql("clean", "SELECT CASE WHEN cell_lat < 25.3::DOUBLE THEN 'Florida Keys / far south tip' WHEN cell_lon > -81.8::DOUBLE THEN 'South FL (Everglades / SE coast)' ELSE 'SW coast (Naples area)' END AS region, count(*) AS n FROM clean WHERE cell_lat < 27 GROUP BY 1"))
def labelled(spark, sf):
    labels = cells(spark, sf).select("Grid_ID", region_label(F.col("cell_lat"), F.col("cell_lon")).alias("region"))
    return op.label_cells(clean_records(spark, sf), labels).groupBy("region").agg(F.count("*").alias("n"))


@R.add("j14_guarded_skill", sql("scores", "SELECT a.yr, a.n, a.brier, CASE WHEN a.n = b.n AND b.brier > 0 THEN 1 - a.brier / b.brier END AS skill FROM (SELECT yr, count(*) AS n, avg((y - p) ** 2) AS brier FROM scores GROUP BY 1) a LEFT JOIN (SELECT yr, count(*) AS n, avg((y - p2) ** 2) AS brier FROM scores WHERE yr <> 1997 OR p2 > 0.2 GROUP BY 1) b ON a.yr = b.yr"), "brier skill")
def guarded(spark, sf):
    s = scores(spark, sf)
    b = lambda d, p: d.groupBy("yr").agg(F.count("*").alias("n"), F.avg((F.col("y") - F.col(p)) ** 2).alias("brier"))
    return op.guarded_skill(b(s, "p"), b(s.filter("yr <> 1997 or p2 > 0.2"), "p2"), ["yr"])


_SIDES = "WITH a AS (SELECT c_custkey AS k, c_acctbal AS bal FROM customer), b AS (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier)"


@R.add("j15_reconcile", f"{_SIDES} SELECT (SELECT count(*) FROM a JOIN b ON a.k = b.k) AS n_compared, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_target, (SELECT count(*) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_source, 'bal' AS column_name, (SELECT count(*) FROM a JOIN b ON a.k = b.k WHERE NOT abs(a.bal - b.bal) < 100) AS n_different")
def reconciled(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return op.reconcile(a, b, ["k"], ["bal"], 100)


@R.add("j16_largest_difference", "SELECT count(*) AS n_shared, max(abs(c_acctbal - s_acctbal)) AS max_diff_bal FROM customer JOIN supplier ON c_custkey = s_suppkey", "max_diff_bal")
def difference(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return op.largest_difference(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal")), "k", ["bal"])


PIXELS = "SELECT decimalLongitude * 111000 AS x_m, decimalLatitude * 111000 AS y_m, individualCount AS value, species, eventDate FROM clean"
BOXES = "SELECT Grid_ID, cell_lon * 111000 AS cx_m, cell_lat * 111000 AS cy_m FROM cells"
INSIDE = "abs(x_m - cx_m) <= 2000 AND abs(y_m - cy_m) <= 2000"


def assigned(spark, sf):
    r = clean_records(spark, sf).select((F.col("decimalLongitude") * 111000).alias("x_m"), (F.col("decimalLatitude") * 111000).alias("y_m"), F.col("individualCount").alias("value"), "species", "eventDate")
    c = cells(spark, sf).select("Grid_ID", (F.col("cell_lon") * 111000).alias("cx_m"), (F.col("cell_lat") * 111000).alias("cy_m"))
    return op.assign_pixels(r, c, 2000)


@R.add("j17_a19_zonal_mean", sql("clean", f"SELECT Grid_ID, avg(value) AS value_mean, count(value) AS n_pixels FROM px JOIN box ON {INSIDE} GROUP BY 1", px=PIXELS, box=BOXES), "value_mean")
def zonal(spark, sf):
    return panels.zonal_mean(assigned(spark, sf), "value")


@R.add("a20_zonal_histogram", sql("clean", f"SELECT Grid_ID, count(DISTINCT species) AS n_codes, sum(value) AS total FROM px JOIN box ON {INSIDE} GROUP BY 1", px=PIXELS, box=BOXES), "total")
def frequency(spark, sf):
    h = panels.zonal_histogram(assigned(spark, sf), "species", "value")
    return h.select("Grid_ID", F.size("histogram").cast("long").alias("n_codes"), F.aggregate(F.map_values("histogram"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@R.add("a21_point_series", sql("clean", f"SELECT Grid_ID, eventDate, arg_min(value, struct_pack(d := d2, x := x_m, y := y_m, v := value)) AS value FROM (SELECT *, (x_m - cx_m) ** 2 + (y_m - cy_m) ** 2 AS d2 FROM px JOIN box ON {INSIDE}) GROUP BY 1, 2", px=PIXELS, box=BOXES), "value")
def series(spark, sf):
    return panels.nearest_pixel_series(assigned(spark, sf), "eventDate", ["value"])
