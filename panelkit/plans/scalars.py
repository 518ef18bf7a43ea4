"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ._tables import Registry, cells, clean_records, daily, histograms, panel, records, scores, sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("f1_f4_climate_arithmetic", sql("daily", 'SELECT Grid_ID, "Date", (tmax + tmin) / 2 AS mid, 610.78::DOUBLE * exp(17.27::DOUBLE * tmean / (tmean + 237.3::DOUBLE)) - prcp AS vpd, EVI * 0.0001::DOUBLE AS evi, (EVI - NDWI) / nullif(EVI + NDWI, 0) AS nd FROM (SELECT Grid_ID, "Date", tmax, tmin, round(tmean, 6) AS tmean, round(prcp, 6) AS prcp, round(EVI, 6) AS EVI, round(NDWI, 6) AS NDWI FROM daily)'), "mid vpd evi nd")
def climate(spark, sf):
    # Means are rounded first: their last digits depend on the order in which rows are added up.
    c = lambda x: F.col(x) if x in ("tmax", "tmin") else F.round(x, 6)
    return daily(spark, sf).select("Grid_ID", "Date", fn.mean_temperature(c("tmax"), c("tmin")).alias("mid"), fn.vapour_deficit(c("tmean"), c("prcp")).alias("vpd"), fn.rescale(c("EVI")).alias("evi"), fn.normalised_difference(c("EVI"), c("NDWI")).alias("nd"))


@R.add("f5_f7_cell_ids", sql("cells", "SELECT Grid_ID, Grid_ID AS made, cell_lat AS lat, cell_lon AS lon, true AS ok, NULL::DOUBLE AS bad_lat FROM cells"), "lat lon")
def cell_ids(spark, sf):
    c = cells(spark, sf)
    lat, lon = fn.cell_centroid(F.col("Grid_ID"))
    return c.select("Grid_ID", fn.cell_id(F.col("cell_lat"), F.col("cell_lon")).alias("made"), lat.alias("lat"), lon.alias("lon"), fn.is_cell_id(F.col("Grid_ID")).alias("ok"), fn.cell_centroid(F.concat(F.lit("x"), "Grid_ID"))[0].alias("bad_lat"))


@R.add("f8_parse_histogram", sql("histograms", "SELECT Grid_ID, count(*) AS n_codes, sum(split_part(x, '=', 2)::DOUBLE) AS total FROM (SELECT Grid_ID, unnest(string_split(trim(histogram, '{}'), ', ')) AS x FROM histograms) GROUP BY 1"), "total")
def parsed(spark, sf):
    h = histograms(spark, sf).withColumn("m", fn.parse_histogram(F.col("histogram")))
    return h.select("Grid_ID", F.size("m").cast("long").alias("n_codes"), fn.histogram_total(F.col("m")).alias("total"))


_PIX = "SELECT Grid_ID, split_part(x, '=', 1)::INT AS code, split_part(x, '=', 2)::DOUBLE AS n FROM (SELECT Grid_ID, unnest(string_split(trim(histogram, '{}'), ', ')) AS x FROM histograms)"


@R.add("f9_histogram_fraction", sql("histograms", "SELECT Grid_ID, coalesce(sum(n) FILTER (code IN (21, 22, 23, 24)), 0) / nullif(sum(n) FILTER (code <> 11), 0) AS urban FROM pix GROUP BY 1", pix=_PIX), "urban")
def fraction(spark, sf):
    h = histograms(spark, sf)
    return h.select("Grid_ID", fn.histogram_fraction(fn.parse_histogram(F.col("histogram")), (21, 22, 23, 24), (11,)).alias("urban"))


@R.add("f10_landcover_columns", sql("histograms", "SELECT Grid_ID, coalesce(sum(n) FILTER (code = 11), 0) / sum(n) AS pct_open_water, coalesce(sum(n) FILTER (code = 42), 0) / sum(n) AS pct_evergreen, coalesce(sum(n) FILTER (code IN (81, 82)), 0) / sum(n) AS pct_agriculture, coalesce(sum(n) FILTER (code IN (90, 95)), 0) / sum(n) AS pct_wetland FROM pix GROUP BY 1", pix=_PIX), "pct_open_water pct_evergreen pct_agriculture pct_wetland")
def landcover(spark, sf):
    from ..operators.landcover import engineer_landcover

    groups = {k: fn.LANDCOVER_GROUPS[k] for k in ("agriculture", "wetland")}
    return engineer_landcover(histograms(spark, sf), {11: "open_water", 42: "evergreen"}, groups)


@R.add("f11_f12_counts", sql("records", "SELECT gbifID, ln(1 + individualCount) AS log_count, sqrt(greatest(individualCount, 1)) AS weight FROM records"), "log_count weight")
def counts(spark, sf):
    return records(spark, sf).select("gbifID", fn.log_count(F.col("individualCount")).alias("log_count"), fn.effort_weight(F.col("individualCount")).alias("weight"))


@R.add("f13_f15_calendar", "SELECT DISTINCT l_shipdate::DATE AS d, isoyear(l_shipdate)::INT AS iso_year, week(l_shipdate)::INT AS iso_week, date_trunc('week', l_shipdate)::DATE AS monday, date_trunc('week', l_shipdate)::DATE AS again, sin(2 * pi() * dayofyear(l_shipdate) / 365.25::DOUBLE) AS sin_doy, cos(2 * pi() * dayofyear(l_shipdate) / 365.25::DOUBLE) AS cos_doy FROM lineitem", "sin_doy cos_doy")
def calendar(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    y, w = fn.iso_year(F.col("d")), fn.iso_week(F.col("d"))
    s, c = fn.season(F.col("d"))
    return d.select("d", y.cast("int").alias("iso_year"), w.alias("iso_week"), fn.week_monday(F.col("d")).alias("monday"), fn.iso_monday(y, w).alias("again"), s.alias("sin_doy"), c.alias("cos_doy"))


@R.add("f16_week_neighbours", sql("weekly", "SELECT iso_week, count(DISTINCT w)::INT AS n, min(w)::INT AS lo, max(w)::INT AS hi FROM (SELECT iso_week, ((iso_week + k - 1 + 53) % 53) + 1 AS w FROM (SELECT DISTINCT iso_week FROM weekly), (SELECT unnest(range(-2, 3)) AS k)) GROUP BY 1"))
def neighbours(spark, sf):
    w = clean_records(spark, sf).select(fn.iso_week(F.col("eventDate")).alias("iso_week")).distinct().withColumn("n", fn.week_neighbours(F.col("iso_week"), 2))
    return w.select("iso_week", F.size("n").alias("n"), F.array_min("n").alias("lo"), F.array_max("n").alias("hi"))


@R.add("f17_f18_distance_support", sql("records", "SELECT gbifID, km, exp(-km / 120) AS conf, 0.25::DOUBLE + 0.75::DOUBLE * exp(-km / 120) AS opacity FROM (SELECT gbifID, 111 * sqrt((decimalLatitude - cell_lat) ** 2 + ((decimalLongitude - cell_lon) * 0.9::DOUBLE) ** 2) AS km FROM records)"), "km conf opacity")
def distance(spark, sf):
    c = F.col
    d = records(spark, sf).withColumn("km", fn.distance_km(c("decimalLatitude"), c("decimalLongitude"), c("cell_lat"), c("cell_lon"), 0.9)).withColumn("conf", fn.support(c("km")))
    return d.select("gbifID", "km", "conf", fn.opacity(c("conf")).alias("opacity"))


@R.add("f19_disagreement", sql("scores", "SELECT grp, avg(abs(p - p2)) AS two, avg(greatest(p, p2, p3) - least(p, p2, p3)) AS three FROM scores GROUP BY 1"), "two three")
def differ(spark, sf):
    c = F.col
    return scores(spark, sf).groupBy("grp").agg(F.avg(fn.disagreement(c("p"), c("p2"))).alias("two"), F.avg(fn.disagreement(c("p"), c("p2"), c("p3"))).alias("three"))


@R.add("f20_region", sql("cells", "SELECT Grid_ID, CASE WHEN cell_lat < 25.3::DOUBLE THEN 'Florida Keys / far south tip' WHEN cell_lat < 27 AND cell_lon > -81.8::DOUBLE THEN 'South FL (Everglades / SE coast)' WHEN cell_lat < 27 THEN 'SW coast (Naples area)' WHEN cell_lat < 29 THEN 'Central Florida' ELSE 'Northeast Florida' END AS region FROM cells"))
def region(spark, sf):
    return cells(spark, sf).select("Grid_ID", fn.region_label(F.col("cell_lat"), F.col("cell_lon")).alias("region"))


@R.add("f21_epoch", "SELECT DISTINCT year(l_shipdate)::INT AS year, (CASE WHEN year(l_shipdate) <= 1996 THEN 1995 WHEN year(l_shipdate) <= 1998 THEN 1997 ELSE 2000 END)::INT AS epoch FROM lineitem")
def epoch(spark, sf):
    y = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("year")).distinct()
    return y.select("year", fn.epoch_year(F.col("year"), ((1996, 1995), (1998, 1997), (None, 2000))).alias("epoch"))


@R.add("f22_degree_days", sql("daily", 'SELECT Grid_ID, "Date", greatest(tmean - 10, 0) AS dd, (tmin < 10)::INT::DOUBLE AS cold FROM daily'), "dd cold")
def degree_days(spark, sf):
    return daily(spark, sf).select("Grid_ID", "Date", fn.degree_day(F.col("tmean")).alias("dd"), fn.cold_day(F.col("tmin")).alias("cold"))


@R.add("f23_fold_label", sql("panel", "SELECT Grid_ID || '_' || iso_year AS fold, count(*) AS n FROM panel GROUP BY 1"))
def fold(spark, sf):
    return panel(spark, sf).groupBy(fn.fold_label(F.col("Grid_ID"), F.col("iso_year").cast("string")).alias("fold")).agg(F.count("*").alias("n"))


@R.add("f24_feature_blocks", "SELECT DISTINCT p_brand AS feature, CASE WHEN p_brand = 'Brand#11' THEN 'first' WHEN p_brand LIKE 'Brand#2%' THEN 'second' ELSE 'other' END AS block FROM part")
def blocks(spark, sf):
    from ..operators.landcover import assign_blocks

    features = table(spark, sf, "part").select(F.col("p_brand").alias("feature")).distinct()
    return assign_blocks(features, {"first": ["Brand#11"]}, {"Brand#2": "second"})


@R.add("f25_category_order", "SELECT DISTINCT o_orderpriority AS category, (CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END)::INT AS place FROM orders")
def order(spark, sf):
    from ..operators.landcover import category_places

    return category_places(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category")).distinct(), ["5-LOW", "1-URGENT"])
