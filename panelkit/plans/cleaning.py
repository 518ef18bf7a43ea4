"""Queries of scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources as io
from ..operators import cleaning as op
from ._tables import FOCAL, Registry, cells, clean_records, daily, histograms, panel, records, scores, sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("io1_io9_csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer", "c_acctbal")
def csv(spark, sf):
    path = io.work_dir(spark, "customers-csv")
    io.write_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return io.read_table(spark, path, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@R.add("io2_occurrence_scan", sql("records", "SELECT gbifID, species, individualCount, coordinateUncertaintyInMeters, eventDate, month(eventDate)::INT AS month FROM records"), "individualCount coordinateUncertaintyInMeters")
def occurrences(spark, sf):
    r, path = records(spark, sf), io.work_dir(spark, "occurrences-tsv")
    r = r.select("gbifID", "species", "individualCount", "decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters", "eventDate", F.dayofmonth("eventDate").alias("day"), F.month("eventDate").alias("month"), F.year("eventDate").alias("year"))
    r.write.csv(path, header=True, sep="\t")
    return io.read_occurrences(spark, path).select("gbifID", "species", "individualCount", "coordinateUncertaintyInMeters", "eventDate", "month")


@R.add("io3_columns", "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice")
def columns(spark, sf):
    return io.read_columns(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_totalprice"])


@R.add("io4_io8_yearly", "SELECT year(o_orderdate)::INT AS year, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1", "total")
def yearly(spark, sf):
    path = io.work_dir(spark, "orders-yearly")
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    io.write_yearly(o, path, ("o_orderkey",))
    return io.read_yearly(spark, path).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@R.add("io5_io7_reports", "SELECT event_id, year(ts)::INT AS report_year, coalesce('{\"n\":' || (json_extract(props, '$.n'))::VARCHAR || '}', '{}') AS detail FROM events WHERE year(ts) = 2024")
def reports(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("report_date"), F.from_json("props", "n bigint").alias("detail"))
    path = io.work_dir(spark, "reports-json")
    # Each line an array of one report, as the service's files hold arrays of reports.
    e.select(F.concat(F.lit("["), F.to_json(F.struct("*")), F.lit("]")).alias("value")).write.text(path)
    back = io.read_reports(spark, path, e.schema, lines=True)
    return io.filter_report_years(io.stringify_nested(back), [2024]).select("event_id", "report_year", "detail")


@R.add("io10_upsert", "SELECT c_nationkey, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS src, CASE WHEN c_nationkey % 2 = 0 THEN count(*) ELSE -count(*) END AS n FROM customer GROUP BY 1, 2")
def upsert(spark, sf):
    g = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    old = g.select("c_nationkey", "c_mktsegment", F.lit("old").alias("src"), (-F.col("n")).alias("n"))
    new = g.filter("c_nationkey % 2 = 0").select("c_nationkey", "c_mktsegment", F.lit("new").alias("src"), "n")
    return io.upsert_latest(old, new, ["c_nationkey", "c_mktsegment"])


@R.add("io11_feature_list", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem", "l_quantity l_discount")
def features(spark, sf):
    path = io.work_dir(spark, "features")
    io.FeatureSpec(static=["l_discount", "l_comment_secret"], dynamic=["l_quantity"], never_feed_to_model=["l_comment_secret"]).save(spark, path)
    return io.FeatureSpec.load(spark, path).select(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@R.add("io12_unstack_bands", "SELECT l_suppkey AS x, l_linenumber // 3 AS day, max(l_quantity) FILTER (l_linenumber % 3 = 0 AND l_quantity <= 45) AS a, max(l_quantity) FILTER (l_linenumber % 3 = 1 AND l_quantity <= 45) AS b, max(l_quantity) FILTER (l_linenumber % 3 = 2 AND l_quantity <= 45) AS c FROM lineitem GROUP BY 1, 2", "a b c")
def bands(spark, sf):
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("x"), F.col("l_linenumber").alias("band"), F.col("l_quantity").alias("value"))
    return io.unstack_bands(p, ["a", "b", "c"], 45, ("x",))


@R.add("p1_keep_present", "SELECT s_suppkey, s_name FROM supplier")
def present(spark, sf):
    return op.keep_present(table(spark, sf, "supplier"), ["s_suppkey", "s_missing", "s_name"])[0]


@R.add("p2_p4_coercion", "SELECT p_partkey, trim('  ' || p_brand || ' ') AS brand, try_cast(substr(p_name, 1, 3) AS DOUBLE) AS number, try_cast(p_size::VARCHAR AS DOUBLE) AS size, NULL::DATE AS no_day, DATE '2020-02-03' AS day FROM part", "number size")
def coerced(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("  "), "p_brand", F.lit(" ")).alias("brand"), F.substring("p_name", 1, 3).alias("number"), F.col("p_size").cast("string").alias("size"), F.lit("no day").alias("no_day"), F.lit("2020-02-03 10:00:00").alias("day"))
    return op.to_days(op.to_numbers(op.trimmed(p, ["brand"]), ["number", "size"]), ["no_day", "day"])


@R.add("p5_drop_null", sql("daily", "SELECT (SELECT count(*) FROM daily WHERE EVI IS NOT NULL AND NDWI IS NOT NULL) AS n_any, (SELECT count(*) FROM daily WHERE EVI IS NOT NULL OR NDWI IS NOT NULL) AS n_all"))
def dropped(spark, sf):
    d = daily(spark, sf)
    n = lambda how, name: op.drop_null(d, ["EVI", "NDWI"], how).agg(F.count("*").alias(name))
    return n("any", "n_any").join(F.broadcast(n("all", "n_all")))


@R.add("p6_p7_clean_occurrences", sql("records", "SELECT gbifID, species, individualCount FROM records WHERE decimalLatitude BETWEEN 25.1::DOUBLE AND 25.8::DOUBLE AND decimalLongitude BETWEEN -81.2::DOUBLE AND -80.5::DOUBLE AND individualCount > 0 AND year(eventDate) BETWEEN 1996 AND 1999 AND (coordinateUncertaintyInMeters IS NULL OR coordinateUncertaintyInMeters <= 5000)"), "individualCount")
def cleaned(spark, sf):
    return op.clean_occurrences(records(spark, sf), (25.1, 25.8, -81.2, -80.5), (1996, 1999)).select("gbifID", "species", "individualCount")


@R.add("p8_p9_sentinels_floats", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber NOT IN (7, 50) THEN l_linenumber END AS k, CASE WHEN l_quantity NOT IN (7, 50) THEN l_quantity::FLOAT END AS q FROM lineitem")
def sentinels(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linenumber").alias("k"), F.col("l_quantity").alias("q"))
    return op.to_floats(op.nullify(d, [7, 50], ["k", "q"]).withColumn("k", F.col("k").cast("int")), ["q"])


@R.add("p10_focal", sql("clean", "SELECT Grid_ID, count(*) AS n FROM clean WHERE species = 'focal' GROUP BY 1"))
def focal(spark, sf):
    return op.in_category(clean_records(spark, sf), "species", FOCAL).groupBy("Grid_ID").agg(F.count("*").alias("n"))


@R.add("p11_restrict_to_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def restricted(spark, sf):
    keys = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return op.restrict_to(table(spark, sf, "orders"), keys, ["o_custkey"]).select("o_orderkey", "o_custkey")


@R.add("p12_flag_drop_above", sql("daily", "SELECT Grid_ID, count(*) AS n, count(*) FILTER (coalesce(EVI > 50, false)) AS above, count(*) FILTER (EVI <= 50) AS kept FROM daily GROUP BY 1"))
def flagged(spark, sf):
    d = op.flag_above(daily(spark, sf), "EVI", 50, "wet")
    kept = op.drop_above(d, "EVI", 50).groupBy("Grid_ID").agg(F.count("*").alias("kept"))
    return d.groupBy("Grid_ID").agg(F.count("*").alias("n"), F.count_if("wet").alias("above")).join(kept, "Grid_ID", "left").fillna({"kept": 0})


@R.add("p13_p14_usable_rows", sql("daily", 'SELECT Grid_ID, "Date" FROM daily WHERE NOT (coalesce(prcp > 200, false) OR (EVI IS NULL AND NDWI IS NULL))'))
def usable(spark, sf):
    d = op.drop_unusable_cells(daily(spark, sf), "prcp", 200, ["EVI", "NDWI"])
    return op.drop_warmup(d, ["EVI", "NDWI"]).select("Grid_ID", "Date")


@R.add("p15_p16_columns", sql("daily", 'SELECT Grid_ID, "Date", tmax, tmin, tmean FROM daily'), "tmax tmin tmean")
def chosen(spark, sf):
    d = daily(spark, sf)
    return op.assert_parity(d, ["Grid_ID", "Date"], op.with_prefix(d.columns, ("t",)))


@R.add("p17_support_filter", sql("scores", "SELECT grp, count(*) FILTER (p >= 0.5) AS near, count(*) FILTER (p2 <= 0.3) AS close FROM scores GROUP BY 1"))
def supported(spark, sf):
    s = scores(spark, sf)
    a = op.within_support(s, "p", least=0.5).groupBy("grp").agg(F.count("*").alias("near"))
    b = op.within_support(s, "p2", most=0.3).groupBy("grp").agg(F.count("*").alias("close"))
    return s.select("grp").distinct().join(a, "grp", "left").join(b, "grp", "left").fillna(0)


@R.add("p18_melt", sql("scores", "SELECT grp, yr, scheme, avg(p) AS p, count(*) AS n FROM (SELECT grp, yr, 'spatial' AS scheme, p FROM scores UNION ALL SELECT grp, yr, 'temporal', p2 FROM scores) GROUP BY 1, 2, 3"), "p")
def melted(spark, sf):
    s = scores(spark, sf).select("grp", "yr", F.col("p").alias("oof_spatial"), F.col("p2").alias("oof_temporal"))
    return op.melt_scores(s, ["grp", "yr"]).groupBy("grp", "yr", "scheme").agg(F.avg("p").alias("p"), F.count("*").alias("n"))


@R.add("p19_pivot", sql("scores", "SELECT grp, yr, max(p3) FILTER (\"by\" = 'F') AS \"F\", max(p3) FILTER (\"by\" = 'O') AS \"O\" FROM scores GROUP BY 1, 2"), "F O")
def pivoted(spark, sf):
    s = scores(spark, sf).groupBy("grp", "yr", F.col("by").alias("model")).agg(F.max("p3").alias("p"))
    return op.pivot_models(s, ["grp", "yr"], ["F", "O"])
