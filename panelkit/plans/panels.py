"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels as op
from ..sources import materialise
from ._tables import FOCAL, Registry, cells, clean_records, daily, nation_daily, panel, scores, sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


@R.add("a1_summarise", sql("daily", "SELECT Grid_ID, avg(tmean) AS tmean_mean, min(tmean) AS tmean_min, max(tmean) AS tmean_max, stddev_samp(tmean) AS tmean_std, coalesce(sum(EVI), 0) AS EVI_sum, avg(EVI) AS EVI_mean FROM daily GROUP BY 1"), "tmean_mean tmean_min tmean_max tmean_std EVI_sum EVI_mean")
def summarised(spark, sf):
    return op.summarise(daily(spark, sf), ["Grid_ID"], {"tmean": ("mean", "min", "max", "std"), "EVI": ("sum", "mean")})


@R.add("a2_a10_first_known", sql("daily", 'SELECT Grid_ID, arg_min(EVI, "Date") FILTER (EVI IS NOT NULL) AS EVI, arg_min(NDWI, "Date") FILTER (NDWI IS NOT NULL) AS NDWI FROM daily GROUP BY 1'), "EVI NDWI")
def known(spark, sf):
    return op.first_known(daily(spark, sf), ["Grid_ID"], ["EVI", "NDWI"], "Date")


@R.add("a3_abundance_panel", sql("clean", "SELECT Grid_ID, year(eventDate)::INT AS year, count(*) AS n_events, avg(ln(1 + individualCount)) AS mean_log_count, avg(individualCount) AS mean_count, min(cell_lat) AS cell_lat, min(cell_lon) AS cell_lon, count(*) < 5 AS low_n_flag FROM clean GROUP BY 1, 2"), "mean_log_count mean_count cell_lat cell_lon")
def abundance(spark, sf):
    r = clean_records(spark, sf).withColumn("year", F.year("eventDate"))
    return op.aggregate_panel(r, ["Grid_ID", "year"])


@R.add("a4_presence_panel", sql("presence", "SELECT * FROM presence"), "cell_lat cell_lon mean_log_count mean_count total_count max_count")
def presence(spark, sf):
    return op.presence_panel(clean_records(spark, sf), FOCAL)


@R.add("a5_cellweek_activity", sql("activity", "SELECT * EXCLUDE (week_start) FROM activity"), "other_count cell_lat cell_lon focal_count")
def activity(spark, sf):
    return op.cellweek_activity(clean_records(spark, sf), FOCAL)


@R.add("a6_a7_absences_capped", sql("panel", "SELECT * EXCLUDE (other_count, n_species), other_count, n_species FROM panel WHERE presence = 0 QUALIFY row_number() OVER (PARTITION BY Grid_ID ORDER BY other_count DESC, iso_year, iso_week) <= 20"), "cell_lat cell_lon mean_log_count mean_count total_count max_count other_count")
def absences(spark, sf):
    r = clean_records(spark, sf)
    return op.as_absence_rows(op.infer_absences(op.cellweek_activity(r, FOCAL), op.presence_panel(r, FOCAL), 3, 20))


@R.add("a8_weekly_climatology", sql("daily", 'SELECT Grid_ID, week("Date")::INT AS iso_week, avg(tmean) AS tmean, avg(prcp) AS prcp, count(*) AS n_years FROM daily WHERE isodow("Date") = 1 GROUP BY 1, 2'), "tmean prcp")
def climatology(spark, sf):
    return op.weekly_climatology(daily(spark, sf), ["tmean", "prcp"])


@R.add("a9_collapse_years", sql("nation_daily", 'SELECT Grid_ID, avg(qty) AS qty, arg_min(value, year) AS value FROM (SELECT Grid_ID, year("Date") AS year, sum(qty) AS qty, max(value) AS value FROM nation_daily GROUP BY 1, 2) GROUP BY 1'), "qty value")
def collapsed(spark, sf):
    y = nation_daily(spark, sf).groupBy("Grid_ID", F.year("Date").alias("year")).agg(F.sum("qty").alias("qty"), F.max("value").alias("value"))
    return op.collapse_years(y, ["qty"], ["value"])


_CAP = "(SELECT quantile_cont(o_totalprice, 0.995) FROM orders)"


@R.add("a11_winsorise", f"SELECT o_orderkey, least(o_totalprice, {_CAP}) AS o_totalprice FROM orders", "o_totalprice")
def winsorised(spark, sf):
    return op.winsorise(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")[0]


@R.add("a11_winsorise_cut", f"SELECT {_CAP} AS cap, count(*) FILTER (o_totalprice > {_CAP}) AS n_capped FROM orders", "cap")
def cut(spark, sf):
    return op.winsorise(table(spark, sf, "orders"), "o_totalprice")[1]


@R.add("a12_fold_report", sql("panel", """SELECT *, pos::DOUBLE / n AS prevalence, n < 30 OR pos < 5 OR neg < 5 AS thin FROM (
  SELECT 'cell' AS scheme, Grid_ID AS fold, count(*) AS n, count(*) FILTER (presence = 1) AS pos, count(*) FILTER (presence = 0) AS neg FROM panel GROUP BY 2
  UNION ALL SELECT 'temporal', iso_year::VARCHAR, count(*), count(*) FILTER (presence = 1), count(*) FILTER (presence = 0) FROM panel GROUP BY 2)"""), "prevalence")
def folds(spark, sf):
    return op.fold_report(panel(spark, sf), {"cell": "Grid_ID", "temporal": "iso_year"})


@R.add("a13_sampling_effort", sql("panel", """SELECT count(*) AS n_cells, quantile_cont(c, 0.5)::DOUBLE AS median_weeks, quantile_cont(c, 0.9)::DOUBLE AS p90_weeks,
  100 * (SELECT sum(c) FROM (SELECT c FROM cw ORDER BY c DESC LIMIT (SELECT greatest(1, count(*) // 10) FROM cw)))::DOUBLE / sum(c) AS top_decile_pct, 100 * count(*)::DOUBLE / (SELECT count(*) FROM cells) AS coverage_pct FROM cw""", cw="SELECT Grid_ID, count(*) AS c FROM panel GROUP BY 1"), "median_weeks p90_weeks top_decile_pct coverage_pct")
def effort(spark, sf):
    return op.sampling_effort(panel(spark, sf), cells(spark, sf))


@R.add("a13_block_effort", sql("panel", "SELECT iso_year, count(*) AS cell_weeks, count(DISTINCT Grid_ID) AS cells, avg(presence) AS presence_rate FROM panel GROUP BY 1"), "presence_rate")
def blocks(spark, sf):
    return op.block_effort(panel(spark, sf), "iso_year")


@R.add("a14_impute_medians", sql("daily", 'SELECT Grid_ID, "Date", coalesce(EVI, (SELECT quantile_cont(EVI, 0.5) FROM daily)) AS EVI FROM daily'), "EVI")
def imputed(spark, sf):
    d = daily(spark, sf).select("Grid_ID", "Date", "EVI")
    return op.impute(d, op.fit_medians(d, ["EVI"]))


@R.add("a15_class_balance", sql("scores", "SELECT yr, count(*) AS n, sum(y)::BIGINT AS pos, (count(*) - sum(y))::BIGINT AS neg, (count(*) - sum(y))::DOUBLE / nullif(sum(y), 0) AS neg_per_pos, count(*)::DOUBLE / nullif(2 * sum(y), 0) AS weight_pos, count(*)::DOUBLE / nullif(2 * (count(*) - sum(y)), 0) AS weight_neg FROM scores GROUP BY 1"), "neg_per_pos weight_pos weight_neg")
def balance(spark, sf):
    return op.class_balance(scores(spark, sf), "y", ["yr"])


@R.add("a16_oof_summary", sql("scores", "SELECT \"by\" AS model, yr::VARCHAR AS scheme, count(*) AS n, avg(y) AS prevalence FROM scores GROUP BY 1, 2"), "prevalence")
def oof(spark, sf):
    return op.oof_summary(scores(spark, sf).select(F.col("by").alias("model"), F.col("yr").cast("string").alias("scheme"), F.col("y").alias("presence")))


@R.add("a17_seed_spread", sql("scores", "SELECT g, metric, max(v) FILTER (seed = 42) AS at_base, min(v) AS least, quantile_cont(v, 0.5) AS median, max(v) AS greatest, max(v) - min(v) AS spread FROM (SELECT g, seed, 'm1' AS metric, m1 AS v FROM s UNION ALL SELECT g, seed, 'm2', m2 FROM s) GROUP BY 1, 2", s="SELECT \"by\" AS g, (grp % 5 + 40)::INT AS seed, avg(p) AS m1, avg(p2) AS m2 FROM scores GROUP BY 1, 2"), "at_base least median greatest spread")
def spread(spark, sf):
    s = scores(spark, sf).groupBy(F.col("by").alias("g"), (F.col("grp") % 5 + 40).alias("seed")).agg(F.avg("p").alias("m1"), F.avg("p2").alias("m2"))
    return op.seed_spread(s, ["m1", "m2"], ["g"])


@R.add("a18_profile_panel", sql("panel", """SELECT t.iso_year, n, positives, single_share, peak_week FROM (SELECT iso_year, count(*) AS n, sum(presence)::BIGINT AS positives, count(*) FILTER (n_events = 1)::DOUBLE / count(*) AS single_share FROM panel GROUP BY ROLLUP (iso_year)) t
  JOIN (SELECT iso_year, iso_week AS peak_week FROM (SELECT iso_year, iso_week, count(*) AS c FROM panel GROUP BY 1, 2 UNION ALL SELECT NULL, iso_week, count(*) FROM panel GROUP BY 2) QUALIFY row_number() OVER (PARTITION BY iso_year ORDER BY c DESC, iso_week) = 1) k ON t.iso_year IS NOT DISTINCT FROM k.iso_year"""), "single_share")
def profile(spark, sf):
    return op.profile_panel(panel(spark, sf))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "twice"]
_NUM = "SELECT l_quantity, l_extendedprice, l_discount, CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, l_quantity * 2 + l_discount AS twice FROM lineitem"
_PAIRS = [(a, b) for i, a in enumerate(_COLS) for b in _COLS[i:]]


def numbers(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select("l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("l_tax"), (F.col("l_quantity") * 2 + F.col("l_discount")).alias("twice"))


@R.add("a22_pearson", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM num" for a, b in _PAIRS).join([f"WITH num AS ({_NUM}) ", ""]), "r")
def pearson(spark, sf):
    return op.corr_matrix(numbers(spark, sf), _COLS)


def _ranked(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


# Ranks are taken anew for each pair, over the rows where both are known.
_SPEARMAN = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr(ra, rb) AS r FROM (SELECT {_ranked(a)} AS ra, {_ranked(b)} AS rb FROM num WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _PAIRS)


@R.add("a22_spearman", f"WITH num AS ({_NUM}) {_SPEARMAN}", "r")
def spearman(spark, sf):
    return op.corr_matrix(numbers(spark, sf), _COLS, "spearman")


_BLOCK = {"l_quantity": "size", "l_extendedprice": "size", "twice": "size", "l_discount": "rate", "l_tax": "rate"}


@R.add("a23_strongest_pairs", f"WITH num AS ({_NUM}), c AS ({' UNION ALL '.join(f'''SELECT '{a}' AS a, '{b}' AS b, '{_BLOCK[a]}' AS ba, '{_BLOCK[b]}' AS bb, abs(corr({a}, {b})) AS r FROM num''' for a, b in _PAIRS if a != b)}) SELECT 'within' AS scope, ba AS block, arg_max(a, r) AS a, arg_max(b, r) AS b, max(r) AS max_abs_r FROM c WHERE ba = bb GROUP BY ba UNION ALL SELECT 'between', 'ALL', arg_max(a, r), arg_max(b, r), max(r) FROM c WHERE ba <> bb", "max_abs_r")
def strongest(spark, sf):
    return op.strongest_pairs(op.corr_matrix(numbers(spark, sf), _COLS), _BLOCK)


@R.add("a24_decorrelated", "SELECT l_linenumber, avg(l_quantity) AS l_quantity, avg(l_discount) AS l_discount FROM lineitem GROUP BY 1", "l_quantity l_discount")
def decorrelated(spark, sf):
    kept = op.decorrelated(op.corr_matrix(numbers(spark, sf), _COLS), [c for c in _COLS if c != "l_tax"], 0.9)
    return table(spark, sf, "lineitem").groupBy("l_linenumber").agg(*(F.avg(c).alias(c) for c in kept if c in ("l_quantity", "l_discount")))


_KEPT = [c for c in _COLS if c != "l_tax"]


def _greedy(columns: list[str], strong: str) -> list[str]:
    """For each column, whether none before it that was taken itself is strongly correlated with it."""
    done: list[str] = []
    for i, c in enumerate(columns):
        done.append("(" + (" AND ".join(f"NOT ({done[j]} AND {strong.format(a=columns[j], b=c)})" for j in range(i)) or "true") + ")")
    return done


_CORR = f"WITH num AS ({_NUM}), c AS (SELECT {', '.join(f'abs(corr({a}, {b})) AS r_{a}_{b}' for a, b in _PAIRS if a != b)} FROM num)"
_STRONG, _GROUPED = "coalesce(r_{a}_{b} > 0.9, false)", "coalesce(r_{a}_{b} >= 0.9, false)"
_HEADS = _greedy(_COLS, _GROUPED)


def _head(i: int) -> str:
    taken = " ".join(f"WHEN {_HEADS[j]} AND {_GROUPED.format(a=_COLS[j], b=_COLS[i])} THEN '{_COLS[j]}'" for j in range(i))
    return f"CASE {taken} ELSE '{_COLS[i]}' END" if taken else f"'{_COLS[i]}'"


@R.add("a24_kept_columns", f"{_CORR} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {k} AS kept FROM c" for c, k in zip(_KEPT, _greedy(_KEPT, _STRONG))))
def kept_columns(spark, sf):
    kept = op.decorrelated(op.corr_matrix(numbers(spark, sf), _COLS), _KEPT, 0.9)
    return spark.createDataFrame([(c, c in kept) for c in _KEPT], "column_name string, kept boolean")


@R.add("a24_groups", f"{_CORR} " + " UNION ALL ".join(f"SELECT {_head(i)} AS head, '{c}' AS column_name FROM c" for i, c in enumerate(_COLS)))
def groups(spark, sf):
    found = op.correlated_groups(op.corr_matrix(numbers(spark, sf), _COLS), _COLS, 0.9)
    return spark.createDataFrame([(g[0], c) for g in found for c in g], "head string, column_name string")


@R.add("a25_importance", "WITH v AS (SELECT avg(abs(l_quantity - l_extendedprice / 1000)) AS s, avg(abs(l_discount - l_tax)) AS r FROM lineitem) SELECT 'size' AS block, 2::INT AS n_features, s AS mean_abs, 100 * s / (s + r) AS pct FROM v UNION ALL SELECT 'rate', 2, r, 100 * r / (s + r) FROM v", "mean_abs pct")
def importance(spark, sf):
    d = table(spark, sf, "lineitem").select("l_quantity", (-F.col("l_extendedprice") / 1000).alias("price"), "l_discount", (-F.col("l_tax")).alias("tax"))
    return op.importance(d, {"size": ["l_quantity", "price"], "rate": ["l_discount", "tax"]})


_POINTS = "SELECT cell_lat AS lat, cell_lon AS lon, sum(individualCount) AS value, avg(individualCount) AS alpha FROM clean GROUP BY 1, 2"


def points(spark, sf):
    return clean_records(spark, sf).groupBy(F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")).agg(F.sum("individualCount").alias("value"), F.avg("individualCount").alias("alpha"))


@R.add("a26_rasterise", sql("clean", "SELECT round((lon - (SELECT min(lon) FROM pt)) / 0.05::DOUBLE)::INT AS ix, round((lat - (SELECT min(lat) FROM pt)) / 0.05::DOUBLE)::INT AS iy, avg(value) AS value, avg(alpha) AS alpha FROM pt GROUP BY 1, 2", pt=_POINTS), "value alpha")
def raster(spark, sf):
    p = points(spark, sf)
    full = cells(spark, sf).select(F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"))
    return op.rasterise(p.join(full, ["lat", "lon"]), "value", "alpha")


@R.add("a27_fill_gaps")
def filled(spark, sf):
    p = points(spark, sf)
    g = op.rasterise(p, "value", "alpha").filter(~((F.col("ix") == 2) & (F.col("iy") == 3)))
    return op.fill_gaps(materialise(g, "raster"), 2)


@R.add("a28_row_bands", sql("clean", "SELECT lat, n_cells, n_null, pos_ - (SELECT arg_min(pos_, struct_pack(n := n_cells, l := lat)) FROM rows_) AS \"offset\" FROM rows_ WHERE abs(pos_ - (SELECT arg_min(pos_, struct_pack(n := n_cells, l := lat)) FROM rows_)) <= 2", rows_="SELECT lat, count(*) AS n_cells, count(*) FILTER (value > 1000) AS n_null, (row_number() OVER (ORDER BY lat))::INT AS pos_ FROM (SELECT cell_lat AS lat, cell_lon AS lon, sum(individualCount) AS value FROM clean GROUP BY 1, 2) GROUP BY 1"), "lat")
def bands(spark, sf):
    return op.row_bands(points(spark, sf).withColumn("value", F.when(F.col("value") <= 1000, F.col("value"))))


@R.add("a29_block_geography", sql("cells", "SELECT (cell_ord % 3)::INT AS spatial_block, count(*) AS n_cells, avg(cell_lat) AS lat, avg(cell_lon) AS lon, min(cell_lat) AS lat_min, max(cell_lat) AS lat_max, min(cell_lon) AS lon_min, max(cell_lon) AS lon_max, CASE WHEN avg(cell_lat) < 25.3::DOUBLE THEN 'Florida Keys / far south tip' WHEN avg(cell_lon) > -81.8::DOUBLE THEN 'South FL (Everglades / SE coast)' ELSE 'SW coast (Naples area)' END AS region FROM cells GROUP BY 1"), "lat lon lat_min lat_max lon_min lon_max")
def geography(spark, sf):
    return op.block_geography(cells(spark, sf).withColumn("spatial_block", (F.col("cell_ord") % 3).cast("int")))
