"""Queries of the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as op
from ._tables import Registry, cells, daily, panel, records, scores, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_ONE = lambda name, level, metric: f"SELECT '{name}' AS \"check\", {level} AS level, ({metric})::DOUBLE AS metric"
_LEVEL = lambda m, fail=None, warn=None: "CASE " + (f"WHEN {m} {fail} THEN 'FAIL' " if fail else "") + (f"WHEN {m} {warn} THEN 'WARN' " if warn else "") + "ELSE 'PASS' END"


@R.add("q1_keys_unique", sql("daily", _ONE("keys_unique", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) AS m FROM (SELECT Grid_ID FROM daily GROUP BY Grid_ID HAVING count(*) > 1))"), "metric")
def unique(spark, sf):
    return op.keys_unique(daily(spark, sf), ["Grid_ID"])


@R.add("q2_cell_count", sql("cells", _ONE("cell_count", _LEVEL("m", None, "NOT BETWEEN 95 AND 105"), "m") + " FROM (SELECT count(DISTINCT Grid_ID) AS m FROM cells)"), "metric")
def count(spark, sf):
    return op.cell_count(cells(spark, sf), 100)


@R.add("q3_null_shares", sql("daily", " UNION ALL ".join(_ONE(f"null_share:{c}", _LEVEL("m", ">= 0.999", ">= 0.5"), "m") + f" FROM (SELECT avg(({c} IS NULL)::INT) AS m FROM daily)" for c in ("EVI", "NDWI", "tmean"))), "metric")
def nulls(spark, sf):
    return op.null_shares(daily(spark, sf), ["EVI", "NDWI", "tmean"])


@R.add("q4_sentinels", sql("daily", " UNION ALL ".join(_ONE(f"sentinel:{c}", _LEVEL("m", "> 0"), "m") + f" FROM (SELECT count(*) FILTER ({c} IN (-3000, -9999, -32768)) AS m FROM daily)" for c in ("EVI", "tmean"))), "metric")
def sentinels(spark, sf):
    return op.surviving_sentinels(daily(spark, sf), ["EVI", "tmean"])


@R.add("q5_ranges", sql("daily", _ONE("range:prcp", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) FILTER (prcp < 0) AS m FROM daily) UNION ALL " + _ONE("range:tmean", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) FILTER (tmean < 5 OR tmean > 60) AS m FROM daily)"), "metric")
def ranges(spark, sf):
    return op.value_ranges(daily(spark, sf), {"prcp": (0, None), "tmean": (5, 60)})


@R.add("q6_date_span", sql("daily", _ONE("date_span", "CASE WHEN a < DATE '2024-01-05' OR b > DATE '2024-12-31' THEN 'WARN' ELSE 'PASS' END", "b - a") + ' FROM (SELECT min("Date") AS a, max("Date") AS b FROM daily)'), "metric")
def span(spark, sf):
    return op.date_span(daily(spark, sf), "2024-01-05", "2024-12-31")


@R.add("q7_static_constant", sql("records", _ONE("static:cell_lat", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) AS m FROM (SELECT Grid_ID FROM records GROUP BY 1 HAVING min(cell_lat) <> max(cell_lat))) UNION ALL " + _ONE("static:individualCount", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) AS m FROM (SELECT Grid_ID FROM records GROUP BY 1 HAVING min(individualCount) <> max(individualCount)))"), "metric")
def static(spark, sf):
    return op.static_constant(records(spark, sf), ["cell_lat", "individualCount"])


@R.add("q8_usable_cells", sql("daily", _ONE("too_wet", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) FILTER (prcp > 300) AS m FROM daily) UNION ALL " + _ONE("no_landcover", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) FILTER (EVI IS NULL AND NDWI IS NULL) AS m FROM daily) UNION ALL " + _ONE("vegetation:EVI", _LEVEL("m", ">= 0.05"), "m") + " FROM (SELECT avg((EVI IS NULL)::INT) AS m FROM daily)"), "metric")
def usable(spark, sf):
    return op.usable_cells(daily(spark, sf), "prcp", 300, ["EVI", "NDWI"], ["EVI"])


@R.add("f7_cell_id_check", sql("cells", _ONE("cell_ids", "'PASS'", "0") + " FROM (SELECT count(*) FROM cells)"), "metric")
def ids(spark, sf):
    return op.cell_ids(cells(spark, sf))


@R.add("q9_panel_integrity", sql("panel", _ONE("disjoint_classes", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) AS m FROM (SELECT 1 FROM panel GROUP BY Grid_ID, iso_year, iso_week HAVING count(DISTINCT presence) > 1)) UNION ALL " + _ONE("unique_cell_weeks", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) AS m FROM (SELECT 1 FROM panel GROUP BY Grid_ID, iso_year, iso_week HAVING count(*) > 1)) UNION ALL " + _ONE("cells_in_one_block", _LEVEL("m", "> 0"), "m") + " FROM (SELECT count(*) AS m FROM (SELECT Grid_ID FROM panel GROUP BY 1 HAVING count(DISTINCT iso_year) > 1))"), "metric")
def integrity(spark, sf):
    return op.panel_integrity(panel(spark, sf), "iso_year")


@R.add("q11_same_rows", sql("scores", _ONE("same_rows", "CASE WHEN a <> b THEN 'FAIL' ELSE 'PASS' END", "b - a") + ' FROM (SELECT min(n) AS a, max(n) AS b FROM (SELECT "by", count(*) AS n FROM scores GROUP BY 1))'), "metric")
def same(spark, sf):
    return op.same_rows(scores(spark, sf), ["by"])
