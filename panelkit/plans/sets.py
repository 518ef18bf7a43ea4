"""Queries of ordering, unions, set operations and hash samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import panels, sets as op
from ._tables import FOCAL, Registry, cells, clean_records, daily, panel, scores, sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
_H = lambda seed, *cs: f"('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(cs)}), 1, 8))::BIGINT"


@R.add("s1_in_order", "SELECT s_suppkey, s_name FROM supplier")
def ordered(spark, sf):
    return op.in_order(table(spark, sf, "supplier").select("s_suppkey", "s_name"), ["s_suppkey"])


@R.add("s2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "o_totalprice")
def top(spark, sf):
    return op.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@R.add("s3_disjoint_union", sql("panel", "SELECT count(*) AS n_shared FROM (SELECT Grid_ID, iso_year, iso_week FROM panel WHERE presence = 1 INTERSECT SELECT Grid_ID, iso_year, iso_week FROM panel WHERE presence = 0)"))
def disjoint(spark, sf):
    p = panel(spark, sf)
    return op.shared_keys(p.filter("presence = 1"), p.filter("presence = 0"), ["Grid_ID", "iso_year", "iso_week"]).agg(F.count("*").alias("n_shared"))


@R.add("s3_union_labelled", sql("panel", "SELECT presence, count(*) AS n FROM panel GROUP BY 1"))
def united(spark, sf):
    r = clean_records(spark, sf)
    presence = panels.presence_panel(r, FOCAL)
    absence = panels.as_absence_rows(panels.infer_absences(panels.cellweek_activity(r, FOCAL), presence))
    return op.union_labelled(presence, absence).groupBy("presence").agg(F.count("*").alias("n"))


@R.add("s4_stack", "SELECT 'customer' AS side, c_nationkey AS nation, avg(c_acctbal) AS bal, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, avg(s_acctbal), count(*) FROM supplier GROUP BY 2", "bal")
def stacked(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return op.stack({"customer": c, "supplier": s}, "side").groupBy("side", "nation").agg(F.avg("bal").alias("bal"), F.count("*").alias("n"))


@R.add("s5_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def only(spark, sf):
    return op.keys_only_in(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_PART = "SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS a FROM orders"


@R.add("s6_stratified_sample", f"SELECT o_orderkey, o_orderstatus FROM ({_PART}) QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H(42, 'o_orderkey')}, o_orderkey) <= greatest(1, round(200 * n::DOUBLE / a))")
def stratified(spark, sf):
    return op.stratified_sample(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), 200, "o_orderstatus", ["o_orderkey"])


_SLOTS = 7 * 53
_PERM = f"""SELECT i, (a0 + {_H(42, '1', 'b1')}) % n AS a1, b1, n FROM (SELECT i, i // {_SLOTS} AS a0, (i % {_SLOTS} + {_H(42, '0', f'i // {_SLOTS}')}) % {_SLOTS} AS b1, n FROM (SELECT unnest(range((SELECT count(*) FROM cells) * {_SLOTS})) AS i, (SELECT count(*) FROM cells) AS n))"""
_PERM = f"""SELECT i, (a1 + {_H(42, '3', 'b2')}) % n AS cell, b2 AS slot FROM (SELECT *, (b1 + {_H(42, '2', 'a1')}) % {_SLOTS} AS b2 FROM ({_PERM}))"""


@R.add("s7_sample_background", sql("panel", "SELECT Grid_ID, iso_year, iso_week FROM (SELECT i, Grid_ID, (1995 + slot // 53)::INT AS iso_year, (1 + slot % 53)::INT AS iso_week FROM perm JOIN (SELECT Grid_ID, row_number() OVER (ORDER BY Grid_ID) - 1 AS cell FROM cells) USING (cell)) k WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.presence = 1 AND p.Grid_ID = k.Grid_ID AND p.iso_year = k.iso_year AND p.iso_week = k.iso_week) ORDER BY i LIMIT 300", perm=_PERM))
def background(spark, sf):
    return op.sample_background(cells(spark, sf), list(range(1995, 2002)), list(range(1, 54)), panel(spark, sf).filter("presence = 1"), 300)


@R.add("s8_group_shuffle_split", sql("scores", f"SELECT s.grp, CASE WHEN r <= ceil(0.25 * n) THEN 'calibration' ELSE 'train' END AS part, count(*) AS n_rows FROM scores s JOIN (SELECT grp, row_number() OVER (ORDER BY {_H(42, 'grp')}, grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM scores)) g ON s.grp = g.grp GROUP BY 1, 2"))
def split(spark, sf):
    return op.group_shuffle_split(scores(spark, sf), "grp").groupBy("grp", "part").agg(F.count("*").alias("n_rows"))


@R.add("s9_group_kfold", sql("scores", "SELECT grp, (CASE WHEN (pos_ // 4) % 2 = 0 THEN pos_ % 4 ELSE 3 - pos_ % 4 END)::INT AS fold, n FROM (SELECT grp, n, row_number() OVER (ORDER BY n DESC, grp) - 1 AS pos_ FROM (SELECT grp, count(*) AS n FROM scores GROUP BY 1))"))
def kfold(spark, sf):
    return op.group_kfold(scores(spark, sf), "grp", 4).groupBy("grp", "fold").agg(F.count("*").alias("n"))


@R.add("s10_prefer_complete", sql("daily", f'SELECT Grid_ID, "Date" FROM daily ORDER BY (EVI IS NOT NULL AND NDWI IS NOT NULL) DESC, {_H(42, "Grid_ID", chr(34) + "Date" + chr(34) + "::VARCHAR")}, Grid_ID, "Date" LIMIT 40'))
def complete(spark, sf):
    return op.prefer_complete(daily(spark, sf), ["EVI", "NDWI"], 40, ["Grid_ID", "Date"]).select("Grid_ID", "Date")
