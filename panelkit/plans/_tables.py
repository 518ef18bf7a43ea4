"""The driver's tables in the shapes that the operators work on, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning

#: Doubles are rounded to so many digits. NUDGE moves means that lie halfway between two of them off the
#: edge, since their last bits depend on the order in which an engine adds up.
DIGITS, NUDGE = 6, 3e-9
FOCAL = "focal"
CODES = (11, 21, 22, 23, 24, 31, 41, 42, 52, 71, 81, 82, 90, 95)


class Registry:
    """Queries of a module with their SQL. Doubles are rounded on both sides."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, doubles: str = ""):
        def put(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[name] = lambda spark, sf: rounded(f(spark, sf))
            if sql is not None:
                fixed = ", ".join(f"round({c} + {NUDGE}::DOUBLE, {DIGITS}) + 0 AS {c}" for c in doubles.split())
                self.oracles[name] = f"SELECT * {f'REPLACE ({fixed}) ' if fixed else ''}FROM ({sql})"
            return f

        return put


def rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(c) + NUDGE, DIGITS) + F.lit(0.0) for c in doubles}) if doubles else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as cells of a lattice: Grid_ID, cell_ord, cell_lat, cell_lon."""
    s = table(spark, sf, "supplier")
    lat, lon = 25000 + 50 * (F.col("s_suppkey") % 20), 81000 + 50 * F.floor(F.col("s_suppkey") / 20)
    part = lambda m: F.concat(F.floor(m / 1000).cast("string"), F.lit("."), F.lpad((m % 1000).cast("string"), 3, "0"))
    return s.select(F.concat(F.lit("Grid_"), part(lat), F.lit("_-"), part(lon)).alias("Grid_ID"), F.col("s_suppkey").alias("cell_ord"), (lat.cast("double") / 1000).alias("cell_lat"), (-lon.cast("double") / 1000).alias("cell_lon"))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as observations, with the cell that each was made in."""
    d = table(spark, sf, "lineitem").join(cells(spark, sf), F.col("l_suppkey") == F.col("cell_ord"))
    day = F.col("l_shipdate").cast("date")
    off = lambda c: ((F.col(c) % 41) - 20).cast("double") / 1000
    return d.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format(day, "yyyyMMdd")).alias("gbifID"),
        F.when(F.col("l_returnflag") == "R", FOCAL).otherwise(F.concat(F.lit("sp_"), "l_returnflag", "l_linestatus")).alias("species"),
        F.col("l_quantity").alias("individualCount"), (F.col("cell_lat") + off("l_orderkey")).alias("decimalLatitude"), (F.col("cell_lon") + off("l_partkey")).alias("decimalLongitude"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 100000).alias("coordinateUncertaintyInMeters"), day.alias("eventDate"), "Grid_ID", "cell_ord", "cell_lat", "cell_lon",
    )


def clean_records(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    return r.filter((F.col("individualCount") > 0) & cleaning.at_most("coordinateUncertaintyInMeters", 5000.0))


def in_turn(value: Column) -> Column:
    """The sum of a group's values in the order of ts and event_id, as one pass over the events adds them up: the last
    bits of a plain sum depend on where tasks are cut, and a day right at a limit would fall on either side of it."""
    rows = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct("ts", "event_id", value.alias("v")))))
    return F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["v"]))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Events as daily series: Grid_ID, Date, tmax, tmin, tmean, prcp, EVI, NDWI."""
    e = table(spark, sf, "events")
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return e.groupBy(F.concat(F.lit("cell_"), F.col("user_id").cast("string")).alias("Grid_ID"), F.col("ts").cast("date").alias("Date")).agg(F.max("value").alias("tmax"), F.min("value").alias("tmin"), F.avg("value").alias("tmean"), in_turn(F.col("value")).alias("prcp"), of("purchase").alias("EVI"), of("signup").alias("NDWI"))


def nation_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as series of several years: Grid_ID (nation), Date, value, qty."""
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return d.groupBy(F.concat(F.lit("n_"), F.col("s_nationkey").cast("string")).alias("Grid_ID"), F.col("l_shipdate").cast("date").alias("Date")).agg(F.avg("l_discount").alias("value"), F.sum("l_quantity").alias("qty"))


def cell_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as daily series of the cells, with gaps: Grid_ID, Date, prcp, tmean, tmax, tmin, EVI."""
    d = table(spark, sf, "lineitem").join(cells(spark, sf), F.col("l_suppkey") == F.col("cell_ord"))
    evi = F.avg(F.when(F.col("l_linenumber") == 1, F.col("l_tax")))
    return d.groupBy("Grid_ID", F.col("l_shipdate").cast("date").alias("Date")).agg(F.sum("l_quantity").alias("prcp"), F.avg("l_discount").alias("tmean"), F.max("l_discount").alias("tmax"), F.min("l_discount").alias("tmin"), evi.alias("EVI"))


def histograms(spark: SparkSession, sf: str) -> DataFrame:
    """Grid_ID, histogram: text like {11=26, 21=22}, from the quantities of a supplier's parts."""
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("p_size") % 14 + 1).cast("int"))
    sums = d.groupBy("l_suppkey", code.alias("code")).agg(F.sum("l_quantity").cast("long").alias("n"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda x: F.concat_ws("=", x["code"], x["n"])), ", "), F.lit("}"))
    h = sums.groupBy("l_suppkey").agg(text.alias("histogram"))
    return h.join(cells(spark, sf), F.col("l_suppkey") == F.col("cell_ord")).select("Grid_ID", "histogram")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as scored rows: y, p, p2, p3, by, grp."""
    d = table(spark, sf, "lineitem")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p3 = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return d.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"), (F.col("l_tax") * 10).alias("p2"), p3.alias("p3"), F.col("l_linestatus").alias("by"), F.col("l_suppkey").alias("grp"), F.year("l_shipdate").alias("yr"))


def panel(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.panels import labelled_panel

    return labelled_panel(clean_records(spark, sf), FOCAL)


CTE = {
    "cells": """SELECT 'Grid_' || (lat_m // 1000) || '.' || lpad((lat_m % 1000)::VARCHAR, 3, '0') || '_-' || (lon_m // 1000) || '.' || lpad((lon_m % 1000)::VARCHAR, 3, '0') AS Grid_ID,
      cell_ord, lat_m / 1000::DOUBLE AS cell_lat, -(lon_m / 1000::DOUBLE) AS cell_lon
      FROM (SELECT s_suppkey AS cell_ord, 25000 + 50 * (s_suppkey % 20) AS lat_m, 81000 + 50 * (s_suppkey // 20) AS lon_m FROM supplier)""",
    "records": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS gbifID,
      CASE WHEN l_returnflag = 'R' THEN 'focal' ELSE 'sp_' || l_returnflag || l_linestatus END AS species, l_quantity AS individualCount,
      cell_lat + ((l_orderkey % 41) - 20) / 1000::DOUBLE AS decimalLatitude, cell_lon + ((l_partkey % 41) - 20) / 1000::DOUBLE AS decimalLongitude,
      CASE WHEN l_linenumber <> 7 THEN l_tax * 100000 END AS coordinateUncertaintyInMeters, l_shipdate::DATE AS eventDate, Grid_ID, cell_ord, cell_lat, cell_lon
      FROM lineitem JOIN cells ON l_suppkey = cell_ord""",
    "clean": "SELECT * FROM records WHERE individualCount > 0 AND (coordinateUncertaintyInMeters IS NULL OR coordinateUncertaintyInMeters <= 5000)",
    "weekly": "SELECT *, isoyear(eventDate)::INT AS iso_year, week(eventDate)::INT AS iso_week FROM clean",
    "presence": """SELECT Grid_ID, iso_year, iso_week, min(date_trunc('week', eventDate))::DATE AS week_start, min(cell_lat) AS cell_lat, min(cell_lon) AS cell_lon, 1::INT AS presence, count(*) AS n_events,
      avg(ln(1 + individualCount)) AS mean_log_count, avg(individualCount) AS mean_count, sum(individualCount) AS total_count, max(individualCount) AS max_count, count(*) < 2 AS low_n_flag
      FROM weekly WHERE species = 'focal' GROUP BY 1, 2, 3""",
    "activity": """SELECT Grid_ID, iso_year, iso_week, sum(individualCount) FILTER (species <> 'focal') AS other_count, count(*) FILTER (species <> 'focal') AS n_other_events,
      count(DISTINCT species) FILTER (species <> 'focal') AS n_species, min(cell_lat) AS cell_lat, min(cell_lon) AS cell_lon, coalesce(sum(individualCount) FILTER (species = 'focal'), 0) AS focal_count, min(date_trunc('week', eventDate))::DATE AS week_start
      FROM weekly GROUP BY 1, 2, 3 HAVING count(*) FILTER (species <> 'focal') > 0""",
    "absent": "SELECT * FROM activity a WHERE focal_count = 0 AND other_count >= 3 AND NOT EXISTS (SELECT 1 FROM presence p WHERE p.Grid_ID = a.Grid_ID AND p.iso_year = a.iso_year AND p.iso_week = a.iso_week)",
    "panel": """SELECT *, NULL::DOUBLE AS other_count, NULL::BIGINT AS n_species FROM presence UNION ALL BY NAME
      SELECT Grid_ID, iso_year, iso_week, week_start, cell_lat, cell_lon, 0::INT AS presence, n_other_events AS n_events, 0::DOUBLE AS mean_log_count, 0::DOUBLE AS mean_count, 0::DOUBLE AS total_count, 0::DOUBLE AS max_count, n_other_events < 2 AS low_n_flag, other_count, n_species FROM absent""",
    "daily": """SELECT 'cell_' || user_id AS Grid_ID, ts::DATE AS "Date", max(value) AS tmax, min(value) AS tmin, avg(value) AS tmean, sum(value) AS prcp, avg(value) FILTER (event_type = 'purchase') AS EVI, avg(value) FILTER (event_type = 'signup') AS NDWI FROM events GROUP BY 1, 2""",
    "nation_daily": """SELECT 'n_' || s_nationkey AS Grid_ID, l_shipdate::DATE AS "Date", avg(l_discount) AS value, sum(l_quantity) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "cell_daily": """SELECT Grid_ID, l_shipdate::DATE AS "Date", sum(l_quantity) AS prcp, avg(l_discount) AS tmean, max(l_discount) AS tmax, min(l_discount) AS tmin, avg(l_tax) FILTER (l_linenumber = 1) AS EVI FROM lineitem JOIN cells ON l_suppkey = cell_ord GROUP BY 1, 2""",
    "histograms": f"""SELECT Grid_ID, '{{' || string_agg(code || '=' || n, ', ' ORDER BY code) || '}}' AS histogram FROM
      (SELECT l_suppkey, [{", ".join(map(str, CODES))}][(p_size % 14) + 1] AS code, sum(l_quantity)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) JOIN cells ON l_suppkey = cell_ord GROUP BY 1""",
    "scores": """SELECT (l_returnflag = 'R')::INT AS y, l_discount * 10 AS p, l_tax * 10 AS p2, ('0x' || substr(md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey), 1, 8))::BIGINT / 4294967296::DOUBLE AS p3,
      l_linestatus AS "by", l_suppkey AS grp, year(l_shipdate)::INT AS yr FROM lineitem""",
    "dense": """SELECT g.Grid_ID, d.day AS "Date", tmax, tmin, tmean, prcp, EVI, NDWI FROM (SELECT DISTINCT Grid_ID FROM daily) g CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-15', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN daily x ON x.Grid_ID = g.Grid_ID AND x."Date" = d.day""",
}
NEEDS = {"records": ["cells"], "cell_daily": ["cells"], "clean": ["records"], "weekly": ["clean"], "presence": ["weekly"], "activity": ["weekly"], "absent": ["activity", "presence"], "panel": ["absent"], "histograms": ["cells"], "dense": ["daily"]}


def sql(uses: str, body: str, **more: str) -> str:
    """WITH the named tables and what they need, the body; more: further tables, in order."""
    done: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in done:
            done.append(name)

    for name in uses.split():
        need(name)
    parts = [f"{n} AS ({CTE[n]})" for n in done] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
