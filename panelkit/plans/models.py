"""Queries of the learned models: their rows can't be told by SQL, the tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, maxent, models as op, verification as v, windows
from ..operators.panels import importance
from ..sources import materialise
from ._tables import Registry, cell_daily, cells, panel, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
FEATURES = ["cell_lat", "cell_lon", "sin_doy", "cos_doy"]
KEYS = ["Grid_ID", "iso_year", "iso_week"]


boost, forest_model = op.boosted_classifier, op.forest_classifier


def model_table(spark, sf) -> DataFrame:
    """The panel with blocks and seasonality, written down once for the many fits."""
    from ..functions import season

    sin, cos = season(F.col("week_start"))
    d = panel(spark, sf).withColumn("sin_doy", sin).withColumn("cos_doy", cos)
    labels = v.lattice_blocks(cells(spark, sf), 3, 1)
    d = d.join(labels, "Grid_ID").withColumn("st_block", F.concat_ws("_", F.col("spatial_block").cast("string"), F.col("iso_year").cast("string")))
    return materialise(d, "model-table")


def grid(spark, sf) -> DataFrame:
    """All cells in all weeks of a year of 53 weeks."""
    from ..functions import iso_monday, season

    g = cells(spark, sf).withColumn("iso_week", F.explode(F.sequence(F.lit(1), F.lit(53))))
    sin, cos = season(iso_monday(F.lit(1998), F.col("iso_week")))
    return g.select("Grid_ID", "iso_week", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"), "cell_lat", "cell_lon", sin.alias("sin_doy"), cos.alias("cos_doy"))


@R.add("m1_abundance_regressor")
def regressor(spark, sf):
    d = model_table(spark, sf).filter("presence = 1")
    oof = op.regression_oof(d, FEATURES, op.boosted_regressor, "spatial_block", KEYS)
    return v.regression_logo(oof, "mean_log_count", "p", "fold")


@R.add("m1_abundance_by_year")
def regressor_by_year(spark, sf):
    d = model_table(spark, sf).filter("presence = 1")
    return v.regression_logo(op.regression_oof(d, FEATURES, op.boosted_regressor, "iso_year", KEYS), "mean_log_count", "p", "fold")


@R.add("m1_regularised_climate")
def regularised(spark, sf):
    """Climate alone, decorrelated, with stronger regularisation: r2 and rmse by block and by year."""
    d = model_table(spark, sf).filter("presence = 1").withColumn("monday", F.col("week_start"))
    d = materialise(d.join(state(spark, sf, d), ["Grid_ID", "monday"], "left"), "abundance-table")
    kept = op.climate_features(d, [*FEATURES, *STATE, "evi_level"])
    parts = [v.regression_logo(op.regression_oof(d, kept, op.regularised_regressor, fold, KEYS), "mean_log_count", "p", "fold").withColumn("by", F.lit(fold)).withColumn("features", F.lit(", ".join(kept))) for fold in ("spatial_block", "iso_year")]
    return parts[0].unionByName(parts[1])


@R.add("m2_v3_v7_boosted_oof_calibrated")
def boosted(spark, sf):
    return op.pooled_oof(model_table(spark, sf), FEATURES, boost, "spatial_block", KEYS, calibrate=True)


@R.add("m3_v3_forest_oof")
def forest(spark, sf):
    return v.score(op.pooled_oof(model_table(spark, sf), FEATURES, forest_model, "spatial_block", KEYS), "presence", "p", ["fold"])


@R.add("v5_forward_scores")
def forward(spark, sf):
    return op.forward_scores(op.forward_oof(model_table(spark, sf), FEATURES, forest_model, KEYS))


@R.add("v3_schemes")
def by_scheme(spark, sf):
    """The forest's pooled scores under each scheme."""
    from ..operators.sets import stack

    d = op.collapsed(model_table(spark, sf), FEATURES, list(v.SCHEMES.values()))
    return stack({s: v.score(op.pooled_oof(d, FEATURES, forest_model, c, [op.ROWS]), "presence", "p", weight=op.ROWS) for s, c in v.SCHEMES.items()}, "scheme")


#: Small trees, three blocks and two periods of years: five seeds, two models and two schemes are 90 fits.
SMALL = {"boosted": lambda: boost(maxIter=2, maxDepth=2), "forest": lambda: forest_model(numTrees=4, maxDepth=3)}
SEEDS = [42, 7, 123, 2024, 31]


@R.add("v16_a17_seed_sensitivity")
def seeds(spark, sf):
    """Spread of the scores when the blocks are built anew by five seeds: two models, two schemes, calibrated."""
    from ..operators.panels import seed_spread

    d = model_table(spark, sf).withColumn("period", (F.col("iso_year") > 1995).cast("int"))
    return seed_spread(op.seed_scores(d, FEATURES, SMALL, SEEDS, KEYS, k=3, period="period", bins=op.Bins(d, FEATURES)), ["roc_auc", "pr_lift", "bss"], ["model", "scheme"])


@R.add("v20_calibration_grid")
def diagnosis(spark, sf):
    schemes = {"spatial": "spatial_block", "spatiotemporal": "st_block"}
    d = op.collapsed(model_table(spark, sf), FEATURES, list(schemes.values()))
    return op.calibration_table(d, FEATURES, {"boosted": boost, "forest": forest_model}, schemes)


def backgrounds(spark, sf, d: DataFrame, n: int = 10_000) -> dict[str, DataFrame]:
    """Two variants of presences (1) and background (0): random keys of six years, and the cell-weeks where others were sampled."""
    from ..functions import iso_monday, season
    from ..operators.sets import sample_background

    present = d.filter("presence = 1")
    keys = sample_background(cells(spark, sf), list(range(1993, 1999)), list(range(1, 54)), present, n)
    sin, cos = season(iso_monday(F.col("iso_year"), F.col("iso_week")))
    drawn = keys.join(cells(spark, sf), "Grid_ID").withColumn("sin_doy", sin).withColumn("cos_doy", cos)
    drawn = drawn.join(v.lattice_blocks(cells(spark, sf), 3, 1), "Grid_ID").withColumn("st_block", F.concat_ws("_", F.col("spatial_block").cast("string"), F.col("iso_year").cast("string"))).withColumn("presence", F.lit(0))
    columns = [*KEYS, *FEATURES, "spatial_block", "st_block", "presence"]
    return {"random": present.select(*columns).unionByName(drawn.select(*columns)), "target_group": d.select(*columns)}


@R.add("m4_maxent")
def maxent_surface(spark, sf):
    from ..operators.sets import stack

    d, g = model_table(spark, sf), grid(spark, sf)
    fits = {k: maxent.MaxEnt(FEATURES).fit(x.filter("presence = 1"), x.filter("presence = 0")).predict(g).select("Grid_ID", "iso_week", "p") for k, x in backgrounds(spark, sf, d).items()}
    return stack(fits, "variant")


@R.add("m4_maxent_scores")
def maxent_scores(spark, sf):
    """Both variants out of fold, calibrated, under two schemes."""
    from ..operators.sets import stack

    d, parts = model_table(spark, sf), {}
    for variant, x in backgrounds(spark, sf, d).items():
        for scheme in ("spatial", "spatiotemporal"):
            oof = maxent.maxent_oof(x, FEATURES, v.SCHEMES[scheme], KEYS)
            parts[f"{variant}, {scheme}"] = v.score(oof, "presence", "p")
    return stack(parts, "variant")


@R.add("m5_training_set", sql("panel", "SELECT presence, count(*) AS n FROM (SELECT presence FROM panel WHERE presence = 1 UNION ALL SELECT 0::INT FROM cells) GROUP BY 1"))
def assembled(spark, sf):
    return op.training_set(panel(spark, sf), "presence_background", cells(spark, sf).select("Grid_ID", "cell_lat", "cell_lon")).groupBy("presence").agg(F.count("*").alias("n"))


@R.add("m6_m8_surface")
def surface(spark, sf):
    d = model_table(spark, sf)
    bins = op.Bins(d, FEATURES)
    models = {"boosted": op.fit_calibrated(d, FEATURES, boost, KEYS, bins=bins), "forest": op.fit_calibrated(d, FEATURES, forest_model, KEYS, bins=bins)}
    sampled = d.select("cell_lat", "cell_lon", "iso_week").distinct()
    return op.predict_surface(grid(spark, sf), models, sampled)


@R.add("m7_m9_hold_out_year")
def held(spark, sf):
    d = model_table(spark, sf)
    return op.predict_surface(grid(spark, sf), {"forest": op.fit_before(d, FEATURES, forest_model, 1998)})


#: Weeks of the predicted year, one for each season, and what is known of a cell as of their Mondays.
YEAR, WEEKS = 1998, (6, 20, 32, 43)
STATE = {f"{c}_{h}_{n}d": (c, h, n) for c, h, n in (("prcp", "sum", 7), ("prcp", "sum", 14), ("prcp", "sum", 28), ("tmean", "mean", 7), ("tmean", "mean", 14), ("tmean", "mean", 28), ("tmax", "max", 14), ("tmin", "mean", 14), ("tmin", "min", 14))}
FILLS = {"prcp": 3, "tmean": 3, "tmax": 3, "tmin": 3, "EVI": 16}
DYNAMIC = [*FEATURES, *STATE, "evi_level"]


def state(spark, sf, mondays: DataFrame) -> DataFrame:
    return windows.state_features(cell_daily(spark, sf), mondays, STATE, FILLS, {"evi_level": "EVI"})


def predicted_mondays(spark, year: int, weeks: tuple[int, ...]) -> DataFrame:
    from ..functions import iso_monday

    return spark.range(1).select(F.explode(F.array(*map(F.lit, weeks))).alias("iso_week")).withColumn("monday", iso_monday(F.lit(year), F.col("iso_week")))


_FILLED = ", ".join(f'last_value({c} IGNORE NULLS) OVER (PARTITION BY Grid_ID ORDER BY "Date" ROWS BETWEEN {n} PRECEDING AND CURRENT ROW) AS {c}' for c, n in FILLS.items())
_SHORT = {"sum": "sum", "mean": "avg", "min": "min", "max": "max"}
_STATE = ", ".join(f'{_SHORT[h]}({c}) FILTER ("Date" >= monday - {n}) AS {name}' for name, (c, h, n) in STATE.items())


@R.add("m9_features", sql("cell_daily", f"""SELECT * FROM (SELECT Grid_ID, monday, {_STATE}, max(EVI) FILTER ("Date" = monday - 1) AS evi_level FROM filled JOIN mondays ON "Date" BETWEEN monday - 28 AND monday - 1 GROUP BY 1, 2) WHERE coalesce({', '.join(STATE)}, evi_level) IS NOT NULL""",
    mondays=f"SELECT (date_trunc('week', DATE '{YEAR}-01-04') + INTERVAL 7 DAY * (w - 1))::DATE AS monday FROM (SELECT unnest({list(WEEKS)}) AS w)",
    filled=f"""SELECT Grid_ID, "Date", {_FILLED} FROM (SELECT g.Grid_ID, d.day AS "Date", prcp, tmean, tmax, tmin, EVI FROM cells g CROSS JOIN (SELECT unnest(generate_series(DATE '1997-12-01', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN cell_daily x ON x.Grid_ID = g.Grid_ID AND x."Date" = d.day)"""), " ".join(STATE) + " evi_level")
def predicted_features(spark, sf):
    """The features of the predicted year: the state of every cell as of four of its Mondays."""
    return state(spark, sf, predicted_mondays(spark, YEAR, WEEKS))


@R.add("m9_out_of_period_surface")
def out_of_period(spark, sf):
    """Models of the years before, with each row's state as of its Monday, on the cells' states in the predicted year."""
    from ..functions import season

    d = model_table(spark, sf).filter(F.col("iso_year") < YEAR).withColumn("monday", F.col("week_start"))
    train = materialise(d.join(state(spark, sf, d), ["Grid_ID", "monday"], "left"), "state-table")
    weeks = predicted_mondays(spark, YEAR, WEEKS)
    sin, cos = season(F.col("monday"))
    g = cells(spark, sf).join(F.broadcast(weeks)).join(state(spark, sf, weeks), ["Grid_ID", "monday"], "left").withColumn("sin_doy", sin).withColumn("cos_doy", cos)
    g = materialise(g.select("Grid_ID", "iso_week", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"), *DYNAMIC), "state-grid")
    models = {"boosted": op.fit_calibrated(train, DYNAMIC, boost, KEYS), "forest": op.fit_calibrated(train, DYNAMIC, forest_model, KEYS)}
    both = train.select(*DYNAMIC, "presence")
    models["maxent"] = maxent.MaxEnt(DYNAMIC, knots=4).fit(both.filter("presence = 1"), both.filter("presence = 0"))
    return op.predict_surface(g, models, train.select("cell_lat", "cell_lon", "iso_week").distinct())


BLOCKS = {"cell_lat": "place", "cell_lon": "place", "sin_doy": "season", "cos_doy": "season"}


def gains(spark, sf) -> DataFrame:
    f = op.fit(model_table(spark, sf), FEATURES, forest_model)
    return spark.createDataFrame(op.gain_importance(f, BLOCKS), "feature string, block string, gain double")


@R.add("m10_gain_importance")
def gain(spark, sf):
    return gains(spark, sf)


@R.add("m10_gain_by_block")
def gain_blocks(spark, sf):
    return op.gain_by_block(gains(spark, sf))


@R.add("m11_shapley")
def attributions(spark, sf):
    """Every row of the panel, against a sample of 50 of its rows."""
    d = model_table(spark, sf)
    f = op.fit(d, FEATURES, forest_model)
    return op.shapley(f, d.select(*KEYS, *FEATURES), op.background_sample(d, 50, KEYS), KEYS, 2)


@R.add("m11_tree_shapley")
def tree_attributions(spark, sf):
    """Every row of the panel, exactly, by the nodes of the boosted trees."""
    d = model_table(spark, sf)
    return attribution.tree_shapley(op.fit(d, FEATURES, boost), d.select(*KEYS, *FEATURES), KEYS)


@R.add("m11_tree_importance")
def tree_importance(spark, sf):
    """Mean sizes of the forest's attributions, summed by block within each row first."""
    d = model_table(spark, sf)
    values = attribution.tree_shapley(op.fit(d, FEATURES, forest_model), d.select(*KEYS, *FEATURES), KEYS)
    return importance(values, {b: [c for c in FEATURES if BLOCKS[c] == b] for b in ("place", "season")})
