"""Rows of the learned models' queries: what must hold whatever was learned."""

import math

import pytest
from pyspark.sql import functions as F

from panelkit.operators import models as op
from panelkit.operators import panels, verification as v
from panelkit.operators.models import materialise
from panelkit.plans import models as plans

KEYS = ["Grid_ID", "iso_year", "iso_week"]
NAMES = ["a", "b", "noise"]


@pytest.fixture(scope="module")
def table(spark):
    """Cells in three groups, four years; a and b tell presence, noise doesn't."""
    d = spark.range(1200).select((F.col("id") % 30).alias("c"), (2013 + F.floor(F.col("id") / 30) % 4).cast("int").alias("iso_year"), (1 + F.floor(F.col("id") / 120)).cast("int").alias("iso_week"), *(F.rand(i).alias(n) for i, n in enumerate(NAMES)), F.rand(9).alias("u"))
    d = d.select(F.concat(F.lit("Grid_"), F.col("c")).alias("Grid_ID"), "iso_year", "iso_week", (25 + F.col("c") % 3 + F.col("c") / 100).alias("cell_lat"), (-81 + F.col("c") / 50).alias("cell_lon"), *NAMES, (F.col("u") < 0.8 * F.col("a") * F.col("b") + 0.1).cast("int").alias("presence"), (F.col("c") % 4).cast("int").alias("n_events"))
    return materialise(v.build_blocks(d, "kmeans", 3).coalesce(1), "models-test")


forest = lambda: op.forest_classifier(numTrees=5, maxDepth=3)
boost = lambda: op.boosted_classifier(maxIter=2, maxDepth=2)  # noqa: E731  takes all rows and features, so that it is the same on any partitions


def test_blocks_of_the_best_start(spark, table):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    cells = [(r.Grid_ID, r.cell_lat, r.cell_lon, r.spatial_block) for r in table.select("Grid_ID", "cell_lat", "cell_lon", "spatial_block").distinct().collect()]
    assert len(cells) == 30 and {c[3] for c in cells} == {0, 1, 2}
    cost = 0.0
    for k in range(3):
        own = [c for c in cells if c[3] == k]
        cost += sum((c[i] - sum(x[i] for x in own) / len(own)) ** 2 for c in own for i in (1, 2))
    x = VectorAssembler(inputCols=["cell_lat", "cell_lon"], outputCol="_v").transform(table.select("Grid_ID", "cell_lat", "cell_lon").distinct())
    assert all(cost <= KMeans(k=3, seed=s, featuresCol="_v").fit(x).summary.trainingCost + 1e-9 for s in (1, 2, 3))
    assert {r.spatial_block: math.floor(r.cell_lat) for r in table.collect()} == {0: 25, 1: 26, 2: 27}  # numbered by place
    again = v.build_blocks(table.drop("spatial_block", "coarse_block", "st_block", "st_block3"), "kmeans", 3)
    assert sorted(again.select("Grid_ID", "spatial_block").distinct().collect()) == sorted((c[0], c[3]) for c in cells)


def test_forward_scheme_never_tests_the_first_year(table):
    rows = v.group_labels(table, v.SCHEMES | v.THREE_BLOCKS, forward="iso_year").groupBy("scheme", "fold").count().collect()
    n = {(r.scheme, r.fold): r["count"] for r in rows}
    assert {f for s, f in n if s == "forward"} == {None, "2014", "2015", "2016"} and n["forward", None] == n["temporal", "2013"]
    assert sum(k for (s, _), k in n.items() if s == "spatiotemporal_3blocks") == 1200


def test_seeds_against_single_runs(spark, table):
    s = materialise(op.seed_scores(table, NAMES, {"boosted": boost}, [42, 7], KEYS, ("temporal", "spatial"), k=3), "seed-test")
    rows = {(r.seed, r.scheme): r for r in s.collect()}
    assert len(rows) == 4 and all(r.block_cells_min <= r.block_cells_max and r.n == 1200 for r in rows.values())
    d = v.build_blocks(table.drop("spatial_block", "coarse_block", "st_block", "st_block3"), "kmeans", 3, 7)
    alone = v.score(op.pooled_oof(d, NAMES, boost, "spatial_block", KEYS, True), "presence", "p").first()
    assert rows[7, "spatial"].brier == pytest.approx(alone.brier)
    spread = {(r.scheme, r.metric): r for r in panels.seed_spread(s, ["roc_auc", "bss"], ["model", "scheme"]).collect()}
    assert len(spread) == 4
    for (scheme, metric), r in spread.items():
        values = [rows[seed, scheme][metric] for seed in (42, 7)]
        assert (r.at_base, r.least, r.greatest) == (values[0], min(values), max(values)) and r.spread == pytest.approx(max(values) - min(values))


def test_calibration_grid_rows(table):
    grid = {(r.scheme, r.calibrated): r for r in op.calibration_table(table, NAMES, {"boosted": boost}, {"spatial": "spatial_block", "temporal": "iso_year"}).collect()}
    assert grid.keys() == {(s, c) for s in ("spatial", "temporal") for c in (False, True)} and {r.n for r in grid.values()} == {1200.0}
    for (scheme, calibrated), r in grid.items():
        alone = v.score(op.pooled_oof(table, NAMES, boost, v.SCHEMES[scheme], KEYS, calibrated), "presence", "p").first()
        assert r.roc_auc == pytest.approx(alone.roc_auc) and r.roc_auc > 0.6
        assert not calibrated or r.brier < grid[scheme, False].brier + 0.02


def test_deployment_fit_maps_scores_upwards(table):
    fitted = op.fit_calibrated(table, NAMES, forest, KEYS)
    both = fitted.raw(table, "raw").select(*KEYS, "raw", *NAMES)
    rows = sorted((r.raw, r.p) for r in fitted.predict(both, "p").collect())
    assert all(x[1] <= y[1] + 1e-12 for x, y in zip(rows, rows[1:])) and 0 <= rows[0][1] < rows[-1][1] <= 1
    share = table.agg(F.avg("presence")).first()[0]
    assert sum(p for _, p in rows) / len(rows) == pytest.approx(share, abs=0.1)


def test_hold_out_year_never_sees_later_years(table):
    changed = table.withColumn("presence", F.when(F.col("iso_year") > 2015, 1 - F.col("presence")).otherwise(F.col("presence")))
    rows = lambda d: sorted((r.Grid_ID, r.iso_week, r.p) for r in op.fit_before(d, NAMES, forest, 2015).predict(table.filter("iso_year = 2016")).collect())
    assert rows(table) == rows(changed)
    own = table.withColumn("presence", F.when(F.col("iso_year") == 2015, 1 - F.col("presence")).otherwise(F.col("presence")))
    assert rows(table) != rows(own)


def test_surface_columns(spark, table):
    models = {"x": op.fit(table, NAMES, forest), "y": op.fit(table, NAMES, lambda: op.boosted_classifier(maxIter=2))}
    grid = table.filter("iso_year = 2013").select("Grid_ID", "iso_week", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon"), *NAMES)
    sampled = table.filter("spatial_block = 0").select("cell_lat", "cell_lon", "iso_week").distinct()
    rows = op.predict_surface(grid, models, sampled).collect()
    assert len(rows) == grid.count()
    places = [(r.cell_lat, r.cell_lon) for r in sampled.select("cell_lat", "cell_lon").distinct().collect()]
    cos = math.cos(math.radians(sum(r.lat for r in rows) / len(rows)))
    for r in rows:
        km = min(111 * math.hypot(r.lat - y, (r.lon - x) * cos) for y, x in places)
        assert r.agree_abs_diff == pytest.approx(abs(r.prob_x - r.prob_y)) and r.confidence_raw == pytest.approx(math.exp(-km / 120))
        assert r.opacity == pytest.approx(0.25 + 0.75 * r.confidence_raw)


def test_gains(spark, table):
    gains = op.gain_importance(op.fit(table, NAMES, lambda: op.forest_classifier(numTrees=20)), {"a": "signal", "b": "signal", "noise": "other"})
    assert sum(g for *_, g in gains) == pytest.approx(1) and {c for c, _, _ in gains[:2]} == {"a", "b"} and gains[-1][0] == "noise"
    rows = {r.block: r for r in op.gain_by_block(spark.createDataFrame(gains, "feature string, block string, gain double")).collect()}
    assert rows["signal"].n_features == 2 and rows["other"].gain == pytest.approx(gains[-1][2]) and sum(r.pct for r in rows.values()) == pytest.approx(100)


def test_out_of_period_surface_is_of_the_predicted_year(spark, sf):
    rows = plans.QUERIES["m9_out_of_period_surface"](spark, sf).collect()
    cells = plans.cells(spark, sf).count()
    assert len(rows) == cells * 4 == len({(r.Grid_ID, r.iso_week) for r in rows}) and {r.iso_week for r in rows} == set(plans.WEEKS)
    for r in rows:
        assert all(0 <= r[f"prob_{m}"] <= 1 for m in ("boosted", "forest", "maxent")) and 0.25 <= r.opacity <= 1
    # Weeks differ, so that it isn't a surface of places alone.
    assert len({round(r.prob_forest, 6) for r in rows if r.Grid_ID == rows[0].Grid_ID}) > 1


def test_climate_features_keep_no_twins(spark, table):
    d = table.withColumn("twin", F.col("a") * 2 + 0.001 * F.col("b")).withColumn("pct_forest", F.col("b")).withColumn("evi_level", F.col("b")).withColumn("flat", F.lit(3.0))
    assert op.climate_features(d, ["a", "twin", "pct_forest", "evi_level", "b", "flat"]) == ["a", "b", "flat"]


def binned(table):
    return op.Bins(table, NAMES, 4).put(table)


def test_bins_follow_quantiles_and_leave_nulls(spark):
    d = spark.createDataFrame([(i, float(i % 100), float(i % 3), None if i % 2 else float("nan")) for i in range(1000)], "id int, many double, few double, none double")
    rows = op.Bins(d, ["many", "few", "none"]).put(d).collect()
    assert all(r.none is None for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.many, set()).add(r.id % 100)
    # Of 32 bins none is empty, and the values of each are neighbours.
    assert len(bins) == 32 and all(max(x) - min(x) == len(x) - 1 <= 4 for x in bins.values())
    assert len({(r.few, r.id % 3) for r in rows}) == 3


def test_collapsed_rows_give_what_the_rows_give(table):
    d = binned(table)
    small = op.collapsed(table, NAMES, ["spatial_block"], op.Bins(table, NAMES, 4))
    assert small.count() < 400 and small.agg(F.sum(op.ROWS)).first()[0] == 1200
    for calibrate in (False, True):
        rows = {(r.spatial_block, r.a, r.b, r.noise): r.p for r in op.pooled_oof(d, NAMES, boost, "spatial_block", ["spatial_block", *NAMES], calibrate).collect()}
        got = op.pooled_oof(small, NAMES, boost, "spatial_block", ["spatial_block", *NAMES, op.ROWS], calibrate)
        found = {(r.spatial_block, r.a, r.b, r.noise): r.p for r in got.collect()}
        assert found.keys() == rows.keys() and all(p == pytest.approx(rows[k]) for k, p in found.items())
        one, other = v.score(got, "presence", "p", weight=op.ROWS).first(), v.score(op.pooled_oof(d, NAMES, boost, "spatial_block", KEYS, calibrate), "presence", "p").first()
        assert one.asDict() == pytest.approx(other.asDict())


def test_rows_that_are_fitted_do_not_grow_with_the_table(table):
    """Five of every row: as many rows are fitted, and they count five times."""
    many, seen = table.withColumn("_k", F.explode(F.array(*map(F.lit, range(5))))).drop("_k"), []

    class Counted:
        def fit(self, d):
            seen.append(d.count())
            return boost().fit(d)

    bins = op.Bins(table, NAMES, 4)
    scores = [op.seed_scores(x, NAMES, {"boosted": Counted}, [42], KEYS, ("spatial",), k=3, bins=bins).first() for x in (table, many)]
    assert sorted(seen[: len(seen) // 2]) == sorted(seen[len(seen) // 2 :]) and scores[1].n == 5 * scores[0].n == 6000
    assert scores[1].brier == pytest.approx(scores[0].brier) and scores[1].block_cells_max == scores[0].block_cells_max
    grid = op.calibration_table(op.collapsed(many, NAMES, ["spatial_block"], bins), NAMES, {"boosted": boost}, {"spatial": "spatial_block"}).collect()
    assert [(r.calibrated, r.n) for r in sorted(grid, key=lambda r: r.calibrated)] == [(False, 6000.0), (True, 6000.0)]


def test_deployment_fit_on_bins(table):
    """The model takes values, not bins, and puts them into the bins that it was fitted on."""
    bins = op.Bins(table, NAMES, 4)
    fitted, plain = op.fit_calibrated(table, NAMES, boost, KEYS, bins=bins), op.fit_calibrated(binned(table), NAMES, boost, KEYS)
    got = {(r.Grid_ID, r.iso_year, r.iso_week): r for r in fitted.predict(table.select(*KEYS, *NAMES)).collect()}
    want = {(r.Grid_ID, r.iso_year, r.iso_week): r.p for r in plain.predict(binned(table)).collect()}
    assert got.keys() == want.keys() and all(r.p == pytest.approx(want[k]) for k, r in got.items())
    assert {r.a for r in got.values()} == {r.a for r in table.collect()}
