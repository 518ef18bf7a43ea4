"""Small hand-made frames with their expected rows: nulls, ties, gaps, year boundaries, empty input."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit import functions as fn
from panelkit import sources as io
from panelkit.operators import checks, cleaning, joins, landcover, models, ordering, panels, sets, verification, windows

DAY = dt.date


def test_iso_weeks_at_year_boundaries(spark):
    days = [DAY(2015, 12, 31), DAY(2016, 1, 1), DAY(2018, 12, 31), DAY(2020, 12, 28), DAY(2021, 1, 3)]
    d = spark.createDataFrame([(x,) for x in days], "d date")
    y, w = fn.iso_year(F.col("d")), fn.iso_week(F.col("d"))
    for r in d.select("d", y.alias("y"), w.alias("w"), fn.iso_monday(y, w).alias("m")).collect():
        assert (r.y, r.w) == r.d.isocalendar()[:2]
        assert r.m == r.d - dt.timedelta(days=r.d.weekday())


def test_histograms(spark):
    rows = [None, "{}", "{11=0}", "{21=22.9, 11=26383.7}", "{11.0=1e2}", "{21=1, 21=5}", "{99=3}", "junk", "{21=..}"]
    d = spark.createDataFrame([(str(i), x) for i, x in enumerate(rows)], "Grid_ID string, histogram string")
    got = [r.m for r in d.select("Grid_ID", fn.parse_histogram(F.col("histogram")).alias("m")).orderBy("Grid_ID").collect()]
    assert got == [{}, {}, {11: 0.0}, {21: 22.9, 11: 26383.7}, {11: 100.0}, {21: 5.0}, {99: 3.0}, {}, {}]
    r = {x.Grid_ID: x for x in landcover.engineer_landcover(d, {11: "water11"}, unknown=(99,)).collect()}
    assert r["2"].pct_water11 is None and r["6"].pct_class_99 == 1.0 and r["5"].pct_urban == 1.0
    assert landcover.unknown_codes(d, {11: "w", 21: "u"}) == [99]


def test_cleaning_of_dirty_occurrences(spark):
    s = "gbifID string, species string, individualCount string, decimalLatitude string, decimalLongitude string, coordinateUncertaintyInMeters double, eventDate string"
    good = ("1", " a ", "3", "25.5", "-81", 10.0, "2015-01-01")
    rows = [good, ("2", None, *good[2:]), ("3", "a", "x", *good[3:]), ("4", "a", "0", *good[3:]), ("5", "a", "1", "99", "-81", 1.0, "2015-01-01"), ("6", *good[1:5], None, good[6]), ("7", *good[1:5], 5000.0, good[6]), ("8", *good[1:5], 5000.1, good[6]), ("9", *good[1:6], "no date"), ("10", *good[1:6], "1999-01-01")]
    got = cleaning.clean_occurrences(spark.createDataFrame(rows, s), (24, 31, -88, -80), (2013, 2018)).collect()
    assert sorted(r.gbifID for r in got) == ["1", "6", "7"] and {r.species for r in got} == {"a"}


def gappy(spark):
    rows = []
    for c, skip in (("a", {3, 10, 11, 12, 20, 21, 22, 23}), ("b", set(range(1, 18)))):
        rows += [(c, DAY(2024, 1, 1) + dt.timedelta(days=i - 1), float(i), float(i), float(i), 1.0, float(i) if i % 16 == 1 else None, None) for i in range(1, 41) if i not in skip]
    return spark.createDataFrame(rows, "Grid_ID string, Date date, tmax double, tmin double, tmean double, prcp double, EVI double, NDWI double")


def test_windows_against_a_plain_loop(spark):
    d = gappy(spark)
    f = {(r.Grid_ID, r.Date): r for r in windows.build_dynamic_features(d, "2024-01-01", "2024-02-09", ecological=True).collect()}
    raw = {(r.Grid_ID, r.Date): r for r in d.collect()}
    assert len(f) == 80
    for (c, day), r in f.items():
        def filled(k, c=c, day=day):
            for back in range(4):
                x = raw.get((c, day - dt.timedelta(days=k + back)))
                if x is not None:
                    return x
            return None
        for n in (7, 14, 28):
            past = [x for x in (filled(k) if day - dt.timedelta(days=k) >= DAY(2024, 1, 1) else None for k in range(1, n + 1)) if x is not None]
            want = sum(x.prcp for x in past) if len(past) >= n - 2 else None
            assert r[f"prcp_sum_{n}d"] == (pytest.approx(want) if want is not None else None)
        evi = next((raw[c, day - dt.timedelta(days=k)].EVI for k in range(1, 18) if (c, day - dt.timedelta(days=k)) in raw and raw[c, day - dt.timedelta(days=k)].EVI is not None), None)
        assert r.evi_level == evi
    assert windows.build_dynamic_features(d.limit(0), "2024-01-01", "2024-01-03").count() == 0


def test_snap_ties_far_records_and_single_cell(spark):
    cells = spark.createDataFrame([("A", 1, 25.0, -81.0), ("B", 2, 25.05, -81.0)], "Grid_ID string, cell_ord int, cell_lat double, cell_lon double")
    rec = spark.createDataFrame([(1, 25.025, -81.0), (2, 25.5, -81.0), (3, 25.049, -81.01), (4, None, -81.0)], "id int, decimalLatitude double, decimalLongitude double")
    got = {r.id: (r.Grid_ID, r.snap_km) for r in joins.snap_to_cells(rec, cells).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["A", "B", "B", None]
    assert got[2][1] == pytest.approx(0.45 * 111) and got[4][1] is None
    assert {r.Grid_ID for r in joins.snap_to_cells(rec.filter("id < 4"), cells.limit(1), key=["id"]).collect()} == {"A"}


def test_absences(spark):
    row = lambda cell, sp, n: (sp, float(n), DAY(2016, 1, 1), cell, 25.0, -81.0)
    rows = [row("focal only", "f", 2), row("both", "f", 1), row("both", "x", 9), row("guard", "x", 2), row("guard", "y", 1), row("below", "x", 2)]
    d = spark.createDataFrame(rows, "species string, individualCount double, eventDate date, Grid_ID string, cell_lat double, cell_lon double")
    got = {(r.Grid_ID, r.presence, r.n_species) for r in panels.labelled_panel(d, "f").collect()}
    assert got == {("focal only", 1, None), ("both", 1, None), ("guard", 0, 2)}
    assert panels.labelled_panel(d.limit(0), "f").count() == 0


def test_week_neighbours_wrap(spark):
    d = spark.range(1).select(fn.week_neighbours(F.lit(1), 2).alias("a"), fn.week_neighbours(F.lit(53), 1).alias("b")).first()
    assert sorted(d.a) == [1, 2, 3, 52, 53] and sorted(d.b) == [1, 52, 53]


def test_scores_of_edge_cases(spark):
    s = lambda rows: verification.score(spark.createDataFrame(rows, "y int, p double")).collect()
    tied = s([(1, 0.5), (0, 0.5), (1, 0.5), (0, None)])[0]
    assert tied.n == 3 and tied.roc_auc == 0.5 and tied.pr_auc == pytest.approx(2 / 3)
    assert s([(1, 0.9), (0, 0.1)])[0].roc_auc == 1.0 and s([(0, 0.9), (1, 0.1)])[0].roc_auc == 0.0
    one = s([(1, 0.7), (1, 0.2)])[0]
    assert one.roc_auc is None and one.bss is None and one.brier == pytest.approx((0.09 + 0.64) / 2)
    assert s([(1, None)]) == []


def test_weights_stand_for_repeated_rows(spark):
    rows = [(1, 0.8, 2), (0, 0.3, 1), (0, 0.8, 3), (1, 0.1, 1)]
    d = spark.createDataFrame(rows, "y int, p double, w int")
    again = spark.createDataFrame([(y, p) for y, p, w in rows for _ in range(w)], "y int, p double")
    a, b = verification.score(d, weight="w").first(), verification.score(again).first()
    assert all(getattr(a, c) == pytest.approx(getattr(b, c)) for c in ("n", "roc_auc", "pr_auc", "brier", "bss"))


def test_previous_labels_and_duplicates(spark):
    w = lambda n: DAY(2015, 12, 21) + dt.timedelta(days=7 * n)
    rows = [("a", w(i), *w(i).isocalendar()[:2], i % 2, i) for i in (0, 1, 2, 4)] + [("a", w(1), *w(1).isocalendar()[:2], 0, 9)]
    d = spark.createDataFrame(rows, "Grid_ID string, week_start date, iso_year int, iso_week int, presence int, ord int")
    got = {r.ord: r.previous for r in joins.previous_label(d, order="ord").collect()}
    assert got == {0: None, 1: 0, 2: 1, 4: None, 9: 0}


def test_gap_fill_closes_holes_and_not_the_outside(spark):
    cells = [(x, y, float(x * 10 + y)) for x in range(5) for y in range(5) if (x, y) not in ((2, 2), (4, 2))]
    got = {(r.ix, r.iy): r for r in panels.fill_gaps(spark.createDataFrame(cells, "ix int, iy int, value double")).collect()}
    assert got[2, 2].filled and got[2, 2].value == 12.0
    assert all(0 <= x <= 4 and 0 <= y <= 4 for x, y in got) and not got[0, 0].filled


def test_checks_on_clean_and_bad_frames(spark):
    d = spark.createDataFrame([("Grid_25.000_-81.000", DAY(2015, 1, 1), 1.0), ("bad", DAY(2019, 1, 1), -9999.0)], "Grid_ID string, Date date, EVI double")
    level = lambda df: {r.check: r.level for r in df.collect()}
    assert level(checks.keys_unique(d, ["Grid_ID", "Date"])) == {"keys_unique": "PASS"}
    assert level(checks.keys_unique(d.union(d), ["Grid_ID", "Date"])) == {"keys_unique": "FAIL"}
    assert level(checks.keys_unique(d, ["nope"])) == {"keys_unique": "FAIL"}
    assert level(checks.cell_ids(d)) == {"cell_ids": "FAIL"}
    assert level(checks.surviving_sentinels(d, ["EVI"])) == {"sentinel:EVI": "FAIL"}
    assert level(checks.date_span(d, "2013-01-01", "2018-12-31")) == {"date_span": "WARN"}
    assert level(checks.value_ranges(d, {"EVI": (-1, 1)})) == {"range:EVI": "FAIL"}
    assert level(checks.cell_count(d, 2)) == {"cell_count": "PASS"}


def test_upsert_and_reports(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = {r.k: (r.v, r.w) for r in io.upsert_latest(old, spark.createDataFrame([(2, "c", 5)], "k int, v string, w int"), ["k"]).collect()}
    assert got == {1: ("a", None), 2: ("c", 5)}
    d = spark.createDataFrame([("2017-05-01",), ("2016",), ("junk",), (None,)], "report_year_text string")
    assert [r.report_year for r in io.filter_report_years(d, [2016, 2017]).orderBy("report_year").collect()] == [2016, 2017]


def test_samples_are_exact_and_repeatable(spark):
    d = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a = sets.stratified_sample(d, 100, "y", ["id"])
    assert {r.y: r["count"] for r in a.groupBy("y").count().collect()} == {0: 90, 1: 10}
    assert sorted(a.collect()) == sorted(sets.stratified_sample(d.repartition(5), 100, "y", ["id"]).collect())


def test_models_see_no_row_of_their_fold(spark):
    rows = [(f"c{i % 5}", 2015 + i % 3, i, i % 2, 2, float(i % 2) + (i % 7) / 10, i % 3) for i in range(240)]
    d = spark.createDataFrame(rows, "Grid_ID string, iso_year int, iso_week int, presence int, n_events int, x double, spatial_block int")
    make = lambda: models.forest_classifier(numTrees=5, maxDepth=3)
    oof = models.pooled_oof(d, ["x"], make, "spatial_block", ["iso_week"], calibrate=True)
    got = oof.collect()
    assert len(got) == 240 and len({r.iso_week for r in got}) == 240
    assert verification.score(oof, "presence", "p").first().roc_auc > 0.95
    fitted = models.fit(d, ["x"], make)
    middle = d.limit(1).withColumn("x", F.lit(panels.fit_medians(d, ["x"])["x"]))
    values = models.shapley(fitted, d.limit(4), middle, ["iso_week"], 2).collect()
    base = fitted.raw(middle).first().p
    full = {r.iso_week: r.p for r in fitted.raw(d.limit(4)).collect()}
    assert all(v.value == pytest.approx(full[v.iso_week] - base) for v in values)


def test_folds_that_are_null_or_of_one_class(spark):
    rows = [(i, "ab"[i % 2] if i < 40 else None, i % 2 if 10 <= i else 0, 2, float(i % 2), 2015 + i // 20) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, fold string, presence int, n_events int, x double, iso_year int")
    make = lambda: models.forest_classifier(numTrees=3, maxDepth=2)
    got = models.pooled_oof(d, ["x"], make, "fold", ["id"], calibrate=True).collect()
    assert sorted(r.id for r in got) == list(range(60)) and all(r.p is not None for r in got) and {r.fold for r in got} == {"a", "b", None}
    one = models.pooled_oof(d.filter("fold = 'a'"), ["x"], make, "fold", ["id"]).collect()
    assert len(one) == 20 and all(r.p is None for r in one)
    flat = models.pooled_oof(d.withColumn("presence", F.lit(1)), ["x"], make, "fold", ["id"]).collect()
    assert {r.p for r in flat} == {1.0} and len(flat) == 60
    none = models.pooled_oof(d.limit(0), ["x"], make, "fold", ["id"])
    assert none.columns == ["id", "presence", "fold", "p"] and none.count() == 0
    ahead = models.forward_oof(d, ["x"], make, ["id"]).collect()
    assert sorted(r.id for r in ahead) == list(range(20, 60)) and models.forward_oof(d.limit(0), ["x"], make, ["id"]).count() == 0


def test_abundance_is_scored_out_of_fold(spark):
    rows = [(i, i % 3, 2, float(i % 5), float(i % 5) + 10 * (i % 3)) for i in range(90)]
    d = spark.createDataFrame(rows, "id int, fold int, n_events int, x double, mean_log_count double").withColumn("presence", F.lit(1))
    got = models.regression_oof(d, ["x"], lambda: models.boosted_regressor(maxIter=3, maxDepth=3), "fold", ["id"]).collect()
    assert sorted(r.id for r in got) == list(range(90))
    # A fold is ten above or below the others: only a model that hasn't seen it misses by so much.
    assert all(abs(r.p - r.mean_log_count) > 3 for r in got if r.fold in ("0", "2"))


def test_lattice_of_one_row_and_target_group(spark):
    cells = spark.createDataFrame([(f"c{i}", 25.0 + i % 4, -81.0 - i) for i in range(12)], "Grid_ID string, cell_lat double, cell_lon double")
    assert {r.spatial_block: r["count"] for r in verification.lattice_blocks(cells, 1, 3).groupBy("spatial_block").count().collect()} == {0: 4, 1: 4, 2: 4}
    assert {r.spatial_block for r in verification.lattice_blocks(cells, 1, 1).collect()} == {0}
    g = spark.createDataFrame([("x", "a", 3.0), ("y", "a", 1.0), ("z", None, 0.0)], "feature string, block string, gain double")
    assert {r.block: (r.n_features, r.pct) for r in models.gain_by_block(g).collect()} == {"a": (2, 100.0), None: (1, 0.0)}


def test_shapley_values_sum_to_the_difference_from_the_background(spark):
    rows = [(i, i % 2, 2, float(i % 2) + i / 50, float(i % 3)) for i in range(60)]
    d = spark.createDataFrame(rows, "id int, presence int, n_events int, x double, z double")
    fitted = models.fit(d, ["x", "z"], lambda: models.forest_classifier(numTrees=4, maxDepth=3))
    back = models.background_sample(d, 1, ["id"])
    got = {}
    for r in models.shapley(fitted, d, back, ["id"], 3).collect():
        got[r.id] = got.get(r.id, 0) + r.value
    base = fitted.raw(back).first().p
    assert len(got) == 60 and all(got[r.id] == pytest.approx(r.p - base) for r in fitted.raw(d).collect())


def test_running_sums_and_places_over_many_ranges(spark):
    rows = [(i % 3 or None, float((i * 37) % 101), i) for i in range(500)]
    d = spark.createDataFrame(rows, "g int, v double, n long")
    got = {r.n: r.before for r in ordering.running(d.repartition(7), [F.desc("v"), F.col("n")], {"before": "n"}, ["g"]).collect()}
    for g, v, n in rows:
        assert got[n] == sum(m for h, w, m in rows if h == g and (-w, m) < (-v, n))
    assert [r.v for r in ordering.numbered(d, [F.col("v"), F.col("n")], "at").orderBy("at").collect()] == sorted(v for _, v, _ in rows)
    assert sorted(r["at"] for r in ordering.numbered(d, [F.col("v"), F.col("n")], "at").collect()) == list(range(500))


def test_percentiles_are_exact(spark):
    import numpy as np

    v = [float((i * 7919) % 997) for i in range(300)] + [None] * 5
    d = spark.createDataFrame([(x, None, 4.0) for x in v], "a double, b double, c double")
    shares = [0.0, 0.1, 0.5, 0.995, 1.0]
    got = {r["column"]: r["values"] for r in ordering.exact_percentiles(d, ["a", "b", "c"], shares).collect()}
    assert got["a"] == pytest.approx(list(np.percentile([x for x in v if x is not None], [100 * s for s in shares]))) and got["c"] == [4.0] * 5 and "b" not in got
    assert panels.fit_medians(d, ["a", "b"])["b"] == 0.0


def test_nearest_cell_of_far_records_against_all_cells(spark):
    import math

    cells = [(f"c{i}", i, 25 + (i * 7 % 30) / 20, -81 - (i * 11 % 40) / 20) for i in range(60)]
    recs = [(i, 24 + (i * 13 % 97) / 25, -84 + (i * 29 % 113) / 25) for i in range(200)]
    c, r = spark.createDataFrame(cells, "Grid_ID string, cell_ord int, cell_lat double, cell_lon double"), spark.createDataFrame(recs, "id int, decimalLatitude double, decimalLongitude double")
    cos = math.cos(math.radians(sum(x[1] for x in recs) / len(recs)))
    for x in joins.snap_to_cells(r, c).collect():
        km = lambda k: 111 * math.hypot(x.decimalLatitude - k[2], (x.decimalLongitude - k[3]) * cos)
        assert x.snap_km == pytest.approx(min(map(km, cells)))
    assert {x.Grid_ID for x in joins.snap_to_cells(r, c.limit(0)).collect()} == {None} and joins.snap_to_cells(r.limit(0), c).count() == 0


def test_union_of_panels_that_share_a_key(spark):
    row = "Grid_ID string, iso_year int, iso_week int, presence int"
    a, b = spark.createDataFrame([("x", 2015, 1, 1)], row), spark.createDataFrame([("x", 2015, 1, 0), ("y", 2015, 1, 0)], row)
    with pytest.raises(ValueError, match="both panels"):
        sets.union_labelled(a, b)
    assert sets.union_labelled(a, b.filter("Grid_ID = 'y'")).count() == 2


def test_panel_in_one_pass_equals_its_parts(spark):
    rows = [("fxyz"[i % 4], float(i % 5), DAY(2016, 1, 1) + dt.timedelta(days=i % 40), f"c{i % 6}", 25.0 + i % 6, -81.0) for i in range(240)]
    d = spark.createDataFrame(rows, "species string, individualCount double, eventDate date, Grid_ID string, cell_lat double, cell_lon double")
    presence = panels.presence_panel(d, "f")
    for cap in (None, 2):
        parts = sets.union_labelled(presence, panels.as_absence_rows(panels.infer_absences(panels.cellweek_activity(d, "f"), presence, 3, cap)))
        whole = panels.labelled_panel(d, "f", 3, cap)
        assert sorted(map(repr, whole.select(*parts.columns).collect())) == sorted(map(repr, parts.collect()))


def test_yearly_files_and_reports_in_arrays(spark, tmp_path):
    d = spark.range(100).withColumn("year", (2015 + F.col("id") % 3).cast("int"))
    io.write_yearly(d, str(tmp_path / "yearly"), ("id",))
    assert {r.year: r["count"] for r in io.read_yearly(spark, str(tmp_path / "yearly")).groupBy("year").count().collect()} == {2015: 34, 2016: 33, 2017: 33}
    (tmp_path / "a_2016.json").write_text('[{"id": 1, "x": {"k": 2}}, {"id": 2}]')
    assert [(r.id, r.x) for r in io.stringify_nested(io.read_reports(spark, str(tmp_path / "a_2016.json"))).orderBy("id").collect()] == [(1, '{"k":2}'), (2, None)]
    newer = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "k int, v string, at int")
    assert io.upsert_latest(newer.limit(0), newer, ["k"], "at").first().v == "new"


@pytest.mark.parametrize("ties", [3, 1000])
def test_spearman_ranks_each_pair_by_itself(spark, ties):
    r = np.random.default_rng(ties)
    frame = pd.DataFrame({c: np.floor(r.random(300) * ties) for c in "abcd"})
    frame["b"] = frame.b + frame.a
    frame.loc[r.random(300) < 0.3, "c"] = None
    frame.loc[r.random(300) < 0.2, "d"] = None
    frame["e"] = None
    frame.loc[0, "e"] = 1.0
    df = spark.createDataFrame([[None if pd.isna(x) else float(x) for x in row] for row in frame.to_numpy()], "a double, b double, c double, d double, e double")
    want = frame.astype(float).corr(method="spearman")
    got = {(x.a, x.b): x.r for x in panels.corr_matrix(df.repartition(5), list("abcde"), "spearman").collect()}
    assert len(got) == 15
    for (a, b), v in got.items():
        w = want.loc[a, b]
        assert (v is None or np.isnan(v)) if np.isnan(w) or "e" in (a, b) else v == pytest.approx(w)
    assert panels.corr_matrix(df.limit(0), ["a"], "spearman").first().r is None


def test_far_records_meet_few_cells(spark):
    import math

    r = np.random.default_rng(5)
    cells = [(f"c{i}", i, 25 + 0.05 * (i % 50), -81 + 0.05 * (i // 50), i % 3) for i in range(2500)]
    recs = [(i, float(y), float(x), i % 4) for i, (y, x) in enumerate(zip(r.uniform(-60, 80, 150), r.uniform(-170, 170, 150)))]
    c = spark.createDataFrame(cells, "Grid_ID string, cell_ord int, cell_lat double, cell_lon double, g int")
    d = spark.createDataFrame(recs, "id int, lat double, lon double, g int")
    for on in ((), ("g",)):
        got = {x.id: x._best for x in joins.nearest(d, "lat", "lon", c, ["cell_ord"], 0.05, 0.9, on).collect()}
        for i, y, x, g in recs:
            own = [(111 * math.hypot(y - k[2], (x - k[3]) * 0.9), k[1]) for k in cells if not on or k[4] == g]
            assert (got[i] is None and not own) or got[i].km == pytest.approx(min(own)[0])
    far = d.withColumn("_id", F.col("id"))
    pyramid = joins._pyramid(c, [], 0.05, 0.05, 6)
    met = joins._descended(far, "lat", "lon", c, pyramid, [], 0.05, 0.05, 0.9, 6).groupBy("_id").count().collect()
    assert len(met) == 150 and max(x["count"] for x in met) <= 8


def test_states_as_of_mondays_against_a_filled_calendar(spark):
    r = np.random.default_rng(8)
    days = pd.date_range("2015-01-01", "2015-04-30")
    rows = [(f"c{k}", d.date(), float(r.random()) if r.random() < 0.6 else None, float(r.random()) if r.random() < 0.1 else None) for k in range(4) for d in days if r.random() < (0.9 if k else 0.15)]
    df = spark.createDataFrame(rows, "Grid_ID string, Date date, a double, v double").repartition(3)
    mondays = [d.date() for d in days if d.weekday() == 0][::2]
    specs = {"s7": ("a", "sum", 7), "m28": ("a", "mean", 28), "x14": ("a", "max", 14), "n14": ("a", "min", 14)}
    got = {(x.Grid_ID, x.monday): x for x in windows.state_features(df, spark.createDataFrame([(m,) for m in mondays], "monday date"), specs, {"a": 3, "v": 16}, {"level": "v"}).collect()}
    frame = pd.DataFrame(rows, columns=["g", "d", "a", "v"]).astype({"a": float, "v": float})
    some = 0
    for g in ("c0", "c1", "c2", "c3"):
        own = frame[frame.g == g].set_index(pd.to_datetime(frame[frame.g == g].d))[["a", "v"]].reindex(days)
        a, v = own.a.ffill(limit=3), own.v.ffill(limit=16)
        for m in mondays:
            before = a[a.index < pd.Timestamp(m)]
            level = v[v.index < pd.Timestamp(m)].iloc[-1:] if len(before) else before
            want = [before.iloc[-7:].sum(min_count=1), before.iloc[-28:].mean(), before.iloc[-14:].max(), before.iloc[-14:].min(), level.iloc[0] if len(level) else np.nan]
            x = got.get((g, m))
            values = [None] * 5 if x is None else [x.s7, x.m28, x.x14, x.n14, x.level]
            some += x is not None
            assert [np.nan if z is None else z for z in values] == pytest.approx(want, nan_ok=True)
    assert some > 20


@pytest.mark.parametrize("few, bins", [(20_000, 512), (50, 7), (0, 3)])
def test_percentiles_by_refined_histograms(spark, monkeypatch, few, bins):
    monkeypatch.setattr(ordering, "FEW", few)
    monkeypatch.setattr(ordering, "BINS", bins)
    r = np.random.default_rng(4)
    frame = pd.DataFrame({"a": r.normal(size=3000), "b": np.exp(r.normal(size=3000) * 20), "c": np.where(r.random(3000) < 0.7, 0.0, r.random(3000)), "d": r.integers(-1, 2, 3000).astype(float), "e": np.where(r.random(3000) < 0.5, 1e308, -1e308)})
    shares = [0.0, 0.025, 1 / 3, 0.5, 0.995, 1.0]
    got = {x["column"]: x["values"] for x in ordering.exact_percentiles(spark.createDataFrame(frame).repartition(4), list("abcde"), shares).collect()}
    for c in "abcd":
        assert got[c] == pytest.approx(np.percentile(frame[c], [100 * s for s in shares]), rel=1e-12)
    assert {abs(x) for x in got["e"]} == {1e308}


@pytest.mark.parametrize("times", [1, 2, 3])
def test_gap_fill_against_all_known_cells(spark, times):
    r = np.random.default_rng(times)
    known = {(x, y): (float(r.random()), float(r.random())) for x in range(14) for y in range(14) if r.random() < 0.45}
    grid = spark.createDataFrame([(x, y, v, a) for (x, y), (v, a) in known.items()], "ix int, iy int, value double, alpha double")
    holes = {(h.ix, h.iy) for h in panels.closed_holes(grid.select("ix", "iy"), times).collect()}
    got = {(g.ix, g.iy): (g.value, g.alpha, g.filled) for g in panels.fill_gaps(grid, times).collect()}
    assert len(holes) > 10 and got.keys() == known.keys() | holes
    for h in holes:
        near = min(known, key=lambda k: ((k[0] - h[0]) ** 2 + (k[1] - h[1]) ** 2, k))
        assert got[h] == (*known[near], True)
    assert all(got[k] == (*v, False) for k, v in known.items())


def test_background_numbers_are_a_permutation(spark):
    a, b = sets.permuted(F.col("id"), 13, 21, 5)
    assert spark.range(13 * 21).select(a.alias("a"), b.alias("b")).distinct().count() == 13 * 21
    cells = spark.createDataFrame([(f"c{i}",) for i in range(9)], "Grid_ID string")
    some = spark.createDataFrame([(f"c{i}", 2015, w) for i in range(9) for w in range(1, 9)], "Grid_ID string, iso_year int, iso_week int")
    take = lambda n, e: sets.sample_background(cells, [2015, 2016], list(range(1, 11)), e, n)
    got = take(40, some).collect()
    assert len(set(got)) == 40 and not {(r.Grid_ID, r.iso_year, r.iso_week) for r in got} & {tuple(r) for r in some.collect()}
    assert sorted(take(40, some).collect()) == sorted(got)
    assert take(1000, some).count() == 180 - 72 and take(50, some.limit(0)).count() == 50 and sets.sample_background(cells.limit(0), [2015], [1], some, 5).count() == 0


def test_upsert_of_equal_rows_is_repeatable(spark):
    new = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "b", None)], "k int, v string, w double")
    for n in (1, 3):
        assert tuple(io.upsert_latest(new.limit(0), new.repartition(n), ["k"]).first()) == (1, "b", 1.0)


def test_no_state_where_only_a_longer_fill_reaches_the_window(spark):
    days = [("a", DAY(1998, 1, 1), 1.0, 2.0), ("b", DAY(1998, 1, 30), 1.0, None)]
    specs = {"a_7": ("a", "sum", 7), "a_28": ("a", "sum", 28)}
    monday = spark.createDataFrame([(DAY(1998, 2, 2),)], "monday date")
    state = windows.state_features(spark.createDataFrame(days, "Grid_ID string, Date date, a double, v double"), monday, specs, {"a": 3, "v": 16}, {"level": "v"})
    # Of "a" the long fill ends on 17 January, in reach of a window of 28 days, but v is asked for on the last day alone.
    assert [tuple(r) for r in state.collect()] == [("b", DAY(1998, 2, 2), 3.0, 3.0, None)]


def test_daily_sums_do_not_depend_on_how_tasks_are_cut(spark, tmp_path):
    from panelkit.plans import _tables

    values = [0.1, 0.2, 0.3]
    assert (values[0] + values[1]) + values[2] != values[0] + (values[1] + values[2])
    rows = [(i, dt.datetime(2024, 1, 1, i), 1, "view", x) for i, x in enumerate(values)] + [(9, dt.datetime(2024, 1, 2), 1, "view", None)]
    for part in (rows[2:], rows[1:2], rows[:1]), (rows[1:], rows[:1]):
        sf = str(tmp_path / str(len(part)))
        for p in part:
            spark.createDataFrame(p, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
        got = {r.Date.day: r.prcp for r in _tables.daily(spark, sf).collect()}
        assert got == {1: (values[0] + values[1]) + values[2], 2: None}
