"""Queries of cross-validation labels, scores, reference forecasts and the bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verification as op
from ..operators.panels import block_geography
from ._tables import Registry, cells, panel, scores, sql, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
METRICS = "prevalence pr_auc pr_lift roc_auc brier bss"


def _score(rows: str, y: str = "y", p: str = "p", by: str = "", weight: str = "1") -> str:
    """Scores from their definitions: areas by comparing running sums over distinct scores."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {g}n, pos / n AS prevalence, CASE WHEN pos > 0 AND pos < n THEN ap / pos END AS pr_auc, CASE WHEN pos > 0 AND pos < n THEN ap / pos - pos / n END AS pr_lift,
  CASE WHEN pos > 0 AND pos < n THEN area / (pos * (n - pos)) END AS roc_auc, se / n AS brier, CASE WHEN pos > 0 AND pos < n THEN 1 - (se / n) / (pos / n * (1 - pos / n)) END AS bss
  FROM (SELECT {g}sum(p1 + p0) AS n, sum(p1) AS pos, sum(p0 * (above1 + p1 / 2)) AS area, sum(CASE WHEN p1 > 0 THEN p1 * (above1 + p1) / (above1 + p1 + above0 + p0) END) AS ap, sum(p1 * (1 - s) ** 2 + p0 * s ** 2) AS se
    FROM (SELECT *, coalesce(sum(p1) OVER w, 0) AS above1, coalesce(sum(p0) OVER w, 0) AS above0 FROM (SELECT {g}{p}::DOUBLE AS s, sum(CASE WHEN {y} = 1 THEN {weight} ELSE 0 END)::DOUBLE AS p1, sum(CASE WHEN {y} = 1 THEN 0 ELSE {weight} END)::DOUBLE AS p0 FROM ({rows}) WHERE {p} IS NOT NULL AND {y} IS NOT NULL GROUP BY {g}{p}) WINDOW w AS ({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) {f'GROUP BY {by}' if by else ''})"""


@R.add("v1_lattice_blocks", sql("cells", "SELECT Grid_ID, ((cell_lat > (SELECT quantile_cont(cell_lat, 0.5) FROM cells))::INT * 3 + (cell_lon > (SELECT quantile_cont(cell_lon, 1 / 3.0::DOUBLE) FROM cells))::INT + (cell_lon > (SELECT quantile_cont(cell_lon, 2 / 3.0::DOUBLE) FROM cells))::INT)::INT AS spatial_block FROM cells"))
def lattice(spark, sf):
    return op.lattice_blocks(cells(spark, sf))


@R.add("v1_kmeans_blocks")
def kmeans(spark, sf):
    return block_geography(op.build_blocks(panel(spark, sf), "kmeans", 6))


@R.add("v2_group_labels", sql("panel", "SELECT scheme, fold, count(*) AS n FROM (SELECT 'cell' AS scheme, Grid_ID AS fold FROM panel UNION ALL SELECT 'temporal', iso_year::VARCHAR FROM panel) GROUP BY 1, 2"))
def labels(spark, sf):
    return op.group_labels(panel(spark, sf), {"cell": "Grid_ID", "temporal": "iso_year"}).groupBy("scheme", "fold").agg(F.count("*").alias("n"))


_BLOCKS = "SELECT Grid_ID, ((cell_lat > (SELECT quantile_cont(cell_lat, 0.5) FROM places))::INT * 3 + (cell_lon > (SELECT quantile_cont(cell_lon, 1 / 3.0::DOUBLE) FROM places))::INT + (cell_lon > (SELECT quantile_cont(cell_lon, 2 / 3.0::DOUBLE) FROM places))::INT)::INT AS b6, (cell_lat > (SELECT quantile_cont(cell_lat, 0.5) FROM places))::INT AS b2 FROM places"
_FOLDS = {"spatial": "b6::VARCHAR", "temporal": "iso_year::VARCHAR", "spatiotemporal": "b6 || '_' || iso_year", "spatiotemporal_3blocks": "b2 || '_' || iso_year", "forward": "CASE WHEN iso_year > (SELECT min(iso_year) FROM panel) THEN iso_year::VARCHAR END"}


@R.add("v2_schemes", sql("panel", " UNION ALL ".join(f"SELECT '{s}' AS scheme, {c} AS fold, count(*) AS n FROM panel JOIN blocks USING (Grid_ID) GROUP BY 2" for s, c in _FOLDS.items()), places="SELECT DISTINCT Grid_ID, cell_lat, cell_lon FROM panel", blocks=_BLOCKS))
def schemes(spark, sf):
    """Rows of each fold of all five schemes, over blocks of a lattice."""
    d = op.build_blocks(panel(spark, sf), "lattice")
    return op.group_labels(d, op.SCHEMES | op.THREE_BLOCKS, forward="iso_year").groupBy("scheme", "fold").agg(F.count("*").alias("n"))


@R.add("v4_logo_mean", sql("panel", "SELECT a.iso_week, a.iso_year, count(b.presence) AS n_other, avg(b.presence) AS mean_other FROM (SELECT DISTINCT iso_week, iso_year FROM panel) a LEFT JOIN panel b ON a.iso_week = b.iso_week AND a.iso_year <> b.iso_year GROUP BY 1, 2"), "mean_other")
def logo(spark, sf):
    return op.logo_mean(panel(spark, sf), "iso_year", "presence", ["iso_week"])


@R.add("v6_scores", sql("scores", _score('SELECT * FROM scores', by='"by"')), "n " + METRICS)
def scored(spark, sf):
    return op.score(scores(spark, sf), by=["by"])


@R.add("v6_scores_continuous", sql("scores", _score("SELECT * FROM scores", p="p3", by="yr")), "n " + METRICS)
def continuous(spark, sf):
    return op.score(scores(spark, sf), p="p3", by=["yr"])


@R.add("w12_curve", sql("scores", 'SELECT "by", s AS p, p1 AS pos, p0 AS neg, coalesce(sum(p1) OVER w, 0) AS tp, coalesce(sum(p0) OVER w, 0) AS fp FROM (SELECT "by", p AS s, sum(y)::DOUBLE AS p1, (count(*) - sum(y))::DOUBLE AS p0 FROM scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY "by" ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)'), "p pos neg tp fp")
def curve(spark, sf):
    return op.curve(scores(spark, sf), "y", "p", ["by"])


@R.add("v8_reliability", sql("scores", "SELECT least(floor(p3 * 10), 9)::INT AS bin, count(*) AS n, avg(p3) AS mean_p, avg(y) AS observed FROM scores GROUP BY 1"), "mean_p observed")
def reliable(spark, sf):
    return op.reliability(scores(spark, sf), p="p3")


@R.add("w11_quantile_reliability", sql("scores", "SELECT (SELECT count(DISTINCT e)::INT FROM edges WHERE e > (SELECT min(e) FROM edges) AND e < (SELECT max(e) FROM edges) AND s.p > e) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS observed FROM scores s GROUP BY 1 HAVING count(*) >= 15", edges="SELECT unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM scores"), "mean_p observed")
def quantiles(spark, sf):
    return op.quantile_reliability(scores(spark, sf))


@R.add("v9_prevalence_forecast", sql("panel", "SELECT a.iso_year, avg(b.presence) AS train, any_value(c.test) AS test FROM (SELECT DISTINCT iso_year FROM panel) a JOIN panel b ON a.iso_year <> b.iso_year JOIN (SELECT iso_year, avg(presence) AS test FROM panel GROUP BY 1) c ON a.iso_year = c.iso_year GROUP BY 1"), "train test")
def prevalence(spark, sf):
    p = panel(spark, sf)
    f = lambda source: op.prevalence_forecast(p, "iso_year", source).groupBy("iso_year").agg(F.avg("p").alias(source))
    return f("train").join(f("test"), "iso_year")


@R.add("v10_persistence", sql("panel", "SELECT Grid_ID, week_start, previous, (SELECT avg(b.presence) FROM j b WHERE b.iso_year < 1998 AND b.previous = a.previous) AS p FROM j a WHERE iso_year >= 1998", j="SELECT a.*, b.presence AS previous FROM panel a LEFT JOIN panel b ON a.Grid_ID = b.Grid_ID AND a.week_start = b.week_start + 7"), "p")
def persistence(spark, sf):
    p = panel(spark, sf)
    return op.persistence_forecast(p, F.col("iso_year") < 1998).select("Grid_ID", "week_start", "previous", "p")


@R.add("v10_persistence_coverage", sql("panel", "SELECT count(*) AS n, 100 * count(b.presence)::DOUBLE / count(*) AS coverage_pct FROM panel a LEFT JOIN panel b ON a.Grid_ID = b.Grid_ID AND a.iso_year = b.iso_year + 1 AND a.iso_week = b.iso_week WHERE a.iso_year >= 1998"), "coverage_pct")
def covered(spark, sf):
    p = panel(spark, sf)
    return op.coverage(op.persistence_forecast(p, F.col("iso_year") < 1998, "prior_year", raw=True))


@R.add("v11_brier_skill", sql("scores", 'SELECT "by", count(*) FILTER (p2 > 0.2) AS n_vs_r1, 1 - sum((p - y) ** 2) FILTER (p2 > 0.2) / sum((p2 - y) ** 2) FILTER (p2 > 0.2) AS bss_vs_r1, count(*) AS n_vs_p3, 1 - sum((p - y) ** 2) / sum((p3 - y) ** 2) AS bss_vs_p3 FROM scores GROUP BY 1'), "bss_vs_r1 bss_vs_p3")
def skill(spark, sf):
    s = scores(spark, sf).withColumn("r1", F.when(F.col("p2") > 0.2, F.col("p2")))
    return op.brier_skill(s, "p", ["r1", "p3"], by=["by"])


_WIDE = "SELECT y, p, CASE WHEN p2 > 0.1 THEN p2 END AS p2, 0.3::DOUBLE AS base FROM scores"
_LONG = " UNION ALL ".join(f"SELECT y, '{m}' AS method, '{r}' AS rows, {m} AS s FROM wide {'WHERE p2 IS NOT NULL' if r == 'matched' else ''}" for m in ("p", "p2", "base") for r in ("own", "matched"))


@R.add("v12_matched_scores", sql("scores", f"SELECT * REPLACE (CASE WHEN method <> 'base' THEN pr_auc END AS pr_auc, CASE WHEN method <> 'base' THEN pr_lift END AS pr_lift, CASE WHEN method <> 'base' THEN roc_auc END AS roc_auc) FROM ({_score('SELECT * FROM long', p='s', by='rows, method')})", wide=_WIDE, long=_LONG), "n " + METRICS)
def matched(spark, sf):
    s = scores(spark, sf).select("y", "p", F.when(F.col("p2") > 0.1, F.col("p2")).alias("p2"), F.lit(0.3).alias("base"))
    return op.matched_scores(s, ["p", "p2", "base"], constant=("base",))


def _draws(n: int) -> str:
    return f"SELECT replicate, unit, count(*) AS times FROM (SELECT r.r AS replicate, ('0x' || substr(md5('42|' || r.r || '|' || u.i), 1, 8))::BIGINT % g AS k FROM (SELECT row_number() OVER (ORDER BY yr) - 1 AS i, count(*) OVER () AS g FROM (SELECT DISTINCT yr FROM scores)) u, (SELECT unnest(range({n})) AS r) r) d JOIN (SELECT yr AS unit, row_number() OVER (ORDER BY yr) - 1 AS i FROM (SELECT DISTINCT yr FROM scores)) v ON d.k = v.i GROUP BY 1, 2"


_BOOT = "SELECT s.*, d.replicate, d.times FROM scores s JOIN draws d ON s.yr = d.unit"
_REPS = 1000
# Scores are summed by year before they meet the draws.
_SUMS = "SELECT model, s, yr, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM ({}) GROUP BY 1, 2, 3"
_EACH = "SELECT 1 AS y, model, s, replicate, n1 * times AS w FROM sums JOIN draws ON yr = unit UNION ALL SELECT 0, model, s, replicate, n0 * times FROM sums JOIN draws ON yr = unit"
_MODELS = " UNION ALL ".join(f"SELECT y, yr, '{m}' AS model, {m} AS s FROM scores" for m in ("p", "p2", "p3"))


@R.add("v13_block_bootstrap", sql("scores", " UNION ALL ".join(f"SELECT '{m}' AS metric, any_value(p.{m}) AS point, quantile_cont(r.{m}, 0.025) AS lo, quantile_cont(r.{m}, 0.975) AS hi, count(r.{m}) AS n_boot FROM reps r, point p" for m in op.METRICS), draws=_draws(_REPS), sums=_SUMS.format("SELECT y, yr, 0 AS model, p3 AS s FROM scores"), each=_EACH, reps=_score("SELECT * FROM each", p="s", by="replicate", weight="w"), point=_score("SELECT * FROM scores", p="p3")), "point lo hi")
def bootstrap(spark, sf):
    return op.block_bootstrap(scores(spark, sf), "yr", _REPS, p="p3")


_PAIRS = [(a, b, m) for a, b in (("p", "p2"), ("p", "p3"), ("p2", "p3")) for m in op.PAIRED]
_DIFF = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, '{m}' AS metric, max({m}) FILTER (model = '{a}') - max({m}) FILTER (model = '{b}') AS d FROM {{}}" for a, b, m in _PAIRS)


@R.add("v14_paired_differences", sql("scores", "SELECT a, b, metric, any_value(q.d) AS point, quantile_cont(r.d, 0.025) AS lo, quantile_cont(r.d, 0.975) AS hi, avg((r.d > 0)::INT) AS favours_a FROM each_d r JOIN point_d q USING (a, b, metric) GROUP BY 1, 2, 3", draws=_draws(_REPS), long=_MODELS, sums=_SUMS.format("SELECT * FROM long"), each=_EACH, sc=_score("SELECT * FROM each", p="s", by="replicate, model", weight="w"), pt=_score("SELECT * FROM long", p="s", by="model"), each_d=_DIFF.replace("{}", "sc GROUP BY replicate"), point_d=_DIFF.replace("{}", "pt")), "point lo hi favours_a")
def paired(spark, sf):
    return op.paired_differences(scores(spark, sf), ["p", "p2", "p3"], "yr", _REPS)


@R.add("v15_brier_against", sql("scores", "SELECT *, diff_lo > 0 OR diff_hi < 0 AS significant FROM (SELECT quantile_cont(d, 0.025) AS diff_lo, quantile_cont(d, 0.975) AS diff_hi, quantile_cont(skill, 0.025) AS skill_lo, quantile_cont(skill, 0.975) AS skill_hi FROM (SELECT (sum(times * (p2 - y) ** 2) - sum(times * (p - y) ** 2)) / sum(times) AS d, 1 - sum(times * (p - y) ** 2) / sum(times * (p2 - y) ** 2) AS skill FROM boot GROUP BY replicate))", draws=_draws(_REPS), boot=_BOOT), "diff_lo diff_hi skill_lo skill_hi")
def against(spark, sf):
    return op.brier_against(scores(spark, sf), "p", "p2", "yr", _REPS)


_REF = " UNION ALL ".join(f"SELECT {{by}}, '{n}' AS statistic, {v} AS value FROM {{one}}" for n, v in (("brier_diff", "br - bm"), ("bss", "CASE WHEN br > 0 THEN 1 - bm / br END"), ("roc_diff", "rm - rr")))
_ONE = ", ".join(f"max({c}) FILTER (model = '{m}' AND roc_auc IS NOT NULL) AS {a}" for m, c, a in (("p3", "brier", "bm"), ("p", "brier", "br"), ("p3", "roc_auc", "rm"), ("p", "roc_auc", "rr")))


@R.add(
    "v15_against_reference",
    sql("scores", "SELECT p.statistic, p.value AS point, quantile_cont(r.value, 0.025) AS lo, quantile_cont(r.value, 0.975) AS hi, count(r.value) AS n_boot, (SELECT count(DISTINCT yr) FROM scores) AS n_blocks, coalesce(quantile_cont(r.value, 0.025) > 0 OR quantile_cont(r.value, 0.975) < 0, false) AS significant FROM point p LEFT JOIN reps r ON p.statistic = r.statistic GROUP BY 1, 2",
        draws=_draws(_REPS), two="SELECT y, yr, 'p3' AS model, p3 AS s FROM scores UNION ALL SELECT y, yr, 'p', p FROM scores", sums=_SUMS.format("SELECT * FROM two"), each=_EACH,
        sa=_score("SELECT * FROM two", p="s", by="model"), onea=f"SELECT 0 AS zero, {_ONE} FROM sa", point=_REF.format(by="zero", one="onea"),
        sr=_score("SELECT * FROM each", p="s", by="replicate, model", weight="w"), oner=f"SELECT replicate, {_ONE} FROM sr GROUP BY 1", reps=_REF.format(by="replicate", one="oner")),
    "point lo hi",
)
def against_both(spark, sf):
    return op.against_reference(scores(spark, sf), "p3", "p", "yr", _REPS)


@R.add("v17_regression_logo", "SELECT l_linenumber, count(*) AS n, 1 - sum((y - p) ** 2) / (sum(y ** 2) - sum(y) ** 2 / count(*)) AS r2, sqrt(sum((y - p) ** 2) / count(*)) AS rmse FROM (SELECT l_linenumber, l_extendedprice / 1000 AS y, l_quantity * 1.5::DOUBLE AS p FROM lineitem) GROUP BY ROLLUP (l_linenumber)", "r2 rmse")
def regression(spark, sf):
    d = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))
    return op.regression_logo(d, "y", "p", "l_linenumber")


_OBS = "SELECT Grid_ID, iso_week, presence FROM panel WHERE iso_year = 1998"
_PRED = "SELECT Grid_ID, iso_week, m AS model, avg(presence) / m AS p FROM panel, (SELECT unnest([1, 2]) AS m) WHERE iso_year < 1998 GROUP BY 1, 2, 3"
_WK = "SELECT o.Grid_ID, model, p, presence FROM pred JOIN obs o ON o.Grid_ID = pred.Grid_ID AND o.iso_week = 20 AND pred.iso_week = 20"


@R.add("v18_week_validation", sql("panel", f"SELECT s.*, mean_p_present, mean_p_absent, low_power FROM ({_score('SELECT * FROM wk', y='presence', by='model')}) s JOIN (SELECT model, avg(p) FILTER (presence = 1) AS mean_p_present, avg(p) FILTER (presence = 0) AS mean_p_absent, count(*) FILTER (presence = 0) < 10 AS low_power FROM wk GROUP BY 1) m ON s.model = m.model", obs=_OBS, pred=_PRED, wk=_WK), "n mean_p_present mean_p_absent " + METRICS)
def weekly(spark, sf):
    p = panel(spark, sf)
    pred = p.filter("iso_year < 1998").groupBy("Grid_ID", "iso_week").agg(F.avg("presence").alias("_m")).withColumn("model", F.explode(F.array(F.lit(1), F.lit(2)))).select("Grid_ID", "iso_week", "model", (F.col("_m") / F.col("model")).alias("p"))
    return op.week_validation(pred, p.filter("iso_year = 1998").select("Grid_ID", "iso_week", "presence"), 20, ["model"])


@R.add("v19_comparison_table", sql("scores", " UNION ALL ".join(f"SELECT *, '{m}' AS model, {i}::INT AS place FROM ({_score('SELECT * FROM scores', p=m)})" for m, i in (("p2", 1), ("p", 2), ("p3", 3)))), "n " + METRICS)
def compared(spark, sf):
    s = scores(spark, sf)
    return op.comparison_table({m: op.score(s, p=m) for m in ("p", "p2", "p3")}, ["p2", "p"])
