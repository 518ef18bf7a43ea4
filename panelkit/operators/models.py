"""Models on pyspark.ml: estimators, out-of-fold predictions, calibration, surfaces, attributions."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import disagreement, effort_weight, fold_label, key_hash, opacity, support
from ..sources import materialise
from .joins import support_distance
from .panels import corr_matrix, decorrelated, impute
from .sets import group_kfold, group_shuffle_split
from .verification import SCHEMES, kmeans_blocks, score

LABEL, WEIGHT, VECTOR = "presence", "weight", "_features"
#: Where a row stands for several (see collapsed()): their number, and the sum of their efforts.
ROWS, EFFORT = "n_rows", "effort"


def boosted_regressor(**how) -> Estimator:
    return GBTRegressor(featuresCol=VECTOR, labelCol="mean_log_count", weightCol=WEIGHT, **({"maxIter": 20, "maxDepth": 4, "seed": 42} | how))


def regularised_regressor(**how) -> Estimator:
    """Shallower trees of larger leaves, each on parts of the rows and features, with smaller steps."""
    return boosted_regressor(**({"maxDepth": 3, "minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "stepSize": 0.05} | how))


#: Prefixes of land cover and vegetation, which a model of climate alone leaves out.
NOT_CLIMATE = ("pct_", "EVI", "NDWI", "evi_", "ndwi_")


def climate_features(df: DataFrame, candidates: list[str], threshold: float = 0.9) -> list[str]:
    """The candidates without land cover and vegetation, each only if no one kept before it is correlated with it beyond the threshold."""
    kept = [c for c in candidates if not c.startswith(NOT_CLIMATE)]
    return decorrelated(materialise(corr_matrix(df, kept), "climate-correlations"), kept, threshold)


def boosted_classifier(**how) -> Estimator:
    return GBTClassifier(featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT, **({"maxIter": 20, "maxDepth": 4, "seed": 42} | how))


def forest_classifier(**how) -> Estimator:
    return RandomForestClassifier(featuresCol=VECTOR, labelCol=LABEL, weightCol=WEIGHT, **({"numTrees": 50, "maxDepth": 6, "seed": 42} | how))


class Bins:
    """Each feature's bins between quantiles of its values, as many as Spark's trees make of it; a feature of few values has a bin for each. Reads no labels."""

    def __init__(self, df: DataFrame, features: list[str], bins: int = 32):
        shares = [i / bins for i in range(1, bins)]
        row = df.agg(*(F.percentile_approx(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), shares, 10_000).alias(c) for c in features)).first()
        self.edges = {c: sorted(set(row[c] or [0.0])) for c in features}

    def put(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """df with the numbers of the bins in place of the values, in columns of these names after the prefix; null stays null."""
        names = [f"{prefix}{c}" for c in self.edges]
        splits = [[-math.inf, *e, math.inf] for e in self.edges.values()]
        d = df.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in names})
        d = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[f"_b_{c}" for c in names], handleInvalid="keep").transform(d)
        return d.withColumns({c: F.when(F.col(c).isNotNull(), F.col(f"_b_{c}")) for c in names}).select(*df.columns)


def collapsed(df: DataFrame, features: list[str], by: list[str], bins: Bins | None = None) -> DataFrame:
    """by, features (bins), presence, n_rows, effort: one row for all that agree in these. Trees split between bins alone, so that they need no more.

    Their number has a bound by that of the bins, whatever the number of rows. A boosted tree is
    that of the rows themselves; the forest's bags draw such rows.
    """
    effort = effort_weight(F.col("n_events")) if "n_events" in df.columns else F.lit(1.0)
    d = (bins or Bins(df, features)).put(df.withColumn(EFFORT, effort))
    return materialise(d.groupBy(*by, *features, LABEL).agg(F.count("*").alias(ROWS), F.sum(EFFORT).alias(EFFORT)), "collapsed")


def _merged(df: DataFrame, features: list[str]) -> DataFrame:
    """Collapsed rows without what told their folds apart; other tables as they are."""
    if ROWS not in df.columns:
        return df
    return df.groupBy(*features, LABEL).agg(F.sum(ROWS).alias(ROWS), F.sum(EFFORT).alias(EFFORT))


def _rows(df: DataFrame):
    return F.col(ROWS) if ROWS in df.columns else F.lit(1)


def training_weights(df: DataFrame, balanced: bool = True, counts: tuple[int, int] | None = None) -> DataFrame:
    """Adds weight: the root of the effort, times what balances the classes of these rows. counts: rows and positives, where they are known."""
    effort = F.col(EFFORT) if ROWS in df.columns else effort_weight(F.col("n_events")) if "n_events" in df.columns else F.lit(1.0)
    d = df.withColumn(WEIGHT, effort)
    if not balanced:
        return d
    n, pos = counts or d.agg(F.sum(_rows(df)), F.sum(F.when(F.col(LABEL) == 1, _rows(df)).otherwise(0))).first()
    if not pos or pos == n:
        return d
    return d.withColumn(WEIGHT, F.col(WEIGHT) * F.when(F.col(LABEL) == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))


def _medians(df: DataFrame, columns: list[str]) -> list:
    """Of a quantile summary of bounded size; of collapsed rows by the numbers of their few values."""
    if ROWS in df.columns:
        return [F.percentile(F.col(c).cast("double"), 0.5, F.col(ROWS)).alias(c) for c in columns]
    return [F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in columns]


def sketched_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians to replace unknown values with: of a quantile summary of bounded size, in one pass; of all nulls 0."""
    row = df.agg(*_medians(df, columns)).first()
    return {c: float(row[c]) if row[c] is not None else 0.0 for c in columns}


class Fitted:
    """A model with the medians of its training rows and, where it is calibrated, its isotonic map; bins: of its features, where it was fitted on them."""

    def __init__(self, model: Model, features: list[str], medians: dict[str, float], isotonic: Model | None = None):
        self.model, self.features, self.medians, self.isotonic, self.bins = model, features, medians, isotonic, None

    def raw(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = df.withColumns({f"_f_{c}": F.col(c).cast("double") for c in self.features})
        d = self.bins.put(d, "_f_") if self.bins else d
        d = d.withColumns({f"_f_{c}": F.coalesce(f"_f_{c}", F.lit(self.medians[c])) for c in self.features})
        d = VectorAssembler(inputCols=[f"_f_{c}" for c in self.features], outputCol=VECTOR).transform(d)
        d = self.model.transform(d)
        p = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in d.columns else F.col("prediction")
        return d.withColumn(out, p).select(*(c for c in df.columns if c != out), out)

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        d = self.raw(df, out)
        if self.isotonic is None:
            return d
        return self.isotonic.transform(d.withColumn("_x", F.col(out))).withColumn(out, F.col("_iso")).drop("_x", "_iso")


def fit(train: DataFrame, features: list[str], make: Callable[[], Estimator], calibration: DataFrame | None = None, balanced: bool = True, known: tuple[tuple[int, int], dict[str, float]] | None = None) -> Fitted:
    """Medians, weights and model from train alone; the isotonic map from calibration rows. known: train's rows and positives, and its medians."""
    counts, medians = known or (None, sketched_medians(train, features))
    d = impute(training_weights(train, balanced, counts), medians)
    d = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(d.withColumns({c: F.col(c).cast("double") for c in features}))
    fitted = Fitted(make().fit(d), features, medians)
    if calibration is not None:
        fitted.isotonic = _isotonic(fitted.raw(calibration, "_x"), "_x")
    return fitted


def _isotonic(scored: DataFrame, p: str) -> Model:
    """The isotonic map of scores to labels; equal ones are one weighted row."""
    g = scored.groupBy(F.col(p).alias("_x"), F.col(LABEL).cast("double").alias(LABEL)).agg(F.sum(_rows(scored)).cast("double").alias("_n"))
    return IsotonicRegression(featuresCol="_x", labelCol=LABEL, weightCol="_n", predictionCol="_iso").fit(g)


def _empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """No rows of the columns, with fold and p, as out-of-fold predictions have them."""
    return df.select(*columns, LABEL).limit(0)


def _scored(train: DataFrame, aside: DataFrame | None, test: DataFrame, features: list[str], make: Callable[[], Estimator]) -> DataFrame:
    """test with p: of the model of train, through the isotonic map of aside; where train has one class, the share of its positives (null without rows)."""
    train = _merged(train, features)
    if ROWS in train.columns:
        train, aside = materialise(train, "training-rows"), None if aside is None else _merged(aside, features)
    number = lambda c: F.coalesce(F.sum(F.when(c, _rows(train))), F.lit(0))
    n, pos, known, *found = train.agg(number(F.lit(True)), number(F.col(LABEL) == 1), number(F.col(LABEL).isNotNull()), *_medians(train, features)).first()
    if pos in (0, known):
        return test.withColumn("p", F.lit(pos / known if known else None).cast("double"))
    return fit(train, features, make, aside, known=((n, pos), {c: 0.0 if x is None else float(x) for c, x in zip(features, found)})).predict(test)


def pooled_oof(df: DataFrame, features: list[str], make: Callable[[], Estimator], fold: str, keys: list[str], calibrate: bool = False, group: str | None = None, parallel: int = 8) -> DataFrame:
    """keys, presence, fold, p: every row scored by the model that didn't see its fold.

    The driver loops over the folds alone, `parallel` at a time; fitting and scoring are distributed.
    With calibrate, a quarter of the other folds (or of the groups in them) is set aside for the
    isotonic map; where nothing would be left to fit on, scores stay raw. A null fold is a fold. Where
    the training rows have one class, or there are none, p is their share of positives, or null.
    """
    # The folds in the order in which they are set aside; they are few, as each is a fit.
    drawn = [r[0] for r in df.select(fold).distinct().orderBy(key_hash(42, F.col(fold)), fold).collect()]
    folds = sorted(drawn, key=lambda x: (x is not None, x))
    one_of = lambda values: reduce(lambda a, b: a | b, (F.col(fold).eqNullSafe(F.lit(x)) for x in values))

    def one(value) -> DataFrame:
        own = F.col(fold).eqNullSafe(F.lit(value))
        test, train, aside = df.filter(own), df.filter(~own), None
        others = [x for x in drawn if x != value]
        if calibrate and group in (None, fold):
            if len(others) > 1:
                held = one_of(others[: math.ceil(len(others) / 4)])
                train, aside = train.filter(~held), train.filter(held)
        elif calibrate and train.select(group).distinct().count() > 1:
            split = group_shuffle_split(train, group)
            train, aside = split.filter("part = 'train'").drop("part"), split.filter("part = 'calibration'").drop("part")
        return _scored(train, aside, test, features, make).select(*keys, LABEL, F.col(fold).cast("string").alias("fold"), "p")

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(folds) or 1))) as pool:
        parts = list(pool.map(inheritable_thread_target(df.sparkSession)(one), folds))
    none = _empty(df, keys).withColumn("fold", F.lit(None).cast("string")).withColumn("p", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts or [none])


def forward_oof(df: DataFrame, features: list[str], make: Callable[[], Estimator], keys: list[str], year: str = "iso_year") -> DataFrame:
    """keys, presence, test_year, p: each year scored by a model of all years before it; with two or more, the last of them calibrates."""
    years = [r[0] for r in df.select(year).filter(F.col(year).isNotNull()).distinct().orderBy(year).collect()]
    parts = []
    for i, y in enumerate(years[1:], 1):
        train, aside = df.filter(F.col(year) < y), None
        if i >= 2:
            aside, train = df.filter(F.col(year) == years[i - 1]), df.filter(F.col(year) < years[i - 1])
        parts.append(_scored(train, aside, df.filter(F.col(year) == y), features, make).select(*keys, LABEL, F.col(year).alias("test_year"), "p"))
    none = _empty(df.withColumn("test_year", F.col(year)), [*keys, "test_year"]).withColumn("p", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts or [none])


def regression_oof(df: DataFrame, features: list[str], make: Callable[[], Estimator], fold: str, keys: list[str], label: str = "mean_log_count") -> DataFrame:
    """keys, label, fold, p: abundance out of fold, each fold scored by the regressor of the others; null where there are none."""
    parts = []
    for r in df.select(fold).distinct().orderBy(fold).collect():
        own = F.col(fold).eqNullSafe(F.lit(r[0]))
        test, train = df.filter(own), df.filter(~own & F.col(label).isNotNull())
        scored = fit(train, features, make, balanced=False).predict(test) if train.limit(1).count() else test.withColumn("p", F.lit(None).cast("double"))
        parts.append(scored.select(*keys, label, F.col(fold).cast("string").alias("fold"), "p"))
    none = df.select(*keys, label).limit(0).withColumn("fold", F.lit(None).cast("string")).withColumn("p", F.lit(None).cast("double"))
    return reduce(DataFrame.unionByName, parts or [none])


def forward_scores(oof: DataFrame) -> DataFrame:
    """Scores of each test year, and pooled (test_year null)."""
    pooled = score(oof, LABEL, "p").withColumn("test_year", F.lit(None).cast(oof.schema["test_year"].dataType))
    return score(oof, LABEL, "p", ["test_year"]).unionByName(pooled)


def calibration_table(df: DataFrame, features: list[str], makers: dict[str, Callable[[], Estimator]], schemes: dict[str, str] | None = None, keys: tuple[str, ...] = ("Grid_ID", "iso_year", "iso_week")) -> DataFrame:
    """Scores of each model, scheme and of raw and calibrated predictions. df may be collapsed()."""
    parts, weight = [], ROWS if ROWS in df.columns else None
    keys = [weight] if weight else list(keys)
    for name, make in makers.items():
        for scheme, fold in (schemes or SCHEMES).items():
            for calibrated in (False, True):
                s = score(materialise(pooled_oof(df, features, make, fold, keys, calibrated), "grid-oof"), LABEL, "p", weight=weight)
                parts.append(s.select(F.lit(name).alias("model"), F.lit(scheme).alias("scheme"), F.lit(calibrated).alias("calibrated"), "*"))
    return reduce(DataFrame.unionByName, parts)


def seed_scores(df: DataFrame, features: list[str], makers: dict[str, Callable[[], Estimator]], seeds: list[int], keys: list[str], schemes: tuple[str, ...] = ("spatiotemporal", "spatial"), k: int = 6, calibrate: bool = True, period: str = "iso_year", bins: Bins | None = None, parallel: int = 4) -> DataFrame:
    """seed, model, scheme, cells of the smallest and largest block, and scores, with the blocks built anew for each seed; the models' own seeds stay. period: what spatiotemporal folds join with the blocks. bins: collapse the rows to these.

    The blocks of all seeds are joined at once, so that the table is read and collapsed once.
    """
    keys, weight = ([ROWS], ROWS) if bins else (keys, None)
    at_once = inheritable_thread_target(df.sparkSession)
    cells = materialise(df.groupBy("Grid_ID").agg(F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon")), "seed-cells")
    blocks = [f"_block{i}" for i in range(len(seeds))]
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        found = list(pool.map(at_once(lambda s: kmeans_blocks(cells, k, s)), seeds))
        labels = materialise(reduce(lambda a, b: a.join(b, "Grid_ID"), (x.withColumnRenamed("spatial_block", c) for x, c in zip(found, blocks))), "seed-labels")
        d = df.drop("spatial_block", "st_block").join(labels, "Grid_ID")
        d = collapsed(d, features, [*blocks, period], bins) if bins else materialise(d, "seed-blocks")

        def sizes(c: str) -> dict:
            return labels.groupBy(c).agg(F.count("*").alias("n")).agg(F.min("n").alias("block_cells_min"), F.max("n").alias("block_cells_max")).first().asDict()

        def one(case: tuple) -> DataFrame:
            s, c, cells_of, name, scheme = case
            own = d.withColumn("spatial_block", F.col(c)).withColumn("st_block", fold_label(F.col(c).cast("string"), F.col(period).cast("string")))
            scores = score(materialise(pooled_oof(own, features, makers[name], SCHEMES[scheme], keys, calibrate), "seed-oof"), LABEL, "p", weight=weight)
            return scores.select(F.lit(s).alias("seed"), F.lit(name).alias("model"), F.lit(scheme).alias("scheme"), *(F.lit(x).alias(n) for n, x in cells_of.items()), "*")

        cases = [(s, c, of, name, scheme) for s, c, of in zip(seeds, blocks, pool.map(at_once(sizes), blocks)) for name in makers for scheme in schemes]
        return reduce(DataFrame.unionByName, list(pool.map(at_once(one), cases)))


def training_set(panel: DataFrame, variant: str, background: DataFrame | None = None) -> DataFrame:
    """presence_absence: the panel; presence_background: presences and background keys with label 0."""
    if variant == "presence_absence":
        return panel
    return panel.filter(F.col(LABEL) == 1).unionByName(background.withColumn(LABEL, F.lit(0)), allowMissingColumns=True)


def fit_calibrated(df: DataFrame, features: list[str], make: Callable[[], Estimator], keys: list[str], group: str = "Grid_ID", k: int = 5, bins: Bins | None = None) -> Fitted:
    """For use: the model of all rows, with the isotonic map of out-of-fold scores over k folds of groups. bins: collapse the rows to these."""
    folds = group_kfold(df, group, k)
    folds = collapsed(folds, features, ["fold"], bins) if bins else materialise(folds, "calibrated-folds")
    oof = pooled_oof(folds, features, make, "fold", [ROWS] if bins else keys)
    fitted = fit(materialise(_merged(folds, features), "training-rows") if bins else df, features, make)
    fitted.isotonic, fitted.bins = _isotonic(oof, "p"), bins
    return fitted


def fit_before(df: DataFrame, features: list[str], make: Callable[[], Estimator], year: int) -> Fitted:
    """The model of the years before `year`, calibrated on that year."""
    return fit(df.filter(F.col("iso_year") < year), features, make, df.filter(F.col("iso_year") == year))


def predict_surface(grid: DataFrame, models: dict, sampled: DataFrame | None = None, window: int = 2) -> DataFrame:
    """Grid_ID, iso_week, lat, lon, prob_<model>, agree_abs_diff and, given where was sampled, confidence_raw and opacity. models: Fitted, MaxEnt or whatever has predict()."""
    d = grid
    for name, m in models.items():
        d = m.predict(d, f"prob_{name}")
    probs = [f"prob_{n}" for n in models]
    d = d.select("Grid_ID", "iso_week", "lat", "lon", *probs).withColumn("agree_abs_diff", disagreement(*map(F.col, probs)))
    if sampled is None:
        return d
    d = support_distance(d, sampled, window).withColumn("confidence_raw", support(F.col("support_km")))
    return d.withColumn("opacity", opacity(F.col("confidence_raw")))


def gain_importance(fitted: Fitted, blocks: dict[str, str] | None = None) -> list[tuple[str, str | None, float]]:
    """feature, block, share of the split gain, from the largest on. As many rows as there are features."""
    values = fitted.model.featureImportances.toArray()
    rows = [(c, (blocks or {}).get(c), float(v)) for c, v in zip(fitted.features, values)]
    return sorted(rows, key=lambda r: (-r[2], r[0]))


def gain_by_block(gains: DataFrame) -> DataFrame:
    """block, n_features, gain, pct: the rows of gain_importance() rolled up by block."""
    g = gains.groupBy("block").agg(F.count("*").alias("n_features"), F.sum("gain").alias("gain"))
    total = gains.agg(F.sum("gain").alias("_all"))
    return g.join(F.broadcast(total)).select("block", "n_features", "gain", F.when(F.col("_all") > 0, 100 * F.col("gain") / F.col("_all")).alias("pct"))


def background_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """n rows drawn by a hash of their keys: what absent features are replaced with."""
    return df.orderBy(key_hash(seed, *map(F.col, keys)), *keys).limit(n)


def shapley(fitted: Fitted, rows: DataFrame, background: DataFrame, keys: list[str], permutations: int = 4, seed: int = 42, most_background: int = 50) -> DataFrame:
    """keys, feature, value: sampled-permutation Shapley values against rows of the background.

    background: a sample of at most `most_background` rows (see background_sample(); more are
    refused with ValueError), held as one array. Each permutation of a row goes with one of them, drawn by a hash,
    whose values absent features have. All steps are scored in one batch, and the differences
    between steps are averaged: a row's values sum to its score less the mean score of its
    background rows.
    """
    names, medians = fitted.features, fitted.medians
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))
    if background.select(F.lit(1)).limit(most_background + 1).count() > most_background:
        raise ValueError(f"the background has more than {most_background} rows")
    held = background.select(*names).agg(F.array_sort(F.collect_list(F.struct(*(known(c).alias(c) for c in names)))).alias("_held"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(names)))).alias("_step")
    d = rows.select(*keys, *names).withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).join(F.broadcast(held))
    turn = F.pmod(key_hash(f"{seed}b", F.col("_perm"), *map(F.col, keys)), F.size("_held")).cast("int")
    d = d.withColumn("_base", F.get("_held", turn)).drop("_held")
    order = F.array_sort(F.array(*(F.struct(key_hash(seed, F.col("_perm"), F.lit(c)).alias("h"), F.lit(c).alias("c")) for c in names)))
    d = d.withColumn("_order", F.transform(order, lambda x: x["c"])).select("*", steps)
    taken = lambda c: F.array_position("_order", c) <= F.col("_step")
    d = d.withColumns({c: F.when(taken(c), known(c)).otherwise(F.col(f"_base.{c}")) for c in names})
    s = fitted.raw(d, "_s").select(*keys, "_perm", "_order", "_step", "_s")
    pairs = s.groupBy(*keys, "_perm", "_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("_step", "_s"))), lambda x: x["_s"]).alias("_all"))
    gains = F.transform("_order", lambda c, i: F.struct(c.alias("feature"), (F.get(F.col("_all"), i + 1) - F.get(F.col("_all"), i)).alias("v")))
    return pairs.select(*keys, F.explode(gains).alias("_g")).groupBy(*keys, "_g.feature").agg(F.avg("_g.v").alias("value"))
