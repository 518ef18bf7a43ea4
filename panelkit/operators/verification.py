"""Cross-validation labels, exact scores, reference forecasts, calibration tables, block bootstrap."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fold_label, key_hash
from ..sources import materialise
from .joins import previous_label
from .ordering import exact_percentiles, numbered, running


def lattice_blocks(cells: DataFrame, rows: int = 2, columns: int = 3) -> DataFrame:
    """Grid_ID, spatial_block: tiles between quantiles of latitude and longitude; a single row or column has no cuts."""
    c = cells.select("Grid_ID", "cell_lat", "cell_lon").distinct()
    none = F.array().cast("array<double>")
    inner = lambda v, n: F.percentile(v, F.array(*(F.lit(i / n) for i in range(1, n)))) if n > 1 else F.any_value(none)
    cuts = c.agg(inner("cell_lat", rows).alias("_y"), inner("cell_lon", columns).alias("_x"))
    above = lambda edges, v: F.size(F.filter(edges, lambda e: v > e))
    block = above(F.col("_y"), F.col("cell_lat")) * columns + above(F.col("_x"), F.col("cell_lon"))
    return c.join(F.broadcast(cuts)).select("Grid_ID", block.cast("int").alias("spatial_block"))


def kmeans_blocks(cells: DataFrame, k: int = 6, seed: int = 42, starts: int = 10, parallel: int = 4) -> DataFrame:
    """Grid_ID, spatial_block: clusters of the distinct cells' centroids, the closest of several starts; blocks are numbered by their centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    c = cells.groupBy("Grid_ID").agg(F.min("cell_lat").alias("cell_lat"), F.min("cell_lon").alias("cell_lon"))
    v = materialise(VectorAssembler(inputCols=["cell_lat", "cell_lon"], outputCol="_v").transform(c), "kmeans-cells")

    def fit(i: int):
        model = KMeans(k=k, seed=seed + 1000 * i, featuresCol="_v", predictionCol="_b").fit(v)
        return model.summary.trainingCost, i, model

    with ThreadPoolExecutor(max_workers=max(1, min(parallel, starts))) as pool:
        *_, model = min(pool.map(inheritable_thread_target(cells.sparkSession)(fit), range(starts)), key=lambda x: x[:2])
    centres = [tuple(x) for x in model.clusterCenters()]
    place = {i: n for n, i in enumerate(sorted(range(len(centres)), key=centres.__getitem__))}
    number = F.element_at(F.create_map(*(F.lit(x) for i in place.items() for x in i)), F.col("_b"))
    return model.transform(v).select("Grid_ID", number.alias("spatial_block"))


def build_blocks(panel: DataFrame, method: str = "kmeans", k: int = 6, seed: int = 42, coarse: int = 3) -> DataFrame:
    """The panel with spatial_block and, of `coarse` blocks, coarse_block; st_block and st_block3 of either and the year."""
    blocks = lambda n: kmeans_blocks(panel, n, seed) if method == "kmeans" else lattice_blocks(panel, 2, max(1, n // 2))
    label = lambda c: fold_label(F.col(c).cast("string"), F.col("iso_year").cast("string"))
    d = panel.join(blocks(k), "Grid_ID").join(blocks(coarse).withColumnRenamed("spatial_block", "coarse_block"), "Grid_ID")
    return d.withColumn("st_block", label("spatial_block")).withColumn("st_block3", label("coarse_block"))


SCHEMES = {"spatial": "spatial_block", "temporal": "iso_year", "spatiotemporal": "st_block"}
THREE_BLOCKS = {"spatiotemporal_3blocks": "st_block3"}


def group_labels(df: DataFrame, schemes: dict[str, str] | None = None, forward: str | None = None) -> DataFrame:
    """A row for each row and scheme, with scheme and fold.

    forward: a column of years; the scheme of that name tests each year on those before it, so that
    rows of the first year are in no fold of it (null: they only train).
    """
    named = [F.struct(F.lit(s).alias("scheme"), F.col(c).cast("string").alias("fold")) for s, c in (schemes or SCHEMES).items()]
    d = df
    if forward:
        d = df.join(F.broadcast(df.agg(F.min(forward).alias("_first"))))
        named.append(F.struct(F.lit("forward").alias("scheme"), F.when(F.col(forward) > F.col("_first"), F.col(forward).cast("string")).alias("fold")))
    return d.withColumn("_x", F.explode(F.array(*named))).select(*df.columns, "_x.scheme", "_x.fold")


def curve(df: DataFrame, y: str, p: str, by: list[str], weight: str | None = None) -> DataFrame:
    """by, p, pos, neg and what stands above: tp, fp before each score, from the highest on. Ties are one row.

    Scores are summed first, so that what is ordered are the distinct scores of a group; they are
    dealt out by ranges, so that no group is ordered in one task.
    """
    w = F.col(weight) if weight else F.lit(1)
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    g = d.groupBy(*by, F.col(p).cast("double").alias("p")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("double").alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).cast("double").alias("neg"))
    return running(g, [F.desc("p")], {"tp": "pos", "fp": "neg"}, by)


def score(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """n, prevalence, pr_auc (average precision), pr_lift, roc_auc, brier, bss of each group; a group of one class has null where it can't be told.

    The curve's areas are exact, with ties taken together.
    """
    by = by or []
    c = curve(df, y, p, by, weight)
    total, pos = F.sum(F.col("pos") + F.col("neg")), F.sum("pos")
    agg = c.groupBy(*by).agg(
        total.alias("n"), pos.alias("_pos"),
        F.sum(F.col("neg") * (F.col("tp") + F.col("pos") / 2)).alias("_area"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * (F.col("tp") + F.col("pos")) / (F.col("tp") + F.col("pos") + F.col("fp") + F.col("neg")))).alias("_ap"),
        F.sum(F.col("pos") * (1 - F.col("p")) ** 2 + F.col("neg") * F.col("p") ** 2).alias("_se"),
    )
    return _metrics(agg, by)


def _metrics(sums: DataFrame, by: list[str]) -> DataFrame:
    """The scores from a group's n, _pos, _area (pairs of either class in the right order), _ap and _se (squared errors)."""
    sums = sums.filter(F.col("n") > 0)
    neg = F.col("n") - F.col("_pos")
    two = (F.col("_pos") > 0) & (neg > 0)
    prev = F.col("_pos") / F.col("n")
    brier = F.col("_se") / F.col("n")
    return sums.select(*by, F.col("n").cast("double").alias("n"), prev.alias("prevalence"), F.when(two, F.col("_ap") / F.col("_pos")).alias("pr_auc"), F.when(two, F.col("_ap") / F.col("_pos") - prev).alias("pr_lift"), F.when(two, F.col("_area") / (F.col("_pos") * neg)).alias("roc_auc"), brier.alias("brier"), F.when(two, 1 - brier / (prev * (1 - prev))).alias("bss"))


def reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows, mean score and observed share in bins of equal width; the last one is closed."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    return d.groupBy(*(by or []), "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))


def quantile_reliability(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10, least: int = 15) -> DataFrame:
    """The same in bins between distinct quantiles, without bins of fewer than `least` rows; ties stay together."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    edges = exact_percentiles(d, [p], [i / bins for i in range(bins + 1)]).select(F.array_distinct("values").alias("_e"))
    inner = F.slice("_e", F.lit(2), F.greatest(F.size("_e") - 2, F.lit(0)))
    d = d.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: F.col(p) > e)))
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed")).filter(F.col("n") >= least)


def logo_mean(df: DataFrame, fold: str, value: str, group: list[str] | None = None) -> DataFrame:
    """group, fold, n_other, mean_other: means over all other folds, by subtraction instead of a loop."""
    group = group or []
    part = df.groupBy(*group, fold).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    every = Window.partitionBy(*group)
    n, s = F.sum("_n").over(every) - F.col("_n"), F.sum("_s").over(every) - F.col("_s")
    return part.select(*group, fold, n.alias("n_other"), F.when(n > 0, s / n).alias("mean_other"))


def prevalence_forecast(df: DataFrame, fold: str, source: str = "train", label: str = "presence") -> DataFrame:
    """df with p, the prevalence of the other folds, or of the row's own fold."""
    if source == "test":
        own = df.groupBy(fold).agg(F.avg(label).alias("p"))
        return df.join(own, fold)
    return df.join(logo_mean(df, fold, label).select(fold, F.col("mean_other").alias("p")), fold)


def persistence_forecast(panel: DataFrame, train: Column, mode: str = "prev_week", raw: bool = False, label: str = "presence") -> DataFrame:
    """Rows outside train with p: the label of the week or year before, or what train says follows such a label."""
    d = previous_label(panel, mode, label).withColumn("_train", train)
    if raw:
        return d.filter(~F.col("_train")).withColumn("p", F.col("previous").cast("double")).drop("_train")
    after = d.filter(F.col("_train") & F.col("previous").isNotNull()).groupBy("previous").agg(F.avg(label).alias("p"))
    return d.filter(~F.col("_train")).drop("_train").join(after, "previous", "left")


def coverage(df: DataFrame, p: str = "p") -> DataFrame:
    return df.agg(F.count("*").alias("n"), (100 * F.count(p) / F.count("*")).alias("coverage_pct"))


def brier_skill(df: DataFrame, p: str, references: list[str], y: str = "y", by: list[str] | None = None) -> DataFrame:
    """For each reference: rows where both are known, and 1 - brier / brier of the reference on them."""
    out = []
    for r in references:
        both = F.col(p).isNotNull() & F.col(r).isNotNull() & F.col(y).isNotNull()
        mine, ref = (F.sum(F.when(both, (F.col(c) - F.col(y)) ** 2)) for c in (p, r))
        out += [F.count_if(both).alias(f"n_vs_{r}"), F.when(ref > 0, 1 - mine / ref).alias(f"bss_vs_{r}")]
    return df.groupBy(*(by or [])).agg(*out)


def matched_scores(wide: DataFrame, methods: list[str], y: str = "y", by: list[str] | None = None, constant: tuple[str, ...] = ()) -> DataFrame:
    """method, rows (own: its coverage, matched: where all methods are known) and scores; a constant method's discrimination is null."""
    by = by or []
    full = F.lit(True)
    for m in methods:
        full = full & F.col(m).isNotNull()
    d = wide.withColumn("_full", full)
    long = d.unpivot([*by, y, "_full"], methods, "method", "p")
    long = long.withColumn("rows", F.explode(F.when(F.col("_full"), F.array(F.lit("own"), F.lit("matched"))).otherwise(F.array(F.lit("own")))))
    s = score(long, y, "p", [*by, "rows", "method"])
    if constant:
        s = s.withColumns({c: F.when(~F.col("method").isin(*constant), F.col(c)) for c in ("pr_auc", "pr_lift", "roc_auc")})
    return s


def _units(df: DataFrame, unit: str) -> DataFrame:
    """unit, _i: the distinct units that aren't null, numbered by name from 0."""
    return numbered(df.select(unit).filter(F.col(unit).isNotNull()).distinct(), [F.col(unit)], "_i")


def _drawn(units: DataFrame, first: int, last: int, seed: int) -> DataFrame:
    """replicate, _i, times: how often each unit is drawn in the replicates first .. last - 1. The k-th draw of a replicate is a hash of both, modulo the number of units."""
    u = units.join(F.broadcast(units.agg(F.count("*").alias("_g"))))
    each = u.select("_i", "_g", F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("replicate"))
    return each.select("replicate", (key_hash(seed, F.col("replicate"), F.col("_i")) % F.col("_g")).alias("_i")).groupBy("replicate", "_i").agg(F.count("*").alias("times"))


def draws(units: DataFrame, unit: str, n_boot: int, seed: int = 42) -> DataFrame:
    """replicate, unit, times: how often each unit is drawn with replacement, as many draws as there are units."""
    u = _units(units, unit)
    return _drawn(u, 0, n_boot, seed).join(u, "_i").select("replicate", unit, "times")


METRICS = ["roc_auc", "pr_auc", "pr_lift", "brier", "bss"]
#: Weights (units times replicates) that go to all tasks at once; with more units fewer replicates are taken at a time.
WEIGHTS_AT_ONCE = 4_000_000
#: Units are numbered by a broadcast table up to this number of them.
UNITS_BROADCAST = 200_000
#: Scores times replicates that are held in one array.
BLOCK = 1_000_000


def _weights(units: DataFrame, count: int, first: int, last: int, seed: int) -> np.ndarray:
    """times by unit and replicate, for the replicates first .. last - 1."""
    rows = _drawn(units, first, last, seed).groupBy("_i").agg(F.collect_list("replicate").alias("r"), F.collect_list("times").alias("t")).toArrow()
    out = np.zeros((count, last - first), np.int32)
    if rows.num_rows:
        r, t = (rows[c].combine_chunks() for c in ("r", "t"))
        out[np.repeat(rows["_i"].to_numpy(), r.value_lengths().to_numpy()), r.flatten().to_numpy() - first] = t.flatten().to_numpy()
    return out


def _weighted_sums(ordered: DataFrame, weights: np.ndarray, by: list[str], first: int) -> DataFrame:
    """by, replicate and, of each range of scores, the parts of what _metrics() needs. ordered: by, _part (ranges, from the highest scores on), _p, _i, pos, neg.

    Each row stands for all replicates at once: the weights of its unit are an array, and so are the
    running sums. A range begins with the weighted sums of the ranges before it.
    """
    held = ordered.sparkSession.sparkContext.broadcast(weights)
    n_reps = weights.shape[1]
    keys = ", ".join(f"`{c}` {ordered.schema[c].dataType.simpleString()}" for c in by)
    keys += ", " if by else ""

    def labelled(of: pa.Table, columns: dict[str, np.ndarray], names: list[str]) -> pa.Table:
        one = pa.array(np.zeros(n_reps, np.int64))
        kept = {c: of[c].take(one) for c in names}
        return pa.table(kept | {"replicate": np.arange(first, first + n_reps)} | columns)

    def total(part: pa.Table) -> pa.Table:
        w = held.value[part["_i"].to_numpy()]
        return labelled(part, {c: part[c].to_numpy() @ w for c in ("pos", "neg")}, [*by, "_part"])

    def inside(part: pa.Table, before: pa.Table) -> pa.Table:
        p, i, pos, neg = (part[c].to_numpy() for c in ("_p", "_i", "pos", "neg"))
        order = np.argsort(-p, kind="stable")
        p, i, pos, neg = p[order], i[order], pos[order], neg[order]
        r = before["replicate"].to_numpy() - first
        tp, fp = np.zeros(n_reps), np.zeros(n_reps)
        tp[r], fp[r] = before["tp"].to_numpy(), before["fp"].to_numpy()
        sums = {c: np.zeros(n_reps) for c in ("n", "_pos", "_area", "_ap", "_se")}
        scores = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])  # ties are one score
        ends = np.r_[scores[1:], len(p)]
        a = 0
        while a < len(scores):
            b = max(a + 1, int(np.searchsorted(ends, scores[a] + max(1, BLOCK // n_reps), "right")))
            rows = slice(scores[a], ends[b - 1])
            w = held.value[i[rows]].astype(float)
            up, down = w * pos[rows, None], w * neg[rows, None]
            if b - a < len(up):
                up, down = (np.add.reduceat(x, scores[a:b] - scores[a]) for x in (up, down))
            above, below = tp + np.cumsum(up, 0), fp + np.cumsum(down, 0)
            sums["_area"] += (down * (above - up / 2)).sum(0)
            sums["_ap"] += (up * above / np.maximum(above + below, 1)).sum(0)
            sums["_se"] += (pos[rows] * (1 - p[rows]) ** 2 + neg[rows] * p[rows] ** 2) @ w
            sums["_pos"] += up.sum(0)
            sums["n"] += up.sum(0) + down.sum(0)
            tp, fp, a = above[-1], below[-1], b
        return labelled(part, sums, by)

    parts = ordered.groupBy(*by, "_part", "_i").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = parts.groupBy(*by, "_part").applyInArrow(total, f"{keys}_part int, replicate long, pos double, neg double")
    w = Window.partitionBy(*by, "replicate").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select(*by, "_part", "replicate", *(F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(n) for c, n in (("pos", "tp"), ("neg", "fp"))))
    both = ordered.groupBy(*by, "_part").cogroup(above.groupBy(*by, "_part"))
    return both.applyInArrow(inside, f"{keys}replicate long, n double, _pos double, _area double, _ap double, _se double")


def bootstrap_scores(df: DataFrame, unit: str, n_boot: int, seed: int = 42, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """by, replicate and the scores of each replicate of whole units drawn with replacement.

    Rows are summed by unit and score and ordered once, whatever the number of replicates; see
    _weighted_sums(). Rows without a unit are in no replicate; replicates without a row are left out.
    """
    by = by or []
    units = materialise(_units(df, unit), "units")
    count = (units.agg(F.max("_i")).first()[0] or 0) + 1
    flat = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, unit, F.col(p).cast("double").alias("_p"))
    flat = flat.agg(F.count_if(F.col(y) == 1).cast("double").alias("pos"), F.count_if(F.col(y) != 1).cast("double").alias("neg"))
    flat = flat.join(F.broadcast(units) if count <= UNITS_BROADCAST else units, unit).select(*by, "_p", "_i", "pos", "neg")
    ordered = materialise(flat.repartitionByRange(*map(F.col, by), F.desc("_p")).withColumn("_part", F.spark_partition_id()), "ordered-scores")
    step = max(1, WEIGHTS_AT_ONCE // count)
    parts = [_weighted_sums(ordered, _weights(units, count, a, min(a + step, n_boot), seed), by, a) for a in range(0, n_boot, step)]
    sums = reduce(DataFrame.unionByName, parts).groupBy(*by, "replicate").agg(*(F.sum(c).alias(c) for c in ("n", "_pos", "_area", "_ap", "_se")))
    return _metrics(sums, [*by, "replicate"])


def intervals(replicates: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """by, metric, lo, hi: the 2.5th and 97.5th percentiles over the replicates, and n_boot: those where the metric can be told."""
    by = by or []
    long = replicates.unpivot(by, metrics, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.count("value").alias("n_boot"))


def block_bootstrap(df: DataFrame, unit: str, n_boot: int = 1000, seed: int = 42, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """by, metric, point (of all rows as they are), lo, hi, n_boot."""
    by = by or []
    point = score(df, y, p, by).unpivot(by, METRICS, "metric", "point")
    ci = intervals(materialise(bootstrap_scores(df, unit, n_boot, seed, y, p, by), "replicates"), METRICS, by)
    ci = ci.withColumnsRenamed({c: f"_{c}" for c in (*by, "metric")})
    same = reduce(lambda a, b: a & b, (point[c].eqNullSafe(ci[f"_{c}"]) for c in (*by, "metric")))
    return point.join(ci, same, "left").select(*by, "metric", "point", "lo", "hi", "n_boot")


PAIRED = ("roc_auc", "pr_lift", "bss")


def paired_differences(wide: DataFrame, models: list[str], unit: str, n_boot: int = 1000, seed: int = 42, y: str = "y", metrics: tuple[str, ...] = PAIRED) -> DataFrame:
    """a, b, metric, point, lo, hi of a - b on the same draws, and the share of replicates that favour a; rows where all models are known."""
    d = wide.dropna(subset=[*models, y]).unpivot([y, unit], models, "model", "p")

    def differences(scores: DataFrame, by: list[str]) -> DataFrame:
        one = scores.groupBy(*by).agg(*(F.max(F.when(F.col("model") == m, F.col(k))).alias(f"{k}_{i}") for i, m in enumerate(models) for k in metrics))
        pairs = F.array(*(F.struct(F.lit(models[i]).alias("a"), F.lit(models[j]).alias("b"), F.lit(k).alias("metric"), (F.col(f"{k}_{i}") - F.col(f"{k}_{j}")).alias("d")) for i, j in combinations(range(len(models)), 2) for k in metrics))
        return one.select(F.explode(pairs).alias("_x")).select("_x.*")

    point = differences(score(d, y, "p", ["model"]), []).withColumnRenamed("d", "point")
    r = differences(materialise(bootstrap_scores(d, unit, n_boot, seed, y, "p", ["model"]), "replicates"), ["replicate"])
    ci = r.groupBy("a", "b", "metric").agg(F.percentile("d", 0.025).alias("lo"), F.percentile("d", 0.975).alias("hi"), F.avg((F.col("d") > 0).cast("double")).alias("favours_a"))
    return point.join(ci, ["a", "b", "metric"])


def against_reference(wide: DataFrame, p: str, reference: str, unit: str, n_boot: int = 1000, seed: int = 42, y: str = "y") -> DataFrame:
    """statistic (brier_diff: reference - p, bss, roc_diff: p - reference), point, lo, hi, n_blocks, n_boot (draws where it can be told), significant.

    On rows where both are known, with units drawn as blocks; squared errors are summed by unit first.
    A draw of one class has no statistic. significant: the interval leaves out 0.
    """
    d = wide.dropna(subset=[p, reference, y])
    long = d.unpivot([y, unit], [p, reference], "model", "p")
    stats = ["brier", "roc_auc"]

    def told(scores: DataFrame, by: list[str]) -> DataFrame:
        one = scores.groupBy(*by).agg(*(F.max(F.when((F.col("model") == m) & F.col("roc_auc").isNotNull(), F.col(s))).alias(f"{s}_{k}") for s in stats for k, m in (("m", p), ("r", reference))))
        values = {"brier_diff": F.col("brier_r") - F.col("brier_m"), "bss": F.when(F.col("brier_r") > 0, 1 - F.col("brier_m") / F.col("brier_r")), "roc_diff": F.col("roc_auc_m") - F.col("roc_auc_r")}
        return one.select(*by, *(v.alias(k) for k, v in values.items())).unpivot(by, list(values), "statistic", "value")

    point = told(score(long, y, "p", ["model"]).withColumn("_all", F.lit(0)), ["_all"]).select("statistic", F.col("value").alias("point"))
    reps = told(materialise(bootstrap_scores(long, unit, n_boot, seed, y, "p", ["model"]), "replicates"), ["replicate"])
    ci = reps.groupBy("statistic").agg(F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"), F.count("value").alias("n_boot"))
    blocks = d.select(unit).distinct().agg(F.count("*").alias("n_blocks"))
    return point.join(ci, "statistic").join(F.broadcast(blocks)).withColumn("significant", F.coalesce((F.col("lo") > 0) | (F.col("hi") < 0), F.lit(False)))


def brier_against(wide: DataFrame, p: str, reference: str, unit: str, n_boot: int = 1000, seed: int = 42, y: str = "y") -> DataFrame:
    """Mean brier difference (reference - p) and skill with their intervals; squared errors are summed by unit first."""
    sums = wide.dropna(subset=[p, reference, y]).groupBy(unit).agg(F.count("*").alias("_n"), F.sum((F.col(p) - F.col(y)) ** 2).alias("_p"), F.sum((F.col(reference) - F.col(y)) ** 2).alias("_r"))
    d = sums.join(draws(wide, unit, n_boot, seed), unit)
    r = d.groupBy("replicate").agg(F.sum(F.col("times") * F.col("_n")).alias("n"), F.sum(F.col("times") * F.col("_p")).alias("sp"), F.sum(F.col("times") * F.col("_r")).alias("sr"))
    r = r.select(((F.col("sr") - F.col("sp")) / F.col("n")).alias("d"), F.when(F.col("sr") > 0, 1 - F.col("sp") / F.col("sr")).alias("skill"))
    out = r.agg(F.percentile("d", 0.025).alias("diff_lo"), F.percentile("d", 0.975).alias("diff_hi"), F.percentile("skill", 0.025).alias("skill_lo"), F.percentile("skill", 0.975).alias("skill_hi"))
    return out.withColumn("significant", (F.col("diff_lo") > 0) | (F.col("diff_hi") < 0))


def regression_logo(df: DataFrame, y: str, p: str, fold: str) -> DataFrame:
    """fold (null: all), n, r2, rmse, from sums; by grouping sets."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    sums = d.groupBy(fold).agg(F.count("*").alias("_n"), F.sum((F.col(y) - F.col(p)) ** 2).alias("_e"), F.sum(y).alias("_s"), F.sum(F.col(y) ** 2).alias("_q"))
    r = sums.rollup(fold).agg(F.sum("_n").alias("n"), F.sum("_e").alias("_e"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    sst = F.col("_q") - F.col("_s") ** 2 / F.col("n")
    return r.select(fold, "n", F.when(sst > 0, 1 - F.col("_e") / sst).alias("r2"), F.sqrt(F.col("_e") / F.col("n")).alias("rmse"))


def week_validation(predicted: DataFrame, observed: DataFrame, week: int, by: list[str] | None = None, low_power: int = 10) -> DataFrame:
    """Scores of one week, mean score of either class, and a flag for fewer than low_power absences."""
    from .joins import join_week

    by = by or []
    j = join_week(predicted, observed, week)
    s = score(j, "presence", "p", by)
    m = j.groupBy(*by).agg(F.avg(F.when(F.col("presence") == 1, F.col("p"))).alias("mean_p_present"), F.avg(F.when(F.col("presence") == 0, F.col("p"))).alias("mean_p_absent"), (F.count_if(F.col("presence") == 0) < low_power).alias("low_power"))
    return s.join(m, by) if by else s.join(F.broadcast(m))


def comparison_table(tables: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """All models' scores with a rank: the given order first, others after it by name."""
    from .sets import stack

    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return stack(tables, "model").withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))
