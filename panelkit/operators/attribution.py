"""Exact attributions of tree ensembles: path-dependent Shapley values from the nodes of a fitted model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import work_dir
from .models import Fitted

#: Leaves with so many features on their path at most have the attributions of all 2 ** n cases in a table.
TABLED = 6


@dataclass
class Leaf:
    """A leaf's value, and of each feature on the way to it: its number, the bounds low < x <= high that x must keep, and the share of the training weight that kept them."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    table: np.ndarray | None = None

    def attributed(self, kept: np.ndarray) -> np.ndarray:
        """For rows of flags (which features keep their bounds) the Shapley value of each feature.

        With only some features known, a leaf is worth its value times, for each feature on its path,
        1 or 0 where the feature is known and keeps its bounds or not, and its share where it is unknown.
        """
        m = len(self.features)
        out = np.zeros((len(kept), m))
        weight = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        for j in range(m):
            by_size = np.zeros((len(kept), m))  # summed over the sets of k known others
            by_size[:, 0] = 1
            for i in range(m):
                if i != j:
                    more = by_size * self.share[i]
                    more[:, 1:] += by_size[:, :-1] * kept[:, i, None]
                    by_size = more
            out[:, j] = self.value * (kept[:, j] - self.share[j]) * (by_size @ weight)
        return out


def leaves(spark: SparkSession, fitted: Fitted) -> list[Leaf]:
    """The leaves of all trees. Their values add up to the probability of a forest, to the margin of boosted classifiers, to the prediction of regressors.

    Nodes come from the model's stored form; they are as many as the model has, whatever the data.
    """
    path, model = work_dir(spark, "trees"), fitted.model
    model.write().save(path)
    forest = isinstance(model, RandomForestClassificationModel)
    mean = forest or isinstance(model, RandomForestRegressionModel)
    weights = [w / (sum(model.treeWeights) if mean else 1) for w in model.treeWeights]
    nodes: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        if r["split"]["numCategories"] not in (None, -1):
            raise ValueError("splits on categories aren't known here")
        nodes.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    found: list[Leaf] = []

    def size(n: dict) -> float:
        return sum(n["impurityStats"]) if forest else n["impurityStats"][0]

    def walk(tree: dict[int, dict], n: dict, scale: float, way: dict[int, tuple[float, float, float]]) -> None:
        if n["leftChild"] < 0:
            value = n["impurityStats"][1] / size(n) if forest and size(n) else n["prediction"]
            f = sorted(way)
            low, high, share = (np.array([way[c][k] for c in f], float) for k in range(3))
            found.append(Leaf(scale * value, np.array(f, int), low, high, share))
            return
        c, (cut,) = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"]
        low, high, share = way.get(c, (-np.inf, np.inf, 1.0))
        for child, bounds in ((n["leftChild"], (low, min(high, cut))), (n["rightChild"], (max(low, cut), high))):
            to = tree[child]
            walk(tree, to, scale, way | {c: (*bounds, share * (size(to) / size(n) if size(n) else 0.0))})

    for t, tree in nodes.items():
        walk(tree, tree[0], weights[t], {})
    return found


def base_value(found: list[Leaf]) -> float:
    """The ensemble's value where no feature is known: the mean over the training weight."""
    return float(sum(x.value * x.share.prod() for x in found))


def attributed(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values of all features (columns) for rows of their values."""
    out = np.zeros(x.shape)
    for leaf in found:
        m = len(leaf.features)
        if not m:
            continue
        own = x[:, leaf.features]
        kept = (own > leaf.low) & (own <= leaf.high)
        if m <= TABLED:
            if leaf.table is None:
                leaf.table = leaf.attributed((np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float))
            values = leaf.table[kept @ (1 << np.arange(m))]
        else:
            seen, of = np.unique(kept, axis=0, return_inverse=True)
            values = leaf.attributed(seen.astype(float))[of.reshape(-1)]
        out[:, leaf.features] += values
    return out


def tree_shapley(fitted: Fitted, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, base, margin and a column for each feature: its exact Shapley value; margin is the model's output, base plus all of them.

    What a feature is worth in a set of known ones follows the training weight down each tree
    (path-dependent). Unknown values are the medians of the training rows, as in Fitted. The model
    goes to all tasks once; each row is handled by itself.
    """
    spark, names = rows.sparkSession, fitted.features
    held = spark.sparkContext.broadcast(leaves(spark, fitted))
    known = [F.coalesce(F.col(c).cast("double"), F.lit(fitted.medians[c])).alias(c) for c in names]
    d = rows.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = held.value
        base = base_value(found)
        for b in batches:
            x = np.array([b.column(len(keys) + i).to_numpy() for i in range(len(names))], float).reshape(len(names), b.num_rows).T
            values = attributed(found, x)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(np.full(len(x), base)), pa.array(base + values.sum(1)), *(pa.array(values[:, i]) for i in range(len(names)))], [*keys, "base", "margin", *names])

    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return d.mapInArrow(run, ", ".join([*kinds, "base double", "margin double", *(f"`{c}` double" for c in names)]))
