"""Attributions of trees against the enumeration of all sets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.operators import attribution, models

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.range(400).select("id", *(F.rand(i).alias(c) for i, c in enumerate(NAMES)))
    d = d.withColumn("presence", (F.col("a") + F.col("b") * F.col("c") > 0.8).cast("int")).withColumn("mean_log_count", F.col("a") * F.col("d")).withColumn("n_events", (F.col("id") % 5).cast("int"))
    return models.materialise(d.withColumn("d", F.when(F.col("id") % 7 != 0, F.col("d"))), "attribution-rows")


def enumerated(found, x):
    """Shapley values by definition, from the worth of every set of known features."""

    def worth(known):
        total = 0.0
        for leaf in found:
            v = leaf.value
            for c, low, high, share in zip(leaf.features, leaf.low, leaf.high, leaf.share):
                v *= (low < x[c] <= high) if c in known else share
            total += v
        return total

    out, n = [], len(x)
    for j in range(n):
        others = [i for i in range(n) if i != j]
        out.append(sum(factorial(k) * factorial(n - 1 - k) / factorial(n) * (worth({*s, j}) - worth({*s})) for k in range(n) for s in combinations(others, k)))
    return out


@pytest.mark.parametrize("make, output", [(models.boosted_classifier, "margin"), (models.forest_classifier, "p"), (models.boosted_regressor, "p")])
@pytest.mark.parametrize("tabled", [6, 1])
def test_values_against_all_sets_and_their_sum(spark, rows, monkeypatch, make, output, tabled):
    monkeypatch.setattr(attribution, "TABLED", tabled)
    how = {"maxDepth": 4, **({"numTrees": 6} if make is models.forest_classifier else {"maxIter": 6})}
    fitted = models.fit(rows, NAMES, lambda: make(**how))
    found = attribution.leaves(spark, fitted)
    scored = fitted.raw(rows, "p")
    got = {r.id: r for r in attribution.tree_shapley(fitted, rows, ["id"]).collect()}
    assert len(got) == 400
    p = {r.id: r.p for r in scored.collect()}
    for r in got.values():
        want = p[r.id] if output == "p" else np.log(p[r.id] / (1 - p[r.id])) / 2  # of the margin m, p is 1 / (1 + exp(-2 m))
        assert r.margin == pytest.approx(want, abs=1e-9) and r.margin - r.base == pytest.approx(sum(r[c] for c in NAMES), abs=1e-12)
    for r in rows.filter("id < 15").collect():
        x = [r[c] if r[c] is not None else fitted.medians[c] for c in NAMES]
        assert [got[r.id][c] for c in NAMES] == pytest.approx(enumerated(found, x), abs=1e-12)


def test_extra_columns_and_empty_rows(spark, rows):
    fitted = models.fit(rows, NAMES, lambda: models.forest_classifier(numTrees=2, maxDepth=2))
    d = rows.withColumn("base", F.lit("x")).withColumn("key", F.lit(None).cast("string"))
    assert attribution.tree_shapley(fitted, d, ["id", "key"]).columns == ["id", "key", "base", "margin", *NAMES]
    assert attribution.tree_shapley(fitted, rows.limit(0), ["id"]).count() == 0


def test_background_of_a_bounded_size(spark, rows):
    fitted = models.fit(rows, NAMES, lambda: models.forest_classifier(numTrees=2, maxDepth=2))
    with pytest.raises(ValueError):
        models.shapley(fitted, rows.filter("id < 5"), rows, ["id"])
    got = models.shapley(fitted, rows.filter("id < 5"), models.background_sample(rows, 20, ["id"]), ["id"])
    assert got.count() == 20
