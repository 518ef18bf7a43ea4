"""The bootstrap against plain loops."""

import hashlib
import random
from collections import Counter

import pytest

from panelkit.operators import verification as v


def plain(rows):
    """roc_auc, pr_auc, brier of (p, y, times), by definition."""
    pos, neg = sum(t for _, y, t in rows if y), sum(t for _, y, t in rows if not y)
    area = sum(t * u * ((p > q) + (p == q) / 2) for p, y, t in rows if y for q, z, u in rows if not z)
    ap = sum(t / pos * sum(u for q, z, u in rows if z and q >= p) / sum(u for q, z, u in rows if q >= p) for p, y, t in rows if y) if pos else None
    return (area / (pos * neg) if pos and neg else None, ap if pos and neg else None, sum(t * (p - y) ** 2 for p, y, t in rows) / (pos + neg))


@pytest.mark.parametrize("at_once, block", [(4_000_000, 1_000_000), (40, 30), (1, 1)])
def test_every_replicate_against_plain_sums(spark, monkeypatch, at_once, block):
    monkeypatch.setattr(v, "WEIGHTS_AT_ONCE", at_once)
    monkeypatch.setattr(v, "BLOCK", block)
    r = random.Random(6)
    units = ["a", "b", "c", "d", "e"]
    rows = [(r.choice(["x", None]), r.choice(units), r.choice([r.random(), 0.5, 0.25]), int(r.random() < 0.4)) for _ in range(150)]
    df = spark.createDataFrame([*rows, ("x", "a", None, 1), ("x", None, 0.4, 1), ("x", "b", 0.1, None)], "m string, unit string, p double, y int")
    got = {(g.m, g.replicate): g for g in v.bootstrap_scores(df, "unit", 12, by=["m"]).collect()}
    names = sorted(units)
    for k in range(12):
        h = lambda i: int(hashlib.md5(f"42|{k}|{i}".encode()).hexdigest()[:8], 16)
        times = Counter(names[h(i) % 5] for i in range(5))
        for m in ("x", None):
            own = [(p, y, times[u]) for n, u, p, y in rows if n == m and times[u]]
            if own:
                g = got[m, k]
                assert (g.roc_auc, g.pr_auc, g.brier) == pytest.approx(plain(own))
    ci = v.block_bootstrap(df, "unit", 12, by=["m"]).filter("m is null and metric = 'brier'").first()
    assert ci.point == pytest.approx(plain([(p, y, 1) for n, _, p, y in rows if n is None])[2]) and ci.lo < ci.point < ci.hi and ci.n_boot == 12


def test_one_class_and_no_rows(spark):
    df = spark.createDataFrame([("a", 0.2, 1), ("b", 0.4, 1)], "unit string, p double, y int")
    rows = {r.metric: r for r in v.block_bootstrap(df, "unit", 5).collect()}
    assert rows["roc_auc"].point is None and rows["roc_auc"].n_boot == 0 and rows["brier"].n_boot == 5
    assert v.bootstrap_scores(df.limit(0), "unit", 5).count() == 0
