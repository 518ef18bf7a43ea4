"""Total orders without one task for all rows: range partitions, their sums, and sums inside each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import materialise


def running(df: DataFrame, order: list[Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """Adds, for each name in sums, the sum of its column over the rows that come before in the order, in each group of `by`.

    Rows are dealt out by ranges of the order and written down; a range's sum is added to the running
    sums inside the ranges after it. The order should be total: of equal rows any may come first.
    """
    by = by or []
    d = materialise(df.repartitionByRange(*map(F.col, by), *order).withColumn("_part", F.spark_partition_id()), "ordered")
    parts = d.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_p"), *(F.sum(f"_s_{n}").over(before).alias(f"_o_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(lambda a, b: a & b, (d[c].eqNullSafe(parts[f"_by_{c}"]) for c in by), d["_part"] == parts["_p"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return d.join(parts, same).select(*df.columns, *((zero(F.col(f"_o_{n}")) + zero(F.sum(c).over(inside))).alias(n) for n, c in sums.items()))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds out, each row's place in the order, from 0."""
    d = running(df.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"})
    return d.drop("_one")


def average_ranks(df: DataFrame, by: list[str], value: str, tie: str, out: str) -> DataFrame:
    """Adds out, the rank of `value` in its group from 1 on; equal values share the mean of their ranks.

    tie tells rows of one group and value apart: rows are dealt out by ranges of both, so that a
    value that very many rows share lies in several ranges. A range's values get their ranks from
    the sums of distinct values and are joined inside the range.
    """
    d = materialise(df.repartitionByRange(*map(F.col, by), value, tie).withColumn("_part", F.spark_partition_id()), "ranked")
    own = materialise(d.groupBy(*by, value, "_part").agg(F.count("*").alias("_n")), "ranked-values")
    placed = running(own.groupBy(*by, value).agg(F.sum("_n").alias("_n")), [F.col(value)], {"_before": "_n"}, by)
    ranks = own.drop("_n").join(placed.withColumn(out, F.col("_before") + (F.col("_n") + 1) / 2).drop("_before", "_n"), [*by, value])
    return d.join(ranks, [*by, value, "_part"]).select(*df.columns, out)


#: Bins of a pass, values at most that are ordered at the end, and passes after which the rest is ordered whatever its number.
BINS, FEW, PASSES = 512, 20_000, 12


def exact_percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, values: each column's exact percentiles in the order of shares, interpolated between neighbours; null without any value.

    The wanted places are closed in on by histograms: each pass counts the values in equal bins of
    the ranges that hold a wanted place, with each bin's least and greatest value, and goes on in the
    bins that hold one. What is shuffled and sent to the driver are counts of bins, whatever the
    number of distinct values; only the last few values around each place are ordered.
    """
    spark, kind = df.sparkSession, "column string, values array<double>"
    d = materialise(df.select(*(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns)), "percentile-columns")
    long = d.unpivot([], columns, "column", "value").filter("value is not null")
    # For each column the ranges (least, greatest, rows before, rows) that hold wanted places.
    ranges = {r["column"]: [(r["a"], r["b"], 0, r["n"])] for r in long.groupBy("column").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).collect()}
    size = {c: x[0][3] for c, x in ranges.items()}
    wanted = {c: sorted({min(n - 1, int((n - 1) * s) + k) for s in shares for k in (0, 1)}) for c, n in size.items()}
    found: dict[tuple[str, int], float] = {}

    def settle() -> None:
        """Leaves the ranges that hold a wanted place which isn't known yet; one value alone is known."""
        for c, own in ranges.items():
            left = []
            for a, b, before, n in own:
                places = [k for k in wanted[c] if before <= k < before + n]
                if a == b:
                    found.update({(c, k): a for k in places})
                elif places:
                    left.append((a, b, before, n))
            ranges[c] = left

    settle()
    for _ in range(PASSES):
        if sum(n for own in ranges.values() for *_, n in own) <= FEW:
            break
        case = [(c, i, r) for c, own in ranges.items() for i, r in enumerate(own)]
        bins = F.lit(None).cast("struct<i:int,k:int>")
        for c, i, (a, b, _, _) in reversed(case):
            k = F.least(F.greatest(F.floor((F.col("value") / 2 - a / 2) * (BINS / (b / 2 - a / 2))).cast("int"), F.lit(0)), F.lit(BINS - 1))
            bins = F.when((F.col("column") == c) & F.col("value").between(a, b), F.struct(F.lit(i).alias("i"), k.alias("k"))).otherwise(bins)
        counts = long.withColumn("_b", bins).filter("_b is not null").groupBy("column", "_b.i", "_b.k").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).collect()
        by: dict[tuple[str, int], list] = {}
        for r in counts:
            by.setdefault((r["column"], r["i"]), []).append(r)
        narrow: dict[str, list] = {c: [] for c in ranges}
        for (c, i), rows in by.items():
            before = ranges[c][i][2]
            for r in sorted(rows, key=lambda r: r["k"]):
                narrow[c].append((r["a"], r["b"], before, r["n"]))
                before += r["n"]
        ranges = narrow
        settle()
    rest = [(c, a, b, before) for c, own in ranges.items() for a, b, before, _ in own]
    if rest:
        inside = F.lit(None).cast("long")
        for c, a, b, before in rest:
            inside = F.when((F.col("column") == c) & F.col("value").between(a, b), F.lit(before)).otherwise(inside)
        counts = long.withColumn("_from", inside).filter("_from is not null").groupBy("column", "_from", "value").agg(F.count("*").alias("_n"))
        placed = running(counts, [F.col("value")], {"_before": "_n"}, ["column", "_from"])
        at = F.col("_from") + F.col("_before")
        near = reduce(lambda x, y: x | y, ((F.col("column") == c) & (at <= k) & (k < at + F.col("_n")) for c, ks in wanted.items() for k in ks if (c, k) not in found))
        for r in placed.filter(near).select("column", "value", at.alias("a"), (at + F.col("_n")).alias("b")).collect():
            found.update({(r["column"], k): r["value"] for k in wanted[r["column"]] if r["a"] <= k < r["b"]})
    out = []
    for c in columns:
        if c in size:
            places = [(size[c] - 1) * s for s in shares]
            pairs = [(found[c, int(p)], found[c, min(size[c] - 1, int(p) + 1)], p - int(p)) for p in places]
            out.append((c, [low + (high - low) * f if f else low for low, high, f in pairs]))
    return spark.createDataFrame(out, kind)
