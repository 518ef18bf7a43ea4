"""Scans and sinks: typed CSV and TSV, Parquet, yearly files, JSON reports, upserts, feature lists."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OCCURRENCES = "gbifID string, species string, individualCount double, decimalLatitude double, decimalLongitude double, coordinateUncertaintyInMeters double, eventDate date, day int, month int, year int"


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share (spark.checkpoint.dir). Where that is unset: a local one for a session on one machine, else ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="panelkit-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",") -> DataFrame:
    """A CSV file with header, of a declared schema; empty fields are null."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue="", emptyValue="")


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, OCCURRENCES, "\t")


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_yearly(spark: SparkSession, path: str, pattern: str = "*.parquet", exclude: str | None = None) -> DataFrame:
    """All files of a pattern as one table, with the year of each file's folder (year=...) or in its name; names that match `exclude` are left out."""
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(path)
    parts = F.split(F.input_file_name(), "/")
    name = F.element_at(parts, -1)
    df = df.withColumn("_name", name).withColumn("_folder", F.element_at(parts, -2))
    if exclude:
        df = df.filter(~F.col("_name").rlike(exclude))
    year = F.coalesce(F.regexp_extract("_folder", r"^year=(\d{4})$", 1).try_cast("int"), F.regexp_extract("_name", r"(?<!\d)(\d{4})(?!\d)", 1).try_cast("int"))
    return df.withColumn("year", year).drop("_name", "_folder")


def read_reports(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """JSON arrays of report objects, one to a file, or one to a line; nested fields stay structs and arrays. A file of lines is read by many tasks."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def stringify_nested(df: DataFrame) -> DataFrame:
    """Struct, array and map columns as JSON text; others as they are."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema))


def date_column(columns: list[str]) -> str | None:
    """The first column whose name speaks of a date or time, else of a year."""
    for part in ("date", "time", "year"):
        for c in columns:
            if part in c.lower():
                return c
    return None


def filter_report_years(df: DataFrame, years: list[int], column: str | None = None) -> DataFrame:
    """Rows whose date or year column falls in years, with report_year."""
    column = column or date_column(df.columns)
    if column is None:
        raise ValueError("no column for a date or a year")
    text = F.col(f"`{column}`").cast("string")
    year = F.coalesce(F.year(F.try_to_timestamp(text)), F.when(text.rlike(r"^\d{4}$"), text.try_cast("int")))
    return df.withColumn("report_year", year).filter(F.col("report_year").isin(*years))


def write_yearly(df: DataFrame, path: str, sort: tuple[str, ...] = ()) -> None:
    """Parquet in one folder for each year, rows of a file in order."""
    # A year isn't one task's: Spark cuts large ones into files of the advised size.
    df = df.hint("rebalance", "year")
    (df.sortWithinPartitions("year", *sort) if sort else df).write.mode("overwrite").partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """One row for each key: of rows with equal keys, those of `new` replace those of `old`; of several of one side, the one with the greatest `latest`, then with the greatest other values, so that reruns agree."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    rest = [f.name for f in both.schema if f.name not in (*keys, "_turn") and not isinstance(f.dataType, T.MapType)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn"), *([F.col(latest).desc_nulls_last()] if latest else []), *(F.col(c).desc_nulls_last() for c in rest)))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_turn")


def unstack_bands(df: DataFrame, variables: list[str], most: float, keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pixels (keys, band, value) with interleaved bands as one row for each day with a column per variable; values above `most` are null."""
    n = len(variables)
    d = df.withColumn("day", F.floor(F.col("band") / n).cast("int")).withColumn("_v", F.pmod("band", F.lit(n)).cast("int"))
    value = F.when(F.col("value") <= most, F.col("value"))
    return d.groupBy(*keys, "day").agg(*(F.max(F.when(F.col("_v") == i, value)).alias(v) for i, v in enumerate(variables)))


@dataclass
class FeatureSpec:
    """Which columns a model may see."""

    static: list[str] = field(default_factory=list)
    dynamic: list[str] = field(default_factory=list)
    seasonal: list[str] = field(default_factory=list)
    never_feed_to_model: list[str] = field(default_factory=list)

    @property
    def model_features(self) -> list[str]:
        banned = set(self.never_feed_to_model)
        return [c for c in [*self.dynamic, *self.seasonal, *self.static] if c not in banned]

    def select(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*keys, *self.model_features)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self) | {"model_features": self.model_features}),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureSpec":
        got = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
        return cls(**{k: got[k] for k in ("static", "dynamic", "seasonal", "never_feed_to_model")})
