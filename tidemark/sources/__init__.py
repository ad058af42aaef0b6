"""Readers and writers by file kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: csv and txt with a header and inferred types, json lines, anything else as Parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if end in ("csv", "txt"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if end in ("json", "jsonl"):
        return spark.read.json(path)
    if end == "feather":
        raise ValueError("Spark has no reader for feather files: convert the file to Parquet first")
    return spark.read.parquet(path)


def load_pair(spark: SparkSession, train: str, test: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Train and test tables, the test without a label."""
    a, b = read_table(spark, train), read_table(spark, test)
    return a, b.drop(label)


def select_features(train: DataFrame, test: DataFrame, leave: tuple[str, ...] = ("label", "timestamp")) -> list[str]:
    """Numeric columns of train that test has too, in train's order."""
    also = set(test.columns)
    return [f.name for f in train.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave and f.name in also]


def write_predictions(pred: DataFrame, sample: DataFrame, id_col: str, target: str, path: str) -> DataFrame:
    """Writes the sample with the predictions in its target column; (rows, mean, sd). Raises if rows do not match or a value is not finite.

    pred: (id, pred).
    """
    out = sample.drop(target).join(pred.select(id_col, F.col("pred").alias(target)), id_col, "inner")
    bad = F.isnan(target) | F.col(target).isNull() | (F.abs(target) == float("inf"))
    facts = out.agg(F.count("*").alias("rows"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("sd"), F.count_if(bad).alias("bad"))
    row = facts.first()
    if row["rows"] != sample.count() or row["rows"] != pred.count():
        raise ValueError(f"{row['rows']} predictions match, the sample has {sample.count()} rows")
    if row["bad"]:
        raise ValueError(f"{row['bad']} predictions are not finite")
    out.write.mode("overwrite").csv(path, header=True)
    return facts.drop("bad")


def union_reports(*tables: DataFrame) -> DataFrame:
    """One table with every column in first-seen order, null where a part lacks it."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_report(path: str, *tables: DataFrame) -> DataFrame:
    """Writes the tables as one (see union_reports) and gives it back; columns that CSV cannot hold are written as JSON."""
    out = union_reports(*tables)
    flat = {f.name: F.to_json(f.name) for f in out.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    out.withColumns(flat).write.mode("overwrite").csv(path, header=True)
    return out


def map_to_sample(pred: DataFrame, sample: DataFrame, target: str) -> DataFrame:
    """The sample with the predictions of its rows, by place, in column `target`; raises if there are not as many predictions as rows, or a place has none.

    pred: (row_idx, pred); sample: row_idx and its own columns.
    """
    n, rows = pred.count(), sample.count()
    if n != rows:
        raise ValueError(f"prediction length mismatch: {n} predictions, {rows} rows")
    out = sample.drop(target).join(pred.select("row_idx", F.col("pred").alias(target)), "row_idx")
    if out.count() != rows:
        raise ValueError("prediction places do not match those of the sample")
    return out
