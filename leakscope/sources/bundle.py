"""Targets on disk: a JSON manifest beside one Parquet folder of records; arrays from CSV and Parquet.

Nothing is unpickled and no module is imported by path.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest"
#: Columns of the records of a target.
RECORD_COLUMNS = ("record_id", "is_member", "y", "features", "probs", "raw")


def save_target(records: DataFrame, path: str, manifest: dict, dataset: str | None = None, model=None, model_name: str | None = None) -> None:
    """Write a target, with its fitted model if there is one. With a registered dataset named, only ids and membership are written; the rest is read again from it."""
    kept = records if dataset is None else records.select("record_id", "is_member")
    kept.write.mode("overwrite").parquet(f"{path}/records")
    spark = records.sparkSession
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
    text = json.dumps(manifest | {"dataset": dataset, "columns": kept.columns, "model_name": model_name if model is not None else None})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{MANIFEST}")


def load_target(spark: SparkSession, path: str, datasets: dict | None = None) -> tuple[DataFrame, dict]:
    """Records and manifest; datasets: readers by name, each a function of the session."""
    manifest = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
    records = spark.read.parquet(f"{path}/records")
    if manifest.get("dataset"):
        if not datasets or manifest["dataset"] not in datasets:
            raise ValueError(f"no reader registered for dataset {manifest['dataset']}")
        records = subset(datasets[manifest["dataset"]](spark).drop("is_member"), records)
    return records, manifest


def load_model(path: str, manifest: dict):
    """The model saved with a target, or nothing."""
    from leakscope.operators import models

    return models.load(manifest["model_name"], f"{path}/model") if manifest.get("model_name") else None


def to_arrays(df: DataFrame, columns: list[str], max_rows: int = 1_000_000) -> dict:
    """Columns as NumPy arrays on the driver; arrays of one length become matrices. More rows than max_rows are refused."""
    import numpy as np

    rows = df.select(*columns).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows do not become arrays on the driver")
    return {c: np.array(rows[c].tolist()) for c in columns}


def from_arrays(spark: SparkSession, arrays: dict) -> DataFrame:
    """A table of arrays of one length, with row_no; matrices become array columns."""
    import pandas as pd

    sizes = {len(a) for a in arrays.values()}
    if len(sizes) > 1:
        raise ValueError("the arrays differ in length")
    return spark.createDataFrame(pd.DataFrame({"row_no": range(sizes.pop() if sizes else 0), **{k: list(map(lambda v: v.tolist(), a)) for k, a in arrays.items()}}))


def read_array(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """(row_no, values array<double>) of a headerless CSV, or a Parquet folder as it is; other suffixes are an error."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if not path.endswith(".csv"):
        raise ValueError(f"unsupported file extension: {path}")
    rows = spark.read.csv(path, header=False, inferSchema=False)
    values = F.array(*[F.col(c).try_cast("double") for c in rows.columns])
    ordered = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row_no"), values.alias("values"))
    return ordered.select("row_no", "values")


def subset(df: DataFrame, ids: DataFrame, record: str = "record_id") -> DataFrame:
    """The rows of ids, with their membership if ids has it."""
    if "is_member" in ids.columns:
        return df.join(ids.select(record, "is_member"), record)
    return df.join(ids.select(record), record, "left_semi")


def combine(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both splits, labelled by is_member; columns that one side lacks are null."""
    return train.withColumn("is_member", F.lit(1)).unionByName(test.withColumn("is_member", F.lit(0)), allowMissingColumns=True)


def feature_dictionary(spark: SparkSession, features: dict) -> DataFrame:
    """{id: {name, indices, encoding}} as a table."""
    rows = [(int(i), f["name"], [int(x) for x in f["indices"]], f["encoding"]) for i, f in features.items()]
    return spark.createDataFrame(rows, "feature_id int, name string, indices array<int>, encoding string")
