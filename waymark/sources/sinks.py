"""Writers of results: datasets, rounds of a rollout, requests, tables and settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns become JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_round(df: DataFrame, path: str, step: int) -> None:
    """One round of an iterative job: rounds are appended, never rewritten.

    A round that is written again after a failure replaces itself.
    """
    df.write.mode("overwrite").parquet(f"{path}/round={step}")


def write_dataset(df: DataFrame, path: str) -> None:
    """A dataset with a folder for each value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """One JSON text file, through Spark's file systems."""
    spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def request_lines(df: DataFrame, id_col: str = "custom_id", messages_col: str = "messages", **settings) -> DataFrame:
    """(value): a JSON request for each row; a trailing assistant message is left out."""
    last = F.try_element_at(messages_col, F.lit(-1))
    open_ended = F.coalesce(last["role"] == "assistant", F.lit(False))
    sent = F.when(open_ended, F.slice(F.col(messages_col), F.lit(1), F.size(messages_col) - 1)).otherwise(F.col(messages_col))
    body = F.struct(sent.alias("messages"), *(F.lit(v).alias(k) for k, v in sorted(settings.items())))
    return df.select(F.to_json(F.struct(F.col(id_col).alias("custom_id"), body.alias("body"))).alias("value"))


def write_requests(df: DataFrame, path: str, **settings) -> None:
    request_lines(df, **settings).write.mode("overwrite").text(path)
