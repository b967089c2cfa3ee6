"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.session import prepare, shared_folder, written

__all__ = ["blank", "free_name", "fresh_path", "no_links", "prepare", "read_table", "shared_folder", "written", "written_dense"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank(column: str | Column) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared folder."""
    return f"{shared_folder(spark)}/sessionloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}/{name}"


def written_dense(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, in a denser codec: for whole texts and other large tables that are read a few times."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_links(spark: SparkSession) -> DataFrame:
    """``a, b`` without rows, known to the optimizer as empty; ``createDataFrame`` would start Python workers to read none."""
    return spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b")).where(F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of the table has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
