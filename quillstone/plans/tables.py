"""The tables of a scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.session import bounded_batches, spread

#: Tables whose rows are texts.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in TEXTS else found
