"""Interval joins whose rows are few: intervals meet in bins of their own size.

A right interval belongs to the class of the power of two that its length doesn't exceed, and lies in two bins of that width at most. A left
one looks into the bins of each class that there is. A pair that meets in several bins counts in the first one that both have.
So what is exchanged is linear in the intervals and their hits where left ones aren't much longer than right ones, and one key's
intervals are spread over its bins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The narrowest bins are two to this power wide.
LEAST_CLASS = 8


def _bin(at: Column, of_class: Column) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), of_class)).cast("long")


def _bins(start: Column, stop: Column, of_class: Column) -> Column:
    return F.explode(F.sequence(_bin(start, of_class), _bin(F.greatest(start, stop - 1), of_class)))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], least_class: int = LEAST_CLASS) -> DataFrame:
    """All pairs of left (keys, start, stop) and right (keys, from_, to_) with from_ < stop and to_ > start, with the other columns of both.

    Positions are integers, ends exclusive. An empty interval overlaps what it lies inside of. Rows with a null position or key have no pairs; repeated rows
    have pairs each for itself.
    """
    size = F.greatest(F.lit(1), F.col("to_") - F.col("from_"))
    classed = right.withColumn("class_", F.greatest(F.lit(least_class), F.ceil(F.log2(size.cast("double")))).cast("int"))
    binned = classed.withColumn("bin_", _bins(F.col("from_"), F.col("to_"), F.col("class_")))
    classes = classed.select("class_").where("class_ IS NOT NULL").distinct()  # 63 at most
    looking = left.join(F.broadcast(classes)).withColumn("bin_", _bins(F.col("start"), F.col("stop"), F.col("class_")))
    pairs = looking.join(binned, [*keys, "class_", "bin_"]).where("from_ < stop AND to_ > start")
    first = F.greatest(_bin(F.col("start"), F.col("class_")), _bin(F.col("from_"), F.col("class_")))
    return pairs.where(F.col("bin_") == first).drop("class_", "bin_")
