"""Joins and windows over half-open intervals.

Every join has an equi key. As one key can hold very many intervals (a whole chromosome), both sides are dealt to
bins of positions as well, so that no task meets all intervals of a key with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bases of a bin. A bin holds at most as many blocks of a path, and a genome of 3e9 bases has 730,000 bins.
BIN = 4096


def _bins(df: DataFrame, start: Column, last: Column, bin_size: int) -> DataFrame:
    """A row for each bin of positions from start to last."""
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(start / bin_size), F.floor(last / bin_size))))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Rows of a with the rows of b of the same keys whose [start, end) overlaps; b's keys are dropped.

    bin_size: bases a bin; a pair that meets in several bins is kept in the first of them. Column names of the two
    sides must differ but for the keys.
    """
    (s, e), (x, y) = a_range, b_range
    meets = (F.col(s) < F.col(y)) & (F.col(x) < F.col(e))
    a = _bins(a, F.col(s), F.greatest(F.col(e), F.col(s) + 1) - 1, bin_size)
    b = _bins(b, F.col(x), F.greatest(F.col(y), F.col(x) + 1) - 1, bin_size)
    first = F.col("_bin") == F.floor(F.greatest(F.col(s), F.col(x)) / bin_size)
    return a.join(b, [*keys, "_bin"]).where(meets & first).drop("_bin")


def point_join(points: DataFrame, point: str, blocks: DataFrame, keys: list[str], block_range: tuple[str, str], bin_size: int = BIN) -> DataFrame:
    """Each point with the block [start, end) of its keys that holds it; points in no block are left out."""
    x, y = block_range
    points = points.withColumn("_bin", F.floor(F.col(point) / bin_size))
    blocks = _bins(blocks, F.col(x), F.greatest(F.col(y), F.col(x) + 1) - 1, bin_size)
    return points.join(blocks, [*keys, "_bin"]).where((F.col(point) >= F.col(x)) & (F.col(point) < F.col(y))).drop("_bin")


def consecutive(df: DataFrame, keys: list[str], point: str, start: str, end: str) -> DataFrame:
    """[p_i, p_i+1) of the distinct sorted points of each key. A single point gives nothing."""
    w = W.partitionBy(*keys).orderBy(point)
    return df.select(*keys, point).distinct().withColumn(end, F.lead(point).over(w)).where(F.col(end).isNotNull()).withColumnRenamed(point, start)


def with_offsets(df: DataFrame, keys: list[str], order: list[str], length: str, start: str, end: str) -> DataFrame:
    """Running start and end of pieces laid one after another."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(end, F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(start, F.col(end) - F.col(length))


def merge_contiguous(df: DataFrame, keys: list[str], first: tuple[str, str], second: tuple[str, str] | None = None) -> DataFrame:
    """Merges ranges that adjoin, in the order of their start; with a second pair of columns, both must adjoin."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c) for c in (first + (second or ()))])
    goes_on = F.lag(first[1]).over(w) == F.col(first[0])
    if second:
        goes_on &= F.lag(second[1]).over(w) == F.col(second[0])
    df = df.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = [x for pair in (first, second) if pair for x in (F.min(pair[0]).alias(pair[0]), F.max(pair[1]).alias(pair[1]))]
    return df.groupBy(*keys, "_island").agg(*out).drop("_island")


def chunk_ranges(points: DataFrame, keys: list[str], point: str, length: str) -> DataFrame:
    """Break points to consecutive ranges from 0 to the length, empty ones left out. points: keys, point, length."""
    every = points.select(*keys, length, F.col(point).alias("end")).unionByName(points.select(*keys, length, F.col(length).alias("end"))).where((F.col("end") > 0) & (F.col("end") <= F.col(length))).distinct()
    w = W.partitionBy(*keys).orderBy("end")
    return every.withColumn("start", F.lag("end", 1, 0).over(w)).withColumn("chunk", F.row_number().over(w).cast("bigint")).select(*keys, "chunk", "start", "end")
