"""Directories of VCF or GFF files as streams: files are parsed as they arrive, and counted by contig.

The sequence-graph store itself is not a stream; these are an extension for watching incoming files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _stream(spark: SparkSession, folder: str, files: int) -> DataFrame:
    return spark.readStream.schema("value string").option("maxFilesPerTrigger", files).text(folder)


def variants(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(chrom, pos, ref, alts) of the records of arriving VCF files."""
    f = _stream(spark, folder, files).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"))


def features(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(chrom, kind, start, end, attributes) of the records of arriving GFF files."""
    f = _stream(spark, folder, files).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[2].alias("kind"), F.col("f")[3].cast("long").alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[8].alias("attributes"))


def density(records: DataFrame, position: str, width: int) -> DataFrame:
    """(chrom, window, n): how many records fall in each window of positions so far."""
    return records.groupBy("chrom", F.floor(F.col(position) / width).alias("window")).agg(F.count("*").alias("n"))
