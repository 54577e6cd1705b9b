import pytest
from pyspark.sql import functions as F

from strandlake.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("ATCCGG", "CCGGAT"), ("CNNNNA", "TNNNNG"), ("cNNgnAt", "aTncNNg"), ("", "")])
def test_revcomp(spark, text, want):
    assert one(spark, S.revcomp(F.lit(text))) == want


@pytest.mark.parametrize(("a", "want"), [((10, 20, 10, 20), (True, False, True)), ((10, 20, 5, 15), (False, True, True)), ((10, 20, 0, 10), (False, True, False)), ((0, 10, 10, 10), (False, False, False))])
def test_overlap(spark, a, want):
    assert tuple(one(spark, S.overlap_flags(*map(F.lit, a)))) == want


@pytest.mark.parametrize(("text", "want"), [("0/1|2", [(0, False), (1, False), (2, True)]), ("1", [(1, True)]), ("2|.|2", [(2, True), None, (2, True)]), (".", [None])])
def test_genotype(spark, text, want):
    assert [x and tuple(x) for x in one(spark, S.parse_genotype(F.lit(text)))] == want


def test_names(spark):
    assert one(spark, S.train_case(F.lit("myPath_one two"))) == "My-Path-One-Two"
    assert tuple(one(spark, S.region(F.lit("chr1:5-10")))) == ("chr1", 5, 10)
    assert one(spark, S.collection_parent(F.lit("a/b/c/"))) == "a/b"
    assert one(spark, S.collection_parent(F.lit("a"))) is None
    assert one(spark, F.sha2(F.lit("a test"), 256)).startswith("a82639b6")
