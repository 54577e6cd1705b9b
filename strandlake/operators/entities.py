"""Get-or-create on the tables of a store: rows that are not there yet are appended, and every row gets its id.

Ids come from hashes of natural keys (functions.scalars.key_number), so that no counter has to be shared and a row
has the same id wherever it is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import scalars as S


def _safe(keys: list[str]):
    """A join key that takes nulls as equal."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def upsert(existing: DataFrame, candidates: DataFrame, keys: list[str], ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(all rows, candidates with their ids). Nulls in keys are equal to each other; candidates may repeat."""
    asked = candidates.withColumn("_k", _safe(keys))
    known = existing.withColumn("_k", _safe(keys)).select("_k", F.col(ident).alias("_id"))
    first = W.partitionBy("_k").orderBy(*[F.col(c).asc_nulls_first() for c in candidates.columns])
    new = asked.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(known, "_k", "left_anti").withColumn(ident, S.key_number(F.col("_k")))
    rows = existing.unionByName(new.select(*existing.columns))
    ids = known.unionByName(new.select("_k", F.col(ident).alias("_id")))
    return rows, asked.join(ids, "_k").withColumn(ident, F.col("_id")).drop("_k", "_id")


def upsert_edges(existing: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    return upsert(existing, candidates, ["source_node", "source_coordinate", "source_strand", "target_node", "target_coordinate", "target_strand"], "edge_id")


def sequences(records: DataFrame) -> DataFrame:
    """Distinct sequences of records (sequence_type, sequence, name, file_path) with hash and length."""
    kind = S.sequence_hash(*[F.col(c) for c in ("sequence_type", "sequence", "name", "file_path")])
    return records.select("sequence_type", "sequence", "name", "file_path", kind.alias("hash"), F.length("sequence").cast("long").alias("length")).dropDuplicates(["hash"])


def edges_for_graphs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of graphs: members (bg, edge_id, chromosome_index, phased) with the edges' fields."""
    return members.join(edges, "edge_id")


def cloned(members: DataFrame, copies: DataFrame) -> DataFrame:
    """Membership rows of copied graphs. copies: (old, new)."""
    return members.join(copies, F.col("bg") == F.col("old")).drop("bg", "old").withColumnRenamed("new", "bg").select(*members.columns)


def child_graphs(graphs: DataFrame, children: DataFrame) -> DataFrame:
    """Graphs of child samples: a copy of each graph of the parent. graphs: (id, collection, sample, name);
    children: (collection, parent, sample), a null parent standing for the reference."""
    p = graphs.select(F.col("id").alias("old"), F.col("collection").alias("_c"), F.col("sample").alias("_s"), "name")
    made = children.join(p, (F.col("collection") == F.col("_c")) & F.col("parent").eqNullSafe(F.col("_s")))
    return made.select("old", "collection", "sample", "name").withColumn("id", S.key_number(F.concat_ws("/", "collection", "sample", "name")))


def current_paths(paths: DataFrame, keys: list[str]) -> DataFrame:
    """The newest path of each graph (largest path_id)."""
    newest = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("path_id").desc()))
    return paths.withColumn("_n", newest).where("_n = 1").drop("_n")


def paths_of(paths: DataFrame, collection: str, sample: str | None) -> DataFrame:
    """Paths of a collection and sample; a null sample is the reference."""
    return paths.where((F.col("collection") == collection) & F.col("sample").eqNullSafe(F.lit(sample)))


def operation_files(additions: DataFrame, used: DataFrame) -> DataFrame:
    """Files (id and further fields) with the operations that use them (file_addition_id, operation_hash), null where none does."""
    return additions.join(used.withColumnRenamed("file_addition_id", "id"), "id", "left")


def graphs_with_edges(graphs: DataFrame, members: DataFrame, edges: DataFrame, sample: str) -> DataFrame:
    """All graphs with the edges of one sample's: the sample is part of the join, not a filter."""
    wanted = members.withColumn("_sample", F.lit(sample))
    return graphs.join(wanted, (graphs["id"] == wanted["bg"]) & (graphs["sample"] == wanted["_sample"]), "left").drop("_sample", "bg").join(edges, "edge_id", "left").distinct()


def explorer(graphs: DataFrame, place: str) -> DataFrame:
    """(kind, name, n): what a collection shows: its reference graphs, its samples with their graphs, and the
    collections directly below it."""
    inside = graphs.where(F.col("collection") == place)
    reference = inside.where("sample is null").groupBy(F.col("name")).agg(F.count("*").alias("n")).select(F.lit("reference").alias("kind"), "name", "n")
    samples = inside.where("sample is not null").groupBy(F.col("sample").alias("name")).agg(F.count("*").alias("n")).select(F.lit("sample").alias("kind"), "name", "n")
    below = graphs.where(F.col("collection").startswith(place + "/")).withColumn("name", F.split_part(F.substr("collection", F.lit(len(place) + 2)), F.lit("/"), F.lit(1)))
    below = below.groupBy("name").agg(F.count("*").alias("n")).select(F.lit("collection").alias("kind"), "name", "n")
    return reference.unionByName(samples).unionByName(below)
