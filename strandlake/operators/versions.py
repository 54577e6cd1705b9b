"""Operations: ancestry, branches, moves between versions, and what a change depends on.

An operation is (op, parent, branch). Parents are followed in rounds over all asked operations at once, with
doubling steps, so that a log of n operations needs about log2(n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.session import materialized


def ancestors(ops: DataFrame, asked: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(op, ancestor, depth): each asked operation (op) with itself, its parent, and so on.

    Jumps of 1, 2, 4 ... steps double: the ancestors within 2k steps are those within k, and theirs k steps up.
    """
    jump = materialized(ops.where(F.col("parent").isNotNull()).select(F.col("op").alias("ancestor"), F.col("parent").alias("up")))
    seen = materialized(asked.select("op", F.col("op").alias("ancestor"), F.lit(0).cast("long").alias("depth")).distinct())
    size = 1
    for _ in range(most_rounds):
        more = materialized(seen.join(jump, "ancestor").select("op", F.col("up").alias("ancestor"), (F.col("depth") + size).alias("depth")))
        if not more.head(1):
            return seen
        seen = materialized(seen.unionByName(more))
        jump = materialized(jump.join(jump.select(F.col("ancestor").alias("up"), F.col("up").alias("far")), "up").select("ancestor", F.col("far").alias("up")))
        size *= 2
    raise RuntimeError("the operations do not end")


def unmasked(ops: DataFrame, masked: DataFrame) -> DataFrame:
    """Operations that no mask hides; those whose parent is hidden lose it."""
    kept = ops.join(masked.select("op"), "op", "left_anti")
    hidden = masked.select(F.col("op").alias("parent"), F.lit(True).alias("_hidden"))
    return kept.join(hidden, "parent", "left").withColumn("parent", F.when(F.col("_hidden").isNull(), F.col("parent"))).drop("_hidden").select(*ops.columns)


def branch_operations(ops: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch, op, place): a branch's operations, oldest first. branches: (branch, current)."""
    up = ancestors(ops, branches.select(F.col("current").alias("op")))
    named = branches.join(up.withColumnRenamed("op", "current"), "current")
    most = named.groupBy("branch").agg(F.max("depth").alias("most"))
    return named.join(most, "branch").select("branch", F.col("ancestor").alias("op"), (F.col("most") - F.col("depth")).alias("place"))


def path_between(ops: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, step, op, direction): operations to revert (up from the source) and to apply (down to the target).

    pairs: (source, target). What both have as ancestors stays.
    """
    asked = pairs.select(F.col("source").alias("op")).unionByName(pairs.select(F.col("target").alias("op"))).distinct()
    up = ancestors(ops, asked)
    a = pairs.join(up.select(F.col("op").alias("source"), "ancestor", F.col("depth").alias("da")), "source")
    b = pairs.join(up.select(F.col("op").alias("target"), "ancestor", F.col("depth").alias("db")), "target")
    key = ["source", "target", "ancestor"]
    revert = a.join(b.select(*key), key, "left_anti").select("source", "target", "da", F.col("ancestor").alias("op"))
    apply_ = b.join(a.select(*key), key, "left_anti").select("source", "target", "db", F.col("ancestor").alias("op"))
    n = revert.groupBy("source", "target").agg(F.count("*").alias("n"))
    size = apply_.groupBy("source", "target").agg(F.count("*").alias("m"))
    down = apply_.join(size, ["source", "target"]).join(n, ["source", "target"], "left").select("source", "target", (F.coalesce("n", F.lit(0)) + F.col("m") - 1 - F.col("db")).alias("step"), "op", F.lit("apply").alias("direction"))
    return revert.select("source", "target", F.col("da").alias("step"), "op", F.lit("revert").alias("direction")).unionByName(down)


def merge_operations(ops: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, place, op): the other's operations that the current one lacks, in the order to apply them."""
    return path_between(ops, pairs).where("direction = 'apply'").select("source", "target", "step", "op")


def changeset(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two snapshots that differ: keys, change (insert, delete or update), and a hash of the new row."""
    rest = [c for c in after.columns if c not in keys]
    digest = lambda df: df.select(*keys, F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256).alias("row"))
    both = digest(before).withColumnRenamed("row", "old").join(digest(after).withColumnRenamed("row", "new"), keys, "full")
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update")
    return both.withColumn("change", kind).where("change is not null").select(*keys, "change", F.col("new").alias("row"))


def dependencies(created: DataFrame, key: str, references: dict[str, DataFrame]) -> DataFrame:
    """(table, id): rows that created ones refer to without being created with them.

    references: for each table the (id) rows of it that were created together; created has a column table_id for each.
    """
    out = None
    for name, own in references.items():
        need = created.where(F.col(f"{name}_id").isNotNull()).select(F.col(f"{name}_id").alias("id")).distinct().join(own.select("id"), "id", "left_anti").select(F.lit(name).alias("table"), "id")
        out = need if out is None else out.unionByName(need)
    return out


def remapped(rows: DataFrame, column: str, *maps: DataFrame) -> DataFrame:
    """A column of ids put through maps (old, new): the first map that knows an id gives its new one."""
    out, names = rows, []
    for i, m in enumerate(maps):
        names.append(f"_new{i}")
        out = out.join(m.select(F.col("old").alias(f"_old{i}"), F.col("new").alias(names[-1])), F.col(column) == F.col(f"_old{i}"), "left").drop(f"_old{i}")
    return out.withColumn(column, F.coalesce(*names, column)).drop(*names)
