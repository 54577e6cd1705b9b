"""Paths: ordered edges or blocks, their offsets, and what is read off them.

A block of a path is (path_id, idx, node_id, seq_start, seq_end, strand); with offsets it also has path_start and
path_end. All functions work on any number of paths at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import intervals as I


def blocks_from_edges(path_edges: DataFrame) -> DataFrame:
    """Blocks of paths given as ordered edges (path_id, idx and the edge's six fields).

    Between one edge and the next lies a block: from where the one enters the node to where the next leaves it.
    """
    w = W.partitionBy("path_id").orderBy("idx")
    out = path_edges.withColumn("seq_end", F.lead("source_coordinate").over(w)).where(F.col("seq_end").isNotNull())
    return out.select("path_id", "idx", F.col("target_node").alias("node_id"), F.col("target_coordinate").alias("seq_start"), "seq_end", F.col("target_strand").alias("strand"))


def path_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with path_start and path_end."""
    sized = blocks.withColumn("_len", F.col("seq_end") - F.col("seq_start"))
    return I.with_offsets(sized, ["path_id"], ["idx"], "_len", "path_start", "path_end").drop("_len")


def path_length(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("path_id").agg(F.sum(F.col("seq_end") - F.col("seq_start")).alias("length"))


def path_sequence(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, sequence). nodes: (node_id, sequence). Texts are joined last, cut to the block before the shuffle."""
    text = S.slice_of(F.col("sequence"), F.col("seq_start"), F.col("seq_end"))
    text = F.when(F.col("strand") == "-", S.revcomp(text)).otherwise(text)
    pieces = blocks.join(nodes, "node_id").select("path_id", F.struct("idx", text.alias("text")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["text"]), "")
    return pieces.groupBy("path_id").agg(joined.alias("sequence"))


def subsequence(sequences: DataFrame, start: str, end: str) -> DataFrame:
    """Adds subsequence: [start, end) of each path's sequence, cut at its ends."""
    lo = F.greatest(F.col(start), F.lit(0))
    hi = F.least(F.col(end), F.length("sequence"))
    return sequences.withColumn("subsequence", F.when(hi > lo, S.slice_of(F.col("sequence"), lo, hi)).otherwise(""))


def validate(path_edges: DataFrame) -> DataFrame:
    """(path_id, problem): where consecutive edges do not fit, or a path does not begin at START and finish at END."""
    w = W.partitionBy("path_id").orderBy("idx")
    last = {c: F.lag(c).over(w) for c in ("target_node", "target_strand", "target_coordinate")}
    e = path_edges.withColumns({f"_{c}": x for c, x in last.items()} | {"_after": F.lead("idx").over(w)})
    checks = {
        "node": F.col("_target_node") != F.col("source_node"),
        "strand": F.col("_target_strand") != F.col("source_strand"),
        "coordinate": F.col("_target_coordinate") > F.col("source_coordinate"),
        "start": F.col("_target_node").isNull() & (F.col("source_node") != S.START_NODE),
        "end": F.col("_after").isNull() & (F.col("target_node") != S.END_NODE),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return e.select("path_id", "idx", F.explode(found).alias("problem"))


def block_mappings(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where two paths run over the same bases. a, b: blocks with offsets; pairs: (a_path, b_path).

    One row for each overlap of two blocks of a node: its range on a (source) and on b (target).
    """
    x = a.select(F.col("path_id").alias("a_path"), "node_id", F.col("seq_start").alias("s"), F.col("seq_end").alias("e"), F.col("path_start").alias("a_at"))
    y = b.select(F.col("path_id").alias("b_path"), "node_id", F.col("seq_start").alias("x"), F.col("seq_end").alias("y"), F.col("path_start").alias("b_at"))
    met = I.overlap_join(pairs.join(x, "a_path"), y, ["b_path", "node_id"], ("s", "e"), ("x", "y"))
    lo, hi = F.greatest("s", "x"), F.least("e", "y")
    return met.select(
        "a_path", "b_path", (F.col("a_at") + lo - F.col("s")).alias("source_start"), (F.col("a_at") + hi - F.col("s")).alias("source_end"),
        (F.col("b_at") + lo - F.col("x")).alias("target_start"), (F.col("b_at") + hi - F.col("x")).alias("target_end"),
    )


def propagate(annotations: DataFrame, mappings: DataFrame) -> DataFrame:
    """Annotations (a_path, name, start, end) on the other path: (a_path, b_path, name, start, end).

    The first and the last mapping that the annotation overlaps give its new start and end; an end that a mapping
    holds moves with it, else the mapping's own end is taken. Without a mapping the annotation is dropped.
    """
    met = I.overlap_join(annotations, mappings, ["a_path"], ("start", "end"), ("source_start", "source_end"))
    one = F.struct("source_start", "source_end", "target_start", "target_end")
    ends = met.groupBy("a_path", "b_path", "name", "start", "end").agg(F.min(one).alias("f"), F.max(one).alias("l"))
    holds = lambda m, p: (p >= F.col(f"{m}.source_start")) & (p <= F.col(f"{m}.source_end"))
    start = F.when(holds("f", F.col("start")), F.col("f.target_start") + F.col("start") - F.col("f.source_start")).otherwise(F.col("f.target_start"))
    end = F.when(holds("l", F.col("end")), F.col("l.target_start") + F.col("end") - F.col("l.source_start")).otherwise(F.col("l.target_end"))
    return ends.select("a_path", "b_path", "name", start.alias("start"), end.alias("end"))


def partition_range(ranges: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks of a path inside ranges (path_id, range_id, start, end), cut to them; adjoining ones of a node merged."""
    met = I.overlap_join(ranges, blocks, ["path_id"], ("start", "end"), ("path_start", "path_end"))
    lo, hi = F.greatest("start", "path_start"), F.least("end", "path_end")
    cut = met.select(
        "path_id", "range_id", "node_id", "strand", (F.col("seq_start") + lo - F.col("path_start")).alias("seq_start"),
        (F.col("seq_start") + hi - F.col("path_start")).alias("seq_end"), lo.alias("path_start"), hi.alias("path_end"),
    )
    return I.merge_contiguous(cut, ["path_id", "range_id", "node_id", "strand"], ("path_start", "path_end"), ("seq_start", "seq_end"))


def translate(records: DataFrame, blocks: DataFrame, gff: bool = False) -> DataFrame:
    """Records (path_id, record_id, start, end) as pieces named by node, in path coordinates.

    gff: records count from 1, and blocks are taken from one base later on, as the format's reader does.
    """
    shifted = blocks.withColumn("_from", F.col("path_start") + (1 if gff else 0))
    met = I.overlap_join(records, shifted, ["path_id"], ("start", "end"), ("_from", "path_end"))
    return met.select("path_id", "record_id", F.col("node_id").cast("string").alias("name"), F.greatest("start", "_from").alias("start"), F.least("end", "path_end").alias("end"))


def with_replacement(path_edges: DataFrame, edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges of new paths: an edit (path_id, start, end, edge_in, edge_out) replaces those between its two blocks.

    Kept are the edges up to the block that holds the start and from the block that holds the end on. Returns
    (path_id, idx, edge_id), numbered anew.
    """
    at = lambda p, name: I.point_join(edits, p, blocks.select("path_id", F.col("idx").alias(name), "path_start", "path_end"), ["path_id"], ("path_start", "path_end")).select("path_id", name)
    both = edits.join(at("start", "first"), "path_id").join(at("end", "last"), "path_id")
    kept = path_edges.select("path_id", F.col("idx").cast("double").alias("at"), "edge_id").join(both.select("path_id", "first", "last"), "path_id")
    kept = kept.where((F.col("at") <= F.col("first")) | (F.col("at") > F.col("last"))).select("path_id", "at", "edge_id")
    new = both.select("path_id", F.explode(F.array(F.struct((F.col("first") + 0.25).alias("at"), F.col("edge_in").alias("edge_id")), F.struct((F.col("first") + 0.5).alias("at"), F.col("edge_out").alias("edge_id")))).alias("x")).select("path_id", "x.at", "x.edge_id")
    return kept.unionByName(new).withColumn("idx", F.row_number().over(W.partitionBy("path_id").orderBy("at")) - 1).select("path_id", "idx", "edge_id")


def accession_edges(accessions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edges of named parts of paths, in order: (path_id, name, idx, the edge's six fields).

    accessions: (path_id, name, start, end). START leads to where the part begins, its blocks follow each other, and
    the block that holds the end, or stops there, leads to END; both terminals have the coordinate -1.
    """
    length = path_length(blocks)
    asked = accessions.join(length, "path_id").where((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length")))
    asked = asked.withColumn("_to", F.least(F.col("end") + 1, F.col("length"))).drop("length")
    met = I.overlap_join(asked, blocks, ["path_id"], ("start", "_to"), ("path_start", "path_end"))
    w = W.partitionBy("path_id", "name").orderBy("idx")
    at = lambda c: F.col(c) - F.col("path_start") + F.col("seq_start")
    plus, outside = F.lit("+"), F.lit(-1).cast("long")
    first = F.lag("idx").over(w).isNull()
    row = met.select(
        "path_id", "name", "idx", (F.row_number().over(w) - 1).cast("long").alias("k"), F.lead("idx").over(w).isNull().alias("last"),
        F.struct(
            F.coalesce(F.lag("node_id").over(w), F.lit(S.START_NODE).cast("long")).alias("source_node"), F.coalesce(F.lag("seq_end").over(w), outside).alias("source_coordinate"), F.coalesce(F.lag("strand").over(w), plus).alias("source_strand"),
            F.col("node_id").alias("target_node"), F.when(first, at("start")).otherwise(F.col("seq_start")).alias("target_coordinate"), F.when(first, plus).otherwise(F.col("strand")).alias("target_strand")).alias("into"),
        F.struct(F.col("node_id").alias("source_node"), at("end").alias("source_coordinate"), plus.alias("source_strand"), F.lit(S.END_NODE).cast("long").alias("target_node"), outside.alias("target_coordinate"), plus.alias("target_strand")).alias("out"))
    ends = row.where("last").select("path_id", "name", (F.col("k") + 1).alias("idx"), "out.*")
    return row.select("path_id", "name", F.col("k").alias("idx"), "into.*").unionByName(ends)
