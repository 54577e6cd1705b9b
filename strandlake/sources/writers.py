"""Records as lines of text formats, and writers of such lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import graph


def fasta_lines(name: Column, sequence: Column, width: int = 80) -> Column:
    """A FASTA record: the name, then the sequence in lines of a width."""
    wrapped = F.rtrim(F.regexp_replace(sequence, f"(.{{1,{width}}})", "$1\n"), F.lit("\n"))
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped)


def bed_lines(records: DataFrame, rest: str | None = None) -> DataFrame:
    cols = ["name", F.col("start").cast("string"), F.col("end").cast("string")] + ([rest] if rest else [])
    return records.select(F.concat_ws("\t", *cols).alias("value"))


def gff_lines(records: DataFrame) -> DataFrame:
    """Nine columns; start and end as they are."""
    return records.select(F.concat_ws("\t", "name", "source", "kind", F.col("start").cast("string"), F.col("end").cast("string"), "score", "strand", "phase", "attributes").alias("value"))


def gfa_lines(split: DataFrame, linked: DataFrame, projected: DataFrame, nodes: DataFrame, names: DataFrame, max_size: int | None = None) -> DataFrame:
    """(bg, kind, value): S, L and P lines of graphs.

    split: blocks; linked: block edges; projected: projected paths with bg; names: (path_id, name). Blocks longer
    than max_size are written as several segments, linked one to the next.
    """
    inner = split.where(~S.is_terminal(F.col("node_id")))
    size = max_size or (1 << 62)

    def cut(df: DataFrame) -> DataFrame:
        starts = F.sequence(F.col("start"), F.greatest(F.col("end") - 1, F.col("start")), F.lit(size).cast("long"))
        return df.withColumn("a", F.explode(starts)).withColumn("b", F.least(F.col("a") + size, F.col("end")))

    seg = lambda n, a, b: S.segment_id(F.col(n), F.col(a), F.col(b))
    pieces = cut(inner)
    s = pieces.join(nodes, "node_id").select("bg", F.lit("S").alias("kind"), S.segment_line(seg("node_id", "a", "b"), S.slice_of(F.col("sequence"), F.col("a"), F.col("b"))).alias("value"))
    own = pieces.where("b < end").select("bg", "node_id", "a", "b", F.col("b").alias("c"), F.least(F.col("b") + size, F.col("end")).alias("e"))
    plus = F.lit("+")
    within = own.select("bg", F.lit("L").alias("kind"), S.link_line(seg("node_id", "a", "b"), plus, seg("node_id", "c", "e"), plus).alias("value"))
    pairs = linked.where(~S.is_terminal(F.col("s_node")) & ~S.is_terminal(F.col("t_node")))
    last = F.col("s_start") + F.floor((F.greatest(F.col("s_end") - 1, F.col("s_start")) - F.col("s_start")) / size) * size
    pairs = pairs.withColumns({"sa": last, "tb": F.least(F.col("t_start") + size, F.col("t_end"))})
    between = pairs.select("bg", F.lit("L").alias("kind"), S.link_line(seg("s_node", "sa", "s_end"), F.col("source_strand"), seg("t_node", "t_start", "tb"), F.col("target_strand")).alias("value"))
    steps = cut(projected).select("bg", "path_id", F.struct("idx", "part", F.when(F.col("strand") == "-", -F.col("a")).otherwise(F.col("a")).alias("o"), F.concat(seg("node_id", "a", "b"), "strand").alias("step")).alias("x"))
    p = steps.groupBy("bg", "path_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["step"]).alias("steps")).join(names, "path_id")
    p = p.select("bg", F.lit("P").alias("kind"), S.path_line(S.train_case(F.col("name")), F.col("steps")).alias("value"))
    return s.unionByName(within).unionByName(between).unionByName(p).distinct()


def gfa_of(edges: DataFrame, blocks: DataFrame, nodes: DataFrame, names: DataFrame, max_size: int | None = None) -> DataFrame:
    """GFA lines of graphs given as edges, with their paths' blocks (bg, path_id, idx, node_id, seq_start, seq_end, strand)."""
    split = graph.blocks(edges)
    return gfa_lines(split, graph.block_edges(edges, split), graph.project_paths(blocks, split), nodes, names, max_size)


def dot_lines(edges_: DataFrame) -> DataFrame:
    """(bg, value): links of graphs as DOT edges."""
    name = lambda p: F.concat(F.lit('"'), S.segment_id(F.col(f"{p}_node"), F.col(f"{p}_start"), F.col(f"{p}_end")), F.lit('"'))
    return edges_.select("bg", F.concat(name("s"), F.lit(" -> "), name("t"), F.lit(";")).alias("value")).distinct()


def arms_fasta(edits: DataFrame) -> DataFrame:
    """Left and right arms of edits (id, left, right) as FASTA records; empty arms are skipped."""
    both = edits.select(F.explode(F.array(*[F.struct(F.concat_ws("_", "id", F.lit(side)).alias("name"), F.col(side).alias("sequence")) for side in ("left", "right")])).alias("r"))
    return both.select("r.*").where(F.coalesce(F.length("sequence"), F.lit(0)) > 0)


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
