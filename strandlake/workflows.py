"""Longer jobs on a store: alignments as edits, sub-graphs, chunks, stitches, differences, GenBank records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import edits, graph, intervals, paths
from strandlake.repository import EDGE, Repository
from strandlake.sources import readers, writers



def alignment_positions(alignments: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, side, node_id, strand, position): where arms of edits lie. segments: (segment, node_id, length).

    A left arm ends at path start + matches, counted through its path's segments; a right arm begins at the path
    start of its first one. The first alignment of an arm counts.
    """
    named = alignments.withColumns({"id": F.regexp_extract("query", "^(.*)_(left|right)$", 1), "side": F.regexp_extract("query", "_(left|right)$", 1)}).where("side != ''")
    first = W.partitionBy("id", "side").orderBy(F.col("mapq").desc(), "qstart", "path", "pstart")
    named = named.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    steps = named.select("id", "side", "pstart", "matches", F.posexplode("steps").alias("i", "s")).select("id", "side", "pstart", "matches", "i", "s.segment", "s.strand").join(segments, "segment")
    at = intervals.with_offsets(steps, ["id", "side"], ["i"], "length", "from", "to")
    goal = F.when(F.col("side") == "left", F.col("pstart") + F.col("matches")).otherwise(F.col("pstart"))
    inside = F.when(F.col("side") == "left", (goal > F.col("from")) & (goal <= F.col("to"))).otherwise((goal >= F.col("from")) & (goal < F.col("to")))
    return at.where(inside).select("id", "side", "node_id", "strand", (goal - F.col("from")).alias("position"))


def update_with_gaf(repo: Repository, gaf: str, csv: str, segments: DataFrame, collection: str, sample: str, parent: str | None = None) -> str:
    """Sequences put between arms that alignments place in the graphs; an empty arm stands for the graph's end."""
    spark = repo.spark
    items = readers.edit_list(spark, csv)
    if items.where("left = '' and right = ''").head(1):
        raise ValueError("an edit needs an arm")
    placed = alignment_positions(readers.gaf(spark, gaf), segments)
    side = lambda k: placed.where(F.col("side") == k).select("id", F.col("node_id").alias(f"{k}_node"), F.col("strand").alias(f"{k}_strand"), F.col("position").alias(f"{k}_at"))
    e = items.join(side("left"), "id", "left").join(side("right"), "id", "left").where("(left = '' or left_node is not null) and (right = '' or right_node is not null)")
    key = F.concat_ws(":", F.lit("gaf"), "id", "sequence", "left_node", "left_at", "right_node", "right_at")
    text = F.upper("sequence")
    e = e.withColumns({"text": text, "node_id": S.key_number(key), "node_hash": F.sha2(key, 256), "h": S.sequence_hash(F.lit("DNA"), text, F.lit(""), F.lit("")), "n": F.length("sequence").cast("long")})
    zero, plus = F.lit(0).cast("long"), F.lit("+")
    pick = lambda arm, field, other: F.when(F.col(arm) == "", other).otherwise(F.col(f"{arm}_{field}"))
    into = F.struct(pick("left", "node", F.lit(S.START_NODE).cast("long")).alias("source_node"), pick("left", "at", zero).alias("source_coordinate"), pick("left", "strand", plus).alias("source_strand"), F.col("node_id").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand"))
    out = F.struct(F.col("node_id").alias("source_node"), F.col("n").alias("source_coordinate"), plus.alias("source_strand"), pick("right", "node", F.lit(S.END_NODE).cast("long")).alias("target_node"), pick("right", "at", zero).alias("target_coordinate"), pick("right", "strand", plus).alias("target_strand"))
    rows = repo.child(collection, parent, sample)
    new = e.select(F.explode(F.array(into, out)).alias("e")).select("e.*").withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    members = rows["graphs"].select(F.col("id").alias("bg")).join(new.select("edge_id", zero.alias("chromosome_index"), F.lit(0).alias("phased")), F.lit(True))
    rows |= {
        "sequences": repo._new("sequences", e.select(F.col("h").alias("hash"), F.lit("DNA").alias("sequence_type"), F.col("text").alias("sequence"), F.lit("").alias("name"), F.lit("").alias("file_path"), F.col("n").alias("length")), ["hash"]),
        "nodes": repo._new("nodes", e.select("node_id", F.col("h").alias("sequence_hash"), F.col("node_hash").alias("hash")), ["node_id"]),
        "edges": repo._new("edges", repo._edge_rows(new), ["edge_id"]), "members": rows["members"].unionByName(repo._new("members", members, ["bg", "edge_id", "chromosome_index", "phased"])),
    }
    return repo.commit("update gaf", rows, gaf)


def derive_chunks(repo: Repository, collection: str, graph_name: str, points: list[int], sample: str, parent: str | None = None) -> str:
    """A graph cut at points of its current path: graphs name.1, name.2 and so on, each with copied nodes and a path."""
    spark = repo.spark
    g = repo.graphs(collection, parent).where(F.col("name") == graph_name)
    p = repo.current_paths(g)
    blocks = repo.path_blocks(p)
    size = paths.path_length(blocks).join(spark.createDataFrame([(x,) for x in points] or [(0,)], "point long"), F.lit(True))
    cuts = intervals.chunk_ranges(size, ["path_id"], "point", "length")
    inside = paths.partition_range(cuts.select("path_id", F.col("chunk").alias("range_id"), "start", "end"), blocks)
    name = F.concat_ws(".", F.lit(graph_name), F.col("range_id").cast("string"))
    bg = S.key_number(F.concat_ws("/", F.lit(collection), F.lit(sample), name))
    inside = inside.withColumns({"bg": bg, "name": name})
    ends = inside.groupBy("bg").agg(F.min_by(F.struct("node_id", "seq_start"), "path_start").alias("a"), F.max_by(F.struct("node_id", "seq_end"), "path_start").alias("b"))
    every = repo.edges(g)
    linked = graph.block_edges(every, graph.blocks(every))
    linked = ends.select("bg").join(linked.drop("bg"), F.lit(True))
    spots = ends.select("bg", F.col("a.node_id").alias("s_node"), F.col("a.seq_start").alias("s_at"), F.col("b.node_id").alias("e_node"), F.col("b.seq_end").alias("e_at"))
    e = edits.subgraph(linked, spots).withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    copy = S.key_number(F.concat_ws(".", "bg", "node_id"))
    nodes = inside.select("bg", "node_id").unionByName(linked.select("bg", F.col("s_node").alias("node_id"))).unionByName(linked.select("bg", F.col("t_node").alias("node_id"))).distinct().where(~S.is_terminal(F.col("node_id")))
    nodes = nodes.join(repo.table("nodes").select("node_id", "sequence_hash"), "node_id").select(copy.alias("node_id"), "sequence_hash", F.sha2(F.concat_ws(".", F.lit("copy"), "bg", "node_id"), 256).alias("hash"))
    w = W.partitionBy("bg").orderBy("path_start")
    prev = lambda c, other: F.coalesce(F.lag(c).over(w), other)
    one, zero, plus = F.lit(S.START_NODE).cast("long"), F.lit(0).cast("long"), F.lit("+")
    placed = inside.withColumn("copy", copy)
    pe = placed.select("bg", (F.row_number().over(w) - 1).cast("long").alias("idx"), prev("copy", one).alias("source_node"), prev("seq_end", zero).alias("source_coordinate"), prev("strand", plus).alias("source_strand"), F.col("copy").alias("target_node"), F.col("seq_start").alias("target_coordinate"), F.col("strand").alias("target_strand"))
    last = placed.groupBy("bg").agg(F.max(F.struct("path_start", "copy", "seq_end", "strand")).alias("l"), F.count("*").alias("idx"))
    pe = pe.unionByName(last.select("bg", "idx", F.col("l.copy").alias("source_node"), F.col("l.seq_end").alias("source_coordinate"), F.col("l.strand").alias("source_strand"), F.lit(S.END_NODE).cast("long").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")))
    pe = pe.withColumns({"edge_id": S.key_number(F.concat_ws(":", *EDGE)), "path_id": S.key_number(F.concat_ws("#", "bg", F.lit("chunk")))})
    both = e.select(*EDGE, "edge_id").unionByName(pe.select(*EDGE, "edge_id")).distinct()
    members = e.select("bg", "edge_id", "chromosome_index", "phased").unionByName(pe.select("bg", "edge_id", zero.alias("chromosome_index"), F.lit(0).alias("phased"))).distinct()
    return repo.commit("derive chunks", {
        "nodes": repo._new("nodes", nodes, ["node_id"]), "graphs": inside.select(F.col("bg").alias("id"), F.lit(collection).alias("collection"), F.lit(sample).alias("sample"), "name").distinct(),
        "edges": repo._new("edges", both, ["edge_id"]), "members": members, "paths": inside.select(S.key_number(F.concat_ws("#", "bg", F.lit("chunk"))).alias("path_id"), "bg", "name", F.lit(len(repo._log)).alias("made")).distinct(),
        "path_edges": pe.select("path_id", "idx", "edge_id"),
    }, graph_name)


def derive_subgraph(repo: Repository, collection: str, graph_name: str, start: int, end: int, sample: str, parent: str | None = None) -> str:
    """The part of a graph between two points of its current path, as a sample's graph."""
    if not 0 <= start < end:
        raise ValueError("the range is empty")
    made = derive_chunks(repo, collection, graph_name, [start, end], sample, parent)
    return made


def make_stitch(repo: Repository, collection: str, names: list[str], sample: str, new_name: str, parent: str | None = None) -> str:
    """Graphs laid end to end as one; its current path is theirs in order."""
    spark = repo.spark
    order = spark.createDataFrame(list(enumerate(names)), "place long, name string")
    g = repo.graphs(collection, parent).join(order, "name")
    new = S.key_number(F.concat_ws("/", F.lit(collection), F.lit(sample), F.lit(new_name)))
    e = repo.edges(g)
    p = repo.current_paths(g.select("id", "collection", "sample", "name"))
    pe = repo.path_edges(p).join(p.select("path_id", "bg"), "path_id")
    laid = edits.stitch_edges(e, g.select(F.lit(0).cast("long").alias("new"), "place", F.col("id").alias("bg")), pe.select("bg", "edge_id").distinct()).withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    b = repo.path_blocks(p).join(p.select("path_id", "bg"), "path_id").join(g.select(F.col("id").alias("bg"), "place"), "bg")
    # one row a graph: how many steps come before its own, and the last of them
    of_all = W.orderBy("place")
    ends = b.groupBy("place").agg(F.max(F.struct("idx", "node_id", "seq_end", "strand")).alias("l"), F.count("*").alias("n"))
    ends = ends.select("place", F.coalesce(F.sum("n").over(of_all.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.lag("l").over(of_all).alias("_before"))
    w = W.partitionBy("place").orderBy("idx")
    one, zero, plus = F.lit(S.START_NODE).cast("long"), F.lit(0).cast("long"), F.lit("+")
    prev = lambda c, other: F.coalesce(F.lag(c).over(w), F.col(f"_before.{c}"), other)
    steps = b.join(ends, "place").select((F.col("_offset") + F.row_number().over(w) - 1).cast("long").alias("idx"), prev("node_id", one).alias("source_node"), prev("seq_end", zero).alias("source_coordinate"), prev("strand", plus).alias("source_strand"), F.col("node_id").alias("target_node"), F.col("seq_start").alias("target_coordinate"), F.col("strand").alias("target_strand"))
    last = b.agg(F.max(F.struct("place", "idx", "node_id", "seq_end", "strand")).alias("l"), F.count("*").alias("n"))
    steps = steps.unionByName(last.select(F.col("n").alias("idx"), F.col("l.node_id").alias("source_node"), F.col("l.seq_end").alias("source_coordinate"), F.col("l.strand").alias("source_strand"), F.lit(S.END_NODE).cast("long").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")))
    steps = steps.withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    path_id = S.key_number(F.concat_ws("#", new.cast("string"), F.lit("stitch")))
    row = spark.range(1)
    return repo.commit("make stitch", {
        "graphs": row.select(new.alias("id"), F.lit(collection).alias("collection"), F.lit(sample).alias("sample"), F.lit(new_name).alias("name")),
        "edges": repo._new("edges", laid.select(*EDGE, "edge_id").unionByName(steps.select(*EDGE, "edge_id")), ["edge_id"]),
        "members": laid.select(new.alias("bg"), "edge_id", "chromosome_index", F.lit(0).alias("phased")).distinct(),
        "paths": row.select(path_id.alias("path_id"), new.alias("bg"), F.lit(new_name).alias("name"), F.lit(len(repo._log)).alias("made")), "path_edges": steps.select(path_id.alias("path_id"), "idx", "edge_id"),
    }, ",".join(names))


def sample_diff(repo: Repository, collection: str, a: str | None, b: str | None) -> DataFrame:
    """(kind, value): GFA lines that set the current paths of two samples side by side, cut where they part."""
    out = None
    p, q = (repo.current_paths(repo.graphs(collection, s)) for s in (a, b))
    for left, right, tag in ((p, q, a), (q, p, b)):
        pairs = left.select(F.col("path_id").alias("a_path"), "graph").join(right.select(F.col("path_id").alias("b_path"), "graph"), "graph")
        blocks = repo.path_blocks(left)
        m = paths.block_mappings(blocks, repo.path_blocks(right), pairs.select("a_path", "b_path"))
        shared = m.select(F.col("a_path").alias("path"), F.col("b_path").alias("other"), F.col("source_start").alias("start"), F.col("source_end").alias("end")).distinct()
        whole = paths.path_length(blocks).join(pairs, F.col("path_id") == F.col("a_path"), "left").select(F.col("path_id").alias("path"), F.coalesce("b_path", F.lit(-1)).alias("other"), "length")
        cut = edits.diff_ranges(shared, whole).select(F.col("path").alias("path_id"), F.col("start").alias("range_id"), "start", "end")
        parts = paths.partition_range(cut, blocks)
        ident = F.concat_ws(".", F.col("node_id").cast("string"), F.col("seq_start").cast("string"))
        seg = parts.join(repo.node_texts(), "node_id").select(F.lit("S").alias("kind"), S.segment_line(ident, S.slice_of(F.col("sequence"), F.col("seq_start"), F.col("seq_end"))).alias("value"))
        w = W.partitionBy("path_id").orderBy("path_start")
        link = parts.select("path_id", ident.alias("t"), F.col("strand").alias("ts"), F.lag(ident).over(w).alias("s"), F.lag("strand").over(w).alias("ss")).where("s is not null")
        link = link.select(F.lit("L").alias("kind"), S.link_line(F.col("s"), F.col("ss"), F.col("t"), F.col("ts")).alias("value"))
        steps = parts.groupBy("path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("path_start", F.concat(ident, "strand").alias("x")))), lambda x: x["x"]).alias("steps")).join(left.select("path_id", "name"), "path_id")
        line = steps.select(F.lit("P").alias("kind"), S.path_line(F.concat_ws(".", "name", F.lit(tag or "reference")), F.col("steps")).alias("value"))
        rows = seg.unionByName(link).unionByName(line)
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def update_with_gfa(repo: Repository, path: str, collection: str, sample: str, parent: str | None = None) -> str:
    """Paths of a GFA as edits: one that spells a current path is matched; a path that shares segments with it
    replaces what lies between the shared ones."""
    spark = repo.spark
    g = readers.gfa(spark, path)
    steps = g["paths"].select("name", "step", "segment").unionByName(g["walks"].select("name", "step", "segment")).join(g["segments"], "segment")
    steps = intervals.with_offsets(steps.withColumn("n", F.length("sequence").cast("long")), ["name"], ["step"], "n", "from", "to")
    spelled = steps.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "sequence"))), lambda x: x["sequence"]), "").alias("text"))
    own = repo.sequences_of(collection, parent).select(F.col("name").alias("graph"), F.col("sequence").alias("text"))
    matched = spelled.join(own, "text").select(F.col("name").alias("matched"), "graph")
    rest = spelled.select("name").join(matched.select(F.col("matched").alias("name")), "name", "left_anti")
    base = steps.join(matched, F.col("name") == F.col("matched")).select("graph", "segment", F.col("from").alias("f"), F.col("to").alias("t"))
    mine = steps.join(rest, "name").join(base, "segment", "left").withColumn("hit", F.col("graph").isNotNull())
    where = mine.where("hit").groupBy("name").agg(F.min("graph").alias("g"))
    mine = mine.drop("graph").join(where, "name")
    w = W.partitionBy("name").orderBy("step")
    before = F.coalesce(F.last(F.when(F.col("hit"), F.col("t")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    after = F.first(F.when(F.col("hit"), F.col("f")), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    size = repo.sequences_of(collection, parent).select(F.col("name").alias("g"), F.length("sequence").cast("long").alias("size"))
    new = mine.withColumns({"a": before, "b": after}).where("not hit").join(size, "g").withColumn("b", F.coalesce("b", "size"))
    items = new.groupBy("g", "name", "a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "sequence"))), lambda x: x["sequence"]), "").alias("sequence"))
    return repo.update_with_edits("update gfa", items.select(F.col("g").alias("graph"), F.col("a").alias("start"), F.col("b").alias("end"), "sequence"), collection, sample, parent)


def import_library(repo: Repository, parts: str, design: str, collection: str, region: str, sample: str | None = None) -> str:
    """All combinations of a design as a graph of their own; its path takes the first part of each slot."""
    spark = repo.spark
    used = readers.library(spark, design).join(readers.fasta(spark, parts).select(F.col("name").alias("part"), "sequence"), "part")
    key = F.concat_ws(":", F.lit(collection), F.lit(region), "part", F.concat(F.lit("column-"), F.col("slot").cast("string")))
    pool = F.lit(0).alias("pool")
    first = F.row_number().over(W.partitionBy("slot").orderBy("row"))
    used = used.select(pool, "row", "slot", "part", "sequence", F.sha2(key, 256).alias("node_hash"), S.key_number(key).alias("node_id"), F.length("sequence").cast("long").alias("length"), S.sequence_hash(F.lit("DNA"), F.col("sequence"), F.lit(""), F.lit("")).alias("h"))
    one, two, zero, plus = F.lit(S.START_NODE).cast("long"), F.lit(S.END_NODE).cast("long"), F.lit(0).cast("long"), F.lit("+")
    anchors = spark.range(1).select(pool, one.alias("s_node"), zero.alias("s_at"), two.alias("e_node"), zero.alias("e_at"))
    bg = S.key_number(F.concat_ws("/", F.lit(collection), F.coalesce(F.lit(sample), F.lit("\u0000")), F.lit(region)))
    e = edits.library_edges(used.drop("row").distinct(), anchors, preserve=False).withColumns({"bg": bg, "phased": F.lit(0)})
    main = used.withColumn("_n", first).where("_n = 1").select("slot", "node_id", "length")
    w = W.partitionBy(F.lit(0)).orderBy("slot")
    pe = main.select((F.row_number().over(w) - 1).cast("long").alias("idx"), F.coalesce(F.lag("node_id").over(w), one).alias("source_node"), F.coalesce(F.lag("length").over(w), zero).alias("source_coordinate"), plus.alias("source_strand"), F.col("node_id").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand"))
    last = main.agg(F.max(F.struct("slot", "node_id", "length")).alias("l"), F.count("*").alias("n"))
    pe = pe.unionByName(last.select(F.col("n").alias("idx"), F.col("l.node_id").alias("source_node"), F.col("l.length").alias("source_coordinate"), plus.alias("source_strand"), two.alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand")))
    pe = pe.withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    path_id = S.key_number(F.concat_ws("#", bg.cast("string"), F.lit("default")))
    return repo.commit("import library", {
        "sequences": repo._new("sequences", used.select(F.col("h").alias("hash"), F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"), "length"), ["hash"]),
        "nodes": repo._new("nodes", used.select("node_id", F.col("h").alias("sequence_hash"), F.col("node_hash").alias("hash")), ["node_id"]),
        "graphs": spark.range(1).select(bg.alias("id"), F.lit(collection).alias("collection"), F.lit(sample).cast("string").alias("sample"), F.lit(region).alias("name")),
        "edges": repo._new("edges", repo._edge_rows(e), ["edge_id"]), "members": repo._new("members", e, ["bg", "edge_id", "chromosome_index", "phased"]),
        "paths": spark.range(1).select(path_id.alias("path_id"), bg.alias("bg"), F.lit(f"{region} default path").alias("name"), F.lit(len(repo._log)).alias("made")), "path_edges": pe.select(path_id.alias("path_id"), "idx", "edge_id"),
    }, design)


def translate_gff(repo: Repository, path: str, collection: str, sample: str | None = None) -> DataFrame:
    """GFF records as pieces named by node, in path coordinates: the columns of the records."""
    p = repo.current_paths(repo.graphs(collection, sample)).select("path_id", F.col("graph").alias("chrom"))
    r = readers.gff(repo.spark, path).withColumn("record_id", F.monotonically_increasing_id()).join(p, "chrom")
    t = paths.translate(r.select("path_id", "record_id", "start", "end"), repo.path_blocks(p), gff=True)
    return t.join(r.select("record_id", "source", "kind", "score", "strand", "phase", "attributes"), "record_id").select("name", "source", "kind", "start", "end", "score", "strand", "phase", "attributes")


def genbank_records(repo: Repository, collection: str, sample: str | None = None) -> DataFrame:
    """(name, value): a GenBank record a graph: its current path, and as features the ways that leave and rejoin it.

    One graph is one task: its links are walked from each block of the path to the next one that is on it.
    """
    g = repo.graphs(collection, sample)
    p = repo.current_paths(g)
    e = repo.edges(g)
    split = graph.blocks(e)
    linked = graph.block_edges(e, split)
    on = graph.project_paths(repo.path_blocks(p).join(p.select("path_id", "bg"), "path_id").select("bg", "path_id", "idx", "node_id", "seq_start", "seq_end", "strand"), split)
    text = split.join(repo.node_texts(), "node_id").select("bg", "node_id", "start", "end", S.slice_of(F.col("sequence"), F.col("start"), F.col("end")).alias("text"))
    rows = on.join(text, ["bg", "node_id", "start", "end"]).select("bg", F.lit("path").alias("kind"), F.col("idx").cast("long").alias("at"), F.col("part").cast("long").alias("part"), "node_id", "start", "end", F.lit(0).cast("long").alias("t_node"), F.lit(0).cast("long").alias("t_start"), F.lit(0).cast("long").alias("t_end"), "text")
    none = F.lit(0).cast("long")
    rows = rows.unionByName(text.select("bg", F.lit("block").alias("kind"), none.alias("at"), none.alias("part"), "node_id", "start", "end", none.alias("t_node"), none.alias("t_start"), none.alias("t_end"), "text"))
    rows = rows.unionByName(linked.select("bg", F.lit("link").alias("kind"), none.alias("at"), none.alias("part"), F.col("s_node").alias("node_id"), F.col("s_start").alias("start"), F.col("s_end").alias("end"), "t_node", "t_start", "t_end", F.lit("").alias("text")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        main = pdf[pdf.kind == "path"].sort_values(["at", "part"])
        order = [tuple(x) for x in main[["node_id", "start", "end"]].to_numpy().tolist()]
        texts = {(r.node_id, r.start, r.end): r.text for r in pdf[pdf.kind != "link"].itertuples()}
        offset, total = {}, 0
        for b in order:
            offset[b] = total
            total += len(texts[b])
        near: dict[tuple, list] = {}
        for r in pdf[pdf.kind == "link"].itertuples():
            near.setdefault((r.node_id, r.start, r.end), []).append((r.t_node, r.t_start, r.t_end))
        begin, finish = (S.START_NODE, 0, 0), (S.END_NODE, 0, 0)
        offset |= {begin: 0, finish: total}
        ends = {b: offset[b] + len(texts.get(b, "")) for b in offset}
        found = set()
        for b in [begin, *order]:
            ways = [(t, "") for t in near.get(b, [])]
            seen = set()
            while ways:
                t, spelled = ways.pop()
                if t in offset:
                    if ends[b] != offset[t] or spelled:
                        found.add((ends[b], offset[t], spelled))
                elif (t, spelled) not in seen:
                    seen.add((t, spelled))
                    ways += [(u, spelled + texts.get(t, "")) for u in near.get(t, [])]
        features = []
        for a, z, spelled in sorted(x for x in found if x[0] <= x[1]):
            kind = "Deletion" if not spelled else "Insertion" if a == z else "Replacement"
            features.append(f"     misc_feature    {a + 1}..{max(z, a + 1)}\n                     /note=\"{kind}\"" + (f"\n                     /sequence=\"{spelled}\"" if spelled else ""))
        whole = "".join(texts[b] for b in order).lower()
        lines = [f"{i + 1:>9} " + " ".join(whole[j : j + 10] for j in range(i, min(i + 60, len(whole)), 10)) for i in range(0, len(whole), 60)]
        body = "\n".join(["FEATURES             Location/Qualifiers", *features, "ORIGIN", *lines, "//"])
        return pd.DataFrame({"bg": [pdf["bg"].iloc[0]], "body": [body], "length": [len(whole)]})

    done = rows.groupBy("bg").applyInPandas(run, "bg long, body string, length long")
    return done.join(g.select(F.col("id").alias("bg"), "name"), "bg").select("name", F.concat(F.lit("LOCUS       "), "name", F.lit(" "), F.col("length").cast("string"), F.lit(" bp    DNA     linear\n"), "body").alias("value"))


def export_genbank(repo: Repository, path: str, collection: str, sample: str | None = None) -> None:
    writers.write_lines(genbank_records(repo, collection, sample), path)
