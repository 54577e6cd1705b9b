"""Edits of sequence graphs as tables of new nodes and edges: single changes, variants, part libraries, sub-graphs,
stitches, differences.

A change is (change_id, path_id, start, end, node_id, node_start, node_end, chromosome_index, phased, preserve): the
path's bases [start, end) become the node's [node_start, node_end), nothing if these are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import graph, intervals, paths
from strandlake.session import materialized, once

#: Sources of a step that a task pairs at once, pairs a task makes, about, and tasks at most.
SLICE, TASK_PAIRS, MOST_TASKS = 512, 20_000_000, 100_000
EDGE = ["source_node", "source_coordinate", "source_strand", "target_node", "target_coordinate", "target_strand"]


def _edge(sn: Column, sc: Column, tn: Column, tc: Column, ci: Column, phased: Column) -> Column:
    plus = F.lit("+")
    return F.struct(
        sn.cast("long").alias("source_node"), sc.cast("long").alias("source_coordinate"), plus.alias("source_strand"), tn.cast("long").alias("target_node"), tc.cast("long").alias("target_coordinate"),
        plus.alias("target_strand"), ci.cast("long").alias("chromosome_index"), phased.cast("int").alias("phased"))


def out_of_bounds(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Changes that begin before their path, or end after it."""
    sizes = paths.path_length(blocks)
    return changes.join(sizes, "path_id").where((F.col("start") < 0) | (F.col("end") > F.col("length")) | (F.col("start") > F.col("length")))


def edit_edges(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """New edges of changes, one row each: change_id, the edge's fields, chromosome_index and phased.

    blocks: path blocks with offsets. A change that starts where a block does leaves from the block before. At the
    start of the path the edge leaves START; with preserve, an edge from either cut to itself keeps the old bases
    on a way. Changes that reach out of their path give no edges; out_of_bounds lists them.
    """
    spots = blocks.select("path_id", F.col("node_id").alias("n"), "seq_start", "path_start", "path_end")
    last = blocks.groupBy("path_id").agg(F.max("path_end").alias("length"))
    end_block = last.select("path_id", F.lit(S.END_NODE).cast("long").alias("n"), F.lit(0).cast("long").alias("seq_start"), F.col("length").alias("path_start"), (F.col("length") + 1).alias("path_end"))
    spots = spots.unionByName(end_block)
    begin = F.lit(S.START_NODE).cast("long")
    # the base before the start is in the block the edge leaves; base -1 is START
    left = changes.where("start > 0").join(last, "path_id").where("end <= length").drop("length").withColumn("_p", F.col("start") - 1)
    left = intervals.point_join(left, "_p", spots, ["path_id"], ("path_start", "path_end"))
    left = left.withColumns({"s_node": F.col("n"), "s_at": F.col("start") - F.col("path_start") + F.col("seq_start")}).drop("_p", "n", "seq_start", "path_start", "path_end")
    first = changes.where("start = 0").join(last, "path_id").where("end <= length").drop("length").withColumns({"s_node": begin, "s_at": F.lit(0).cast("long")})
    both = left.unionByName(first)
    right = intervals.point_join(both, "end", spots, ["path_id"], ("path_start", "path_end"))
    e_at = F.col("end") - F.col("path_start") + F.col("seq_start")
    s_node, s_at, e_node, ci, ph = F.col("s_node"), F.col("s_at"), F.col("n"), F.col("chromosome_index"), F.col("phased")
    zero = F.lit(0)
    gone = F.col("node_start") == F.col("node_end")
    keep_start = F.when(F.col("preserve") & ~S.is_terminal(s_node), _edge(s_node, s_at, s_node, s_at, zero, zero))
    keep_end = F.when(F.col("preserve") & ~S.is_terminal(e_node), _edge(e_node, e_at, e_node, e_at, zero, zero))
    # edges that leave START carry no phase
    into = F.when(~gone, _edge(s_node, s_at, F.col("node_id"), F.col("node_start"), ci, F.when(S.is_terminal(s_node), 0).otherwise(ph)))
    out = F.when(~gone, _edge(F.col("node_id"), F.col("node_end"), e_node, e_at, ci, ph))
    over = F.when(gone, _edge(s_node, s_at, e_node, e_at, ci, ph))
    found = F.filter(F.array(keep_start, keep_end, into, out, over), lambda x: x.isNotNull())
    return right.select("change_id", F.explode(found).alias("e")).select("change_id", "e.*")


def apply_changes(edges: DataFrame, new: DataFrame, graph_of: DataFrame) -> DataFrame:
    """Edges of graphs with those of changes: graph_of is (change_id, bg). Known edges of a graph stay as they are."""
    named = new.join(graph_of, "change_id").withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    rows = named.select("bg", "edge_id", *EDGE, "chromosome_index", "phased").distinct()
    known = edges.select("bg", "edge_id", "chromosome_index", "phased")
    return edges.unionByName(rows.join(known, ["bg", "edge_id", "chromosome_index", "phased"], "left_anti").select(*edges.columns))


# --- variants ------------------------------------------------------------------------------------------------------


def variant_changes(calls: DataFrame) -> DataFrame:
    """Changes of variant calls (path_id, pos, ref, alts, gt, and any further columns): one an allele called.

    Missing alleles, the reference, an asterisk and symbols other than copy numbers change nothing. The slot of an
    allele in its genotype is its chromosome; preserve if any allele of the call is the reference.
    """
    got = calls.withColumn("_gt", S.parse_genotype(F.col("gt")))
    has_ref = F.exists("_gt", lambda x: F.coalesce(x["allele"] == 0, F.lit(False)))
    rows = got.withColumn("preserve", has_ref).select("*", F.posexplode("_gt").alias("chromosome_index", "_a")).where("_a.allele > 0")
    rows = rows.withColumns({"alt": F.get("alts", F.col("_a.allele") - 1), "phased": F.col("_a.phased").cast("int")}).where("alt is not null and alt != '*'")
    rows = rows.withColumn("c", S.trimmed_allele(F.col("pos"), F.col("ref"), F.col("alt"))).where("c.sequence is not null")
    rows = rows.withColumns({"start": F.col("c.start"), "end": F.col("c.end"), "sequence": F.col("c.sequence")})
    key = F.concat(F.col("path_id").cast("string"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit("->"), S.sequence_hash(F.lit("DNA"), F.col("sequence"), F.lit(""), F.lit("")))
    rows = rows.withColumns({"node_hash": F.sha2(key, 256), "node_id": S.key_number(key), "node_start": F.lit(0).cast("long"), "node_end": F.length("sequence").cast("long")})
    return rows.drop("_gt", "_a", "c", "alts", "alt")


def variant_accessions(calls: DataFrame) -> DataFrame:
    """(path_id, name, start, end): reference accessions that calls of allele 0 ask for (column gan)."""
    got = calls.where(F.col("gan").isNotNull() & F.exists(S.parse_genotype(F.col("gt")), lambda x: F.coalesce(x["allele"] == 0, F.lit(False))))
    return got.select("path_id", F.col("gan").alias("name"), (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("ref")).alias("end")).distinct()


# --- part libraries ------------------------------------------------------------------------------------------------


def _products(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(pool, source, source_at, target, target_at): each source of a step with each target of it, no pair of a pool twice.

    Both: (pool, step, node, at). Pairs are many, so they are not compared with each other: a pair comes from the first
    step that has it, which either side knows from its own steps. Sources of a step are dealt in slices, and targets
    are copied to each, so that a large step is made by many tasks.
    """

    def sides(df: DataFrame, name: str) -> DataFrame:
        steps = df.where("pool is not null and step is not null").groupBy("pool", F.col("node").alias(name), F.col("at").alias(f"{name}_at")).agg(F.sort_array(F.collect_set("step")).alias("steps"))
        return steps.select("pool", name, f"{name}_at", F.explode("steps").alias("step"), F.when(F.size("steps") > 1, F.col("steps")).alias(f"{name}_steps"))

    s, t = materialized(sides(sources, "source")), materialized(sides(targets, "target"))
    sizes = s.groupBy("pool", "step").agg(F.count("*").alias("n")).join(t.groupBy("pool", "step").agg(F.count("*").alias("m")), ["pool", "step"])
    sizes = materialized(sizes.withColumn("slices", F.ceil(F.col("n") / SLICE)))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    sizes, tasks = sizes.select("pool", "step", "slices"), int(min(MOST_TASKS, 1 + pairs // TASK_PAIRS))
    s = s.join(sizes, ["pool", "step"]).withColumn("slice", F.pmod(F.xxhash64("source", "source_at"), "slices")).drop("slices")
    t = t.join(sizes, ["pool", "step"]).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).drop("slices")
    by = ["pool", "step", "slice"]
    both = t.repartition(tasks, *by).join(s.repartition(tasks, *by).hint("merge"), by)
    again = F.col("source_steps").isNotNull() & F.col("target_steps").isNotNull() & (F.array_min(F.array_intersect("source_steps", "target_steps")) != F.col("step"))
    return both.where(~again).select("pool", "source", "source_at", "target", "target_at")


def library_edges(parts: DataFrame, anchors: DataFrame, preserve: bool = True) -> DataFrame:
    """Edges of combinatorial pools. parts: (pool, slot, node_id, length); anchors: (pool, s_node, s_at, e_node, e_at).

    Each part of a slot is joined to each of the next slot, the first slot to the pool's start and the last to its
    end. An edge's own number is its chromosome, so that no pruning takes it.
    """
    ends = parts.groupBy("pool").agg(F.min("slot").cast("long").alias("first"), F.max("slot").cast("long").alias("last")).join(anchors, "pool")
    plus, zero = F.lit("+"), F.lit(0).cast("long")
    row = lambda sn, sc, tn, tc: [sn.cast("long").alias("source_node"), sc.cast("long").alias("source_coordinate"), plus.alias("source_strand"), tn.cast("long").alias("target_node"), tc.cast("long").alias("target_coordinate"), plus.alias("target_strand")]
    side = lambda df, step, node, at: df.select("pool", step.cast("long").alias("step"), F.col(node).cast("long").alias("node"), at.cast("long").alias("at"))
    # a step's sources are the parts of the slot before, or the pool's start, its targets those of the slot, or the end
    sources = side(parts, F.col("slot") + 1, "node_id", F.col("length")).unionByName(side(ends, F.col("first"), "s_node", F.col("s_at")))
    targets = side(parts, F.col("slot"), "node_id", zero).unionByName(side(ends, F.col("last") + 1, "e_node", F.col("e_at")))
    every = _products(sources, targets).select("pool", *row(F.col("source"), F.col("source_at"), F.col("target"), F.col("target_at")))
    every = every.withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE)))
    out = every.withColumn("chromosome_index", F.col("edge_id"))
    if preserve:
        cut = anchors.select("pool", F.explode(F.array(F.struct(F.col("s_node").alias("n"), F.col("s_at").alias("at")), F.struct(F.col("e_node").alias("n"), F.col("e_at").alias("at")))).alias("c")).where(~S.is_terminal(F.col("c.n")))
        own = cut.select("pool", *row(F.col("c.n"), F.col("c.at"), F.col("c.n"), F.col("c.at"))).distinct()
        out = out.unionByName(own.withColumn("edge_id", S.key_number(F.concat_ws(":", *EDGE))).withColumn("chromosome_index", F.lit(0).cast("long")))
    return out


def library_sizes(parts: DataFrame) -> DataFrame:
    """(pool, products): how many sequences each pool makes, a product over its slots."""
    return parts.groupBy("pool", "slot").agg(F.countDistinct("node_id").alias("n")).groupBy("pool").agg(F.aggregate(F.collect_list("n"), F.lit(1).cast("long"), lambda a, x: a * x).alias("products"))


def library_products(parts: DataFrame) -> DataFrame:
    """(pool, sequence): all products, slot by slot; parts has the parts' sequence. As many as library_sizes tells."""
    last = parts.agg(F.max("slot")).first()[0]
    out = parts.where("slot = 0").select("pool", "sequence")
    ends = parts.groupBy("pool").agg(F.max("slot").alias("last"))
    done = out.join(ends, "pool").where("last = 0").select("pool", "sequence")
    for k in range(1, (last or 0) + 1):
        step = parts.where(F.col("slot") == k).select("pool", F.col("sequence").alias("next"))
        out = out.join(step, "pool").select("pool", F.concat("sequence", "next").alias("sequence"))
        done = done.unionByName(out.join(ends, "pool").where(F.col("last") == k).select("pool", "sequence"))
    return done


# --- sub-graphs, stitches, differences -----------------------------------------------------------------------------


def subgraph(edges_: DataFrame, cuts: DataFrame) -> DataFrame:
    """Edges of derived graphs: (bg, edge's fields with nodes as copies). cuts: (bg, s_node, s_at, e_node, e_at).

    Kept are the links on a way from the block that holds the start to the one that holds the end; nodes become
    copies named by graph and node; START leads to the start, and the end to END.
    """
    edges_ = once(edges_)
    here = lambda side, n, at: (F.col(f"{side}_node") == F.col(f"c.{n}")) & (F.col(f"{side}_start") <= F.col(f"c.{at}")) & (F.col(f"{side}_end") >= F.col(f"c.{at}"))
    found = [F.when(here(side, f"{end}_node", f"{end}_at"), F.struct(F.lit(end).alias("cut"), F.col(f"{side}_node").alias("node_id"), F.col(f"{side}_start").alias("start"), F.col(f"{side}_end").alias("end"))) for side in ("s", "t") for end in ("s", "e")]
    placed = edges_.select("bg", *graph.SOURCE, *graph.TARGET).join(cuts.select("bg", F.struct(*cuts.columns).alias("c")), "bg").select("bg", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("b"))
    placed = materialized(placed.select("bg", "b.*").distinct())
    first, last = (placed.where(F.col("cut") == end).drop("cut") for end in ("s", "e"))
    kept = graph.intermediate(edges_, first, last)
    copy = lambda c: F.when(S.is_terminal(F.col(c)), F.col(c)).otherwise(S.key_number(F.concat_ws(".", "bg", c)))
    plus, zero = F.lit("+"), F.lit(0).cast("long")
    inner = kept.select("bg", copy("s_node").alias("source_node"), F.col("s_end").alias("source_coordinate"), "source_strand", copy("t_node").alias("target_node"), F.col("t_start").alias("target_coordinate"), "target_strand", F.col("chromosome_index").cast("long").alias("chromosome_index"), F.col("phased").cast("int").alias("phased"))
    start = cuts.select("bg", F.lit(S.START_NODE).cast("long").alias("source_node"), zero.alias("source_coordinate"), plus.alias("source_strand"), copy("s_node").alias("target_node"), F.col("s_at").cast("long").alias("target_coordinate"), plus.alias("target_strand"), zero.alias("chromosome_index"), F.lit(0).alias("phased"))
    end = cuts.select("bg", copy("e_node").alias("source_node"), F.col("e_at").cast("long").alias("source_coordinate"), plus.alias("source_strand"), F.lit(S.END_NODE).cast("long").alias("target_node"), zero.alias("target_coordinate"), plus.alias("target_strand"), zero.alias("chromosome_index"), F.lit(0).alias("phased"))
    return inner.unionByName(start).unionByName(end).distinct()


def stitch_edges(edges: DataFrame, order: DataFrame, current: DataFrame) -> DataFrame:
    """Edges of graphs laid end to end: (new, edge's fields, chromosome_index). order: (new, place, bg).

    Inner edges stay; every edge into END of one graph joins every edge out of START of the next. The joint on the
    current path has chromosome 0, the others count on from the largest in use. current: (bg, edge_id) of the
    current paths' edges.
    """
    e = edges.join(order, "bg")
    ends = order.groupBy("new").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    e = e.join(ends, "new")
    on_path = current.withColumn("own", F.lit(True))
    e = e.join(on_path, ["bg", "edge_id"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    kept = e.where((F.col("source_node") != S.START_NODE) & (F.col("target_node") != S.END_NODE) | (F.col("source_node") == S.START_NODE) & (F.col("place") == F.col("first")) | (F.col("target_node") == S.END_NODE) & (F.col("place") == F.col("last")))
    kept = kept.select("new", *EDGE, F.col("chromosome_index").cast("long").alias("chromosome_index")).distinct()
    a = e.where(F.col("target_node") == S.END_NODE).select("new", (F.col("place") + 1).alias("place"), *EDGE[:3], F.col("own").alias("own_a")).distinct()
    b = e.where(F.col("source_node") == S.START_NODE).select("new", "place", *EDGE[3:], F.col("own").alias("own_b")).distinct()
    one = a.groupBy("new", "place", *EDGE[:3]).agg(F.max("own_a").alias("own_a"))
    two = b.groupBy("new", "place", *EDGE[3:]).agg(F.max("own_b").alias("own_b"))
    joint = one.join(two, ["new", "place"])
    most = kept.groupBy("new").agg(F.max("chromosome_index").alias("most"))
    side = F.row_number().over(W.partitionBy("new", "_main").orderBy("place", *EDGE))
    joint = joint.withColumn("_main", F.col("own_a") & F.col("own_b")).withColumn("_n", side).join(most, "new", "left")
    index = F.when(F.col("_main"), 0).otherwise(F.coalesce("most", F.lit(0)) + F.col("_n"))
    return kept.unionByName(joint.select("new", *EDGE, index.cast("long").alias("chromosome_index")))


def diff_ranges(mappings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(path, other, start, end, shared): a path cut into what it shares with another and the gaps between.

    mappings: (path, other, start, end); lengths: (path, other, length).
    """
    whole = intervals.merge_contiguous(mappings, ["path", "other"], ("start", "end"))
    w = W.partitionBy("path", "other").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    gaps = whole.select("path", "other", before.alias("g"), F.col("start").alias("h"))
    tail = lengths.join(whole.groupBy("path", "other").agg(F.max("end").alias("g")), ["path", "other"], "left").select("path", "other", F.coalesce("g", F.lit(0).cast("long")).alias("g"), F.col("length").alias("h"))
    gaps = gaps.unionByName(tail).where("g < h").select("path", "other", F.col("g").alias("start"), F.col("h").alias("end"), F.lit(False).alias("shared"))
    return whole.withColumn("shared", F.lit(True)).unionByName(gaps)


def applied_offsets(edits: DataFrame, keys: list[str]) -> DataFrame:
    """Edits (start, old, new in their own order) with start and end in the sequence before any of them."""
    w = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.length("old") - F.length("new")).over(w), F.lit(0))
    at = F.col("start") + shift
    return edits.withColumns({"wt_start": at, "wt_end": at + F.length("old")})


def originals(records: DataFrame, noted: DataFrame) -> DataFrame:
    """Records (name, sequence) as they were before edits (name, start, end, old): the old bases put back, in order."""
    cuts = noted.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("start", "end", "old"))).alias("cuts"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    whole = F.col("sequence")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["end"].alias("at"), F.concat(acc["text"], S.slice_of(whole, acc["at"], x["start"]), x["old"]).alias("text"))

    back = F.aggregate("cuts", first, step, lambda acc: F.concat(acc["text"], S.slice_of(whole, acc["at"], F.length(whole).cast("long"))))
    return records.join(cuts, "name", "left").select("name", F.when(F.col("cuts").isNull(), whole).otherwise(back).alias("sequence"))
