"""Sequence graphs: blocks from edge coordinates, links between blocks, and what can be reached.

An edge is (bg, edge_id, source_node, source_coordinate, source_strand, target_node, target_coordinate,
target_strand, chromosome_index, phased); bg names the graph. A block is (bg, node_id, start, end), its identity.
A link joins two blocks: s_node, s_start, s_end, t_node, t_start, t_end.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions import scalars as S
from strandlake.operators import intervals as I
from strandlake.operators import whole
from strandlake.session import materialized, once

SOURCE, TARGET = ["s_node", "s_start", "s_end"], ["t_node", "t_start", "t_end"]


def boundaries(edges: DataFrame) -> DataFrame:
    """(bg, node_id, points): sorted distinct coordinates at which edges leave or enter each inner node."""
    ends = edges.select("bg", F.col("source_node").alias("node_id"), F.col("source_coordinate").alias("point")).unionByName(
        edges.select("bg", F.col("target_node").alias("node_id"), F.col("target_coordinate").alias("point")))
    return ends.where(~S.is_terminal(F.col("node_id"))).groupBy("bg", "node_id").agg(F.array_sort(F.collect_set("point")).alias("points"))


def blocks(edges: DataFrame) -> DataFrame:
    """(bg, node_id, start, end): nodes split at their boundaries, and the two empty terminal blocks of each graph."""
    out = edges.where(~S.is_terminal(F.col("source_node"))).select("bg", F.col("source_node").alias("node_id"), F.col("source_coordinate").alias("p"))
    into = edges.where(~S.is_terminal(F.col("target_node"))).select("bg", F.col("target_node").alias("node_id"), F.col("target_coordinate").alias("p"))
    inner = I.consecutive(out.unionByName(into), ["bg", "node_id"], "p", "start", "end")
    ends = F.explode(F.array(F.lit(S.START_NODE).cast("long"), F.lit(S.END_NODE).cast("long"))).alias("node_id")
    terminal = edges.select("bg").distinct().select("bg", ends).select("bg", "node_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
    return inner.select("bg", "node_id", F.col("start").cast("long"), F.col("end").cast("long")).unionByName(terminal)


def block_edges(edges: DataFrame, split: DataFrame) -> DataFrame:
    """Links, one row an edge: the block that ends where it leaves, the block that starts where it enters.

    Edges that meet no block border are dropped.
    """
    s = split.select(F.col("bg").alias("bg"), F.col("node_id").alias("s_node"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    t = split.select(F.col("bg").alias("bg"), F.col("node_id").alias("t_node"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    e = edges.withColumns({"s_node": F.col("source_node"), "s_end": F.col("source_coordinate"), "t_node": F.col("target_node"), "t_start": F.col("target_coordinate")})
    e = e.select("bg", "edge_id", "source_strand", "target_strand", "chromosome_index", "phased", "s_node", "s_end", "t_node", "t_start")
    return e.join(s, ["bg", "s_node", "s_end"]).join(t, ["bg", "t_node", "t_start"]).select("bg", *SOURCE, *TARGET, "edge_id", "source_strand", "target_strand", "chromosome_index", "phased")


def links(edges_: DataFrame) -> DataFrame:
    """One row a pair of blocks, with its edges sorted by id."""
    one = F.struct("edge_id", "source_strand", "target_strand", "chromosome_index", "phased")
    return edges_.groupBy("bg", *SOURCE, *TARGET).agg(F.array_sort(F.collect_list(one)).alias("edges"))


def pruned(edges_: DataFrame, reach: bool = True) -> DataFrame:
    """Links that stay when, of the edges that leave a block with the same chromosome index, only the newest counts.

    A pair of blocks that loses an edge is removed as a whole; then what START cannot reach is. Both windows run on one
    shuffle, by the block that the edges leave.
    """
    newest = F.max("edge_id").over(W.partitionBy("bg", *SOURCE, "chromosome_index"))
    lost = (F.col("chromosome_index") != S.NO_CHROMOSOME) & (F.col("edge_id") != F.col("_newest"))
    again = F.row_number().over(W.partitionBy("bg", *SOURCE, "chromosome_index", "edge_id").orderBy(*TARGET)) > 1
    ranked = edges_.repartition("bg", *SOURCE).withColumns({"_newest": newest, "_again": again}).withColumn("_lost", lost | (F.col("_again") & (F.col("chromosome_index") != S.NO_CHROMOSOME)))
    kept = ranked.withColumn("_gone", F.max("_lost").over(W.partitionBy("bg", *SOURCE, *TARGET))).where("not _gone").select(*edges_.columns)
    if not reach:
        return kept
    kept = materialized(kept)
    start = kept.where(F.col("s_node") == S.START_NODE).select("bg", *SOURCE).distinct()
    seen = reachable(kept, start.select("bg", *[F.col(c).alias(d) for c, d in zip(SOURCE, ("node_id", "start", "end"), strict=True)]))
    return kept.join(seen.select("bg", *[F.col(d).alias(c) for c, d in zip(SOURCE, ("node_id", "start", "end"), strict=True)]), ["bg", *SOURCE], "left_semi")


_NODE = ["node_id", "start", "end"]
_TO = [f"to_{n}" for n in _NODE]
#: The number of the block that stands for all that are known to be reached.
_REACHED = -(1 << 63)
#: Links that a job of a search goes ahead, the jobs until a graph is deep, and the doublings of a round of contraction.
STEPS, SHALLOW_JOBS, JUMPS = 8, 2, 6


def _block(cols: list[str]) -> Column:
    return F.struct(*[F.col(c).cast("long").alias(n) for c, n in zip(cols, _NODE, strict=True)])


def reachable(edges_: DataFrame, seeds: DataFrame, backwards: bool = False) -> DataFrame:
    """(bg, node_id, start, end): blocks that can be reached from the seeds, these included.

    Graphs that fit a task are searched there (see whole), the others by _spread_reachable.
    """
    a, b = (TARGET, SOURCE) if backwards else (SOURCE, TARGET)
    step = edges_.select("bg", *[F.col(c).cast("long").alias(n) for c, n in zip(a, _NODE, strict=True)], *[F.col(c).cast("long").alias(n) for c, n in zip(b, _TO, strict=True)]).na.drop(subset=[*_NODE, *_TO])
    nothing = [F.lit(None).cast("long").alias(n) for n in _TO]
    rows = materialized(step.unionByName(seeds.select("bg", *[F.col(c).cast("long").alias(c) for c in _NODE], *nothing)))
    small, large = whole.parted(rows)
    found = whole.by_graph(small, whole.reached_blocks, rows.select("bg", *_NODE).schema)
    if large is None:
        return materialized(found)
    return materialized(found).unionByName(_spread_reachable(large.where("to_node_id is not null").distinct(), large.where("to_node_id is null").select("bg", *_NODE)))


def _spread_reachable(step: DataFrame, seeds: DataFrame) -> DataFrame:
    """Reachability of large graphs over ways (bg, block, to block), each graph spread over all tasks.

    A few jobs go STEPS links ahead each, breadth first, which is all for shallow graphs. What is left of deeper ones is
    contracted (see _contracted), so that the rounds do not follow the depth. All graphs advance together.
    """
    to = _TO
    step = materialized(step)
    front = seen = materialized(seeds.distinct())
    for _ in range(SHALLOW_JOBS):
        at, every = front, None
        for k in range(1, STEPS + 1):
            at = at.join(step, ["bg", *_NODE]).select("bg", *[F.col(t).alias(n) for t, n in zip(to, _NODE, strict=True)]).distinct()
            one = at.withColumn("_k", F.lit(k))
            every = one if every is None else every.unionByName(one)
        new = materialized(every.groupBy("bg", *_NODE).agg(F.min("_k").alias("_k")).join(seen, ["bg", *_NODE], "left_anti"))
        seen = seen.unionByName(new.drop("_k"))
        front = new.where(F.col("_k") == STEPS).drop("_k")
        if not front.head(1):
            return seen
    ways = step.select("bg", _block(_NODE).alias("u"), _block(to).alias("v"))
    return _contracted(ways, materialized(seen.select("bg", _block(_NODE).alias("v")))).select("bg", "v.*")


def _contracted(ways: DataFrame, first: DataFrame) -> DataFrame:
    """(bg, v): blocks that can be reached from the first ones (bg, v), these included, over ways (bg, u, v).

    What is reached is one block. A block with a single way in is reached if the block before it is, so it is merged
    into that one, and its ways out become that one's; a block without a way in is left out. Chains, trees and bubbles
    collapse at once wherever they are, so the rounds follow the widest tangle. They end when no way leaves what is
    reached.
    """
    reached = F.struct(*[F.lit(_REACHED).alias(n) for n in _NODE])
    ways = ways.join(first, ["bg", "v"], "left_anti").join(first.select("bg", F.col("v").alias("u"), F.lit(True).alias("_in")), ["bg", "u"], "left")
    ways = materialized(ways.select("bg", F.when(F.col("_in"), reached).otherwise(F.col("u")).alias("u"), "v").where("u != v").distinct())
    merged: list[DataFrame] = []
    while ways.where(F.col("u") == reached).head(1):
        # into: the block that one is merged into, if there is one way in; ends: whether that block stays
        least = ways.groupBy("bg", "v").agg(F.min("u").alias("least"), F.max("u").alias("most"), F.max(F.col("u") == reached).alias("in"))
        into = least.select("bg", "v", F.when(F.col("in"), reached).when(F.col("least") == F.col("most"), F.col("least")).alias("into"))
        for _ in range(JUMPS):
            up = into.where("into is not null").select("bg", F.col("v").alias("into"), F.col("into").alias("up"))
            into = materialized(into.join(up, ["bg", "into"], "left").select("bg", "v", F.coalesce("up", "into").alias("into"), (F.col("into").isNotNull() & F.col("up").isNull()).alias("ends")))
        merged.append(into.where("ends").select("bg", "v", "into"))
        open_ = ways.join(into, ["bg", "v"]).where("not ends").select("bg", F.coalesce("into", "u").alias("u"), "v")
        ends = into.select("bg", F.col("v").alias("u"), F.when(F.col("ends"), F.col("into")).otherwise(F.col("v")).alias("to"))
        open_ = open_.join(ends, ["bg", "u"], "left").where(F.col("to").isNotNull() | (F.col("u") == reached))
        ways = materialized(open_.select("bg", F.coalesce("to", "u").alias("u"), "v").where("u != v").distinct(), instead_of=(ways,))
    found = first
    for level in reversed(merged):
        known = found.select("bg", F.col("v").alias("into"), F.lit(True).alias("_in"))
        new = level.join(known, ["bg", "into"], "left").where(F.col("_in") | (F.col("into") == reached))
        found = materialized(found.unionByName(new.select("bg", "v")))
    return found


def intermediate(edges_: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges on a way from a source to a target: both ends reached from the sources and reaching the targets."""
    edges_ = once(edges_)
    kinds = {f.name: f.dataType for f in edges_.schema}
    seeds = lambda df, k: df.select("bg", *[F.col(n).cast(kinds[c]).alias(c) for n, c in zip(_NODE, SOURCE, strict=True)], F.lit(k).alias("_kind"))
    rows = edges_.withColumn("_kind", F.lit(0)).unionByName(materialized(seeds(sources, 1).unionByName(seeds(targets, 2))), allowMissingColumns=True)
    small, large = whole.parted(rows)
    found = whole.by_graph(small, whole.between, edges_.schema)
    if large is None:
        return found
    sources, targets = (large.where(F.col("_kind") == k).select("bg", *[F.col(c).alias(n) for c, n in zip(SOURCE, _NODE, strict=True)]) for k in (1, 2))
    return found.unionByName(_spread_intermediate(large.where("_kind = 0").drop("_kind"), sources, targets))


def _spread_intermediate(edges_: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    edges_ = materialized(edges_)
    both = reachable(edges_, sources).join(reachable(edges_, targets, backwards=True), ["bg", "node_id", "start", "end"])
    named = lambda cols: both.select("bg", *[F.col(n).alias(c) for n, c in zip(("node_id", "start", "end"), cols, strict=True)])
    return edges_.join(named(SOURCE), ["bg", *SOURCE], "left_semi").join(named(TARGET), ["bg", *TARGET], "left_semi")


def boundary_heal(split: DataFrame, edges_: DataFrame) -> DataFrame:
    """Links that join two halves of a node that no edge joins: a block nothing leaves, and its neighbour nothing enters."""
    inner = split.where(~S.is_terminal(F.col("node_id")))
    out = edges_.select("bg", F.col("s_node").alias("node_id"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    into = edges_.select("bg", F.col("t_node").alias("node_id"), F.col("t_start").alias("start"), F.col("t_end").alias("end"))
    keys = ["bg", "node_id", "start", "end"]
    a = inner.join(out, keys, "left_anti").select("bg", "node_id", F.col("start").alias("s_start"), F.col("end").alias("at"))
    b = inner.join(into, keys, "left_anti").select("bg", "node_id", F.col("start").alias("at"), F.col("end").alias("t_end"))
    return a.join(b, ["bg", "node_id", "at"]).select("bg", "node_id", "s_start", "at", "t_end", F.lit(-1).cast("long").alias("edge_id"))


def components(pairs: DataFrame) -> DataFrame:
    """(bg, node, component): the smallest node that each node is connected to. pairs: (bg, a, b).

    Graphs that fit a task are labelled there (see whole) if nodes are whole numbers or structs of them, the others by
    _spread_components.
    """
    kind = pairs.schema["a"].dataType
    fields = kind.fields if isinstance(kind, T.StructType) else [T.StructField("", kind)]
    if pairs.schema["b"].dataType != kind or not all(isinstance(f.dataType, T.IntegralType) for f in fields):
        return _spread_components(pairs)
    flat = [F.col(x if not f.name else f"{x}.{f.name}").alias(f"{x}{i}") for x in "ab" for i, f in enumerate(fields)]
    rows = materialized(pairs.select("bg", *flat).na.drop())
    node = lambda x: F.struct(*[F.col(f"{x}{i}").alias(f.name) for i, f in enumerate(fields)]) if isinstance(kind, T.StructType) else F.col(f"{x}0")
    out = T.StructType([rows.schema["bg"], *[T.StructField(f"{x}{i}", f.dataType) for x in "nc" for i, f in enumerate(fields)]])
    small, large = whole.parted(rows)
    found = materialized(whole.by_graph(small, whole.component_labels(len(fields)), out).select("bg", node("n").alias("node"), node("c").alias("component")))
    return found if large is None else found.unionByName(_spread_components(large.select("bg", node("a").alias("a"), node("b").alias("b"))))


def _spread_components(pairs: DataFrame) -> DataFrame:
    """Components of large graphs, each spread over all tasks.

    Labels spread along the pairs and along labels themselves, so that long chains take few rounds.
    """
    both = pairs.select("bg", "a", "b").unionByName(pairs.select("bg", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialized(both)
    label = materialized(both.groupBy("bg", F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), ["bg", "b"]).groupBy("bg", "a").agg(F.min("component").alias("near"))
        step = label.join(near.withColumnRenamed("a", "node"), ["bg", "node"]).select("bg", "node", "component", F.least("component", "near").alias("low"))
        # the label's own label
        jump = step.select("bg", F.col("node").alias("low"), F.col("low").alias("lower"))
        after = materialized(step.join(jump, ["bg", "low"]).select("bg", "node", F.col("lower").alias("component"), (F.col("lower") != F.col("component")).alias("moved")))
        label = after.drop("moved")
        if not after.where("moved").head(1):
            return label


def simple_paths(edges_: DataFrame, by_edge: bool = False) -> DataFrame:
    """(bg, path): every way from START to END that repeats no block, as an array of blocks (or of edge ids).

    Ways are many by nature: this is for graphs of few bubbles, of any length. All graphs advance together, and a
    round adds one block, or a whole chain of blocks with one way in and one way out. Ways end, as no block repeats.
    """
    step = edges_.select("bg", _block(SOURCE).alias("s"), _block(TARGET).alias("t"), "edge_id")
    step = step if by_edge else step.select("bg", "s", "t").distinct().withColumn("edge_id", F.lit(0).cast("long"))
    step = _chained(materialized(step))
    ways = step.where(F.col("s.node_id") == S.START_NODE).select("bg", F.concat(F.array("s"), "ts").alias("path"), "ids", "t")
    done = None
    while True:
        ways = materialized(ways)
        over = ways.where(F.col("t.node_id") == S.END_NODE)
        done = over if done is None else done.unionByName(over)
        open_ = ways.where(F.col("t.node_id") != S.END_NODE).select("bg", F.col("t").alias("s"), "path", "ids")
        if not open_.head(1):
            return done.select("bg", F.col("ids" if by_edge else "path").alias("path"))
        more = step.select("bg", "s", "t", "ts", F.col("ids").alias("more"))
        grown = open_.join(more, ["bg", "s"]).where(~F.arrays_overlap("path", "ts"))
        ways = grown.select("bg", F.concat("path", "ts").alias("path"), F.concat("ids", "more").alias("ids"), "t")


def _chained(step: DataFrame) -> DataFrame:
    """Steps (bg, s, t, edge_id) with chains of steps made one: (bg, s, t, ts, ids), ts and ids in order.

    A block with one way in and one way out, other than START and END, is taken into the way that leads to it; what
    was joined doubles in length each round.
    """
    way = materialized(step.select("bg", "s", "t", F.array("t").alias("ts"), F.array("edge_id").alias("ids")))
    while True:
        out, into = way.groupBy("bg", F.col("s").alias("x")).count().where("count = 1"), way.groupBy("bg", F.col("t").alias("x")).count().where("count = 1")
        inner = out.select("bg", "x").join(into.select("bg", "x"), ["bg", "x"]).where(~S.is_terminal(F.col("x.node_id")))
        # every second block of a chain, by hash: one that is less than the inner blocks beside it
        rank = F.struct(F.xxhash64("x"), "x")
        named = inner.select("bg", "x", rank.alias("r"))
        ends = way.join(named.select("bg", F.col("x").alias("s"), F.col("r").alias("rs")), ["bg", "s"], "left").join(named.select("bg", F.col("x").alias("t"), F.col("r").alias("rt")), ["bg", "t"], "left")
        ends = materialized(ends)
        lower = ends.where("rs is not null").select("bg", F.col("s").alias("x"), F.col("rs").alias("r"), F.col("rt").alias("other"), (F.col("s") == F.col("t")).alias("own"))
        lower = lower.unionByName(ends.where("rt is not null").select("bg", F.col("t").alias("x"), F.col("rt").alias("r"), F.col("rs").alias("other"), (F.col("s") == F.col("t")).alias("own")))
        cut = materialized(lower.groupBy("bg", "x").agg(F.min(~F.col("own") & (F.col("other").isNull() | (F.col("r") < F.col("other")))).alias("least")).where("least").select("bg", "x"))
        if not cut.head(1):
            return way
        a = ends.join(cut.select("bg", F.col("x").alias("t")), ["bg", "t"]).select("bg", "s", F.col("t").alias("x"), F.col("ts").alias("ts1"), F.col("ids").alias("ids1"))
        b = ends.join(cut.select("bg", F.col("x").alias("s")), ["bg", "s"]).select("bg", "t", F.col("s").alias("x"), F.col("ts").alias("ts2"), F.col("ids").alias("ids2"))
        joined = a.join(b, ["bg", "x"]).select("bg", "s", "t", F.concat("ts1", "ts2").alias("ts"), F.concat("ids1", "ids2").alias("ids"))
        rest = ends.join(cut.select("bg", F.col("x").alias("t")), ["bg", "t"], "left_anti").join(cut.select("bg", F.col("x").alias("s")), ["bg", "s"], "left_anti")
        way = materialized(rest.select("bg", "s", "t", "ts", "ids").unionByName(joined), instead_of=(way,))


def _deepest(edges_: DataFrame) -> int:
    """More rounds than any way of an acyclic graph has links: those of the largest graph."""
    return (edges_.groupBy("bg").count().agg(F.max("count")).first()[0] or 0) + 2


def path_counts(edges_: DataFrame) -> DataFrame:
    """(bg, ways): how many ways lead from START to END of acyclic graphs, counted without listing them."""
    pairs = materialized(edges_.select("bg", F.struct(*SOURCE).alias("s"), F.struct(*TARGET).alias("t")).distinct())
    at = materialized(pairs.where(F.col("s.s_node") == S.START_NODE).groupBy("bg", "t").agg(F.count("*").cast("decimal(38,0)").alias("n")))
    done = None
    for _ in range(_deepest(pairs)):
        over = at.where(F.col("t.t_node") == S.END_NODE).select("bg", "n")
        done = over if done is None else done.unionByName(over)
        here = at.where(F.col("t.t_node") != S.END_NODE).select("bg", F.struct(F.col("t.t_node").alias("s_node"), F.col("t.t_start").alias("s_start"), F.col("t.t_end").alias("s_end")).alias("s"), "n")
        at = materialized(here.join(pairs, ["bg", "s"]).groupBy("bg", "t").agg(F.sum("n").cast("decimal(38,0)").alias("n")))
        if not at.head(1):
            return done.groupBy("bg").agg(F.sum("n").alias("ways"))
    raise RuntimeError("the graph has a cycle")


def all_sequences(edges: DataFrame, nodes: DataFrame, prune: bool = True) -> DataFrame:
    """(bg, sequence): the distinct texts that a graph can spell, read forwards. nodes: (node_id, sequence)."""
    linked = block_edges(edges, blocks(edges))
    ways = simple_paths(pruned(linked) if prune else linked).withColumn("way", F.xxhash64("bg", "path"))
    parts = ways.select("bg", "way", F.posexplode("path").alias("i", "b")).select("bg", "way", "i", "b.node_id", "b.start", "b.end").where(~S.is_terminal(F.col("node_id")))
    text = parts.join(nodes, "node_id").select("bg", "way", F.struct("i", S.slice_of(F.col("sequence"), F.col("start"), F.col("end")).alias("x")).alias("p"))
    spelled = text.groupBy("bg", "way").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["x"]), "").alias("sequence"))
    empty = ways.join(spelled, ["bg", "way"], "left_anti").select("bg", F.lit("").alias("sequence"))
    return spelled.select("bg", "sequence").unionByName(empty).distinct()


def project_paths(path_blocks: DataFrame, split: DataFrame) -> DataFrame:
    """Blocks of paths as blocks of the present graph: (path_id, idx, part, node_id, start, end, strand).

    path_blocks: (bg, path_id, idx, node_id, seq_start, seq_end, strand). A path is projected only if the graph's
    blocks cover each of its blocks exactly.
    """
    inside = I.overlap_join(path_blocks, split, ["bg", "node_id"], ("seq_start", "seq_end"), ("start", "end")).where((F.col("start") >= F.col("seq_start")) & (F.col("end") <= F.col("seq_end")))
    cover = inside.groupBy("bg", "path_id", "idx").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    bad = path_blocks.join(cover, ["bg", "path_id", "idx"], "left").where(F.coalesce("covered", F.lit(0)) != F.col("seq_end") - F.col("seq_start")).select("bg", "path_id").distinct()
    order = W.partitionBy("bg", "path_id", "idx").orderBy(F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start")))
    good = inside.join(bad, ["bg", "path_id"], "left_anti").withColumn("part", F.row_number().over(order) - 1)
    return good.select("bg", "path_id", "idx", "part", "node_id", "start", "end", "strand")


def spans(edges_: DataFrame, unambiguous: bool = False) -> DataFrame:
    """(bg, node_id, start, end, at): every offset from START at which each block of an acyclic graph can lie.

    unambiguous: leave out nodes of which two different spans overlap, by offset and then by base.
    """
    node = ["node_id", "start", "end"]
    step = materialized(edges_.select("bg", *[F.col(c).alias(n) for c, n in zip(SOURCE, node, strict=True)], *[F.col(c).alias(f"n_{n}") for c, n in zip(TARGET, node, strict=True)]).distinct())
    front = materialized(step.where(F.col("node_id") == S.START_NODE).select("bg", *node, F.lit(0).cast("long").alias("at")).distinct())
    seen = front
    for _ in range(_deepest(step)):
        grown = front.join(step, ["bg", *node]).select("bg", *[F.col(f"n_{n}").alias(n) for n in node], (F.col("at") + F.col("end") - F.col("start")).alias("at")).distinct()
        front = materialized(grown.join(seen, ["bg", *node, "at"], "left_anti"))
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    else:
        raise RuntimeError("the graph has a cycle")
    if not unambiguous:
        return seen
    a = seen.select("bg", "node_id", F.struct(F.col("at").alias("x"), F.col("start").alias("y")).alias("lo"), F.struct((F.col("at") + F.col("end") - F.col("start")).alias("x"), F.col("end").alias("y")).alias("hi"))
    b = a.select("bg", "node_id", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    clash = a.join(b, ["bg", "node_id"]).where(((F.col("lo") != F.col("lo2")) | (F.col("hi") != F.col("hi2"))) & (F.col("lo") < F.col("hi2")) & (F.col("lo2") < F.col("hi")))
    return seen.join(clash.select("bg", "node_id").distinct(), ["bg", "node_id"], "left_anti")


def depth(edges_: DataFrame) -> DataFrame:
    """(bg, node_id, start, end, depth): the longest number of links from START; the layers of a drawing."""
    node = ["node_id", "start", "end"]
    step = materialized(edges_.select("bg", *[F.col(c).alias(n) for c, n in zip(SOURCE, node, strict=True)], *[F.col(c).alias(f"n_{n}") for c, n in zip(TARGET, node, strict=True)]).distinct())
    front = materialized(step.where(F.col("node_id") == S.START_NODE).select("bg", *node).distinct())
    layers = front.withColumn("depth", F.lit(0).cast("long"))
    for k in range(1, _deepest(step) + 1):
        front = materialized(front.join(step, ["bg", *node]).select("bg", *[F.col(f"n_{n}").alias(n) for n in node]).distinct())
        if not front.head(1):
            return layers.groupBy("bg", *node).agg(F.max("depth").alias("depth"))
        layers = layers.unionByName(front.withColumn("depth", F.lit(k).cast("long")))
    raise RuntimeError("the graph has a cycle")


def _cut_nodes(pairs: list[tuple]) -> list:
    """Nodes whose removal disconnects an undirected graph, by one depth-first search without recursion."""
    near: dict = defaultdict(list)
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    seen: dict = {}
    low: dict = {}
    cut = set()
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        stack, roots = [(root, None, iter(near[root]))], 0
        while stack:
            v, parent, rest = stack[-1]
            for u in rest:
                if u not in seen:
                    seen[u] = low[u] = len(seen)
                    stack.append((u, v, iter(near[u])))
                    break
                if u != parent:
                    low[v] = min(low[v], seen[u])
            else:
                stack.pop()
                if parent is None:
                    continue
                low[parent] = min(low[parent], low[v])
                if parent == root:
                    roots += 1
                elif low[v] >= seen[parent]:
                    cut.add(parent)
        if roots > 1:
            cut.add(root)
    return sorted(cut)


def articulation_points(edges_: DataFrame) -> DataFrame:
    """(bg, node_id, start, end): blocks whose removal disconnects their graph. One graph is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = zip(zip(*[pdf[c] for c in SOURCE], strict=True), zip(*[pdf[c] for c in TARGET], strict=True), strict=True)
        found = _cut_nodes(sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}))
        return pd.DataFrame([(pdf["bg"].iloc[0], *x) for x in found], columns=["bg", "node_id", "start", "end"])

    flat = edges_.select("bg", *SOURCE, *TARGET).distinct()
    return flat.groupBy("bg").applyInPandas(run, f"bg {flat.schema['bg'].dataType.simpleString()}, node_id long, start long, end long")


def partitions(layers: DataFrame, cuts: DataFrame, least: int) -> DataFrame:
    """Blocks dealt to consecutive parts that end at articulation points and have at least so many blocks.

    layers: (bg, node_id, start, end, depth). A part ends at the first cut after it has enough blocks.
    """
    node = ["bg", "node_id", "start", "end"]
    w = W.partitionBy("bg").orderBy("depth", "node_id", "start")
    ranked = layers.withColumn("rank", F.row_number().over(w)).join(cuts.select(*node).withColumn("cut", F.lit(True)), node, "left")
    spans_ = ranked.withColumn("_span", F.floor((F.col("rank") - 1) / least))
    # the first cut in each stretch of that many blocks ends a part
    first = spans_.where("cut").groupBy("bg", "_span").agg(F.min("rank").alias("rank")).withColumn("_ends", F.lit(1))
    ends = ranked.join(first.select("bg", "rank", "_ends"), ["bg", "rank"], "left")
    part = F.coalesce(F.sum("_ends").over(W.partitionBy("bg").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("part", part).select(*node, "rank", "part")


def change_blocks(edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Blocks that a change touches: each node cut where edges leave and enter, from 0 to its length."""
    ends = edges.select(F.col("source_node").alias("node_id"), F.col("source_coordinate").alias("p")).unionByName(edges.select(F.col("target_node").alias("node_id"), F.col("target_coordinate").alias("p")))
    inner = ends.where(~S.is_terminal(F.col("node_id")))
    every = inner.unionByName(inner.select("node_id", F.lit(0).cast("long").alias("p"))).unionByName(inner.select("node_id").distinct().join(lengths, "node_id").select("node_id", F.col("length").alias("p")))
    return I.consecutive(every, ["node_id"], "p", "start", "end")


def _spread_closed(pairs: DataFrame) -> DataFrame:
    """(bg, first, last): of parts of large graphs without START and END, where cycle_breaks opens them."""
    links_ = materialized(pairs.distinct())
    label = _spread_components(links_)
    held = label.groupBy("bg", "component").agg(
        F.count("*").alias("n"), F.max(F.col("node.node_id") == S.START_NODE).alias("has_start"), F.max(F.col("node.node_id") == S.END_NODE).alias("has_end"), F.max("node").alias("largest"))
    closed = held.where("n >= 3 and not has_start and not has_end").select("bg", "component", "largest")
    back = links_.join(closed.select("bg", F.col("component").alias("b")), ["bg", "b"]).groupBy("bg", F.col("b").alias("component")).agg(F.max("a").alias("back"))
    ends = label.join(links_.select("bg", F.col("a").alias("node")).distinct(), ["bg", "node"], "left_anti").groupBy("bg", "component").agg(F.max("node").alias("sink"))
    return closed.join(back, ["bg", "component"], "left").join(ends, ["bg", "component"], "left").select("bg", F.col("component").alias("first"), F.coalesce("back", "sink", "largest").alias("last"))


def cycle_breaks(edges_: DataFrame) -> DataFrame:
    """Edges that open what neither START nor END is joined to: (bg, the edge's six fields, chromosome_index, phased).

    A component of three blocks or more without both begins at its first block (the smallest node) and ends at the
    block from which a link leads back to the first, the largest of several; where none does, at the largest block
    that nothing leaves. START leads to the one, the other to END, and END back to START. A ring keeps its order
    that way, turned so that its smallest node comes first.
    """
    rows = materialized(edges_.select("bg", *[F.col(c).cast("long").alias(c) for c in [*SOURCE, *TARGET]]))
    small, large = whole.parted(rows)
    names = [f"{x}_{n}" for x in ("first", "last") for n in ("node", "start", "end")]
    found = whole.by_graph(small, whole.closed_parts, T.StructType([rows.schema["bg"], *[T.StructField(n, T.LongType()) for n in names]]))
    found = found.select("bg", _block(names[:3]).alias("first"), _block(names[3:]).alias("last"))
    if large is not None:
        found = found.unionByName(_spread_closed(large.select("bg", _block(SOURCE).alias("a"), _block(TARGET).alias("b"))))
    plus, zero = F.lit("+"), F.lit(0).cast("long")
    one, two = F.lit(S.START_NODE).cast("long"), F.lit(S.END_NODE).cast("long")

    def edge(source: Column, at: Column, target: Column, to: Column) -> Column:
        return F.struct(source.alias("source_node"), at.alias("source_coordinate"), plus.alias("source_strand"), target.alias("target_node"), to.alias("target_coordinate"), plus.alias("target_strand"))

    three = F.array(edge(one, zero, F.col("first.node_id"), F.col("first.start")), edge(F.col("last.node_id"), F.col("last.end"), two, zero), edge(two, zero, one, zero))
    return found.select("bg", F.explode(three).alias("e")).select("bg", "e.*", F.lit(S.NO_CHROMOSOME).cast("long").alias("chromosome_index"), F.lit(0).alias("phased"))


def highlighted(projected: DataFrame) -> DataFrame:
    """Blocks of projected paths with the block that follows each: (path_id, idx, part, node_id, start, end, next).

    projected: what project_paths gives. next is null for a path's last block; START and END are left out.
    """
    inner = projected.where(~S.is_terminal(F.col("node_id")))
    follows = F.lead(F.struct("node_id", "start", "end")).over(W.partitionBy("path_id").orderBy("idx", "part"))
    return inner.select("path_id", "idx", "part", "node_id", "start", "end", follows.alias("next"))


# --- drawings ------------------------------------------------------------------------------------------------------


def layout(edges_: DataFrame, sweeps: int = 2) -> DataFrame:
    """(bg, node_id, start, end, layer, place): layers by the longest way from START, and the order inside a layer.

    A sweep orders each layer by the mean place of the blocks that lead to a block, which uncrosses links.
    """
    edges_ = materialized(edges_)
    layers = materialized(depth(edges_).withColumnRenamed("depth", "layer"))
    w = W.partitionBy("bg", "layer")
    at = layers.withColumn("place", F.row_number().over(w.orderBy("node_id", "start")) - 1)
    step = materialized(edges_.select("bg", _block(SOURCE).alias("s"), _block(TARGET).alias("t")).distinct())
    for _ in range(sweeps):
        at = materialized(at)
        named = at.withColumn("t", _block(_NODE))
        mean = step.join(named.select("bg", F.col("t").alias("s"), "place"), ["bg", "s"]).groupBy("bg", "t").agg((F.sum("place") / F.count("*")).alias("mean"))
        ordered = F.row_number().over(w.orderBy(F.coalesce("mean", F.col("place").cast("double")), "node_id", "start")) - 1
        at = named.join(mean, ["bg", "t"], "left").withColumn("place", ordered).select("bg", *_NODE, "layer", "place")
    return at


def scaled_layout(placed: DataFrame, label_width: int, scale: int = 1, aspect: float = 1.0) -> DataFrame:
    """placed with x1, x2 and y: where each block's label begins and ends, in whole characters.

    A layer is as wide as its widest label (the block's bases, label_width at most); labels stand in its middle, and a
    layer is moved by the widths of those before. Below a width of five there are no labels, and a block is one wide.
    """
    y = F.round(F.col("place") * float(scale * aspect)).cast("long")
    x = F.round(F.col("layer") * float(scale)).cast("long")
    placed = placed.withColumns({"x1": x, "y": y})
    if label_width < 5:
        return placed.withColumn("x2", F.col("x1") + 1)
    placed = placed.withColumn("_w", F.least(F.col("end") - F.col("start"), F.lit(label_width)))
    widths = placed.groupBy("bg", "x1").agg(F.max("_w").alias("_widest"))
    of_graph = W.partitionBy("bg").orderBy("x1")
    widths = widths.withColumn("_widest", F.when(F.row_number().over(of_graph) == 1, F.greatest("_widest", F.lit(1))).otherwise(F.col("_widest")))
    widths = widths.withColumn("_moved", F.coalesce(F.sum("_widest").over(of_graph.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    middle = F.round((F.col("_widest") - F.col("_w")) / 2).cast("long")
    done = placed.join(widths, ["bg", "x1"]).withColumn("x1", F.col("x1") + middle + F.col("_moved"))
    return done.withColumn("x2", F.col("x1") + F.col("_w")).select(*[c for c in placed.columns if c != "_w"], "x2")


def drawn_links(edges_: DataFrame, scaled: DataFrame) -> DataFrame:
    """(bg, s_node, .., t_end, x1, y1, x2, y2): links from the end of one label to before the next; START and END have none."""
    pairs = edges_.select("bg", *SOURCE, *TARGET).distinct().where(~S.is_terminal(F.col("s_node")) & ~S.is_terminal(F.col("t_node")))
    a = scaled.select("bg", *[F.col(n).alias(c) for n, c in zip(_NODE, SOURCE, strict=True)], F.col("x2").alias("_x1"), F.col("y").alias("y1"))
    b = scaled.select("bg", *[F.col(n).alias(c) for n, c in zip(_NODE, TARGET, strict=True)], (F.col("x1") - 1).alias("_x2"), F.col("y").alias("y2"))
    return pairs.join(a, ["bg", *SOURCE]).join(b, ["bg", *TARGET]).select("bg", *SOURCE, *TARGET, F.col("_x1").alias("x1"), "y1", F.col("_x2").alias("x2"), "y2")
