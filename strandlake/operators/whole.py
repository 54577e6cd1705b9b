"""Graphs that fit a task, searched on arrays, many graphs at a time.

Graphs of at most MOST_ROWS rows are dealt by graph; a task takes as many as make BATCH_ROWS and advances them together,
in plain array steps. Larger graphs are left to the operators that spread one graph over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.session import materialized

MOST_ROWS = 100_000
BATCH_ROWS = 200_000
OUT_ROWS = 20_000


def parted(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of graphs that fit a task, and those of the others, if there are any. Rows without a graph are left out."""
    rows = rows.where("bg is not null")
    large = materialized(rows.groupBy("bg").count().where(F.col("count") > MOST_ROWS).select("bg"))
    if not large.head(1):
        return rows, None
    return rows.join(large, "bg", "left_anti"), rows.join(large, "bg", "left_semi")


def by_graph(rows: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema) -> DataFrame:
    """What the kernel makes of whole graphs, as many a call as make BATCH_ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < BATCH_ROWS:
                continue
            table = pa.Table.from_batches(held)
            cut = pc.index(table["bg"], table["bg"][-1]).as_py()
            if cut:
                yield from kernel(table.slice(0, cut)).to_batches(OUT_ROWS)
                held, size = table.slice(cut).to_batches(), size - cut
        if held:
            yield from kernel(pa.Table.from_batches(held)).to_batches(OUT_ROWS)

    return rows.repartition("bg").sortWithinPartitions("bg").mapInArrow(run, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def coded(parts: list[tuple[pa.Table, list[str]]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of the blocks (graph and the named columns) of each table, in the blocks' order within a graph.

    Also where each block is first found, as a place in all tables one after the other.
    """
    columns = [np.concatenate([_column(t, names[i]) for t, names in parts]) for i in range(len(parts[0][1]))]
    code = pd.factorize(pd.concat([t["bg"].to_pandas() for t, _ in parts], ignore_index=True))[0]
    for c in columns:
        other, kinds = pd.factorize(c)
        code = pd.factorize(code * max(len(kinds), 1) + other)[0]
    at = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]
    order = np.lexsort([c[at] for c in reversed(columns)])
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    ends = np.cumsum([t.num_rows for t, _ in parts])[:-1]
    return np.split(rank[code], ends), at[order]


def reached(n: int, a: np.ndarray, b: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Which of n blocks the seeds lead to over the ways from a to b, these included."""
    to = b[np.argsort(a, kind="stable")]
    first = np.append(0, np.cumsum(np.bincount(a, minlength=n)))
    seen = np.zeros(n, bool)
    front = np.unique(seeds)
    while len(front):
        seen[front] = True
        size = first[front + 1] - first[front]
        near = to[np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        front = np.unique(near[~seen[near]])
    return seen


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest block that each of n blocks is connected to."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def closed_parts(table: pa.Table) -> pa.Table:
    """bg and the first and the last block of each part without START and END; see graph.cycle_breaks."""
    names = [["s_node", "s_start", "s_end"], ["t_node", "t_start", "t_end"]]
    (a, b), at = coded([(table, names[0]), (table, names[1])])
    n, every = len(at), np.arange(len(at))
    root = roots(n, a, b)
    fields = [np.concatenate([_column(table, s), _column(table, t)])[at] for s, t in zip(*names, strict=True)]
    size = np.bincount(root, minlength=n)
    joined = np.zeros(n, bool)
    joined[root[(fields[0] == S.START_NODE) | (fields[0] == S.END_NODE)]] = True
    largest, sink, back = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    np.maximum.at(largest, root, every)
    nothing = np.ones(n, bool)
    nothing[a] = False
    np.maximum.at(sink, root[nothing], every[nothing])
    leads = root[b] == b
    np.maximum.at(back, b[leads], a[leads])
    first = np.flatnonzero((root == every) & (size >= 3) & ~joined)
    last = np.where(back[first] >= 0, back[first], np.where(sink[first] >= 0, sink[first], largest[first]))
    out = {"bg": table["bg"].take(at[first] % max(table.num_rows, 1))}
    for kind, blocks in (("first", first), ("last", last)):
        out |= {f"{kind}_{c}": f[blocks] for c, f in zip(("node", "start", "end"), fields, strict=True)}
    return pa.table(out)


def component_labels(width: int) -> Callable[[pa.Table], pa.Table]:
    """A kernel that makes (bg, n0.., c0..), each node and its component, of pairs (bg, a0.., b0..)."""
    a_names, b_names = ([f"{x}{i}" for i in range(width)] for x in "ab")

    def run(table: pa.Table) -> pa.Table:
        (a, b), at = coded([(table, a_names), (table, b_names)])
        root = roots(len(at), a, b)
        out = {"bg": table["bg"].take(at % max(table.num_rows, 1))}
        fields = [np.concatenate([_column(table, x), _column(table, y)])[at] for x, y in zip(a_names, b_names, strict=True)]
        return pa.table(out | {f"n{i}": f for i, f in enumerate(fields)} | {f"c{i}": f[root] for i, f in enumerate(fields)})

    return run


def reached_blocks(table: pa.Table) -> pa.Table:
    """Blocks (bg, node_id, start, end) that rows without a way (to_node_id null) lead to over the others."""
    seed = table["to_node_id"].is_null()
    ways, seeds = table.filter(pc.invert(seed)), table.filter(seed)
    here, to = ["node_id", "start", "end"], ["to_node_id", "to_start", "to_end"]
    (a, b, s), at = coded([(ways, here), (ways, to), (seeds, here)])
    found = at[reached(len(at), a, b, s)]
    bg = pa.chunked_array([c for t in (ways, ways, seeds) for c in t["bg"].chunks], table["bg"].type)
    return pa.table({"bg": bg.take(found)} | {h: np.concatenate([_column(ways, h), _column(ways, t), _column(seeds, h)])[found] for h, t in zip(here, to, strict=True)})


def between(table: pa.Table) -> pa.Table:
    """Edges (_kind 0) on a way from a source (_kind 1) to a target (_kind 2)."""
    kind = _column(table, "_kind")
    edges, seeds = table.filter(pa.array(kind == 0)).drop_columns(["_kind"]), table.filter(pa.array(kind > 0))
    source, target = ["s_node", "s_start", "s_end"], ["t_node", "t_start", "t_end"]
    (a, b, s), at = coded([(edges, source), (edges, target), (seeds, source)])
    kind = kind[kind > 0]
    both = reached(len(at), a, b, s[kind == 1]) & reached(len(at), b, a, s[kind == 2])
    return edges.filter(pa.array(both[a] & both[b]))
