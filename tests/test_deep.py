"""Graphs deeper, paths longer and keys larger than any fixed number of rounds."""

from __future__ import annotations

import random

from strandlake.operators import graph, intervals

LINKS = "bg long, s_node long, s_start long, s_end long, t_node long, t_start long, t_end long, edge_id long, source_strand string, target_strand string, chromosome_index long, phased int"


def linked(spark, pairs):
    size = lambda n: 0 if n < 3 else 1
    return spark.createDataFrame([(bg, s, 0, size(s), t, 0, size(t), i, "+", "+", 0, 0) for i, (bg, s, t) in enumerate(pairs)], LINKS)


def slow_reach(pairs, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        bg, n = todo.pop()
        for b, s, t in pairs:
            if (b, s) == (bg, n) and (b, t) not in seen:
                seen.add((b, t))
                todo.append((b, t))
    return seen


def tangles():
    """A chain with bubbles and skips, a random graph with cycles, a ring that nothing leads to, and parts without a way in."""
    random.seed(8)
    deep = [(1, 1, 10)] + [(1, 10 + i, 11 + i) for i in range(120)]
    deep += [(1, 10 + i, 1000 + i) for i in range(0, 120, 7)] + [(1, 1000 + i, 12 + i) for i in range(0, 120, 7)] + [(1, 10 + i, 15 + i) for i in range(3, 110, 11)]
    deep += [(1, 2000, 2001), (1, 2001, 2002), (1, 2002, 20), (1, 3000, 3001), (1, 3001, 3000), (1, 3001, 40)]
    wild = list({(2, random.randint(3, 60), random.randint(3, 60)) for _ in range(75)}) + [(2, 1, 5)]
    return deep + wild


def test_reachable_like_a_search(spark):
    pairs = tangles()
    seeds = [(1, 1), (2, 1)]
    df = spark.createDataFrame([(bg, n, 0, 0) for bg, n in seeds], "bg long, node_id long, start long, end long")
    got = {(r["bg"], r["node_id"]) for r in graph.reachable(linked(spark, pairs), df).collect()}
    assert got == slow_reach(pairs, seeds)
    back = [(1, 60), (2, 7)]
    df = spark.createDataFrame([(bg, n, 0, 1) for bg, n in back], "bg long, node_id long, start long, end long")
    got = {(r["bg"], r["node_id"]) for r in graph.reachable(linked(spark, pairs), df, backwards=True).collect()}
    assert got == slow_reach([(bg, t, s) for bg, s, t in pairs], back)


def test_long_ways(spark):
    """Ways of more than 60 blocks, with a bubble near either end."""
    n = 90
    pairs = [(1, 1, 10), *[(1, 10 + i, 11 + i) for i in range(n)], (1, 10 + n, 2), (1, 11, 500), (1, 500, 13), (1, n, 501), (1, 501, n + 2)]
    ways = [[b["node_id"] for b in r["path"]] for r in graph.simple_paths(linked(spark, pairs)).collect()]
    whole = [1, *range(10, 11 + n), 2]
    want = []
    for a in ([12], [500]):
        for b in ([n + 1], [501]):
            want.append([x for y in whole for x in (a if y == 12 else b if y == n + 1 else [y])])
    assert sorted(ways) == sorted(want)
    ids = graph.simple_paths(linked(spark, pairs), by_edge=True).collect()
    assert {len(r["path"]) for r in ids} == {n + 2} and len(ids) == 4


def test_bins_change_nothing(spark):
    random.seed(9)
    a = [(k % 2, random.randint(0, 500), 0) for k in range(80)]
    a = [(k, s, s + random.choice([0, 1, 5, 200])) for k, s, _ in a]
    b = [(k % 2, s, s + random.choice([0, 1, 7, 300])) for k, s in ((i, random.randint(0, 500)) for i in range(80))]
    x, y = spark.createDataFrame(a, "k int, s long, e long"), spark.createDataFrame(b, "k int, x long, y long")
    want = sorted((k, s, e, p, q) for k, s, e in a for j, p, q in b if j == k and s < q and p < e)
    points = sorted((k, s, p, q) for k, s, _ in a for j, p, q in b if j == k and p <= s < q)
    for size in (1, 16, intervals.BIN):
        assert sorted(map(tuple, intervals.overlap_join(x, y, ["k"], ("s", "e"), ("x", "y"), size).select("k", "s", "e", "x", "y").collect())) == want
        assert sorted(map(tuple, intervals.point_join(x.select("k", "s"), "s", y, ["k"], ("x", "y"), size).select("k", "s", "x", "y").collect())) == points
