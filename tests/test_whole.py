"""Searches inside tasks: the same rows as those spread over all tasks, and no rounds that follow the depth."""

from __future__ import annotations

import random

import pytest
from test_deep import linked, slow_reach, tangles

from strandlake.operators import graph, whole


@pytest.fixture(params=[whole.MOST_ROWS, 60, 0])
def most_rows(request, monkeypatch):
    """Every graph in a task, some, none; few graphs a call."""
    monkeypatch.setattr(whole, "MOST_ROWS", request.param)
    return request.param


def wild_parts():
    """Rings, chains, parts with START or END, pairs, loops of one; as (bg, s, t)."""
    random.seed(3)
    out = []
    for bg in range(60):
        nodes = [*range(3, 3 + random.randint(2, 14)), *([1] if bg % 5 == 0 else []), *([2] if bg % 7 == 0 else [])]
        out += [(bg, random.choice(nodes), random.choice(nodes)) for _ in range(random.randint(1, 14))]
    return out + [(99, 5 + i, 5 + (i + 1) % 80) for i in range(80)]


def slow_breaks(pairs):
    want = []
    for bg in {p[0] for p in pairs}:
        own = [(s, t) for b, s, t in pairs if b == bg]
        left = {x for p in own for x in p}
        while left:
            part, todo = set(), [min(left)]
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += [t if s == x else s for s, t in own if x in (s, t)]
            left -= part
            if len(part) >= 3 and not part & {1, 2}:
                first = min(part)
                back = [s for s, t in own if t == first]
                sinks = [x for x in part if not any(s == x for s, _ in own)]
                last = max(back or sinks or part)
                want += [(bg, 1, 0, first, 0), (bg, last, 1, 2, 0), (bg, 2, 0, 1, 0)]
    return sorted(want)


def test_cycle_breaks_by_brute_force(spark, most_rows):
    pairs = wild_parts()
    got = graph.cycle_breaks(linked(spark, pairs + pairs[::3])).select("bg", "source_node", "source_coordinate", "target_node", "target_coordinate")
    assert sorted(map(tuple, got.collect())) == slow_breaks(pairs)


def test_components_of_all_kinds(spark, most_rows):
    pairs = wild_parts()
    df = spark.createDataFrame(pairs, "bg long, a long, b long")
    got = {(r["bg"], r["node"]): r["component"] for r in graph.components(df).collect()}
    both = pairs + [(bg, t, s) for bg, s, t in pairs]
    assert set(got) == {(bg, x) for bg, *p in pairs for x in p}
    for (bg, x), c in list(got.items())[::9]:
        assert c == min(n for _, n in slow_reach(both, [(bg, x)]))
    text = spark.createDataFrame([(bg, f"{a:03}", f"{b:03}") for bg, a, b in pairs], "bg long, a string, b string")
    assert {(r["bg"], int(r["node"])): int(r["component"]) for r in graph.components(text).collect()} == got


def test_reached_and_between(spark, most_rows, monkeypatch):
    monkeypatch.setattr(whole, "BATCH_ROWS", 50)
    pairs = tangles() + wild_parts()
    edges = linked(spark, pairs)
    block = "bg long, node_id long, start long, end long"
    first, last = [(1, 10), (1, 1007), (2, 5), (99, 7), (7, 3), (500, 9)], [(1, 60), (2, 7), (2, 8), (99, 6), (8, 3)]
    sources, targets = (spark.createDataFrame([(bg, n, 0, 1) for bg, n in x], block) for x in (first, last))
    fore = slow_reach(pairs, first)
    assert {(r["bg"], r["node_id"]) for r in graph.reachable(edges, sources).collect()} == fore
    both = fore & slow_reach([(bg, t, s) for bg, s, t in pairs], last)
    want = sorted(i for i, (bg, s, t) in enumerate(pairs) if (bg, s) in both and (bg, t) in both)
    got = graph.intermediate(edges, sources, targets)
    assert got.columns == edges.columns and sorted(r["edge_id"] for r in got.collect()) == want


def test_written_rounds_do_not_follow_the_depth(spark, monkeypatch):
    """Of graphs that fit a task; spread ones write more rounds the larger they are."""
    written, real = [], graph.materialized
    monkeypatch.setattr(graph, "materialized", lambda *a, **k: written.append(1) or real(*a, **k))
    seeds = spark.createDataFrame([(1, 3, 0, 1)], "bg long, node_id long, start long, end long")
    for run in (graph.cycle_breaks, lambda ring: graph.reachable(ring, seeds)):
        counts = set()
        for n in (20, 500):
            written.clear()
            run(linked(spark, [(1, 3 + i, 3 + (i + 1) % n) for i in range(n)])).collect()
            counts.add(len(written))
        assert len(counts) == 1
