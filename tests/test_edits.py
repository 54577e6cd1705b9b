"""Edits of a chain of four nodes of ten bases, against what they must spell."""

import pytest
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import edits, graph, paths

A, T, C, G = "A" * 10, "T" * 10, "C" * 10, "G" * 10
WHOLE = A + T + C + G
GOLD = [
    (7, 15, "NNNN", "A" * 7 + "NNNN" + "T" * 5 + C + G), (15, 15, "NNNN", A + "T" * 5 + "NNNN" + "T" * 5 + C + G), (12, 17, "NNNN", A + "TT" + "NNNN" + "TTT" + C + G),
    (10, 10, "NNNN", A + "NNNN" + T + C + G), (9, 9, "NNNN", "A" * 9 + "NNNN" + "A" + T + C + G), (10, 20, "NNNN", A + "NNNN" + C + G), (15, 25, "NNNN", A + "T" * 5 + "NNNN" + "C" * 5 + G),
    (5, 35, "NNNN", "A" * 5 + "NNNN" + "G" * 5), (19, 31, "", A + "T" * 9 + "G" * 9), (0, 0, "NNNN", "NNNN" + WHOLE), (40, 40, "NNNN", WHOLE + "NNNN"),
    (10, 11, "NNNN", A + "NNNN" + "T" * 9 + C + G), (19, 20, "NNNN", A + "T" * 9 + "NNNN" + C + G), (0, 1, "", "A" * 9 + T + C + G), (35, 40, "", A + T + C + "G" * 5), (10, 12, "", A + "T" * 8 + C + G), (18, 20, "", A + "T" * 8 + C + G),
]


def chain(spark):
    text = spark.createDataFrame([(3, A), (4, T), (5, C), (6, G)], "node_id long, sequence string")
    stops = [(1, 0, 3, 0), (3, 10, 4, 0), (4, 10, 5, 0), (5, 10, 6, 0), (6, 10, 2, 0)]
    rows = [(1, i, s, sc, "+", t, tc, "+") for i, (s, sc, t, tc) in enumerate(stops)]
    e = spark.createDataFrame(rows, "path_id long, idx long, source_node long, source_coordinate long, source_strand string, target_node long, target_coordinate long, target_strand string")
    return text, e.withColumn("edge_id", S.key_number(F.concat_ws(":", *edits.EDGE)))


def spelled(spark, changes):
    text, e = chain(spark)
    schema = "change_id long, path_id long, start long, end long, node_id long, node_start long, node_end long, chromosome_index long, phased int, preserve boolean"
    made = [(i, 1, s, t, 100 + i, 0, len(x), ci, 0, keep) for i, (s, t, x, ci, keep) in enumerate(changes)]
    c = spark.createDataFrame(made, schema)
    nodes = text.unionByName(spark.createDataFrame([(100 + i, x[2]) for i, x in enumerate(changes) if x[2]] or [(99, "")], "node_id long, sequence string"))
    blocks = paths.path_blocks(paths.blocks_from_edges(e))
    if edits.out_of_bounds(c, blocks).head(1):
        raise ValueError
    edges = e.select(F.lit(1).cast("long").alias("bg"), "edge_id", *edits.EDGE, F.lit(0).cast("long").alias("chromosome_index"), F.lit(0).alias("phased"))
    every = edits.apply_changes(edges, edits.edit_edges(c, blocks), c.select("change_id", F.lit(1).cast("long").alias("bg")))
    return {r["sequence"] for r in graph.all_sequences(every, nodes, prune=False).collect()}


@pytest.mark.parametrize(("start", "end", "text", "want"), GOLD)
def test_edit(spark, start, end, text, want):
    assert spelled(spark, [(start, end, text, 1, True)]) == {WHOLE, want}


def test_two_edits(spark):
    got = spelled(spark, [(7, 15, "NNNN", 1, True), (19, 31, "", 1, True)])
    assert len(got) == 4 and WHOLE in got


@pytest.mark.parametrize("bad", [(350, 400), (-300, 400)])
def test_out_of_bounds(spark, bad):
    with pytest.raises(ValueError):
        spelled(spark, [(*bad, "NNNN", 1, True)])


def test_sequence_of_reverse_strand(spark):
    blocks = spark.createDataFrame([(1, 0, 3, 0, 4, "+"), (1, 1, 4, 2, 5, "-")], "path_id long, idx long, node_id long, seq_start long, seq_end long, strand string")
    nodes = spark.createDataFrame([(3, "ACGTAA"), (4, "TTCAGT")], "node_id long, sequence string")
    assert paths.path_sequence(blocks, nodes).first()["sequence"] == "ACGT" + "CTG"


def test_library_edges_once_each(spark, monkeypatch):
    """Parts in several slots, parts that are the pool's own cuts, slots with gaps, pools without parts or cuts; in slices."""
    import random

    random.seed(6)
    parts = [(random.randint(0, 5), random.choice([0, 1, 2, 4, 5]), random.randint(3, 9), random.randint(0, 2)) for _ in range(150)]
    cuts = [(p, 3 + p, p % 3, 4 + p, p % 2) for p in (0, 1, 2, 3, 4, 7)] + [(1, 1, 0, 2, 0)]
    want = set()
    for pool in {p for p, *_ in parts}:
        own = {s: {(n, k) for p, t, n, k in parts if (p, t) == (pool, s)} for p0, s, *_ in parts if p0 == pool}
        for p, sn, sa, en, ea in cuts:
            if p == pool:
                want |= {(pool, sn, sa, n, 0) for n, _ in own[min(own)]} | {(pool, n, k, en, ea) for n, k in own[max(own)]}
        want |= {(pool, a, k, b, 0) for s in own for a, k in own[s] for b, _ in own.get(s + 1, ())}
    p = spark.createDataFrame(parts, "pool long, slot int, node_id long, length long")
    c = spark.createDataFrame(cuts, "pool long, s_node long, s_at long, e_node long, e_at long")
    cols = ["pool", "source_node", "source_coordinate", "target_node", "target_coordinate"]
    for size in (512, 2):
        monkeypatch.setattr(edits, "SLICE", size)
        got = edits.library_edges(p, c, preserve=False).select(*cols)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        # the pairs themselves are not shuffled and compared
        assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()
