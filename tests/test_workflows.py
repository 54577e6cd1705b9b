"""Longer jobs on a store, end to end."""

import pytest
from pyspark.sql import functions as F
from test_repository import REF, files, repo, texts  # noqa: F401

from strandlake import workflows
from strandlake.repository import Repository
from strandlake.sources import readers


def test_chunks_and_stitch(repo):  # noqa: F811
    workflows.derive_chunks(repo, "test", "m123", [10, 20], "parts")
    got = {r["name"]: r["sequence"] for r in repo.sequences_of("test", "parts").collect()}
    assert got == {"m123.1": REF[:10], "m123.2": REF[10:20], "m123.3": REF[20:]}
    assert texts(repo, "parts") == set(got.values())
    workflows.make_stitch(repo, "test", ["m123.3", "m123.1"], "turned", "new", "parts")
    assert texts(repo, "turned") == {REF[20:] + REF[:10]}
    assert [r["sequence"] for r in repo.sequences_of("test", "turned").collect()] == [REF[20:] + REF[:10]]


def test_gfa_update_and_diff(repo, files):  # noqa: F811
    gfa = files("d.gfa", f"S\ta\t{REF[:10]}\nS\tb\t{REF[10:20]}\nS\tc\t{REF[20:]}\nS\tx\tTTTTT\nP\tone\ta+,b+,c+\t*\nP\ttwo\ta+,x+,c+\t*\n")
    workflows.update_with_gfa(repo, gfa, "test", "child")
    assert texts(repo, "child") == {REF, REF[:10] + "TTTTT" + REF[20:]}
    lines = {r["value"] for r in workflows.sample_diff(repo, "test", None, "child").collect()}
    assert sum(x.startswith("P\t") for x in lines) == 2 and any(x.endswith(REF) for x in lines if x.startswith("S\t"))


def test_gaf(spark, repo, files):  # noqa: F811
    node = repo.table("nodes").first()["node_id"]
    segments = spark.createDataFrame([("s1", node, len(REF))], "segment string, node_id long, length long")
    gaf = files("a.gaf", "e_left\t5\t0\t5\t+\t>s1\t34\t5\t10\t5\t5\t60\tcg:Z:5=\ne_right\t5\t0\t5\t+\t>s1\t34\t12\t17\t5\t5\t60\tcg:Z:5=\n")
    workflows.update_with_gaf(repo, gaf, files("e.csv", "id,left,sequence,right\ne,CGATC,TTTT,CGATC\n"), segments, "test", "g")
    got = {r["value"].split("\t")[2] for r in repo.gfa("test", "g").where("kind = 'S'").collect()}
    assert "TTTT" in got and REF[:10] in got


def test_library_and_genbank(spark, tmp_path, files):  # noqa: F811
    r = Repository(spark, str(tmp_path / "lib"))
    workflows.import_library(r, files("p.fa", ">a\nAA\n>b\nCC\n>c\nGG\n"), files("d.csv", "a,c\nb,\n"), "test", "pool")
    assert texts(r) == {"AAGG", "CCGG"}
    assert [x["sequence"] for x in r.sequences_of("test").collect()] == ["AAGG"]
    workflows.export_genbank(r, str(tmp_path / "gb"), "test")
    back = readers.genbank(spark, str(tmp_path / "gb")).first()
    assert back["sequence"] == "AAGG" and [f["qualifiers"].get("note") for f in back["features"]] == ["Replacement"]


def test_gff(repo, files):  # noqa: F811
    gff = files("a.gff", "##gff-version 3\nm123\tx\tGene\t5\t20\t.\t+\t.\tID=g\n")
    node = repo.table("nodes").first()["node_id"]
    assert [tuple(r)[:5] for r in workflows.translate_gff(repo, gff, "test").collect()] == [(str(node), "x", "Gene", 5, 20)]
    repo.update_with_fasta(files("u.fa", ">x\nAA\n"), "test", "child", "m123", 15, 25)
    assert [tuple(r) for r in repo.propagate_gff(gff, "test", None, "child").collect()] == [("ID=g", 5, 20)]


def test_streams(spark, tmp_path, files):  # noqa: F811
    from strandlake.streaming import lines

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.vcf").write_text("#x\nchr1\t5\t.\tA\tC\nchr1\t105\t.\tA\tC,T\n")
    q = lines.density(lines.variants(spark, str(folder)), "pos", 100).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("seen").collect())) == [("chr1", 0, 1), ("chr1", 1, 1)]
