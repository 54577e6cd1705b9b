"""Imports, updates, versions and exports of a store, end to end."""

import pytest

from strandlake.repository import Repository
from strandlake.sources import readers

REF = "ATCGATCGATCGATCGATCGGGAACACACAGAGA"
HEAD = "##fileformat=VCFv4.1\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def call(names, *records):
    return HEAD + "\t".join(names) + "\n" + "".join(f"m123\t{pos}\t.\t{ref}\t{alt}\t1\t.\t{info}\tGT\t" + "\t".join(gts) + "\n" for pos, ref, alt, info, gts in records)


@pytest.fixture
def files(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


@pytest.fixture
def repo(spark, tmp_path, files):
    r = Repository(spark, str(tmp_path / "store"))
    r.import_fasta(files("a.fa", ">m123 first\nATCGATCGATCGATCGATCG\nGGAACACACAGAGA\n"), "test")
    return r


def texts(repo, sample=None):
    return {r["sequence"] for r in repo.all_sequences("test", sample).collect()}


def test_variants(repo, files):
    repo.update_with_vcf(files("s.vcf", call(["unknown", "G1", "foo"], (3, "CG", "C", "GAN=del1;GAA=1", ["1/1", ".", "1/1"]), (10, "T", "TAGA", "TYPE=ins", ["1/1", ".", "0/0"]))), "test")
    assert texts(repo) == {REF} and texts(repo, "G1") == {REF}
    assert texts(repo, "foo") == {"ATCATCGATCGATCGATCGGGAACACACAGAGA"}
    assert texts(repo, "unknown") == {"ATCATCGATAGACGATCGATCGGGAACACACAGAGA"}


def test_alleles_and_copies(repo, files):
    repo.update_with_vcf(files("c.vcf", call(["bar", "baz"], (10, "TCG", "TG,T,TCAG", ".", ["0/1", "2/3"]))), "test")
    assert texts(repo, "bar") == {REF, "ATCGATCGATGATCGATCGGGAACACACAGAGA"}
    assert texts(repo, "baz") == {"ATCGATCGATATCGATCGGGAACACACAGAGA", "ATCGATCGATCAGATCGATCGGGAACACACAGAGA"}


def test_out_of_bounds(repo, files):
    with pytest.raises(ValueError):
        repo.update_with_vcf(files("o.vcf", call(["x"], (100, "T", "TAGA", ".", ["1/1"]))), "test")


def test_fasta_update_and_library(repo, files):
    repo.update_with_fasta(files("u.fa", ">x\nAAAAAAAA\n"), "test", "child", "m123", 2, 5)
    assert texts(repo, "child") == {REF, "ATAAAAAAAATCGATCGATCGATCGGGAACACACAGAGA"}
    parts = files("p.fa", ">p1\nAAAA\n>p2\nTAAT\n>p3\nCAAC\n>c1\nATGATAA\n>c2\nATGTTAA\n>c3\nATGCTAA\n")
    repo.update_with_library(parts, files("d.csv", "p1,c1\np2,c2\np3,c3"), "test", "pool", "m123", 7, 20)
    made = {REF[:7] + a + b + REF[20:] for a in ("AAAA", "TAAT", "CAAC") for b in ("ATGATAA", "ATGTTAA", "ATGCTAA")}
    assert texts(repo, "pool") == made | {REF}


def test_gfa(spark, tmp_path, files):
    r = Repository(spark, str(tmp_path / "gfa"))
    r.import_gfa(files("w.gfa", "H\tVN:Z:1.2\nS\t1\tACCT\nS\t2\tACAA\nS\t3\tATTC\nS\t4\tAAAC\nL\t1\t+\t2\t+\t*\nL\t2\t+\t3\t+\t*\nL\t3\t+\t4\t+\t*\nW\t291344\t0\t291344\t0\t16\t>1>2>3>4\t*\n"), "test")
    assert texts(r) == {"ACCTACAAATTCAAAC"}
    r.export_gfa(str(tmp_path / "out"), "test")
    again = Repository(spark, str(tmp_path / "again"))
    again.import_gfa(str(tmp_path / "out"), "test")
    assert texts(again) == {"ACCTACAAATTCAAAC"}
    assert [x["sequence"] for x in again.sequences_of("test").collect()] == ["ACCTACAAATTCAAAC"]


def test_genbank(spark, tmp_path, files):
    text = ('LOCUS       rec               20 bp    DNA     circular     27-NOV-2024\nFEATURES             Location/Qualifiers\n     source          1..20\n                     /mol_type="other DNA"\n'
            '     misc_feature    5..8\n                     /Original_Bases\n                     /note="Geneious type: Editing History Insertion"\nORIGIN\n        1 aaaattttaa aaaaaaaaaa\n//\n')
    r = Repository(spark, str(tmp_path / "gb"))
    r.import_genbank(files("x.gb", text), "test")
    assert texts(r) == {"AAAATTTTAAAAAAAAAAAA", "A" * 16}


def test_versions(repo, files, tmp_path):
    base = repo.head
    repo.create_branch("other")
    repo.update_with_fasta(files("u.fa", ">x\nAAAAAAAA\n"), "test", "child", "m123", 2, 5)
    assert [r["mark"] for r in repo.log().collect()] == [">", ""]
    repo.create_patch("HEAD", str(tmp_path / "patch"))
    moved = [(r["op"], r["direction"]) for r in repo.path_between(repo.head, base).collect()]
    assert moved == [(repo.head, "revert")]
    repo.checkout("other")
    assert repo.samples().count() == 0
    repo.merge("main")
    assert {r["sample"] for r in repo.samples().collect()} == {"child"}
    repo.reset(base)
    assert repo.samples().count() == 0
    repo.apply_patch(str(tmp_path / "patch"))
    assert texts(repo, "child") == {REF, "ATAAAAAAAATCGATCGATCGATCGGGAACACACAGAGA"}
    assert repo.push(str(tmp_path / "far")) == 2 and repo.push(str(tmp_path / "far")) == 0
    with pytest.raises(ValueError):
        repo.merge("other")


def test_readers(spark, files):
    bed = readers.bed(spark, files("b.bed", "m123\t1\t10\tabc\t0\n")).first()
    assert tuple(bed) == ("m123", 1, 10, "abc\t0")
    gaf = readers.gaf(spark, files("a.gaf", "q\t50\t0\t50\t+\t>454.0<455.0\t50\t0\t50\t50\t50\t31\ttp:A:P\tcg:Z:50=\n")).first()
    assert [tuple(s) for s in gaf["steps"]] == [("454.0", "+"), ("455.0", "-")] and gaf["cigar"] == "50="
    lib = readers.library(spark, files("l.csv", "a,b\nc,\n")).select("slot", "part").collect()
    assert sorted(map(tuple, lib)) == [(0, "a"), (0, "c"), (1, "b")]
    g = readers.gfa(spark, files("x.gfa", "S 1 AC\nS 3 GT\nP p 1+,3- *\n"))
    assert [(r["segment"], r["strand"]) for r in g["paths"].orderBy("step").collect()] == [("1", "+"), ("3", "-")]
    assert tuple(readers.gfa_ids(g["segments"]).first()) == (True, False)
    assert readers.filled_segments(g["segments"]).count() == 3
    names = spark.createDataFrame([("s#1#c",), ("t#0#c",)], "name string")
    assert {r["genome"] for r in readers.pansn(names).collect()} == {"s", "t"}


def test_rings_are_opened(spark, tmp_path, files):
    """A ring of segments begins at its smallest node; a chain keeps its own ends."""
    r = Repository(spark, str(tmp_path / "rings"))
    r.import_gfa(files("ring.gfa", "H\tVN:Z:1.0\nS\ta\tAAAA\nS\tb\tCC\nS\tc\tGGG\nL\ta\t+\tb\t+\t0M\nL\tb\t+\tc\t+\t0M\nL\tc\t+\ta\t+\t0M\nS\tx\tTTTT\nS\ty\tTAT\nL\tx\t+\ty\t+\t0M\n"), "test")
    e = r.edges(r.graphs("test"))
    ends = {(x["source_node"], x["target_node"]) for x in e.collect() if x["source_node"] < 3 or x["target_node"] < 3}
    inner = {x["source_node"]: x["target_node"] for x in e.collect() if x["source_node"] > 2 and x["target_node"] > 2}
    ring = {a for a in inner if inner.get(inner.get(inner[a], 0), 0) == a}
    first = min(ring)
    last = next(a for a in ring if inner[a] == first)
    x, y = next((a, b) for a, b in inner.items() if a not in ring)
    assert ends == {(1, first), (last, 2), (2, 1), (1, x), (y, 2)}
    # the ring is read once around, from its first node
    assert texts(r) >= {"TTTTTAT"} and len(texts(r)) == 2 and len(max(texts(r), key=len)) == 9


def test_accessions(repo, files):
    repo.add_accession("test", "m123", "part", 4, 20)
    assert [r["sequence"] for r in repo.accession_sequence("part").collect()] == [REF[4:20]]
    with pytest.raises(ValueError):
        repo.add_accession("test", "m123", "part", 1, 3)
    with pytest.raises(ValueError):
        repo.add_accession("test", "m123", "far", 20, 400)
    repo.update_with_fasta(files("u.fa", ">x\nAAAA\n"), "test", "kid", "m123", 2, 5)
    assert repo.table("accessions").where("name = 'part'").count() == 2


def test_operations_need_what_they_name(repo, files, spark, tmp_path):
    """A patch is not applied where the graph that it changes is not there."""
    repo.update_with_fasta(files("u.fa", ">x\nAAAA\n"), "test", "kid", "m123", 2, 5)
    repo.create_patch("HEAD", str(tmp_path / "patch"))
    with pytest.raises(ValueError, match="needs"):
        Repository(spark, str(tmp_path / "other")).apply_patch(str(tmp_path / "patch"))


def test_files_and_counts(repo, files):
    vcf = files("n.vcf", call(["a", "b"], (3, "C", "G", ".", ["1/1", "0/1"]), (9, "A", "T", ".", ["0/0", "1/1"])))
    repo.add_file(vcf, "vcf")
    assert [r["file_path"] for r in repo.files_of("HEAD~1").collect()] == [vcf]
    assert {(r["sample"], r["changes"]) for r in repo.variant_counts(vcf, "test").collect()} == {("a", 2), ("b", 3)}


def test_readers_read_to_the_end(spark, files):
    gfa = readers.gfa(spark, files("h.gfa", "H\t" + "\t".join(f"t{i}:i:{i}" for i in range(150)) + "\nS\ta\tAC\n"))
    assert gfa["header"].count() == 150
    bed = readers.bed(spark, files("b.bed", "c\t1\t2\t" + "\t".join(map(str, range(1500))) + "\n"))
    assert bed.first()["rest"].count("\t") == 1499
    fa = {r["name"]: (r["description"], r["sequence"]) for r in readers.fasta(spark, files("g.fa", ">a x > y\nAC\nGT\n>b\nTT\n")).collect()}
    assert fa == {"a": ("x > y", "ACGT"), "b": ("", "TT")}
    csv = files("e.csv", "id,left,sequence,right\n" + "".join(f",a,{'ACGT' * (i % 3)},b\n" for i in range(50)))
    assert {r["id"] for r in readers.edit_list(spark, csv).collect()} == {f"_gen_{i}" for i in range(50)}
