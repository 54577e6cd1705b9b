"""The store from the command line: ``python -m strandlake.cli --repo FOLDER COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import workflows
from strandlake.functions import scalars as S
from strandlake.operators import paths
from strandlake.repository import Repository
from strandlake.sources import readers, writers


def _show(df: DataFrame) -> None:
    for r in df.toLocalIterator():
        print("\t".join("" if x is None else str(x) for x in r))


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake", description=__doc__)
    top.add_argument("--repo", default=".", help="folder of the store")
    top.add_argument("--collection", default=None, help="collection; the default one if it is left out")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a, **({"action": "store_true"} if a in ("--list", "--create", "--delete") else {}))
        return p

    command("init")
    command("import", "--fasta", "--genbank", "--gfa", "--library", "--parts", "--region", "--sample")
    command("update", "--vcf", "--fasta", "--genbank", "--gfa", "--library", "--parts", "--gaf", "--csv", "--segments", "--sample", "--new-sample", "--region", "--start", "--end", "--genotype")
    command("update-gaf", "--gaf", "--csv", "--segments", "--sample", "--new-sample")
    command("export", "--fasta", "--gfa", "--genbank", "--sample", "--node-max")
    command("transform", "--csv", "--out")
    command("translate", "--bed", "--gff", "--sample")
    command("propagate-annotations", "--gff", "--from-sample", "--to-sample")
    command("get-sequence", "--sample", "--graph", "--region", "--start", "--end")
    command("list-samples")
    command("list-graphs", "--sample")
    command("view", "graph")
    command("diff", "--sample1", "--sample2", "--gfa")
    command("derive-subgraph", "--sample", "--new-sample", "--region")
    command("derive-chunks", "--sample", "--new-sample", "--region", "--breakpoints", "--chunk-size")
    command("make-stitch", "--sample", "--new-sample", "--regions", "--new-region")
    command("operations", "--branch")
    command("branch", "--list", "--create", "--delete", "name").set_defaults(name=None)
    sub.choices["branch"]._actions[-1].nargs = "?"
    command("merge", "branch_name")
    command("checkout", "--branch", "--operation")
    command("reset", "operation")
    command("apply", "operation")
    command("patch-create", "operations_", "--name")
    command("patch-apply", "patch")
    command("patch-view", "patch")
    command("defaults", "--default-collection")
    command("set-remote", "remote")
    command("push", "--remote")
    command("pull")
    command("query", "sql")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("strandlake").getOrCreate()
    repo = Repository(spark, a.repo)
    where = a.collection or repo.settings.get("collection", "default")
    sample = getattr(a, "sample", None)
    new = getattr(a, "new_sample", None)
    c = a.command
    if c == "init":
        repo.save()
    elif c == "import":
        if a.fasta:
            repo.import_fasta(a.fasta, where, sample)
        elif a.genbank:
            repo.import_genbank(a.genbank, where, sample)
        elif a.gfa:
            repo.import_gfa(a.gfa, where, sample)
        else:
            workflows.import_library(repo, a.parts, a.library, where, a.region, sample)
    elif c in ("update", "update-gaf"):
        if getattr(a, "vcf", None):
            repo.update_with_vcf(a.vcf, where, a.genotype, new, sample)
        elif getattr(a, "gaf", None):
            names = spark.read.option("header", True).csv(a.segments).select("segment", F.col("node_id").cast("long"), F.col("length").cast("long"))
            workflows.update_with_gaf(repo, a.gaf, a.csv, names, where, new, sample)
        elif a.fasta:
            repo.update_with_fasta(a.fasta, where, new, a.region, int(a.start), int(a.end), sample)
        elif a.genbank:
            repo.update_with_genbank(a.genbank, where, new, sample)
        elif a.gfa:
            workflows.update_with_gfa(repo, a.gfa, where, new, sample)
        else:
            repo.update_with_library(a.parts, a.library, where, new, a.region, int(a.start), int(a.end), sample)
    elif c == "export":
        if a.fasta:
            repo.export_fasta(a.fasta, where, sample)
        if a.gfa:
            repo.export_gfa(a.gfa, where, sample, int(a.node_max) if a.node_max else None)
        if a.genbank:
            workflows.export_genbank(repo, a.genbank, where, sample)
    elif c == "transform":
        arms = writers.arms_fasta(readers.edit_list(spark, a.csv))
        writers.write_lines(arms.select(writers.fasta_lines(F.col("name"), F.col("sequence")).alias("value")), a.out)
    elif c == "translate":
        _show(repo.translate_bed(a.bed, where, sample) if a.bed else workflows.translate_gff(repo, a.gff, where, sample))
    elif c == "propagate-annotations":
        _show(repo.propagate_gff(a.gff, where, a.from_sample, a.to_sample))
    elif c == "get-sequence":
        name, start, end = a.graph, a.start, a.end
        if a.region:
            r = spark.range(1).select(S.region(F.lit(a.region)).alias("r")).first()["r"]
            name, start, end = r["name"], r["start"], r["end"]
        rows = repo.sequences_of(where, sample).where(F.col("name") == name) if name else repo.sequences_of(where, sample)
        rows = rows.withColumns({"_s": F.lit(int(start or 0)), "_e": F.coalesce(F.lit(int(end) if end is not None else None), F.length("sequence"))})
        _show(paths.subsequence(rows, "_s", "_e").select("subsequence"))
    elif c == "list-samples":
        _show(repo.samples())
    elif c == "list-graphs":
        _show(repo.graphs(where, sample).select("name"))
    elif c == "view":
        g = repo.graphs(where).where(F.col("name") == a.graph).first()
        print(json.dumps(repo.graph_dict(g["id"])))
    elif c == "diff":
        lines = workflows.sample_diff(repo, where, a.sample1, a.sample2)
        writers.write_lines(lines, a.gfa) if a.gfa else _show(lines.select("value"))
    elif c in ("derive-subgraph", "derive-chunks"):
        r = spark.range(1).select(S.region(F.lit(a.region)).alias("r")).first()["r"]
        if c == "derive-subgraph":
            workflows.derive_subgraph(repo, where, r["name"], r["start"], r["end"], new, sample)
        else:
            points = [int(x) for x in a.breakpoints.split(",")] if a.breakpoints else None
            if points is None:
                size = len(repo.sequences_of(where, sample).where(F.col("name") == r["name"]).first()["sequence"])
                points = list(range(int(a.chunk_size), size, int(a.chunk_size)))
            workflows.derive_chunks(repo, where, r["name"], points, new, sample)
    elif c == "make-stitch":
        workflows.make_stitch(repo, where, a.regions.split(","), new, a.new_region, sample)
    elif c == "operations":
        if a.branch:
            repo.checkout(a.branch)
        _show(repo.log().select("mark", "op", "kind", "summary"))
    elif c == "branch":
        if a.create:
            repo.create_branch(a.name)
        elif a.delete:
            repo.delete_branch(a.name)
        else:
            for name in repo.branches():
                print((">" if name == repo.branch else " ") + name)
    elif c == "merge":
        repo.merge(a.branch_name)
    elif c == "checkout":
        repo.checkout(a.branch, a.operation)
    elif c == "reset":
        repo.reset(a.operation)
    elif c == "apply":
        repo.apply(a.operation)
    elif c == "patch-create":
        repo.create_patch(a.operations_, a.name)
    elif c == "patch-apply":
        repo.apply_patch(a.patch)
    elif c == "patch-view":
        _show(spark.read.json(a.patch).groupBy("op", "table").count())
    elif c == "defaults":
        repo.set("collection", a.default_collection)
    elif c == "set-remote":
        repo.set("remote", a.remote)
    elif c == "push":
        print(repo.push(a.remote or repo.settings["remote"]))
    elif c == "query":
        for row in repo.query(a.sql):
            print("\t".join(map(str, row)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
