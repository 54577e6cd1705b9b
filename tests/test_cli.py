"""The command line over a small store."""

from test_repository import REF, files  # noqa: F401

from strandlake import cli


def test_commands(spark, tmp_path, files, capsys):  # noqa: F811
    def run(*args):
        cli.main(["--repo", str(tmp_path / "store"), *map(str, args)], spark)
        return capsys.readouterr().out.strip().split("\n")

    run("init")
    run("defaults", "--default-collection", "test")
    run("import", "--fasta", files("a.fa", f">m123\n{REF}\n"))
    run("update", "--fasta", files("u.fa", ">x\nAAAAAAAA\n"), "--new-sample", "child", "--region", "m123", "--start", 2, "--end", 5)
    assert run("list-graphs") == ["m123"] and run("list-samples") == ["child"]
    assert run("get-sequence", "--region", "m123:2-6") == [REF[2:6]]
    assert [x.split("\t")[2] for x in run("operations")] == ["update fasta", "import fasta"]
    run("branch", "--create", "b")
    assert [x.strip() for x in run("branch", "--list")] == ["b", ">main"]
    run("derive-chunks", "--region", "m123", "--chunk-size", 20, "--new-sample", "parts")
    assert run("list-graphs", "--sample", "parts") == ["m123.1", "m123.2"]
    assert run("query", "SELECT count(*) FROM graphs") == ["4"]
