"""Text formats as DataFrames. Files are read by Spark, a record or a line a row; parsing is expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import scalars as S


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumn("value", F.rtrim("value", F.lit("\r")))


def fasta(spark: SparkSession, path: str, shallow: bool = False) -> DataFrame:
    """(name, description, sequence, length); gzip by extension. shallow: the sequence stays in its file."""
    # a record starts at a line's start alone; only the file's first one still has its sign
    records = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", "")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    text = S.without_space(F.regexp_replace("value", r"^[^\r\n]*", ""))
    out = records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("name"), F.trim(F.regexp_extract(head, r"^\S+\s*(.*)$", 1)).alias("description"), text.alias("sequence"))
    out = out.withColumn("length", F.length("sequence").cast("long"))
    return out.withColumns({"sequence": F.lit(""), "file_path": F.lit(path)}) if shallow else out


def fasta_slices(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (name, start, end) with their bases, cut out of the file's records where they are read."""
    return fasta(spark, path).join(wanted, "name").withColumn("sequence", S.slice_of(F.col("sequence"), F.col("start"), F.col("end"))).drop("length", "description")


def gfa(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """header, segments, links, paths, walks, containments, jumps. Fields may be split by tabs or spaces.

    Paths and walks have one row a step: name, step, segment, strand; a walk is named sample#haplotype#contig:start-end.
    """
    f = _lines(spark, path).where(F.length(F.trim("value")) > 0).select(F.split(F.trim("value"), r"\s+").alias("f"))
    kind = lambda k: f.where(F.col("f")[0] == k)
    at = lambda i: F.get("f", F.lit(i))
    steps = F.posexplode(F.split(at(2), ",")).alias("step", "x")
    paths = kind("P").select(at(1).alias("name"), steps).select("name", "step", F.expr("left(x, length(x) - 1)").alias("segment"), F.right("x", F.lit(1)).alias("strand"))
    walk_name = F.concat(at(1), F.lit("#"), at(2), F.lit("#"), at(3), F.when(at(4) != "*", F.concat(F.lit(":"), at(4), F.lit("-"), at(5))).otherwise(""))
    walk = F.posexplode(F.regexp_extract_all(at(6), F.lit(r"[<>][^<>]+"), F.lit(0))).alias("step", "x")
    walks = kind("W").select(walk_name.alias("name"), at(1).alias("sample"), at(2).alias("haplotype"), at(3).alias("contig"), S.number_or_minus(at(4)).alias("start"), S.number_or_minus(at(5)).alias("end"), walk)
    walks = walks.withColumns({"segment": F.expr("substring(x, 2)"), "strand": F.when(F.col("x").startswith("<"), "-").otherwise("+")}).drop("x")
    edge = lambda k: kind(k).select(at(1).alias("source"), at(2).alias("source_strand"), at(3).alias("target"), at(4).alias("target_strand"), at(5).alias("overlap"))
    return {
        "header": kind("H").select(F.explode(F.slice("f", 2, F.size("f"))).alias("tag")), "segments": kind("S").select(at(1).alias("segment"), at(2).alias("sequence")),
        "links": edge("L"), "containments": edge("C"), "jumps": edge("J"), "paths": paths, "walks": walks,
    }


def gfa_ids(segments: DataFrame) -> DataFrame:
    """(numeric, compact): whether all segment ids are numbers, and whether these are 1 to their count."""
    number = F.col("segment").rlike("^[0-9]+$")
    n = F.col("segment").cast("long")
    return segments.agg(F.coalesce(F.bool_and(number), F.lit(True)).alias("numeric"), F.coalesce(F.bool_and(number) & (F.max(F.when(number, n)) == F.count("*")) & (F.min(F.when(number, n)) == 1), F.lit(True)).alias("compact"))


def filled_segments(segments: DataFrame) -> DataFrame:
    """Numeric segments with empty ones for the numbers that are missing between the first and the last."""
    n = segments.select(F.col("segment").cast("long").alias("n"), "sequence")
    every = n.agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("n"))
    return every.join(n, "n", "left").select(F.col("n").cast("string").alias("segment"), F.coalesce("sequence", F.lit("")).alias("sequence"))


def pansn(names: DataFrame, delimiter: str = "#") -> DataFrame:
    """(name, genome, haplotype, contig): names of three parts by sample; if any is not, each is its own genome."""
    part = F.split("name", F.lit(delimiter if delimiter not in "|.*+?" else "\\" + delimiter))
    whole = names.agg(F.coalesce(F.bool_and(F.size(part) == 3), F.lit(False)).alias("_all"))
    p = names.join(F.broadcast(whole))  # one row
    pick = lambda i: F.when(F.col("_all"), F.get(part, F.lit(i))).otherwise(F.col("name"))
    return p.select("name", pick(0).alias("genome"), F.when(F.col("_all"), F.concat_ws(delimiter, F.get(part, F.lit(0)), F.get(part, F.lit(1)))).otherwise(F.col("name")).alias("haplotype"), pick(2).alias("contig"))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the header line."""
    row = _lines(spark, path).where(F.col("value").startswith("#CHROM")).first()
    return row["value"].split("\t")[9:] if row else []


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """One row a record and sample: chrom, pos, ref, alts, gan, gaa, end, sample, gt (null sample without columns)."""
    names = vcf_samples(spark, path)
    f = _lines(spark, path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    info = lambda k: F.nullif(F.regexp_extract(F.col("f")[7], rf"(?:^|;){k}=([^;]*)", 1), F.lit(""))
    at = F.array_position(F.split(F.get("f", F.lit(8)), ":"), "GT").cast("int")
    base = [F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), F.col("f")[3].alias("ref"), F.split(F.col("f")[4], ",").alias("alts"), info("GAN").alias("gan"), info("GAA").cast("int").alias("gaa"), info("END").cast("long").alias("end")]
    if not names:
        return f.select(*base, F.lit(None).cast("string").alias("sample"), F.lit(None).cast("string").alias("gt"))
    calls = F.posexplode(F.slice("f", 10, len(names))).alias("i", "call")
    rows = f.select(*base, at.alias("at"), calls)
    sample = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1)
    return rows.select("chrom", "pos", "ref", "alts", "gan", "gaa", "end", sample.alias("sample"), F.when(F.col("at") > 0, F.get(F.split("call", ":"), F.col("at") - 1)).alias("gt"))


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments: the twelve columns, the cigar tag and the path's steps (array of segment and strand)."""
    names = ["query", "qlen", "qstart", "qend", "strand", "path", "plen", "pstart", "pend", "matches", "block_len", "mapq"]
    f = _lines(spark, path).select(F.split("value", "\t").alias("f")).where(F.size("f") > 12)
    cols = [(F.col("f")[i] if n in ("query", "strand", "path") else F.col("f")[i].cast("long")).alias(n) for i, n in enumerate(names)]
    out = f.select(*cols, F.nullif(F.regexp_extract(F.array_join("f", "\t"), r"cg:Z:(\S+)", 1), F.lit("")).alias("cigar")).where("cigar is not null")
    step = F.regexp_extract_all("path", F.lit(r"[<>][^<>]+"), F.lit(0))
    return out.withColumn("steps", F.transform(step, lambda x: F.struct(F.substr(x, F.lit(2)).alias("segment"), F.when(x.startswith("<"), "-").otherwise("+").alias("strand"))))


def _numbered(df: DataFrame, out: str) -> DataFrame:
    """Adds the number of each row, from 0, in the order of the file: its place in its part, and the rows of the parts before."""
    df = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = df.groupBy("_part").agg(F.count("*").alias("_size"))  # a row a part of the file
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(out, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")


def library(spark: SparkSession, path: str) -> DataFrame:
    """A design without a header, columns are slots: (row, slot, part); empty cells are skipped."""
    f = _numbered(_lines(spark, path), "row").select("row", F.posexplode(F.split("value", ",")).alias("slot", "part"))
    return f.withColumn("part", F.trim("part")).where("part != ''")


def edit_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, left, sequence, right); an edit without an id is named after its row."""
    rows = _numbered(spark.read.option("header", True).csv(path), "_row")
    n = F.concat(F.lit("_gen_"), F.col("_row").cast("string"))
    return rows.select(F.coalesce("id", n).alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("left", "sequence", "right")])


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, rest): from 0, half open; the other fields stay as they are."""
    f = _lines(spark, path).where(~F.col("value").rlike("^(#|track|browser)") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    return f.select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), F.array_join(F.slice("f", 4, F.size("f")), "\t").alias("rest"))


def gff(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns; start and end count from 1, both included."""
    names = ["chrom", "source", "kind", "start", "end", "score", "strand", "phase", "attributes"]
    f = _lines(spark, path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("f"))
    return f.select(*[(F.col("f")[i].cast("long") if n in ("start", "end") else F.col("f")[i]).alias(n) for i, n in enumerate(names)])


def _field(text: Column, name: str) -> Column:
    return F.regexp_extract(text, rf"(?m)^{name}\s+(\S+)", 1)


def genbank(spark: SparkSession, path: str) -> DataFrame:
    """(name, molecule_type, circular, sequence, features): a record a row.

    features: array of struct<kind, location, start, end, complement, qualifiers>, start from 0; qualifiers is a map.
    """
    r = spark.read.option("lineSep", "\n//").text(path).withColumn("value", F.regexp_replace("value", "\r", "")).where(F.col("value").rlike(r"(?m)^LOCUS"))
    line = F.regexp_extract("value", r"(?m)^LOCUS([^\n]*)", 1)
    origin = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1)
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?:\nORIGIN|\nCONTIG|$)", 1)
    # a feature begins in the sixth column; its further lines are indented by 21
    parts = F.filter(F.split(F.concat(F.lit("\n"), table), r"\n {5}(?=\S)"), lambda x: F.trim(x) != "")

    def one(x: Column) -> Column:
        flat = F.regexp_replace(x, r"\n {21}(?!/)", " ")
        place = F.regexp_replace(F.regexp_extract(flat, r"^\S+\s+([^\n]*)", 1), r"\s", "")
        numbers = F.transform(F.regexp_extract_all(place, F.lit(r"[0-9]+"), F.lit(0)), lambda n: n.cast("long"))
        said = F.split(flat, r"\n {21}/")
        given = F.filter(F.slice(said, 2, F.size(said)), lambda q: q != "")
        pairs = F.transform(given, lambda q: F.struct(F.regexp_extract(q, r"^([^=\n]+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(q, r"(?s)^[^=]+=(.*)$", 1), '^"|"\\s*$', "").alias("v")))
        # a feature may repeat a qualifier: the first is kept under its name, all notes are joined
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        values = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]), "; "))
        between = F.contains(place, F.lit("^"))
        return F.struct(F.regexp_extract(x, r"^(\S+)", 1).alias("kind"), place.alias("location"), F.when(between, F.array_min(numbers)).otherwise(F.array_min(numbers) - 1).alias("start"),
                        F.when(between, F.array_min(numbers)).otherwise(F.array_max(numbers)).alias("end"), place.startswith("complement").alias("complement"), F.map_from_arrays(keys, values).alias("qualifiers"))

    return r.select(_field(F.col("value"), "LOCUS").alias("name"), F.regexp_extract(line, r"\s(ss-|ds-)?(DNA|RNA|mRNA|tRNA|rRNA|AA)\s", 2).alias("molecule_type"), F.contains(line, F.lit("circular")).alias("circular"),
                    F.upper(F.regexp_replace(origin, r"[0-9\s/]", "")).alias("sequence"), F.transform(parts, one).alias("features"))


def genbank_edits(records: DataFrame) -> DataFrame:
    """(name, start, end, old, new, type): edits noted in features by an editing program, in the record's coordinates.

    An insertion has new bases and no old ones, a deletion old ones at one place, a replacement both.
    """
    f = records.select("name", "sequence", F.explode("features").alias("f"))
    kind = F.regexp_extract(F.col("f.qualifiers")["note"], r"Editing History (Insertion|Deletion|Replacement)", 1)
    old = F.upper(S.without_space(F.coalesce(F.col("f.qualifiers")["Original_Bases"], F.lit(""))))
    e = f.select("name", "sequence", F.col("f.start").alias("start"), F.col("f.end").alias("end"), old.alias("old"), kind.alias("type")).where("type != ''")
    e = e.withColumn("end", F.when(F.col("type") == "Deletion", F.col("start")).otherwise(F.col("end")))
    return e.select("name", "start", "end", "old", F.when(F.col("type") == "Deletion", "").otherwise(S.slice_of(F.col("sequence"), F.col("start"), F.col("end"))).alias("new"), "type")
