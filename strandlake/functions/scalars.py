"""Expressions over sequences, ranges, strands, genotypes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START_NODE, END_NODE = 1, 2
NO_CHROMOSOME = -1


# sequences


def sequence_hash(kind: Column, sequence: Column, name: Column, path: Column) -> Column:
    """Content hash of a sequence: its fields, each ended by a semicolon."""
    fields = [F.coalesce(c, F.lit("")) for c in (kind, sequence, name, path)]
    return F.sha2(F.concat(*[p for c in fields for p in (c, F.lit(";"))]), 256)


def revcomp(sequence: Column) -> Column:
    """Reverse complement of A, C, G and T in either case; other letters stay."""
    return F.reverse(F.translate(sequence, "ACGTacgt", "TGCAtgca"))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def slice_of(sequence: Column, start: Column, end: Column) -> Column:
    """Bases [start, end), from 0."""
    return F.substr(sequence, (start + 1).cast("int"), (end - start).cast("int"))


# ranges


def overlap_flags(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Of [a, b) against [x, y): whether it holds the start, holds the end, and overlaps."""
    start, end = (a <= x) & (x < b), (a <= y) & (y < b)
    return F.struct(start.alias("contains_start"), end.alias("contains_end"), ((a < y) & (x < b)).alias("overlap"))


def range_contains(start: Column, end: Column, point: Column) -> Column:
    """Whether a range holds a point, both ends included; a range that starts after its end wraps around."""
    return F.when(start > end, (point >= start) | (point <= end)).otherwise((point >= start) & (point <= end))


def left_adjoins(end: Column, start: Column, modulus: Column | None = None) -> Column:
    """Whether a range ends where another starts, on a circle if a modulus is given."""
    return end == start if modulus is None else F.pmod(end, modulus) == F.pmod(start, modulus)


def range_overlap(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The common part of two ranges, null if they have none."""
    return F.when((b > x) & (a < y), F.struct(F.greatest(a, x).alias("start"), F.least(b, y).alias("end")))


def circular_index(position: Column, offset: Column, length: Column) -> Column:
    return F.pmod(position + offset, length)


# strands


def strand_compatible(a: Column, b: Column) -> Column:
    return (a == b) | a.isin(".", "?") | b.isin(".", "?")


def strand_sign(strand: Column) -> Column:
    """1, -1, or 0 for an unknown one."""
    return F.when(strand == "+", 1).when(strand == "-", -1).otherwise(0)


# genotypes and alleles


def parse_genotype(text: Column) -> Column:
    """array<struct<allele, phased>>: an allele has the separator before it, the first is phased if there is no slash; missing is null."""
    found = F.regexp_extract_all(text, F.lit(r"([|/]?)([0-9]+|\.)"), F.lit(0))

    def one(x: Column) -> Column:
        value = F.regexp_replace(x, r"^[|/]", "")
        return F.when(value != ".", F.struct(value.cast("int").alias("allele"), (~x.startswith("/")).alias("phased")))

    first = F.when(F.regexp_extract(text, r"^([0-9]+)", 1) != "", F.struct(F.regexp_extract(text, r"^([0-9]+)", 1).cast("int").alias("allele"), (~F.contains(text, F.lit("/"))).alias("phased")))
    return F.transform(found, lambda x, i: F.when(i == 0, first).otherwise(one(x)))


def expand_copies(ref: Column, alt: Column) -> Column:
    """<CNn> is n copies of the reference; other symbols give null; plain alleles stay."""
    n = F.regexp_extract(alt, r"^<CN([0-9]+)>$", 1)
    return F.when(n != "", F.repeat(ref, F.nullif(n, F.lit("")).cast("int"))).when(alt.startswith("<"), F.lit(None)).otherwise(alt)


def trimmed_allele(pos: Column, ref: Column, alt: Column) -> Column:
    """struct<start, end, sequence> of a change: from 0, less the shared first base where the lengths differ."""
    plain = ~alt.startswith("<")
    text = expand_copies(ref, alt)
    cut = plain & (alt != "*") & (alt != "") & (F.length(alt) != F.length(ref))
    start = pos - 1
    return F.struct(
        F.when(cut, start + 1).otherwise(start).alias("start"), (start + F.length(ref)).alias("end"),
        F.when(cut, F.substr(text, F.lit(2))).otherwise(text).alias("sequence"),
    )


# names and labels


def collection_name(path: Column) -> Column:
    return F.rtrim(path, F.lit("/"))


def collection_base(path: Column) -> Column:
    return F.substring_index(collection_name(path), "/", -1)


def collection_parent(path: Column) -> Column:
    """All but the last part; null at the top."""
    name = collection_name(path)
    return F.when(F.instr(name, "/") > 0, F.regexp_replace(name, "/[^/]*$", ""))


def region(text: Column) -> Column:
    """struct<name, start, end> of ``name:start-end``; start and end are null where absent."""
    part = lambda i: F.regexp_extract(text, r"^(.*?)(?::([0-9]+)-([0-9]+))?$", i)
    return F.struct(part(1).alias("name"), F.nullif(part(2), F.lit("")).cast("bigint").alias("start"), F.nullif(part(3), F.lit("")).cast("bigint").alias("end"))


def segment_id(node: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(".", node.cast("string"), start.cast("string"), end.cast("string"))


def segment_line(ident: Column, sequence: Column) -> Column:
    return F.concat_ws("\t", F.lit("S"), ident, sequence)


def link_line(a: Column, a_strand: Column, b: Column, b_strand: Column) -> Column:
    return F.concat_ws("\t", F.lit("L"), a, a_strand, b, b_strand, F.lit("0M"))


def path_line(name: Column, steps: Column) -> Column:
    """steps: array of segment and strand."""
    return F.concat_ws("\t", F.lit("P"), name, F.array_join(steps, ","), F.lit("*"))


def train_case(name: Column) -> Column:
    """Words with a capital each, joined by hyphens; a word ends at what is no letter or digit, or before a capital."""
    apart = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.regexp_replace(F.initcap(F.lower(F.trim(apart))), " ", "-")


def number_or_minus(text: Column) -> Column:
    """A number; -1 for an asterisk."""
    return F.when(text == "*", F.lit(-1).cast("bigint")).otherwise(text.cast("bigint"))


#: Fixed value: the sign of a block whose label has no room.
BLOCK_SIGN = "\u23fa"


def inner_label(text: Column, width: int) -> Column:
    """At most width characters, the middle given up for three dots; a sign where the width is below five."""
    if width < 5:
        return F.when(F.length(text) <= width, text).otherwise(F.lit(BLOCK_SIGN))
    head, tail = (width - 3 + 1) // 2, (width - 3) // 2
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("..."), F.right(text, F.lit(tail))))


def html_label(text: Column) -> Column:
    """A sequence as a label: the first three and last two of more than seven bases, special characters escaped."""
    short = F.when(F.length(text) > 7, F.concat(F.substring(text, 1, 3), F.lit("..."), F.right(text, F.lit(2)))).otherwise(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        short = F.replace(short, F.lit(a), F.lit(b))
    return short


def clip_label(text: Column, start: Column, window_start: Column, window_width: Column) -> Column:
    """What of a label at start shows in a window; an ellipsis takes the place of the last character before a cut."""
    n = F.length(text)
    end, window_end = start + n - 1, window_start + window_width - 1
    right = F.when(end > window_end, F.concat(F.substr(text, F.lit(1), (n - (end - window_end) - 1).cast("int")), F.lit("\u2026"))).otherwise(text)
    both = F.when(window_start > start, F.concat(F.lit("\u2026"), F.substr(right, (window_start - start + 2).cast("int")))).otherwise(right)
    return F.when((n == 0) | (end < window_start) | (start > window_end), F.lit("")).otherwise(both)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def clip_line(a: Column, b: Column, low: Column, high: Column) -> Column:
    """struct<a, b>: the part of a line (two points) inside a window (its two corners); null where none is.

    Each side of the window bounds the share of the line that is inside, from below or above.
    """
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = [(-dx, a["x"] - low["x"]), (dx, high["x"] - a["x"]), (-dy, a["y"] - low["y"]), (dy, high["y"] - a["y"])]
    first = F.greatest(F.lit(0.0), *[F.when(p < 0, q / p) for p, q in sides])
    last = F.least(F.lit(1.0), *[F.when(p > 0, q / p) for p, q in sides])
    beside = F.lit(False)
    for p, q in sides:
        beside |= (p == 0) & (q < 0)
    at = lambda t: point(a["x"] + t * dx, a["y"] + t * dy)
    return F.when(~beside & (first <= last), F.struct(at(first).alias("a"), at(last).alias("b")))


def rectangles_meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether two rectangles, each given by two opposite corners, overlap or touch."""
    on = lambda k: (F.greatest(a[k], b[k]) >= F.least(c[k], d[k])) & (F.greatest(c[k], d[k]) >= F.least(a[k], b[k]))
    return on("x") & on("y")


def braille(p: Column) -> Column:
    """A point moved to the nearest dot: halves across, quarters down."""
    return point(F.round(p["x"] * 2) / 2, F.round(p["y"] * 4) / 4)


def curve(a: Column, b: Column, points: int) -> Column:
    """Points of a cubic curve that leaves a and reaches b level: the two, and between them dots of the curve."""
    middle = (a["x"] + b["x"]) / 2

    def at(i: Column) -> Column:
        t = i.cast("double") / (points - 1)
        u = F.lit(1.0) - t
        along = lambda p0, p1, p2, p3: u * u * u * p0 + 3.0 * u * u * t * p1 + 3.0 * u * t * t * p2 + t * t * t * p3
        return braille(point(along(a["x"], middle, middle, b["x"]), along(a["y"], a["y"], b["y"], b["y"])))

    inner = F.transform(F.sequence(F.lit(1), F.lit(points - 2)), at) if points > 2 else F.array().cast("array<struct<x:double,y:double>>")
    return F.concat(F.array(a), inner, F.array(b))


def is_terminal(node: Column) -> Column:
    return node.isin(START_NODE, END_NODE)


def key_number(text: Column) -> Column:
    """A number below 2**60 from the hash of a natural key: an id that needs no counter."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")
