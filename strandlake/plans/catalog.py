"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import scalars as S
from strandlake.operators import edits, entities, graph, intervals, paths, versions
from strandlake.plans import derive as D
from strandlake.session import materialized, table
from strandlake.sources import writers

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scalar functions ----------------------------------------------------------------------------------------------


@query(D.sql_with(["seq"]) + "SELECT doc_id, length(sequence)::BIGINT AS length, sha256('DNA;' || sequence || ';;;') AS hash FROM seq")
def seq_hash(spark, d) -> DataFrame:
    s = F.col("sequence")
    return D.seq(spark, d).select("doc_id", F.length(s).cast("long").alias("length"), S.sequence_hash(F.lit("DNA"), s, F.lit(""), F.lit("")).alias("hash"))


@query(D.sql_with(["seq"]) + "SELECT doc_id, md5(reverse(translate(sequence, 'ACGTacgt', 'TGCAtgca'))) AS revcomp FROM seq")
def revcomp(spark, d) -> DataFrame:
    return D.seq(spark, d).select("doc_id", F.md5(S.revcomp(F.col("sequence")).cast("binary")).alias("revcomp"))


@query("SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS tight FROM documents")
def normalize_string(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(S.without_space(F.coalesce("text", F.lit(""))).cast("binary")).alias("tight"))


_GT = "CASE l_linenumber % 6 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN '.|2' WHEN 3 THEN '1' WHEN 4 THEN '0/1|2' ELSE '2|.' END"


@query(f"""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, {_GT} AS gt FROM lineitem),
p AS (SELECT *, regexp_extract_all(gt, '[0-9.]+') AS a, regexp_extract_all(gt, '[|/]') AS s FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, gt, array_to_string(list_transform(a, lambda x, i: CASE WHEN x = '.' THEN 'missing' ELSE x || CASE WHEN (CASE WHEN i = 1 THEN CASE WHEN contains(gt, '/') THEN '/' ELSE '|' END ELSE s[i - 1] END) = '|' THEN 'p' ELSE 'u' END END), ',') AS alleles FROM p""")
def genotype_parse(spark, d) -> DataFrame:
    call = F.col("l_linenumber") % 6
    gt = F.when(call == 0, "0/1").when(call == 1, "1|0").when(call == 2, ".|2").when(call == 3, "1").when(call == 4, "0/1|2").otherwise("2|.")
    said = lambda x: F.when(x.isNull(), "missing").otherwise(F.concat(x["allele"].cast("string"), F.when(x["phased"], "p").otherwise("u")))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gt.alias("gt"))
    return rows.withColumn("alleles", F.array_join(F.transform(S.parse_genotype(F.col("gt")), said), ","))


@query(D.sql_with(["vcf"]) + r"""SELECT record, pos, ref, alt, CASE WHEN regexp_matches(alt, '^<CN[0-9]+>$') THEN repeat(ref, regexp_extract(alt, '^<CN([0-9]+)>$', 1)::INT) WHEN starts_with(alt, '<') THEN NULL ELSE alt END AS expanded FROM vcf""")
def cnv_expand(spark, d) -> DataFrame:
    return D.vcf(spark, d).select("record", "pos", "ref", "alt", S.expand_copies(F.col("ref"), F.col("alt")).alias("expanded"))


@query(D.sql_with(["vcf"]) + r""", c AS (SELECT *, NOT starts_with(alt, '<') AND alt <> '*' AND length(alt) <> length(ref) AS cut,
  CASE WHEN regexp_matches(alt, '^<CN[0-9]+>$') THEN repeat(ref, regexp_extract(alt, '^<CN([0-9]+)>$', 1)::INT) WHEN starts_with(alt, '<') THEN NULL ELSE alt END AS e FROM vcf)
SELECT record, pos, ref, alt, CASE WHEN cut THEN pos ELSE pos - 1 END AS start, pos - 1 + length(ref) AS "end", CASE WHEN cut THEN substr(e, 2) ELSE e END AS sequence FROM c""")
def vcf_alleles(spark, d) -> DataFrame:
    return D.vcf(spark, d).select("record", "pos", "ref", "alt", S.trimmed_allele(F.col("pos"), F.col("ref"), F.col("alt")).alias("c")).select("record", "pos", "ref", "alt", "c.*")


_RANGES = "SELECT event_id, event_id % 100 AS a, event_id % 100 + user_id % 37 AS b, user_id % 100 AS x, user_id % 100 + event_id % 23 AS y FROM events"


def _ranges(spark, d) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, d, "events").select("event_id", (e % 100).alias("a"), (e % 100 + u % 37).alias("b"), (u % 100).alias("x"), (u % 100 + e % 23).alias("y"))


@query(f"WITH r AS ({_RANGES}) SELECT event_id, a <= x AND x < b AS contains_start, a <= y AND y < b AS contains_end, a < y AND x < b AS overlap FROM r")
def overlap_flags(spark, d) -> DataFrame:
    return _ranges(spark, d).select("event_id", S.overlap_flags(*map(F.col, "abxy")).alias("o")).select("event_id", "o.*")


@query(f"WITH r AS ({_RANGES}) SELECT event_id, CASE WHEN b > x AND a < y THEN greatest(a, x) END AS start, CASE WHEN b > x AND a < y THEN least(b, y) END AS \"end\" FROM r")
def range_overlap(spark, d) -> DataFrame:
    return _ranges(spark, d).select("event_id", S.range_overlap(*map(F.col, "abxy")).alias("o")).select("event_id", F.col("o.start").alias("start"), F.col("o.end").alias("end"))


@query(f"WITH r AS ({_RANGES}) SELECT event_id, CASE WHEN a > y THEN x >= a OR x <= y ELSE x >= a AND x <= y END AS inside, (b % 50) = (x % 50) AS adjoins, (a + y) % 60 AS turned FROM r")
def wraparound_ranges(spark, d) -> DataFrame:
    a, b, x, y = map(F.col, "abxy")
    return _ranges(spark, d).select("event_id", S.range_contains(a, y, x).alias("inside"), S.left_adjoins(b, x, F.lit(50)).alias("adjoins"), S.circular_index(a, y, F.lit(60)).alias("turned"))


_PLACE = "SELECT o_orderkey, c_mktsegment || '/' || o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '/' WHEN o_orderkey % 3 = 1 THEN '/x' ELSE '' END AS place FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"WITH p AS ({_PLACE}), r AS (SELECT o_orderkey, regexp_replace(place, '/+$', '') AS name FROM p) SELECT o_orderkey, name, string_split(name, '/')[-1] AS base, CASE WHEN contains(name, '/') THEN regexp_replace(name, '/[^/]*$', '') END AS parent FROM r")
def collection_parent(spark, d) -> DataFrame:
    end = F.when(F.col("path_id") % 3 == 0, "/").when(F.col("path_id") % 3 == 1, "/x").otherwise("")
    p = D.pth(spark, d).select(F.col("path_id").alias("o_orderkey"), F.concat("collection", F.lit("/"), "name", end).alias("place"))
    place = F.col("place")
    return p.select("o_orderkey", S.collection_name(place).alias("name"), S.collection_base(place).alias("base"), S.collection_parent(place).alias("parent"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, 'chr' || l_linenumber::VARCHAR AS name, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS start, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey + 9 END AS \"end\" FROM lineitem")
def region_parse(spark, d) -> DataFrame:
    text = F.when(F.col("l_partkey") % 2 == 0, F.format_string("chr%d:%d-%d", "l_linenumber", "l_suppkey", F.col("l_suppkey") + 9)).otherwise(F.format_string("chr%d", "l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", S.region(text).alias("r")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "r.*")


@query("""WITH s AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN '.' ELSE '?' END AS a, CASE user_id % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE '.' END AS b FROM events)
SELECT event_id, a = b OR a IN ('.', '?') OR b IN ('.', '?') AS compatible, CASE a WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END AS sign FROM s""")
def strand_flags(spark, d) -> DataFrame:
    pick = lambda c, n: F.when(c % n == 0, "+").when(c % n == 1, "-").when(c % n == 2, ".").otherwise("?")
    s = table(spark, d, "events").select("event_id", pick(F.col("event_id"), 4).alias("a"), pick(F.col("user_id"), 3).alias("b"))
    return s.select("event_id", S.strand_compatible(F.col("a"), F.col("b")).alias("compatible"), S.strand_sign(F.col("a")).alias("sign"))


@query(r"""WITH n AS (SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(p_type || '_' || p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))) AS n FROM part)
SELECT p_partkey, array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || w[2:]), '-') AS name FROM n""")
def train_case(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.train_case(F.concat_ws("_", "p_type", "p_name")).alias("name"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) <= 9 THEN p_name ELSE substr(p_name, 1, 3) || '...' || right(p_name, 3) END AS label,
  replace(replace(replace(CASE WHEN length('<' || p_type || '&>') > 7 THEN substr('<' || p_type || '&>', 1, 3) || '...' || right('<' || p_type || '&>', 2) ELSE '<' || p_type || '&>' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM part""")
def labels_short(spark, d) -> DataFrame:
    odd = F.concat(F.lit("<"), "p_type", F.lit("&>"))
    return table(spark, d, "part").select("p_partkey", S.inner_label(F.col("p_name"), 9).alias("label"), S.html_label(odd).alias("html"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -1 ELSE p_size::BIGINT END AS overlap FROM part")
def number_or_minus(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.number_or_minus(F.when(F.col("p_size") % 5 == 0, "*").otherwise(F.col("p_size").cast("string"))).alias("overlap"))


# --- paths ---------------------------------------------------------------------------------------------------------


@query(D.sql_with(["off"]) + "SELECT path_id, idx, node_id, seq_start, seq_end, strand, path_start, path_end FROM off")
def path_blocks(spark, d) -> DataFrame:
    return paths.path_blocks(D.blk(spark, d))


@query(D.sql_with(["blk"]) + "SELECT path_id, sum(seq_end - seq_start)::BIGINT AS length FROM blk GROUP BY path_id")
def path_length(spark, d) -> DataFrame:
    return paths.path_length(D.blk(spark, d))


_TEXT = "CASE WHEN strand = '-' THEN reverse(translate(substr(sequence, seq_start + 1, seq_end - seq_start), 'ACGT', 'TGCA')) ELSE substr(sequence, seq_start + 1, seq_end - seq_start) END"
_SPELLED = f", spelled AS (SELECT path_id, string_agg({_TEXT}, '' ORDER BY idx) AS sequence FROM blk JOIN node USING (node_id) GROUP BY path_id)\n"


@query(D.sql_with(["node"]) + _SPELLED + "SELECT * FROM spelled")
def path_sequence(spark, d) -> DataFrame:
    return paths.path_sequence(D.blk(spark, d), D.node(spark, d))


@query(D.sql_with(["node"]) + _SPELLED + "SELECT path_id, path_id % 7 AS start, path_id % 7 + 40 AS \"end\", CASE WHEN least(path_id % 7 + 40, length(sequence)) > path_id % 7 THEN substr(sequence, path_id % 7 + 1, least(path_id % 7 + 40, length(sequence)) - path_id % 7) ELSE '' END AS subsequence FROM spelled")
def get_sequence(spark, d) -> DataFrame:
    whole = path_sequence(spark, d).withColumns({"start": F.col("path_id") % 7, "end": F.col("path_id") % 7 + 40})
    return paths.subsequence(whole, "start", "end").drop("sequence")


@query(D.sql_with(["pedge"]) + "SELECT path_id, idx - 1 AS idx, seq_start, seq_end, node_id, strand FROM (SELECT path_id, idx + 1 AS idx, seq_start, seq_end, node_id, strand FROM blk)")
def path_blocks_from_edges(spark, d) -> DataFrame:
    return paths.blocks_from_edges(D.pedge(spark, d))


_BAD = """, e AS (SELECT *, lag(target_node) OVER w AS pn, lag(target_strand) OVER w AS ps, lag(target_coordinate) OVER w AS pc, lead(idx) OVER w AS nx FROM (SELECT * REPLACE (source_node + CASE WHEN (path_id + idx) % 50 = 0 THEN 1 ELSE 0 END AS source_node, source_coordinate - CASE WHEN (path_id + idx) % 40 = 0 THEN 60 ELSE 0 END AS source_coordinate) FROM pedge) WINDOW w AS (PARTITION BY path_id ORDER BY idx)),
k AS (SELECT path_id, idx, unnest(list_filter([CASE WHEN pn <> source_node THEN 'node' END, CASE WHEN ps <> source_strand THEN 'strand' END, CASE WHEN pc > source_coordinate THEN 'coordinate' END,
  CASE WHEN pn IS NULL AND source_node <> 1 THEN 'start' END, CASE WHEN nx IS NULL AND target_node <> 2 THEN 'end' END], lambda x: x IS NOT NULL)) AS problem FROM e) SELECT * FROM k"""


@query(D.sql_with(["pedge"]) + _BAD)
def path_validate(spark, d) -> DataFrame:
    """Paths with an edge changed here and there."""
    at = F.col("path_id") + F.col("idx")
    e = D.pedge(spark, d)
    return paths.validate(e.withColumns({"source_node": F.col("source_node") + F.when(at % 50 == 0, 1).otherwise(0), "source_coordinate": F.col("source_coordinate") - F.when(at % 40 == 0, 60).otherwise(0)}))


_MAP = """, pairs AS (SELECT a.path_id AS a_path, min(b.path_id) AS b_path FROM pth a JOIN pth b ON a.custkey = b.custkey AND b.path_id > a.path_id GROUP BY a.path_id),
m AS (SELECT a_path, b_path, a.path_start + greatest(a.seq_start, b.seq_start) - a.seq_start AS source_start, a.path_start + least(a.seq_end, b.seq_end) - a.seq_start AS source_end,
  b.path_start + greatest(a.seq_start, b.seq_start) - b.seq_start AS target_start, b.path_start + least(a.seq_end, b.seq_end) - b.seq_start AS target_end
  FROM pairs JOIN off a ON a.path_id = a_path JOIN off b ON b.path_id = b_path AND a.node_id % 50 = b.node_id % 50 AND a.seq_start < b.seq_end AND b.seq_start < a.seq_end)
"""


def _mappings(spark, d) -> DataFrame:
    """Of each path and the next one of its customer; nodes count as the same modulo 50, so that paths meet."""
    p = D.pth(spark, d).select("path_id", "custkey")
    from pyspark.sql import Window as W

    pairs = p.withColumn("b_path", F.lead("path_id").over(W.partitionBy("custkey").orderBy("path_id"))).where("b_path is not null").select(F.col("path_id").alias("a_path"), "b_path")
    b = paths.path_blocks(D.blk(spark, d)).withColumn("node_id", F.col("node_id") % 50)
    return paths.block_mappings(b, b, pairs)


@query(D.sql_with(["off", "pth"]) + _MAP + "SELECT * FROM m")
def block_mapping(spark, d) -> DataFrame:
    return _mappings(spark, d)


_PROP = """, hit AS (SELECT a.path_id AS a_path, a.name, a.start, a."end", m.* EXCLUDE (a_path) FROM ann a JOIN m ON m.a_path = a.path_id AND a.start < m.source_end AND m.source_start < a."end"),
f AS (SELECT a_path, b_path, name, start, "end", min({'a': source_start, 'b': source_end, 'c': target_start, 'd': target_end}) AS f, max({'a': source_start, 'b': source_end, 'c': target_start, 'd': target_end}) AS l FROM hit GROUP BY ALL)
SELECT a_path, b_path, name, CASE WHEN start BETWEEN f.a AND f.b THEN f.c + start - f.a ELSE f.c END AS start, CASE WHEN "end" BETWEEN l.a AND l.b THEN l.c + "end" - l.a ELSE l.d END AS "end" FROM f"""


def _annotations(spark, d) -> DataFrame:
    b = paths.path_blocks(D.blk(spark, d))
    return b.select(F.col("path_id").alias("a_path"), F.concat_ws(":", "path_id", "idx").alias("name"), (F.col("path_start") + 3).alias("start"), (F.col("path_end") + 7).alias("end"))


@query(D.sql_with(["ann", "pth"]) + _MAP + _PROP)
def annotation_propagate(spark, d) -> DataFrame:
    return paths.propagate(_annotations(spark, d), _mappings(spark, d))


_CUTS = "SELECT path_id, 5 + path_id % 20 AS start, 60 + path_id % 40 AS \"end\" FROM pth"


def _cuts(spark, d) -> DataFrame:
    return D.pth(spark, d).select("path_id", F.lit(1).alias("range_id"), (5 + F.col("path_id") % 20).alias("start"), (60 + F.col("path_id") % 40).alias("end"))


@query(D.sql_with(["off", "pth"]) + f""", r AS ({_CUTS}), c AS (SELECT path_id, 1 AS range_id, node_id, strand, seq_start + greatest(start, path_start) - path_start AS seq_start, seq_start + least("end", path_end) - path_start AS seq_end,
  greatest(start, path_start) AS path_start, least("end", path_end) AS path_end FROM r JOIN off USING (path_id) WHERE start < path_end AND path_start < "end"),
i AS (SELECT *, CASE WHEN lag(path_end) OVER w = path_start AND lag(seq_end) OVER w = seq_start THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY path_id, node_id, strand ORDER BY path_start, path_end, seq_start, seq_end)),
g AS (SELECT *, sum(new) OVER (PARTITION BY path_id, node_id, strand ORDER BY path_start, path_end, seq_start, seq_end ROWS UNBOUNDED PRECEDING) AS g FROM i)
SELECT path_id, range_id, node_id, strand, min(path_start) AS path_start, max(path_end) AS path_end, min(seq_start) AS seq_start, max(seq_end) AS seq_end FROM g GROUP BY path_id, range_id, node_id, strand, g""")
def range_partition(spark, d) -> DataFrame:
    return paths.partition_range(_cuts(spark, d), paths.path_blocks(D.blk(spark, d)))


def _translate_sql(shift: int) -> str:
    return D.sql_with(["off", "pth"]) + f""", r AS ({_CUTS}) SELECT path_id, 1 AS record_id, node_id::VARCHAR AS name, greatest(start, path_start + {shift}) AS start, least("end", path_end) AS "end"
FROM r JOIN off USING (path_id) WHERE start < path_end AND path_start + {shift} < "end" """


@query(_translate_sql(0))
def translate_bed(spark, d) -> DataFrame:
    return paths.translate(_cuts(spark, d).withColumnRenamed("range_id", "record_id"), paths.path_blocks(D.blk(spark, d)))


@query(_translate_sql(1))
def translate_gff(spark, d) -> DataFrame:
    return paths.translate(_cuts(spark, d).withColumnRenamed("range_id", "record_id"), paths.path_blocks(D.blk(spark, d)), gff=True)


@query(D.sql_with(["off"]) + "SELECT p.path_id, p.point, b.node_id, b.seq_start + p.point - b.path_start AS coordinate FROM (SELECT path_id, unnest([0, 17, 55, 90]) AS point FROM (SELECT DISTINCT path_id FROM blk)) p JOIN off b ON b.path_id = p.path_id AND p.point >= path_start AND p.point < path_end")
def point_lookup(spark, d) -> DataFrame:
    b = paths.path_blocks(D.blk(spark, d))
    points = b.select("path_id").distinct().select("path_id", F.explode(F.array(*[F.lit(x) for x in (0, 17, 55, 90)])).alias("point"))
    met = intervals.point_join(points, "point", b, ["path_id"], ("path_start", "path_end"))
    return met.select("path_id", "point", "node_id", (F.col("seq_start") + F.col("point") - F.col("path_start")).alias("coordinate"))


_SPAN = "SELECT l_suppkey * 1000 + l_partkey % 20 AS k, l_quantity::BIGINT + 60 * (l_partkey % 5) AS s, l_quantity::BIGINT + 60 * (l_partkey % 5) + 1 + l_linenumber AS e, l_orderkey AS i, l_partkey AS j, l_linenumber AS n FROM lineitem"


def _spans(spark, d) -> DataFrame:
    s = F.col("l_quantity").cast("long") + 60 * (F.col("l_partkey") % 5)
    return table(spark, d, "lineitem").select((F.col("l_suppkey") * 1000 + F.col("l_partkey") % 20).alias("k"), s.alias("s"), (s + 1 + F.col("l_linenumber")).alias("e"))


@query(f"WITH a AS (SELECT DISTINCT k, s, e FROM ({_SPAN})), b AS (SELECT DISTINCT k, s + 2 AS x, e + 9 AS y FROM ({_SPAN})) SELECT k, s, e, x, y FROM a JOIN b USING (k) WHERE s < y AND x < e")
def interval_overlap(spark, d) -> DataFrame:
    a = _spans(spark, d).distinct()
    b = a.select("k", (F.col("s") + 2).alias("x"), (F.col("e") + 9).alias("y"))
    return intervals.overlap_join(a, b, ["k"], ("s", "e"), ("x", "y"), bin_size=32)


@query(f"""WITH a AS (SELECT DISTINCT k, s AS p FROM ({_SPAN})), b AS (SELECT k, p AS s, lead(p) OVER (PARTITION BY k ORDER BY p) AS e FROM a), c AS (SELECT k, s, CASE WHEN (s + k) % 5 = 0 THEN s + 0 ELSE e END AS e FROM b WHERE e IS NOT NULL),
i AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY k ORDER BY s, e) = s THEN 0 ELSE 1 END AS new FROM c), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM i)
SELECT k, min(s) AS s, max(e) AS e FROM g GROUP BY k, g""")
def merge_contiguous(spark, d) -> DataFrame:
    pieces = intervals.consecutive(_spans(spark, d).select("k", "s"), ["k"], "s", "a", "b").select("k", F.col("a").alias("s"), F.when((F.col("a") + F.col("k")) % 5 == 0, F.col("a")).otherwise(F.col("b")).alias("e"))
    return intervals.merge_contiguous(pieces, ["k"], ("s", "e"))


@query(D.sql_with(["off"]) + """, n AS (SELECT path_id, max(path_end) AS length FROM off GROUP BY path_id),
p AS (SELECT path_id, length, unnest([10, 30, 30, 75]) AS "end" FROM n UNION ALL SELECT path_id, length, length FROM n), q AS (SELECT DISTINCT path_id, "end" FROM p WHERE "end" > 0 AND "end" <= length)
SELECT path_id, row_number() OVER w AS chunk, coalesce(lag("end") OVER w, 0) AS start, "end" FROM q WINDOW w AS (PARTITION BY path_id ORDER BY "end")""")
def chunk_ranges(spark, d) -> DataFrame:
    n = paths.path_length(D.blk(spark, d)).select("path_id", "length", F.explode(F.array(*[F.lit(x).cast("long") for x in (10, 30, 30, 75)])).alias("point"))
    return intervals.chunk_ranges(n, ["path_id"], "point", "length")


@query(D.sql_with(["off", "pedge"]) + """, e AS (SELECT path_id, path_id % 13 AS start, path_id % 13 + 12 AS "end", -path_id AS edge_in, -path_id - 1 AS edge_out FROM (SELECT path_id, max(path_end) AS n FROM off GROUP BY path_id) WHERE n > path_id % 13 + 12),
b AS (SELECT e.*, (SELECT idx FROM off WHERE off.path_id = e.path_id AND e.start >= path_start AND e.start < path_end) AS f, (SELECT idx FROM off WHERE off.path_id = e.path_id AND e."end" >= path_start AND e."end" < path_end) AS l FROM e),
u AS (SELECT p.path_id, p.idx::DOUBLE AS place, p.edge_id FROM pedge p JOIN b USING (path_id) WHERE p.idx <= f OR p.idx > l UNION ALL SELECT path_id, f + 0.25, edge_in FROM b UNION ALL SELECT path_id, f + 0.5, edge_out FROM b)
SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY place) - 1 AS idx, edge_id FROM u""")
def new_path_with(spark, d) -> DataFrame:
    n = paths.path_length(D.blk(spark, d))
    at = F.col("path_id") % 13
    cut = n.where(F.col("length") > at + 12).select("path_id", at.alias("start"), (at + 12).alias("end"), (-F.col("path_id")).alias("edge_in"), (-F.col("path_id") - 1).alias("edge_out"))
    return paths.with_replacement(D.pedge(spark, d), cut, paths.path_blocks(D.blk(spark, d)))


@query(D.sql_with(["off", "pth"]) + f""", n AS (SELECT path_id, max(path_end) AS length FROM off GROUP BY path_id), r AS (SELECT c.*, length FROM ({_CUTS}) c JOIN n USING (path_id) WHERE "end" <= length AND start <= "end"),
m AS (SELECT r.path_id, r.start AS a, r."end" AS z, o.idx, node_id, seq_start, seq_end, strand, path_start, row_number() OVER w - 1 AS k, lag(node_id) OVER w AS pn, lag(seq_end) OVER w AS pe, lag(strand) OVER w AS ps, lead(o.idx) OVER w IS NULL AS last
  FROM r JOIN off o ON o.path_id = r.path_id AND r.start < o.path_end AND (o.path_start <= r."end") AND o.path_start < r.length WINDOW w AS (PARTITION BY r.path_id ORDER BY o.idx))
SELECT path_id, k AS idx, coalesce(pn, 1) AS source_node, coalesce(pe, -1) AS source_coordinate, coalesce(ps, '+') AS source_strand, node_id AS target_node, CASE WHEN pn IS NULL THEN a - path_start + seq_start ELSE seq_start END AS target_coordinate, CASE WHEN pn IS NULL THEN '+' ELSE strand END AS target_strand FROM m
UNION ALL SELECT path_id, k + 1, node_id, z - path_start + seq_start, '+', 2, -1, '+' FROM m WHERE last""")
def accession_edges(spark, d) -> DataFrame:
    named = _cuts(spark, d).select("path_id", F.lit("acc").alias("name"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return paths.accession_edges(named, paths.path_blocks(D.blk(spark, d))).drop("name")


# --- graphs --------------------------------------------------------------------------------------------------------

_ENDS = "SELECT bg, source_node AS node_id, source_coordinate AS p FROM {0} WHERE source_node > 2 UNION SELECT bg, target_node, target_coordinate FROM {0} WHERE target_node > 2"
_BLOCKS = """, {0}b AS (SELECT bg, node_id, p AS start, lead(p) OVER (PARTITION BY bg, node_id ORDER BY p) AS "end" FROM (""" + _ENDS + """)),
{0}blocks AS (SELECT * FROM {0}b WHERE "end" IS NOT NULL UNION ALL SELECT DISTINCT bg, unnest([1, 2]), 0, 0 FROM {0})
"""
_LINKS = """, {0}links AS (SELECT e.bg, s.node_id AS s_node, s.start AS s_start, s."end" AS s_end, t.node_id AS t_node, t.start AS t_start, t."end" AS t_end, edge_id, source_strand, target_strand, chromosome_index, phased
FROM {0} e JOIN {0}blocks s ON s.bg = e.bg AND s.node_id = source_node AND s."end" = source_coordinate JOIN {0}blocks t ON t.bg = e.bg AND t.node_id = target_node AND t.start = target_coordinate)
"""
_GRAPH = {n: _BLOCKS.format(n) + _LINKS.format(n) for n in ("edg", "dag")}


@query(D.sql_with(["edg"]) + ", e AS (" + _ENDS.format("edg") + ") SELECT bg, node_id, array_to_string(list(p ORDER BY p), ',') AS points FROM e GROUP BY bg, node_id")
def block_boundaries(spark, d) -> DataFrame:
    return graph.boundaries(D.edg(spark, d)).withColumn("points", F.array_join(F.col("points").cast("array<string>"), ","))


@query(D.sql_with(["edg"]) + _BLOCKS.format("edg") + "SELECT * FROM edgblocks")
def graph_blocks(spark, d) -> DataFrame:
    return graph.blocks(D.edg(spark, d))


@query(D.sql_with(["edg"]) + _GRAPH["edg"] + "SELECT bg, s_node, s_start, s_end, t_node, t_start, t_end, count(*) AS n, min(edge_id) AS first_edge FROM edglinks GROUP BY ALL")
def graph_edges(spark, d) -> DataFrame:
    e = D.edg(spark, d)
    out = graph.links(graph.block_edges(e, graph.blocks(e)))
    return out.select("bg", *graph.SOURCE, *graph.TARGET, F.size("edges").cast("long").alias("n"), F.col("edges")[0]["edge_id"].alias("first_edge"))


def _dag(spark, d) -> DataFrame:
    e = materialized(D.dag(spark, d))
    return graph.block_edges(e, graph.blocks(e))


_LOST = """, r AS (SELECT *, row_number() OVER (PARTITION BY bg, s_node, s_start, s_end, chromosome_index ORDER BY edge_id DESC) AS n FROM daglinks),
kept AS (SELECT k.* FROM daglinks k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.n > 1 AND r.bg = k.bg AND r.s_node = k.s_node AND r.s_start = k.s_start AND r.t_node = k.t_node AND r.t_start = k.t_start)),
seen AS (SELECT DISTINCT bg, s_node AS node FROM kept WHERE s_node = 1 UNION SELECT k.bg, k.t_node FROM seen s JOIN kept k ON k.bg = s.bg AND k.s_node = s.node)
"""


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _LOST + "SELECT k.bg, s_node, t_node, edge_id, chromosome_index FROM kept k JOIN seen s ON s.bg = k.bg AND s.node = k.s_node")
def prune_edges(spark, d) -> DataFrame:
    return graph.pruned(_dag(spark, d)).select("bg", "s_node", "t_node", "edge_id", "chromosome_index")


_REACH = """, fwd AS (SELECT DISTINCT bg, t_node AS node FROM daglinks WHERE t_node BETWEEN 1000 AND 1999 UNION SELECT k.bg, k.t_node FROM fwd s JOIN daglinks k ON k.bg = s.bg AND k.s_node = s.node)
"""


def _layer(linked: DataFrame, layer: int) -> DataFrame:
    return linked.where(F.floor(F.col("t_node") / 1000) == layer).select("bg", F.col("t_node").alias("node_id"), F.col("t_start").alias("start"), F.col("t_end").alias("end")).distinct()


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _REACH + "SELECT bg, node AS node_id FROM fwd")
def reachable(spark, d) -> DataFrame:
    linked = materialized(_dag(spark, d))
    return graph.reachable(linked, _layer(linked, 1)).select("bg", "node_id")


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _REACH + """, back AS (SELECT DISTINCT bg, t_node AS node FROM daglinks WHERE t_node BETWEEN 3000 AND 3999 UNION SELECT k.bg, k.s_node FROM back s JOIN daglinks k ON k.bg = s.bg AND k.t_node = s.node),
mid AS (SELECT bg, node FROM fwd INTERSECT SELECT bg, node FROM back)
SELECT k.bg, s_node, t_node, edge_id, chromosome_index FROM daglinks k JOIN mid a ON a.bg = k.bg AND a.node = k.s_node JOIN mid b ON b.bg = k.bg AND b.node = k.t_node""")
def intermediate_edges(spark, d) -> DataFrame:
    linked = materialized(_dag(spark, d))
    return graph.intermediate(linked, _layer(linked, 1), _layer(linked, 3)).select("bg", "s_node", "t_node", "edge_id", "chromosome_index")


@query(D.sql_with(["edg"]) + _GRAPH["edg"] + """, outs AS (SELECT DISTINCT bg, s_node AS node_id, s_start AS start, s_end AS "end" FROM edglinks), ins AS (SELECT DISTINCT bg, t_node AS node_id, t_start AS start, t_end AS "end" FROM edglinks),
a AS (SELECT b.* FROM edgblocks b ANTI JOIN outs o ON o.bg = b.bg AND o.node_id = b.node_id AND o.start = b.start AND o."end" = b."end" WHERE b.node_id > 2), c AS (SELECT b.* FROM edgblocks b ANTI JOIN ins o ON o.bg = b.bg AND o.node_id = b.node_id AND o.start = b.start AND o."end" = b."end" WHERE b.node_id > 2)
SELECT a.bg, a.node_id, a.start AS s_start, a."end" AS at, c."end" AS t_end, -1 AS edge_id FROM a JOIN c ON a.bg = c.bg AND a.node_id = c.node_id AND a."end" = c.start""")
def boundary_heal(spark, d) -> DataFrame:
    e = D.edg(spark, d)
    split = graph.blocks(e)
    return graph.boundary_heal(split, graph.block_edges(e, split))


_PAIRS = "SELECT l_orderkey AS bg, l_partkey % 20 AS a, l_suppkey % 20 + 3 AS b FROM lineitem"


@query(f"WITH RECURSIVE p AS (SELECT DISTINCT * FROM ({_PAIRS})), u AS (SELECT bg, a, b FROM p UNION SELECT bg, b, a FROM p), r AS (SELECT bg, a AS node, a AS other FROM u UNION SELECT r.bg, r.node, u.b FROM r JOIN u ON u.bg = r.bg AND u.a = r.other) SELECT bg, node, min(other) AS component FROM r GROUP BY bg, node")
def components(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return graph.components(rows.select(F.col("l_orderkey").alias("bg"), (F.col("l_partkey") % 20).alias("a"), (F.col("l_suppkey") % 20 + 3).alias("b")))


_WAYS = """, step AS (SELECT DISTINCT bg, s_node, t_node FROM daglinks),
way AS (SELECT bg, [1, t_node] AS path, t_node AS here FROM step WHERE s_node = 1 UNION ALL SELECT w.bg, list_append(w.path, s.t_node), s.t_node FROM way w JOIN step s ON s.bg = w.bg AND s.s_node = w.here WHERE NOT list_contains(w.path, s.t_node))
"""


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _WAYS + "SELECT bg, array_to_string(path, '>') AS path FROM way WHERE here = 2")
def simple_paths(spark, d) -> DataFrame:
    ways = graph.simple_paths(_dag(spark, d))
    return ways.select("bg", F.array_join(F.transform("path", lambda x: x["node_id"].cast("string")), ">").alias("path"))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + """, way AS (SELECT bg, [edge_id] AS path, t_node AS here, [t_node] AS seen FROM (SELECT DISTINCT bg, s_node, t_node, edge_id FROM daglinks) WHERE s_node = 1
UNION ALL SELECT w.bg, list_append(w.path, s.edge_id), s.t_node, list_append(w.seen, s.t_node) FROM way w JOIN (SELECT DISTINCT bg, s_node, t_node, edge_id FROM daglinks) s ON s.bg = w.bg AND s.s_node = w.here WHERE NOT list_contains(w.seen, s.t_node))
SELECT bg, array_to_string(path, '>') AS path FROM way WHERE here = 2""")
def simple_paths_by_edge(spark, d) -> DataFrame:
    one = _dag(spark, d).select("bg", *graph.SOURCE, *graph.TARGET, "edge_id").distinct()
    return graph.simple_paths(one, by_edge=True).select("bg", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _WAYS + "SELECT bg, count(*)::VARCHAR AS ways FROM way WHERE here = 2 GROUP BY bg")
def path_counts(spark, d) -> DataFrame:
    return graph.path_counts(_dag(spark, d)).withColumn("ways", F.col("ways").cast("string"))


_DTEXT = f"translate(md5(n::VARCHAR), '{D._HEX}', '{D._BASES}')"


def _dag_nodes(spark, d) -> DataFrame:
    e = D.dag(spark, d).select(F.col("target_node").alias("node_id")).distinct()
    return e.select("node_id", F.translate(F.md5(F.col("node_id").cast("string").cast("binary")), D._HEX, D._BASES).alias("sequence"))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _LOST + f""", step AS (SELECT DISTINCT k.bg, s_node, t_node FROM kept k JOIN seen s ON s.bg = k.bg AND s.node = k.s_node),
way AS (SELECT bg, [t_node] AS path, t_node AS here FROM step WHERE s_node = 1 UNION ALL SELECT w.bg, list_append(w.path, s.t_node), s.t_node FROM way w JOIN step s ON s.bg = w.bg AND s.s_node = w.here)
SELECT DISTINCT bg, array_to_string(list_transform(list_filter(path, lambda x: x <> 2), lambda n: substr({_DTEXT}, 1, 5 + n % 7)), '') AS sequence FROM way WHERE here = 2""")
def all_sequences(spark, d) -> DataFrame:
    return graph.all_sequences(D.dag(spark, d), _dag_nodes(spark, d))


@query(D.sql_with(["edg", "blk", "pth"]) + _BLOCKS.format("edg") + """, i AS (SELECT b.path_id, b.idx, b.node_id, s.start, s."end", b.strand, b.seq_end - b.seq_start AS n, sum(s."end" - s.start) OVER (PARTITION BY b.path_id, b.idx) AS c,
  row_number() OVER (PARTITION BY b.path_id, b.idx ORDER BY CASE WHEN strand = '-' THEN -s.start ELSE s.start END) - 1 AS part
  FROM blk b JOIN pth p USING (path_id) JOIN edgblocks s ON s.bg = p.custkey AND s.node_id = b.node_id AND s.start >= b.seq_start AND s."end" <= b.seq_end),
bad AS (SELECT b.path_id FROM blk b LEFT JOIN (SELECT DISTINCT path_id, idx, c FROM i) x ON x.path_id = b.path_id AND x.idx = b.idx WHERE coalesce(c, 0) <> b.seq_end - b.seq_start)
SELECT path_id, idx, part, node_id, start, "end", strand FROM i WHERE path_id NOT IN (SELECT path_id FROM bad)""")
def project_paths(spark, d) -> DataFrame:
    b = D.blk(spark, d).join(D.pth(spark, d).select("path_id", F.col("custkey").alias("bg")), "path_id")
    return graph.project_paths(b, graph.blocks(D.edg(spark, d))).drop("bg")


@query(ORACLES["project_paths"].replace("SELECT path_id, idx, part, node_id, start", "SELECT path_id, idx, part, node_id, start, \"end\", lead(node_id) OVER (PARTITION BY path_id ORDER BY idx, part) AS next_node FROM (SELECT path_id, idx, part, node_id, start") + ")")
def path_highlight(spark, d) -> DataFrame:
    shown = graph.highlighted(project_paths(spark, d))
    return shown.select("path_id", "idx", "part", "node_id", "start", "end", F.col("next.node_id").alias("next_node"))


_SPANS = """, step AS (SELECT DISTINCT bg, s_node, s_end - s_start AS len, t_node FROM daglinks),
span AS (SELECT bg, 1 AS node_id, 0 AS at FROM step WHERE s_node = 1 UNION SELECT p.bg, s.t_node, p.at + s.len FROM span p JOIN step s ON s.bg = p.bg AND s.s_node = p.node_id),
sized AS (SELECT DISTINCT p.bg, p.node_id, p.at, b.start, b."end" FROM span p JOIN dagblocks b ON b.bg = p.bg AND b.node_id = p.node_id)
"""


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _SPANS + "SELECT * FROM sized")
def interval_spans(spark, d) -> DataFrame:
    return graph.spans(_dag(spark, d))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _SPANS + """, z AS (SELECT bg, node_id, {'x': sized.at, 'y': start} AS lo, {'x': sized.at + "end" - start, 'y': "end"} AS hi FROM sized),
clash AS (SELECT DISTINCT a.bg, a.node_id FROM z a JOIN z b ON a.bg = b.bg AND a.node_id = b.node_id WHERE (a.lo <> b.lo OR a.hi <> b.hi) AND a.lo < b.hi AND b.lo < a.hi)
SELECT s.* FROM sized s ANTI JOIN clash c ON c.bg = s.bg AND c.node_id = s.node_id""")
def unambiguous_spans(spark, d) -> DataFrame:
    return graph.spans(_dag(spark, d), unambiguous=True)


_DEPTH = """, step AS (SELECT DISTINCT bg, s_node, t_node FROM daglinks), lay AS (SELECT DISTINCT bg, 1 AS node_id, 0 AS depth FROM step UNION SELECT l.bg, s.t_node, l.depth + 1 FROM lay l JOIN step s ON s.bg = l.bg AND s.s_node = l.node_id),
deep AS (SELECT bg, node_id, max(depth)::BIGINT AS depth FROM lay GROUP BY bg, node_id)
"""


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _DEPTH + "SELECT * FROM deep")
def graph_layers(spark, d) -> DataFrame:
    return graph.depth(_dag(spark, d)).select("bg", "node_id", "depth")


_CUT = """, und AS (SELECT DISTINCT bg, s_node AS a, t_node AS b FROM daglinks WHERE s_node <> t_node UNION SELECT bg, t_node, s_node FROM daglinks WHERE s_node <> t_node),
whole AS (SELECT bg, a AS x, a AS node FROM und UNION SELECT w.bg, w.x, u.b FROM whole w JOIN und u ON u.bg = w.bg AND u.a = w.node),
rest AS (SELECT bg, a AS x, min(b) AS node FROM und GROUP BY bg, a UNION SELECT r.bg, r.x, u.b FROM rest r JOIN und u ON u.bg = r.bg AND u.a = r.node AND u.b <> r.x),
n_whole AS (SELECT bg, x, count(*) AS n FROM whole GROUP BY bg, x), n_rest AS (SELECT bg, x, count(*) AS n FROM rest GROUP BY bg, x),
cutnode AS (SELECT w.bg, w.x AS node_id FROM n_whole w JOIN n_rest r ON r.bg = w.bg AND r.x = w.x WHERE r.n < w.n - 1)
"""


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _CUT + """SELECT c.bg, c.node_id, b.start, b."end" FROM cutnode c JOIN dagblocks b ON b.bg = c.bg AND b.node_id = c.node_id""")
def articulation_points(spark, d) -> DataFrame:
    """Checked by taking out each block in turn."""
    return graph.articulation_points(_dag(spark, d))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _CUT + _DEPTH + """, ranked AS (SELECT d.bg, d.node_id, b.start, b."end", row_number() OVER (PARTITION BY d.bg ORDER BY d.depth, d.node_id, b.start) AS rank, c.node_id IS NOT NULL AS cut
  FROM deep d JOIN dagblocks b ON b.bg = d.bg AND b.node_id = d.node_id LEFT JOIN cutnode c ON c.bg = d.bg AND c.node_id = d.node_id),
firsts AS (SELECT bg, min(rank) AS rank FROM ranked WHERE cut GROUP BY bg, (rank - 1) // 4)
SELECT r.bg, r.node_id, r.start, r."end", r.rank, (SELECT count(*) FROM firsts f WHERE f.bg = r.bg AND f.rank < r.rank) AS part FROM ranked r""")
def graph_partitions(spark, d) -> DataFrame:
    linked = materialized(_dag(spark, d))
    return graph.partitions(graph.depth(linked), graph.articulation_points(linked), 4)


_RING = """, r0 AS (SELECT path_id AS bg, idx, (idx * 7 + path_id) % 1000 + 3 AS node, max(idx) OVER (PARTITION BY path_id) AS most FROM blk),
ring AS (SELECT a.bg, a.node AS s, b.node AS t FROM r0 a JOIN r0 b ON a.bg = b.bg AND b.idx = CASE WHEN a.idx < a.most THEN a.idx + 1 WHEN a.bg % 2 = 0 THEN 0 ELSE -1 END
  UNION ALL SELECT bg, 1, node FROM r0 WHERE idx = 0 AND bg % 4 = 1 UNION ALL SELECT bg, node, 2 FROM r0 WHERE idx = most AND bg % 4 = 1),
und AS (SELECT bg, s AS a, t AS b FROM ring UNION SELECT bg, t, s FROM ring), reach AS (SELECT bg, a AS x, a AS node FROM und UNION SELECT r.bg, r.x, u.b FROM reach r JOIN und u ON u.bg = r.bg AND u.a = r.node),
comp AS (SELECT bg, x AS node, min(node) AS c FROM reach GROUP BY bg, x),
closed AS (SELECT bg, c, max(node) AS largest FROM comp GROUP BY bg, c HAVING count(*) >= 3 AND NOT bool_or(node = 1) AND NOT bool_or(node = 2)),
done AS (SELECT k.bg, k.c, coalesce((SELECT max(s) FROM ring g WHERE g.bg = k.bg AND g.t = k.c), (SELECT max(m.node) FROM comp m WHERE m.bg = k.bg AND m.c = k.c AND NOT EXISTS (SELECT 1 FROM ring g WHERE g.bg = m.bg AND g.s = m.node)), largest) AS z FROM closed k)
"""


def _ring(spark, d) -> DataFrame:
    """Paths as rings, as chains with START and END, and as chains that neither is joined to; all blocks are ten long."""
    w = Window.partitionBy("path_id").orderBy("idx")
    node = (F.col("idx") * 7 + F.col("path_id")) % 1000 + 3
    r = D.blk(spark, d).withColumn("node", node).select(F.col("path_id").alias("bg"), "idx", "node", F.lead("node").over(w).alias("next"), F.first("node").over(w).alias("head"))
    one, two = F.lit(S.START_NODE).cast("long"), F.lit(S.END_NODE).cast("long")
    at, last, chain = F.col("node"), F.col("next").isNull(), F.col("bg") % 4 == 1
    way = lambda s, t: F.struct(s.alias("s"), t.alias("t"))
    ways = F.array(F.when(~last, way(at, F.col("next"))), F.when(last & (F.col("bg") % 2 == 0), way(at, F.col("head"))), F.when((F.col("idx") == 0) & chain, way(one, at)), F.when(last & chain, way(at, two)))
    every = r.select("bg", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("w")).select("bg", "w.s", "w.t")
    long_ = lambda c: F.when(S.is_terminal(F.col(c)), F.lit(0)).otherwise(F.lit(10)).cast("long")
    zero = F.lit(0).cast("long")
    return every.select("bg", F.col("s").alias("s_node"), zero.alias("s_start"), long_("s").alias("s_end"), F.col("t").alias("t_node"), zero.alias("t_start"), long_("t").alias("t_end"))


@query(D.sql_with(["blk"], recursive=True) + _RING + "SELECT bg, 1 AS source_node, 0 AS source_coordinate, c AS target_node FROM done UNION ALL SELECT bg, z, 10, 2 FROM done UNION ALL SELECT bg, 2, 0, 1 FROM done")
def cycle_breaking(spark, d) -> DataFrame:
    return graph.cycle_breaks(_ring(spark, d)).select("bg", "source_node", "source_coordinate", "target_node")


_PLACED = _DEPTH + """, p0 AS (SELECT d.bg, d.node_id, b.start, b."end", d.depth AS layer, row_number() OVER (PARTITION BY d.bg, d.depth ORDER BY d.node_id, b.start) - 1 AS place FROM deep d JOIN dagblocks b ON b.bg = d.bg AND b.node_id = d.node_id),
""" + "".join(f"""m{k} AS (SELECT s.bg, s.t_node AS node_id, sum(p.place)::DOUBLE / count(*) AS mean FROM step s JOIN p{k} p ON p.bg = s.bg AND p.node_id = s.s_node GROUP BY s.bg, s.t_node),
p{k + 1} AS (SELECT p.bg, p.node_id, p.start, p."end", p.layer, row_number() OVER (PARTITION BY p.bg, p.layer ORDER BY coalesce(m.mean, p.place::DOUBLE), p.node_id, p.start) - 1 AS place FROM p{k} p LEFT JOIN m{k} m ON m.bg = p.bg AND m.node_id = p.node_id){"," if k == 0 else ""}
""" for k in range(2))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _PLACED + "SELECT bg, node_id, start, \"end\", layer, place FROM p2")
def graph_layout(spark, d) -> DataFrame:
    return graph.layout(_dag(spark, d))


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + _PLACED + """, w AS (SELECT *, layer * 3 AS x, least("end" - start, 8) AS w FROM p2), g AS (SELECT bg, x, max(w) AS widest FROM w GROUP BY bg, x),
h AS (SELECT bg, x, CASE WHEN row_number() OVER (PARTITION BY bg ORDER BY x) = 1 THEN greatest(widest, 1) ELSE widest END AS widest FROM g), k AS (SELECT *, coalesce(sum(widest) OVER (PARTITION BY bg ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM h),
s AS (SELECT w.bg, node_id, (w.x + round((widest - w) / 2) + moved)::BIGINT AS x1, w, (place * 3)::BIGINT AS y FROM w JOIN k ON k.bg = w.bg AND k.x = w.x)
SELECT a.bg, e.s_node, e.t_node, a.x1 + a.w AS x1, a.y AS y1, b.x1 - 1 AS x2, b.y AS y2 FROM (SELECT DISTINCT bg, s_node, t_node FROM daglinks WHERE s_node > 2 AND t_node > 2) e JOIN s a ON a.bg = e.bg AND a.node_id = e.s_node JOIN s b ON b.bg = e.bg AND b.node_id = e.t_node""")
def drawn_links(spark, d) -> DataFrame:
    """Where the links of a drawing begin and end, with labels of eight characters at most."""
    linked = materialized(_dag(spark, d))
    return graph.drawn_links(linked, graph.scaled_layout(graph.layout(linked), 8, 3)).select("bg", "s_node", "t_node", "x1", "y1", "x2", "y2")


@query(D.sql_with(["edg"]) + """, e AS (SELECT source_node AS node_id, source_coordinate AS p FROM edg UNION SELECT target_node, target_coordinate FROM edg), i AS (SELECT * FROM e WHERE node_id > 2 UNION SELECT node_id, 0 FROM e WHERE node_id > 2 UNION SELECT node_id, 64 FROM e WHERE node_id > 2),
c AS (SELECT node_id, p AS start, lead(p) OVER (PARTITION BY node_id ORDER BY p) AS "end" FROM i) SELECT * FROM c WHERE "end" IS NOT NULL""")
def change_graph(spark, d) -> DataFrame:
    lengths = D.node(spark, d).select("node_id", F.length("sequence").cast("long").alias("length"))
    return graph.change_blocks(D.edg(spark, d), lengths)


_LINE = "SELECT event_id, (event_id % 37 - 9)::DOUBLE AS ax, (user_id % 23 - 6)::DOUBLE AS ay, (user_id % 41 - 11)::DOUBLE AS zx, (event_id % 19 - 5)::DOUBLE AS zy FROM events"


@query(f"""WITH l AS ({_LINE}), s AS (SELECT *, zx - ax AS dx, zy - ay AS dy FROM l),
t AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN ax / -dx WHEN dx < 0 THEN (20.0 - ax) / dx ELSE 0.0 END, CASE WHEN dy > 0 THEN ay / -dy WHEN dy < 0 THEN (10.0 - ay) / dy ELSE 0.0 END) AS t0,
  least(1.0, CASE WHEN dx > 0 THEN (20.0 - ax) / dx WHEN dx < 0 THEN ax / -dx ELSE 1.0 END, CASE WHEN dy > 0 THEN (10.0 - ay) / dy WHEN dy < 0 THEN ay / -dy ELSE 1.0 END) AS t1 FROM s),
u AS (SELECT *, t0 <= t1 AND NOT (dx = 0 AND (ax < 0 OR ax > 20)) AND NOT (dy = 0 AND (ay < 0 OR ay > 10)) AS seen FROM t)
SELECT event_id, seen AS visible, CASE WHEN seen THEN round(ax + t0 * dx, 6) END AS x1, CASE WHEN seen THEN round(ay + t1 * dy, 6) END AS y2,
  greatest(ax, zx) >= 0 AND 20 >= least(ax, zx) AND greatest(ay, zy) >= 0 AND 10 >= least(ay, zy) AS meets FROM u""")
def line_clipping(spark, d) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = table(spark, d, "events").select("event_id", S.point(e % 37 - 9, u % 23 - 6).alias("a"), S.point(u % 41 - 11, e % 19 - 5).alias("b"), S.point(F.lit(0), F.lit(0)).alias("low"), S.point(F.lit(20), F.lit(10)).alias("high"))
    four = [F.col(c) for c in ("a", "b", "low", "high")]
    cut = rows.select("event_id", S.clip_line(*four).alias("c"), S.rectangles_meet(*four).alias("meets"))
    return cut.select("event_id", F.col("c").isNotNull().alias("visible"), F.round("c.a.x", 6).alias("x1"), F.round("c.b.y", 6).alias("y2"), "meets")


@query("""WITH l AS (SELECT p_partkey, p_name AS t, length(p_name) AS n, (p_partkey % 7 - 3)::BIGINT AS s, (p_size % 9 + 3)::BIGINT AS w FROM part), e AS (SELECT *, s + n - 1 AS z, w - 1 AS wz FROM l),
r AS (SELECT *, CASE WHEN z > wz THEN substr(t, 1, n - (z - wz) - 1) || '…' ELSE t END AS cut FROM e)
SELECT p_partkey, CASE WHEN n = 0 OR z < 0 OR s > wz THEN '' WHEN s < 0 THEN '…' || substr(cut, -s + 2) ELSE cut END AS shown FROM r""")
def label_clipping(spark, d) -> DataFrame:
    shown = S.clip_label(F.col("p_name"), F.col("p_partkey") % 7 - 3, F.lit(0), F.col("p_size") % 9 + 3)
    return table(spark, d, "part").select("p_partkey", shown.alias("shown"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 11)::DOUBLE AS ax, (p_size % 5)::DOUBLE AS ay, (p_partkey % 11 + p_size)::DOUBLE AS zx, (p_partkey % 13)::DOUBLE AS zy FROM part),
q AS (SELECT *, unnest(generate_series(1, 3)) AS i FROM p), r AS (SELECT *, i / 4.0::DOUBLE AS t, 1.0 - i / 4.0::DOUBLE AS u, (ax + zx) / 2 AS m FROM q)
SELECT p_partkey, i::BIGINT AS i, round((u * u * u * ax + 3.0 * u * u * t * m + 3.0 * u * t * t * m + t * t * t * zx) * 2) / 2 AS x, round((u * u * u * ay + 3.0 * u * u * t * ay + 3.0 * u * t * t * zy + t * t * t * zy) * 4) / 4 AS y FROM r""")
def curve_points(spark, d) -> DataFrame:
    a, b = S.point(F.col("p_partkey") % 11, F.col("p_size") % 5), S.point(F.col("p_partkey") % 11 + F.col("p_size"), F.col("p_partkey") % 13)
    points = table(spark, d, "part").select("p_partkey", F.posexplode(S.curve(a, b, 5)).alias("i", "p")).where("i between 1 and 3")
    return points.select("p_partkey", F.col("i").cast("long").alias("i"), "p.x", "p.y")


# --- entities ------------------------------------------------------------------------------------------------------

_SIX = "source_node, source_coordinate, source_strand, target_node, target_coordinate, target_strand"


@query(D.sql_with(["pedge"]) + f", old AS (SELECT DISTINCT {_SIX} FROM pedge WHERE path_id % 2 = 0), new AS (SELECT DISTINCT {_SIX} FROM pedge) SELECT n.*, o.source_node IS NOT NULL AS known FROM new n LEFT JOIN old o USING ({_SIX})")
def edge_upsert(spark, d) -> DataFrame:
    """Edges of all paths, put into a store that has those of every second path."""
    every = D.pedge(spark, d)
    old = every.where(F.col("path_id") % 2 == 0).select(*edits.EDGE, "edge_id").distinct().withColumn("known", F.lit(True))
    rows, _ = entities.upsert_edges(old, every.select(*edits.EDGE).withColumn("known", F.lit(False)))
    return rows.select(*edits.EDGE, "known")


@query(D.sql_with(["seq"]) + "SELECT sha256('DNA;' || sequence || ';;;') AS hash, any_value(length(sequence))::BIGINT AS length, count(*) AS nodes FROM seq GROUP BY 1")
def node_dedupe(spark, d) -> DataFrame:
    r = D.seq(spark, d).select(F.lit("DNA").alias("sequence_type"), "sequence", F.lit("").alias("name"), F.lit("").alias("file_path"))
    made = entities.sequences(r).select("hash", "length")
    used = r.select(S.sequence_hash(*[F.col(c) for c in r.columns]).alias("hash")).groupBy("hash").agg(F.count("*").alias("nodes"))
    return made.join(used, "hash")


@query(D.sql_with(["edg"]) + "SELECT bg, edge_id, count(*) AS n, min(chromosome_index) AS first_index FROM edg GROUP BY bg, edge_id")
def graph_members(spark, d) -> DataFrame:
    e = D.edg(spark, d)
    joined = entities.edges_for_graphs(e.select("bg", "edge_id", "chromosome_index", "phased"), e.select("edge_id", *edits.EDGE).distinct())
    return joined.groupBy("bg", "edge_id").agg(F.count("*").alias("n"), F.min("chromosome_index").alias("first_index"))


@query(D.sql_with(["edg"]) + """, g AS (SELECT DISTINCT bg AS id, (bg % 3)::VARCHAR AS sample FROM edg) SELECT DISTINCT g.id, g.sample, m.edge_id, m.source_node, m.target_node
FROM g LEFT JOIN edg m ON m.bg = g.id AND g.sample = '1'""")
def graphs_with_edges(spark, d) -> DataFrame:
    e = D.edg(spark, d)
    graphs = e.select(F.col("bg").alias("id"), (F.col("bg") % 3).cast("string").alias("sample")).distinct()
    found = entities.graphs_with_edges(graphs, e.select("bg", "edge_id"), e.select("edge_id", "source_node", "target_node").distinct(), "1")
    return found.select("id", "sample", "edge_id", "source_node", "target_node").distinct()


_GRAPHS = "SELECT collection, sample, name, count(*) AS n FROM pth GROUP BY ALL"


def _graphs(spark, d) -> DataFrame:
    return D.pth(spark, d).groupBy("collection", "sample", "name").agg(F.count("*").alias("n")).withColumn("id", S.key_number(F.concat_ws("/", "collection", "sample", "name")))


@query(D.sql_with(["pth"]) + f", g AS ({_GRAPHS}), k AS (SELECT DISTINCT collection, sample AS parent, coalesce(sample, 'ref') || '.child' AS sample FROM g) SELECT k.collection, k.sample, g.name FROM k JOIN g ON g.collection = k.collection AND g.sample IS NOT DISTINCT FROM k.parent")
def child_sample_clone(spark, d) -> DataFrame:
    g = _graphs(spark, d)
    kids = g.select("collection", F.col("sample").alias("parent"), F.concat(F.coalesce("sample", F.lit("ref")), F.lit(".child")).alias("sample")).distinct()
    return entities.child_graphs(g.select("id", "collection", "sample", "name"), kids).select("collection", "sample", "name")


@query("SELECT p_partkey AS id, p_name AS file_path, u.operation_hash FROM part LEFT JOIN (SELECT DISTINCT l_partkey, md5((l_orderkey % 50)::VARCHAR) AS operation_hash FROM lineitem WHERE l_linenumber = 1) u ON u.l_partkey = p_partkey")
def operation_files(spark, d) -> DataFrame:
    used = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("file_addition_id"), F.md5((F.col("l_orderkey") % 50).cast("string").cast("binary")).alias("operation_hash")).distinct()
    return entities.operation_files(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file_path")), used)


@query(D.sql_with(["edg"]) + "SELECT -bg AS bg, edge_id, chromosome_index, phased FROM edg")
def graph_clone(spark, d) -> DataFrame:
    members = D.edg(spark, d).select("bg", "edge_id", "chromosome_index", "phased")
    return entities.cloned(members, members.select(F.col("bg").alias("old"), (-F.col("bg")).alias("new")).distinct())


@query(D.sql_with(["pth"]) + "SELECT collection, sample, name, max(path_id) AS path_id FROM pth GROUP BY ALL")
def current_path(spark, d) -> DataFrame:
    return entities.current_paths(D.pth(spark, d), ["collection", "sample", "name"]).select("collection", "sample", "name", "path_id")


@query(D.sql_with(["pth"]) + "SELECT path_id, name FROM pth WHERE collection = 'BUILDING' AND sample IS NULL")
def paths_of_reference(spark, d) -> DataFrame:
    return entities.paths_of(D.pth(spark, d), "BUILDING", None).select("path_id", "name")


@query(D.sql_with(["pth"]) + "SELECT DISTINCT sample FROM pth WHERE sample IS NOT NULL")
def list_samples(spark, d) -> DataFrame:
    return D.pth(spark, d).where("sample is not null").select("sample").distinct()


@query(D.sql_with(["pth"]) + _GRAPHS)
def list_graphs(spark, d) -> DataFrame:
    return _graphs(spark, d).drop("id")


@query(D.sql_with(["pth"]) + """, g AS (SELECT collection || '/' || name AS collection, sample, name FROM pth UNION ALL SELECT collection, sample, name FROM pth)
SELECT 'reference' AS kind, name, count(*) AS n FROM g WHERE collection = 'BUILDING' AND sample IS NULL GROUP BY name UNION ALL SELECT 'sample', sample, count(*) FROM g WHERE collection = 'BUILDING' AND sample IS NOT NULL GROUP BY sample
UNION ALL SELECT 'collection', string_split(collection, '/')[2], count(*) FROM g WHERE starts_with(collection, 'BUILDING/') GROUP BY 2""")
def collection_explorer(spark, d) -> DataFrame:
    p = D.pth(spark, d).select("collection", "sample", "name")
    return entities.explorer(p.withColumn("collection", F.concat_ws("/", "collection", "name")).unionByName(p), "BUILDING")


# --- edits ---------------------------------------------------------------------------------------------------------

_CHANGES = """, size AS (SELECT path_id, max(path_end) AS n FROM off GROUP BY path_id),
ch AS (SELECT path_id AS change_id, path_id, CASE WHEN path_id % 7 = 0 THEN 0 ELSE path_id % 29 END AS start, CASE WHEN path_id % 7 = 0 THEN path_id % 3 ELSE path_id % 29 + path_id % 11 END AS "end", 1000000 + path_id AS node_id, CASE WHEN path_id % 5 = 0 THEN 0 ELSE 4 END AS node_end, path_id % 2 AS ci, path_id % 3 = 0 AS preserve FROM size),
spot AS (SELECT path_id, node_id AS n, seq_start, path_start, path_end FROM off UNION ALL SELECT path_id, 2, 0, n, n + 1 FROM size),
l AS (SELECT ch.*, coalesce(s.n, 1) AS sn, coalesce(ch.start - s.path_start + s.seq_start, 0) AS sc FROM ch JOIN size z USING (path_id) LEFT JOIN spot s ON s.path_id = ch.path_id AND ch.start - 1 >= s.path_start AND ch.start - 1 < s.path_end WHERE ch."end" <= z.n),
r AS (SELECT l.*, s.n AS en, l."end" - s.path_start + s.seq_start AS ec FROM l JOIN spot s ON s.path_id = l.path_id AND l."end" >= s.path_start AND l."end" < s.path_end)
SELECT change_id, sn AS source_node, sc AS source_coordinate, sn AS target_node, sc AS target_coordinate, 0 AS chromosome_index FROM r WHERE preserve AND sn > 2
UNION ALL SELECT change_id, en, ec, en, ec, 0 FROM r WHERE preserve AND en > 2
UNION ALL SELECT change_id, sn, sc, node_id, 0, ci FROM r WHERE node_end > 0 UNION ALL SELECT change_id, node_id, node_end, en, ec, ci FROM r WHERE node_end > 0 UNION ALL SELECT change_id, sn, sc, en, ec, ci FROM r WHERE node_end = 0"""


@query(D.sql_with(["off"]) + _CHANGES)
def edit_edges(spark, d) -> DataFrame:
    b = paths.path_blocks(D.blk(spark, d))
    p = F.col("path_id")
    changes = b.select("path_id").distinct().select(
        p.alias("change_id"), "path_id", F.when(p % 7 == 0, 0).otherwise(p % 29).alias("start"), F.when(p % 7 == 0, p % 3).otherwise(p % 29 + p % 11).alias("end"), (p + 1_000_000).alias("node_id"),
        F.lit(0).alias("node_start"), F.when(p % 5 == 0, 0).otherwise(4).alias("node_end"), (p % 2).alias("chromosome_index"), F.lit(0).alias("phased"), (p % 3 == 0).alias("preserve"))
    return edits.edit_edges(changes, b).select("change_id", "source_node", "source_coordinate", "target_node", "target_coordinate", "chromosome_index")


@query(D.sql_with(["vcf"]) + r""", g AS (SELECT *, regexp_extract_all(gt, '[0-9.]+') AS al FROM vcf), u AS (SELECT record AS path_id, pos, ref, gt, [alt, 'TTT'] AS alts, list_contains(al, '0') AS preserve, unnest(al) AS a, unnest(generate_series(0, len(al) - 1)) AS ci FROM g),
x AS (SELECT *, alts[a::INT] AS alt FROM u WHERE a NOT IN ('.', '0')), c AS (SELECT *, NOT starts_with(alt, '<') AND length(alt) <> length(ref) AS cut, CASE WHEN regexp_matches(alt, '^<CN[0-9]+>$') THEN repeat(ref, regexp_extract(alt, '^<CN([0-9]+)>$', 1)::INT) WHEN starts_with(alt, '<') THEN NULL ELSE alt END AS e FROM x WHERE alt <> '*'),
f AS (SELECT path_id, ci AS chromosome_index, preserve, CASE WHEN cut THEN pos ELSE pos - 1 END AS start, pos - 1 + length(ref) AS "end", CASE WHEN cut THEN substr(e, 2) ELSE e END AS sequence FROM c WHERE e IS NOT NULL)
SELECT *, sha256(path_id::VARCHAR || ':' || start::VARCHAR || '-' || "end"::VARCHAR || '->' || sha256('DNA;' || sequence || ';;;')) AS node_hash FROM f""")
def vcf_changes(spark, d) -> DataFrame:
    calls = D.vcf(spark, d).select(F.col("record").alias("path_id"), "pos", "ref", "gt", F.array("alt", F.lit("TTT")).alias("alts"))
    return edits.variant_changes(calls).select("path_id", "chromosome_index", "preserve", "start", "end", "sequence", "node_hash")


_PARTS = "SELECT DISTINCT p_size AS pool, length(p_type) % 3 AS slot, p_partkey + 10 AS node_id, length(p_name)::BIGINT AS length FROM part"


def _parts(spark, d) -> DataFrame:
    slot = F.length("p_type") % 3
    return table(spark, d, "part").select(F.col("p_size").alias("pool"), slot.alias("slot"), (F.col("p_partkey") + 10).alias("node_id"), F.length("p_name").cast("long").alias("length")).distinct()


@query(f"""WITH p AS ({_PARTS}), e AS (SELECT pool, min(slot) AS f, max(slot) AS l FROM p GROUP BY pool)
SELECT pool, pool + 5000 AS source_node, 3 AS source_coordinate, node_id AS target_node, 0 AS target_coordinate FROM p JOIN e USING (pool) WHERE slot = f UNION SELECT pool, node_id, length, pool + 5000, 9 FROM p JOIN e USING (pool) WHERE slot = l
UNION SELECT a.pool, a.node_id, a.length, b.node_id, 0 FROM p a JOIN p b ON a.pool = b.pool AND b.slot = a.slot + 1 UNION SELECT pool, pool + 5000, c, pool + 5000, c FROM e, (VALUES (3), (9)) AS v(c)""")
def library_edges(spark, d) -> DataFrame:
    p = _parts(spark, d)
    node = (F.col("pool") + 5000).cast("long")
    anchors = p.select("pool").distinct().select("pool", node.alias("s_node"), F.lit(3).alias("s_at"), node.alias("e_node"), F.lit(9).alias("e_at"))
    return edits.library_edges(p, anchors).select("pool", "source_node", "source_coordinate", "target_node", "target_coordinate")


@query(f"WITH p AS ({_PARTS}), n AS (SELECT pool, slot, count(DISTINCT node_id) AS n FROM p GROUP BY pool, slot) SELECT pool, product(n)::BIGINT AS products FROM n GROUP BY pool")
def library_sizes(spark, d) -> DataFrame:
    return edits.library_sizes(_parts(spark, d))


@query("""WITH p AS (SELECT n_regionkey AS pool, n_nationkey % 3 AS slot, n_name AS sequence FROM nation), s AS (SELECT pool, count(DISTINCT slot) AS k FROM p GROUP BY pool)
SELECT a.pool, a.sequence || b.sequence || c.sequence AS sequence FROM p a JOIN p b ON b.pool = a.pool AND b.slot = 1 JOIN p c ON c.pool = a.pool AND c.slot = 2 WHERE a.slot = 0""")
def library_pool(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("pool"), (F.col("n_nationkey") % 3).alias("slot"), F.col("n_name").alias("sequence"))
    return edits.library_products(n)


_STITCH = """, o AS (SELECT bg // 3 AS new, bg % 3 AS place, bg FROM (SELECT DISTINCT bg FROM dag)), z AS (SELECT new, min(place) AS f, max(place) AS l FROM o GROUP BY new), x AS (SELECT dag.*, o.new, o.place, z.f, z.l FROM dag JOIN o USING (bg) JOIN z USING (new)),
own AS (SELECT bg, edge_id, true AS own FROM dag GROUP BY bg, edge_id HAVING min(chromosome_index) = 0),
y AS (SELECT x.*, coalesce(own, false) AS own FROM x LEFT JOIN own USING (bg, edge_id)),
k AS (SELECT DISTINCT new, source_node, source_coordinate, target_node, target_coordinate, chromosome_index FROM y WHERE (source_node <> 1 AND target_node <> 2) OR (source_node = 1 AND place = f) OR (target_node = 2 AND place = l)),
a AS (SELECT new, place + 1 AS place, source_node, source_coordinate, bool_or(own) AS own FROM y WHERE target_node = 2 GROUP BY ALL), b AS (SELECT new, place, target_node, target_coordinate, bool_or(own) AS own FROM y WHERE source_node = 1 GROUP BY ALL),
j AS (SELECT new, place, source_node, source_coordinate, target_node, target_coordinate, a.own AND b.own AS main, row_number() OVER (PARTITION BY new, a.own AND b.own ORDER BY place, source_node, source_coordinate, target_node, target_coordinate) AS n FROM a JOIN b USING (new, place))
SELECT * FROM k UNION ALL SELECT new, source_node, source_coordinate, target_node, target_coordinate, CASE WHEN main THEN 0 ELSE (SELECT max(chromosome_index) FROM k WHERE k.new = j.new) + n END FROM j"""


@query(D.sql_with(["dag"]) + _STITCH)
def stitch_edges(spark, d) -> DataFrame:
    e = D.dag(spark, d)
    order = e.select("bg").distinct().select(F.floor(F.col("bg") / 3).alias("new"), (F.col("bg") % 3).alias("place"), "bg")
    own = e.groupBy("bg", "edge_id").agg(F.min("chromosome_index").alias("c")).where("c = 0").select("bg", "edge_id")
    return edits.stitch_edges(e, order, own).select("new", "source_node", "source_coordinate", "target_node", "target_coordinate", "chromosome_index")


@query(D.sql_with(["dag"], recursive=True) + _GRAPH["dag"] + """, cut AS (SELECT bg, min(t_node) AS s, max(t_node) AS e FROM daglinks WHERE t_node > 2 GROUP BY bg),
f AS (SELECT bg, s AS node FROM cut UNION SELECT k.bg, k.t_node FROM f JOIN daglinks k ON k.bg = f.bg AND k.s_node = f.node), r AS (SELECT bg, e AS node FROM cut UNION SELECT k.bg, k.s_node FROM r JOIN daglinks k ON k.bg = r.bg AND k.t_node = r.node),
m AS (SELECT bg, node FROM f INTERSECT SELECT bg, node FROM r), n AS (SELECT DISTINCT k.bg, s_node, s_end, t_node, t_start, chromosome_index FROM daglinks k JOIN m x ON x.bg = k.bg AND x.node = s_node JOIN m y ON y.bg = k.bg AND y.node = t_node)
SELECT bg, ('0x' || substr(md5(concat_ws('.', bg, s_node)), 1, 15))::BIGINT AS source_node, s_end AS source_coordinate, ('0x' || substr(md5(concat_ws('.', bg, t_node)), 1, 15))::BIGINT AS target_node, t_start AS target_coordinate, chromosome_index FROM n
UNION SELECT bg, 1, 0, ('0x' || substr(md5(concat_ws('.', bg, s)), 1, 15))::BIGINT, 1, 0 FROM cut UNION SELECT bg, ('0x' || substr(md5(concat_ws('.', bg, e)), 1, 15))::BIGINT, 2, 2, 0, 0 FROM cut""")
def derive_subgraph(spark, d) -> DataFrame:
    linked = materialized(_dag(spark, d))
    cuts = linked.where("t_node > 2").groupBy("bg").agg(F.min("t_node").alias("s_node"), F.max("t_node").alias("e_node")).select("bg", "s_node", F.lit(1).alias("s_at"), "e_node", F.lit(2).alias("e_at"))
    return edits.subgraph(linked, cuts).select("bg", "source_node", "source_coordinate", "target_node", "target_coordinate", "chromosome_index")


@query(D.sql_with(["off", "pth"]) + _MAP + """, s AS (SELECT DISTINCT a_path, b_path, source_start AS s, source_end AS e FROM m), i AS (SELECT *, CASE WHEN lag(e) OVER w = s THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY a_path, b_path ORDER BY s, e)),
g AS (SELECT *, sum(new) OVER (PARTITION BY a_path, b_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM i), whole AS (SELECT a_path, b_path, min(s) AS s, max(e) AS e FROM g GROUP BY a_path, b_path, g),
n AS (SELECT a_path, b_path, max(path_end) AS len FROM pairs JOIN off ON path_id = a_path GROUP BY ALL),
h AS (SELECT a_path, b_path, coalesce(max(e) OVER (PARTITION BY a_path, b_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, s AS e FROM whole UNION ALL SELECT n.a_path, n.b_path, coalesce((SELECT max(e) FROM whole w WHERE w.a_path = n.a_path AND w.b_path = n.b_path), 0), len FROM n)
SELECT a_path AS path, b_path AS other, s AS start, e AS "end", true AS shared FROM whole UNION ALL SELECT a_path, b_path, s, e, false FROM h WHERE s < e""")
def sample_diff_ranges(spark, d) -> DataFrame:
    m = _mappings(spark, d).select(F.col("a_path").alias("path"), F.col("b_path").alias("other"), F.col("source_start").alias("start"), F.col("source_end").alias("end")).distinct()
    p = D.pth(spark, d).select("path_id", "custkey")
    from pyspark.sql import Window as W

    pairs = p.withColumn("other", F.lead("path_id").over(W.partitionBy("custkey").orderBy("path_id"))).where("other is not null").select(F.col("path_id").alias("path"), "other")
    n = pairs.join(paths.path_length(D.blk(spark, d)).withColumnRenamed("path_id", "path"), "path")
    return edits.diff_ranges(m, n)


@query("""WITH e AS (SELECT l_orderkey AS k, l_linenumber * 10 + l_partkey % 7 AS start, repeat('A', (l_suppkey % 4)::INT) AS old, repeat('C', (l_partkey % 5)::INT) AS new, l_extendedprice AS x FROM lineitem),
f AS (SELECT k, start, min(old) AS old, max(new) AS new FROM e GROUP BY k, start)
SELECT k, start, start + coalesce(sum(length(old) - length(new)) OVER w, 0)::BIGINT AS wt_start, (start + coalesce(sum(length(old) - length(new)) OVER w, 0) + length(old))::BIGINT AS wt_end FROM f WINDOW w AS (PARTITION BY k ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def genbank_offsets(spark, d) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10 + F.col("l_partkey") % 7).alias("start"), F.repeat(F.lit("A"), (F.col("l_suppkey") % 4).cast("int")).alias("old"), F.repeat(F.lit("C"), (F.col("l_partkey") % 5).cast("int")).alias("new"))
    one = rows.groupBy("k", "start").agg(F.min("old").alias("old"), F.max("new").alias("new"))
    return edits.applied_offsets(one, ["k"]).select("k", "start", F.col("wt_start").cast("long").alias("wt_start"), F.col("wt_end").cast("long").alias("wt_end"))


# --- versions ------------------------------------------------------------------------------------------------------

_UP = ", up AS (SELECT op, op AS ancestor, 0::BIGINT AS depth FROM ask UNION ALL SELECT up.op, o.parent, depth + 1 FROM up JOIN ops o ON o.op = up.ancestor WHERE o.parent IS NOT NULL)\n"
_HEADS = "SELECT branch, max(op) AS head, min(op) AS tail, arg_max(op, (op * 7919) % 1009) AS mid FROM ops GROUP BY branch"


def _heads(spark, d) -> DataFrame:
    return D.ops(spark, d).groupBy("branch").agg(F.max("op").alias("head"), F.min("op").alias("tail"))


@query(D.sql_with(["ops"], "ask AS (SELECT max(op) AS op FROM ops GROUP BY branch)", recursive=True) + _UP + "SELECT * FROM up")
def upstream_ops(spark, d) -> DataFrame:
    return versions.ancestors(D.ops(spark, d), _heads(spark, d).select(F.col("head").alias("op")))


@query(D.sql_with(["ops"], "free AS (SELECT o.op, CASE WHEN p.masked THEN NULL ELSE o.parent END AS parent, o.branch FROM ops o LEFT JOIN ops p ON p.op = o.parent WHERE NOT o.masked), ask AS (SELECT max(op) AS op FROM free GROUP BY branch)", recursive=True)
       + _UP.replace("JOIN ops o", "JOIN free o") + ", b AS (SELECT branch, max(op) AS op FROM free GROUP BY branch) SELECT branch, ancestor AS op, max(depth) OVER (PARTITION BY branch) - depth AS place FROM b JOIN up USING (op)")
def branch_ops(spark, d) -> DataFrame:
    ops = D.ops(spark, d)
    free = versions.unmasked(ops, ops.where("masked"))
    heads = free.groupBy("branch").agg(F.max("op").alias("current"))
    return versions.branch_operations(free, heads)


_FORK = "ops2 AS (SELECT op, branch, CASE WHEN parent IS NULL AND branch % 2 = 1 THEN (SELECT max(o.op) FROM ops o WHERE o.branch = ops.branch - 1 AND o.op % 3 = 0) ELSE parent END AS parent FROM ops), pair AS (SELECT a.head AS source, b.head AS target FROM (SELECT branch, max(op) AS head FROM ops GROUP BY branch) a JOIN (SELECT branch, max(op) AS head FROM ops GROUP BY branch) b ON b.branch = a.branch + 1), ask AS (SELECT source AS op FROM pair UNION SELECT target FROM pair)"
_BETWEEN = D.sql_with(["ops"], _FORK, recursive=True) + _UP.replace("JOIN ops o", "JOIN ops2 o") + """, a AS (SELECT p.*, ancestor, depth FROM pair p JOIN up ON up.op = p.source), b AS (SELECT p.*, ancestor, depth FROM pair p JOIN up ON up.op = p.target),
x AS (SELECT a.* FROM a ANTI JOIN b ON a.source = b.source AND a.target = b.target AND a.ancestor = b.ancestor), y AS (SELECT b.* FROM b ANTI JOIN a ON a.source = b.source AND a.target = b.target AND a.ancestor = b.ancestor),
n AS (SELECT source, target, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT source, target, count(*) AS m FROM y GROUP BY ALL),
steps AS (SELECT source, target, depth AS step, ancestor AS op, 'revert' AS direction FROM x UNION ALL SELECT y.source, y.target, coalesce(n, 0) + m - 1 - depth, ancestor, 'apply' FROM y JOIN m ON m.source = y.source AND m.target = y.target LEFT JOIN n ON n.source = y.source AND n.target = y.target)
"""


def _forked(spark, d) -> tuple[DataFrame, DataFrame]:
    """Branches with an odd number begin on the one before them; pairs of the heads of neighbours."""
    ops = D.ops(spark, d)
    fork = ops.where(F.col("op") % 3 == 0).groupBy((F.col("branch") + 1).alias("branch")).agg(F.max("op").alias("fork"))
    ops2 = ops.join(fork, "branch", "left").withColumn("parent", F.when(F.col("parent").isNull() & (F.col("branch") % 2 == 1), F.col("fork")).otherwise(F.col("parent"))).select("op", "branch", "parent")
    h = _heads(spark, d).select("branch", "head")
    return ops2, h.select("branch", F.col("head").alias("source")).join(h.select((F.col("branch") - 1).alias("branch"), F.col("head").alias("target")), "branch").drop("branch")


@query(_BETWEEN + "SELECT * FROM steps")
def path_between(spark, d) -> DataFrame:
    return versions.path_between(*_forked(spark, d))


@query(_BETWEEN + "SELECT source, target, step, op FROM steps WHERE direction = 'apply'")
def merge_ops(spark, d) -> DataFrame:
    return versions.merge_operations(*_forked(spark, d))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus""")
def changeset_diff(spark, d) -> DataFrame:
    """Two made-up snapshots of the orders: one lacks some rows, the other lacks others and has changed some."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    after = o.where(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return versions.changeset(o.where(k % 11 != 0), after, ["o_orderkey"]).drop("row")


@query("""WITH made AS (SELECT l_orderkey AS path_id, l_partkey AS node_id FROM lineitem), own AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O'), nodes AS (SELECT p_partkey AS id FROM part WHERE p_size > 25)
SELECT DISTINCT 'path' AS "table", path_id AS id FROM made ANTI JOIN own ON own.id = path_id UNION ALL SELECT DISTINCT 'node', node_id FROM made ANTI JOIN nodes ON nodes.id = node_id""")
def dependency_capture(spark, d) -> DataFrame:
    made = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path_id"), F.col("l_partkey").alias("node_id"))
    own = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))
    nodes = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("id"))
    return versions.dependencies(made, "path_id", {"path": own, "node": nodes})


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN p.p_size <= 20 THEN l_partkey + 100000 WHEN p.p_size <= 40 THEN l_partkey + 200000 ELSE l_partkey END AS l_partkey FROM lineitem JOIN part p ON p.p_partkey = l_partkey""")
def id_remap(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    maps = [p.where(F.col("p_size") <= top).select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + add).alias("new")) for top, add in ((20, 100_000), (40, 200_000))]
    return versions.remapped(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), "l_partkey", *maps)


# --- lines of text formats -----------------------------------------------------------------------------------------


@query(D.sql_with(["node"]) + _SPELLED + r"SELECT path_id, '>path' || path_id::VARCHAR || chr(10) || rtrim(regexp_replace(sequence, '(.{1,80})', '\1' || chr(10), 'g'), chr(10)) AS value FROM spelled")
def fasta_records(spark, d) -> DataFrame:
    s = path_sequence(spark, d)
    return s.select("path_id", writers.fasta_lines(F.concat(F.lit("path"), F.col("path_id").cast("string")), F.col("sequence")).alias("value"))


@query(f'SELECT concat_ws(chr(9), name, start, "end") AS value FROM ({_translate_sql(0)})')
def bed_lines(spark, d) -> DataFrame:
    return writers.bed_lines(translate_bed(spark, d))


@query(D.sql_with(["dag"]) + _GRAPH["dag"] + f""", names AS (SELECT DISTINCT node_id AS n FROM dagblocks WHERE node_id > 2)
SELECT bg, 'S' AS kind, concat_ws(chr(9), 'S', concat_ws('.', node_id, start, "end"), substr({_DTEXT.replace("n::", "node_id::")}, start + 1, "end" - start)) AS value FROM dagblocks WHERE node_id > 2
UNION SELECT bg, 'L', concat_ws(chr(9), 'L', concat_ws('.', s_node, s_start, s_end), source_strand, concat_ws('.', t_node, t_start, t_end), target_strand, '0M') FROM daglinks WHERE s_node > 2 AND t_node > 2
UNION SELECT custkey, 'P', concat_ws(chr(9), 'P', 'Path-' || path_id::VARCHAR, string_agg(concat_ws('.', x.n, 0, 5 + x.n % 7) || '+', ',' ORDER BY idx), '*') FROM (SELECT path_id, bg AS custkey, idx, node_id AS n FROM dnode) x GROUP BY custkey, path_id""")
def gfa_lines(spark, d) -> DataFrame:
    b = D.blk(spark, d).join(D.pth(spark, d).select("path_id", F.col("custkey").alias("bg")), "path_id")
    b = b.select("bg", "path_id", "idx", (F.col("idx") * 1000 + F.col("node_id") % 2 + 3).alias("node_id"), F.lit("+").alias("strand")).withColumns({"seq_start": F.lit(0).cast("long"), "seq_end": 5 + F.col("node_id") % 7})
    names = b.select("path_id").distinct().withColumn("name", F.concat(F.lit("path "), F.col("path_id").cast("string")))
    return writers.gfa_of(D.dag(spark, d), b, _dag_nodes(spark, d), names)


@query("""SELECT o_orderkey::VARCHAR || '_left' AS name, o_orderpriority AS sequence FROM orders WHERE length(o_orderpriority) > 0 UNION ALL SELECT o_orderkey::VARCHAR || '_right', rtrim(o_orderstatus, 'O') FROM orders WHERE length(rtrim(o_orderstatus, 'O')) > 0""")
def csv_to_fasta(spark, d) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("left"), F.rtrim("o_orderstatus", F.lit("O")).alias("right"))
    return writers.arms_fasta(e)


@query(D.sql_with(["dag"]) + _GRAPH["dag"] + """SELECT DISTINCT bg, '"' || concat_ws('.', s_node, s_start, s_end) || '" -> "' || concat_ws('.', t_node, t_start, t_end) || '";' AS value FROM daglinks""")
def dot_lines(spark, d) -> DataFrame:
    return writers.dot_lines(_dag(spark, d))
