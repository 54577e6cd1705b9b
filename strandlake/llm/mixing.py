"""Mixing sources to target weights by weighted fair queueing.

Every document is offered EPOCHS times. A source's offers are shuffled by a hash, epoch after epoch; the
virtual finish time of an offer is its source's running word count divided by the source's target. All offers
are put in order of finish time and taken until the total budget is used up.

No window runs over a whole source or over the whole table: running counts are taken inside small buckets (of
the hash, of the finish time), and the buckets' own sums, a few thousand rows a source, carry the offsets.

Defined cases: null text has size 0, and is never taken; a null source is a source of its own, the last one;
rows that repeat a doc_id are separate offers, told apart by the text's hash and, where that is equal too, by the order
of their sources; ties of finish time go by source and hash; a null doc_id counts as an empty one; other columns are
kept as they are, whatever their names; an empty table gives no rows; a very long text is one offer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, restored, sheltered, text_of, written

WEIGHTS = (5, 2, 1)
#: Budget and cap are ratios of whole numbers, so that targets are exact up to one division.
BUDGET = (3, 2)
EPOCHS = 2
#: Finish times fall in this many buckets a unit of time.
TIME_BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, all_words, target): budget shared by weight, no target above epochs times its source's size.

    With sources ordered by cap / weight, those whose cap is below the fair share form a prefix; the first one
    at or above it ends the prefix, and what is left is shared by weight. One row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * epochs)
    every = W.orderBy((F.col("cap").cast("double") / F.col("w")), F.col("source").asc_nulls_last())
    before = every.rowsBetween(W.unboundedPreceding, -1)
    whole = every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    num, den = budget
    per = per.withColumns({
        "left_w": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        # in units of 1/den words
        "left_t": F.sum("source_size").over(whole) * num - F.coalesce(F.sum("cap").over(before), F.lit(0)) * den,
    })
    open_ = (F.col("cap") * den * F.col("left_w") >= F.col("w") * F.col("left_t")).cast("int")
    per = per.withColumn("n_open", F.sum(open_).over(every.rowsBetween(W.unboundedPreceding, 0)))
    # from the first open source on, all share what was left there
    share = F.first(F.when(F.col("n_open") > 0, F.struct("left_t", "left_w")), ignorenulls=True).over(whole)
    per = per.withColumn("share", share)
    target = F.when(F.col("n_open") == 0, F.col("cap").cast("double")).otherwise((F.col("w") * F.col("share.left_t")).cast("double") / (F.col("share.left_w") * den).cast("double"))
    return per.select("source", "source_size", F.sum("source_size").over(whole).alias("all_words"), target.alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """df with the running sum of value up to each row, within keys, in order of bucket and then order."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    offset = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", offset).drop("_sum")
    inner = F.sum(value).over(W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_in", inner).join(sums, [*keys, bucket]).withColumn(out, F.col("_before") + F.col("_in")).drop("_before", "_in")


def row_key() -> Column:
    """What tells a row from others: its doc_id and the hash of its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of("text").cast("binary")))


def _numbered(docs: DataFrame) -> DataFrame:
    """Adds _copy, which counts the rows with the same _key by source."""
    return docs.withColumn("_copy", F.row_number().over(W.partitionBy("_key").orderBy(F.col("source").asc_nulls_last())))


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """One row a document: doc_id, _key, size, source_size, target, taken (words, repeats counted)."""
    docs = docs.select("doc_id", "source", word_count(text_of("text")).alias("size"), row_key().alias("_key"))
    # the texts are read once; all that follows works on this small table
    docs = written(_numbered(docs))
    # sources travel as their rank: small, never null
    targets = source_targets(docs, weights, budget, epochs)
    targets = targets.withColumn("_src", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    sized = docs.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    offers = sized.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    offers = offers.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col("_copy").cast("string"), F.col("_key")).cast("binary")))
    # epoch after epoch: the bucket starts with the epoch
    offers = offers.withColumn("_b", F.concat(F.lpad(F.col("epoch").cast("string"), 6, "0"), F.substring("_h", 1, 3)))
    offers = _running(offers, ["_src"], "_b", [F.col("_h")], "size", "_run")
    offers = offers.withColumn("finish", F.col("_run").cast("double") / F.col("target"))
    # nearly all that is taken finishes by time 1; later buckets are wider
    late = F.floor((F.least(F.col("finish"), F.lit(1e9)) - 2) * (TIME_BUCKETS / 64)) + 2 * TIME_BUCKETS
    offers = offers.withColumn("_t", F.when(F.col("finish") <= 2, F.floor(F.col("finish") * TIME_BUCKETS)).otherwise(late)).withColumn("_all", F.lit(0))
    offers = _running(offers, ["_all"], "_t", [F.col("finish"), F.col("_src"), F.col("_h")], "size", "_total")
    taken = offers.where(F.col("_total") * budget[1] <= F.col("all_words") * budget[0]).groupBy("_key", "_copy").agg(F.sum("size").alias("taken"))
    out = sized.join(taken, ["_key", "_copy"], "left")
    return out.select("doc_id", "_key", "_copy", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken."""
    inner, col = sheltered(docs)
    three = docs.select("doc_id", "source", "text")
    times = mix(three, **options).where("taken > 0").select("_key", "_copy", (F.col("taken") / F.col("size")).cast("int").alias("_times"))
    named = inner.withColumns({"doc_id": col("doc_id"), "source": col("source"), "text": col("text")})
    rows = _numbered(named.withColumn("_key", row_key()).drop("doc_id", "text")).join(times, ["_key", "_copy"])
    return restored(rows.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs.columns, [])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS k FROM documents),
dk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source NULLS LAST) AS copy FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM dk GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS src FROM s),
w AS (SELECT *, ([5, 2, 1])[((src - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 2 AS cap FROM r),
l AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w,
    sum(source_size) OVER () * 3 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2 AS left_t
  FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
n AS (SELECT *, sum(CASE WHEN cap * 2 * left_w >= w * left_t THEN 1 ELSE 0 END) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS n_open FROM l),
f AS (SELECT left_t AS ft, left_w AS fw FROM n WHERE n_open > 0 ORDER BY cap::DOUBLE / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, src, source_size, CASE WHEN n_open = 0 THEN cap::DOUBLE ELSE (w * ft)::DOUBLE / (fw * 2)::DOUBLE END AS target FROM n LEFT JOIN f ON true),
z AS (SELECT dk.doc_id, dk.k, dk.copy, dk.size, t.src, t.source_size, t.target FROM dk JOIN t ON dk.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, md5('mix:' || epoch::VARCHAR || ':' || copy::VARCHAR || ':' || k) AS h FROM z, (VALUES (0), (1)) AS e(epoch) WHERE size > 0),
u AS (SELECT *, (sum(size) OVER (PARTITION BY src ORDER BY epoch, h ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS finish FROM o),
v AS (SELECT *, sum(size) OVER (ORDER BY finish, src, h ROWS UNBOUNDED PRECEDING) AS total FROM u),
g AS (SELECT k, copy, sum(size)::BIGINT AS taken FROM v WHERE total * 2 <= (SELECT sum(size) FROM dk) * 3 GROUP BY k, copy)
SELECT z.doc_id, z.size, z.source_size, z.target, coalesce(g.taken, 0)::BIGINT AS taken FROM z LEFT JOIN g ON z.k = g.k AND z.copy = g.copy
"""
