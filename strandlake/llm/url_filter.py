"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter has one block of eight 64-bit words for each bucket of listed URLs; a key sets one bit in each
word of its block. It is an ordinary table, at most MAX_BLOCKS rows of 72 bytes, so it can be broadcast
whatever the length of the list. URLs that pass it meet the list itself in an exact hash join, which removes
the false positives.

Defined cases: a null or empty url or one without ``://`` has an empty host and path, no canonical form, and is
allowed; repeated rows are each judged, and keys that the list repeats count once; rules of equal length go by host and
path; an empty list blocks nothing; a column that has the name of a result is kept as <name>_given; an empty table
gives no rows; a very long url is read whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import ascii_lower, restored, sheltered, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: First words of host labels that put a URL on the list of the registered query.
BAD_LABELS = ("ads", "adult", "casino", "cheap", "free", "spam")
#: Blocks of the filter: 2**19 * 72 bytes, 38 MB, is all that is ever broadcast of it. A list of far more than
#: MAX_BLOCKS * KEYS_A_BLOCK keys fills it, and more rows go to the exact join; the results are the same.
MAX_BLOCKS = 1 << 19
KEYS_A_BLOCK = 32
#: A longer list is shuffled to its join instead of broadcast.
BROADCAST_KEYS = 50_000
RESULTS = ["host", "path", "rule", "verdict"]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without a leading www., path without a trailing slash, query without utm_ fields; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.concat_ws("&", F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")))
    whole = F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""),
        F.regexp_replace(path_of(url), r"/+$", ""),
        F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""),
    )
    return F.when(host_of(url) != "", whole)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its host and path joined) and its verdict; null where none fits."""
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def _bits(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    return [F.call_function("shiftleft", one, F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom_table(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocks that hold a key: _block and the words _w0 to _w7."""
    bits = _bits(F.col(key))
    return listed.groupBy(_block(F.col(key), blocks).alias("_block")).agg(*[F.bit_or(b).alias(f"_w{i}") for i, b in enumerate(bits)])


def in_list(df: DataFrame, key: str, listed: DataFrame, listed_key: str, out: str) -> DataFrame:
    """df with the boolean ``out``: whether its key is listed. A null key is not."""
    keys = written(listed.select(F.col(listed_key).alias("_listed")).where(F.col("_listed").isNotNull()).distinct())
    n = keys.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * KEYS_A_BLOCK < n:
        blocks *= 2
    bloom = F.broadcast(bloom_table(keys, "_listed", blocks))
    probe = df.withColumn("_block", _block(F.col(key), blocks)).join(bloom, "_block", "left")
    hit = F.col(key).isNotNull()
    for i, b in enumerate(_bits(F.col(key))):
        hit &= F.col(f"_w{i}").bitwiseAND(b) == b
    probe = probe.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_block", *[f"_w{i}" for i in range(8)])
    told = F.col("_listed").isNotNull()
    if n <= BROADCAST_KEYS:
        # one pass: what the filter does not pass meets no key
        met = probe.withColumn("_asked", F.when(F.col("_hit"), F.col(key))).join(F.broadcast(keys), F.col("_asked") == F.col("_listed"), "left")
        return met.withColumn(out, told).drop("_listed", "_asked", "_hit")
    # only what passes the filter is shuffled
    misses = probe.where(~F.col("_hit")).withColumn(out, F.lit(False))
    hits = probe.where("_hit").join(keys, F.col(key) == F.col("_listed"), "left").withColumn(out, told).drop("_listed")
    return misses.unionByName(hits).drop("_hit")


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict. ``listed`` has one column of canonical URLs."""
    inner, col = sheltered(pages)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = inner.withColumns({"host": host_of(col(url)), "path": path_of(col(url)), "_canonical": canonical(col(url))})
    judged = in_list(judged, "_canonical", listed, listed.columns[0], "_in")
    method = F.when(F.col("_in"), "block").otherwise("allow")
    return restored(judged.withColumns({"rule": rule, "verdict": F.coalesce(verdict, method)}), pages.columns, RESULTS)


def listed_urls(pages: DataFrame, labels: Sequence[str] = BAD_LABELS) -> DataFrame:
    """Canonical URLs of the pages whose host has a label that starts with a listed word and a hyphen."""
    bad = F.concat(F.lit("."), host_of(F.col("url"))).rlike(r"\.(" + "|".join(labels) + ")-")
    return pages.where(bad).select(canonical(F.col("url")).alias("canonical")).distinct()


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_')), '&') AS q
  FROM pages),
c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE regexp_matches('.' || host, '\.(ads|adult|casino|cheap|free|spam)-') AND canonical IS NOT NULL),
r AS (
  SELECT page_id, host, path, canonical, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
  ELSE CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict
FROM r LEFT JOIN l USING (canonical)
"""
