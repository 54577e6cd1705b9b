"""Quality rules: base counts, then the divergence of a document's histograms from its language's reference.

Two histograms describe a document: the classes of the characters in its words, and its share of each of the
language's most common words. The reference of a language holds the median share (in whole thousandths) of each
class over all its documents, so that even a large minority of junk does not move it. A document is rejected when
the Jensen-Shannon distance (base 2, 0 to 1) of a histogram from the reference exceeds the limit, provided the
document is long enough for that histogram to mean anything. A histogram of k classes from n things drawn lies about
sqrt((k - 1) / (8 n ln 2)) from where they were drawn; the limit is NOISE times that, and a shift for what texts
are about.

A document without a language, or of a language with fewer than MIN_REFERENCE long documents, is compared with the
pooled reference of all documents, with a larger shift and by characters alone.

Defined cases: null and empty texts have zero counts and fail the base rules; where no document is long enough for a
reference, the base rules judge alone; repeated rows are each judged, and no verdict depends on an order; a column
that has the name of a result is kept as <name>_given; an empty table gives no rows; a very long text is read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, in_parts, kept_names, restored, sheltered, text_of, written

# Each language's most common words.
COMMON = {
    "de": ["der", "die", "und", "den", "das", "mit", "von", "ist", "ein", "im"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "on"],
    "es": ["de", "la", "que", "el", "en", "los", "se", "del", "las", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que"],
    "it": ["di", "e", "che", "la", "il", "un", "a", "per", "in", "una"],
    "nl": ["de", "en", "van", "het", "een", "in", "is", "dat", "op", "te"],
    "pl": ["w", "i", "na", "z", "do", "nie", "jest", "to", "o", "a"],
    "pt": ["de", "a", "o", "que", "e", "do", "da", "em", "um", "para"],
    "ru": ["и", "в", "не", "на", "что", "с", "по", "как", "к", "из"],
    "sv": ["och", "i", "att", "det", "som", "en", "på", "är", "av", "för"],
}
CLASSES = ("lower", "upper", "digit", "symbol", "mark", "other")
#: Least characters (code points) in words for the character histogram, least words for the word histogram.
MIN_CHARS, MIN_WORDS = 100, 100
#: Shift of the limit of each histogram, and of the characters against the pooled reference; times the noise.
CHAR_SHIFT, WORD_SHIFT, POOLED_SHIFT, NOISE = 0.13, 0.02, 0.25, 2.0
CHAR_NOISE, WORD_NOISE = (NOISE * math.sqrt(k / (8 * math.log(2))) for k in (5, 10))
MIN_REFERENCE = 20
#: References are broadcast up to this many languages, joined by a shuffle beyond.
BROADCAST_LANGUAGES = 10_000
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _cut(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def with_characters(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds word_chars, n_symbols and the counts _c_<class>: each class is cut from what the one before left."""
    df = df.withColumn("_r0", _cut(text_of(text), r"[\x20\x09-\x0D]+"))
    for i, pattern in enumerate(("[a-z]+", "[A-Z]+", "[0-9]+", r"[#*$%&|<>]+", r"[\x00-\x7F]+")):
        df = df.withColumn(f"_r{i + 1}", _cut(F.col(f"_r{i}"), pattern))
    lengths = [F.length(f"_r{i}").cast("bigint") for i in range(6)]
    df = df.withColumns({"word_chars": lengths[0]} | {f"_c_{c}": (lengths[i] - lengths[i + 1]) if i < 5 else lengths[5] for i, c in enumerate(CLASSES)})
    return df.withColumn("n_symbols", F.col("_c_symbol")).drop(*[f"_r{i}" for i in range(6)])


def with_common(df: DataFrame, words: str = "_words", lang: str = "lang") -> DataFrame:
    """Adds _common: how often each of the language's common words occurs; null for other languages."""
    every = sorted({w for ws in COMMON.values() for w in ws})
    few = F.filter(F.col(words), lambda w: F.lower(w).isin(*every))
    df = df.withColumn("_few", F.when(F.col(lang).isin(*COMMON), F.transform(few, F.lower)))
    listed = None
    for k, ws in COMMON.items():
        a = F.array(*[F.lit(w) for w in ws])
        listed = F.when(F.col(lang) == k, a) if listed is None else listed.when(F.col(lang) == k, a)
    df = df.withColumn("_listed", listed)
    counts = [F.size("_few") - F.size(F.array_remove("_few", F.element_at("_listed", i + 1))) for i in range(10)]
    return df.withColumn("_common", F.when(F.col("_few").isNotNull(), F.array(*counts))).drop("_few", "_listed")


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    df = df.withColumn("_words", F.regexp_extract_all(text_of(text), F.lit(f"({WORD})")))
    return df.withColumn("n_words", F.size("_words").cast("bigint"))


def with_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_dup_lines and n_repeat_words. Everything stays inside the row; sorting finds what occurs twice."""
    lines = F.filter(F.split(text_of(text), "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumn("_lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
    at = F.when(F.col("n_words") >= 5, F.sequence(F.lit(1), F.col("n_words").cast("int") - 4)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_at", at)
    w = F.col("_words")
    df = df.withColumn("_grams", F.transform("_at", lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(5)])))
    # most texts repeat nothing, and end here
    df = df.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    pairs = F.array_sort(F.arrays_zip(F.col("_grams").alias("h"), F.col("_at").alias("i")))
    df = df.withColumn("_sorted", F.when(F.col("_again"), pairs))
    df = df.withColumn("_hash", F.transform("_sorted", lambda x: x["h"]))
    n = F.size("_hash")
    none = F.array(F.lit(None).cast("bigint"))
    df = df.withColumn("_near", F.arrays_zip(
        F.transform("_sorted", lambda x: x["i"]).alias("i"), F.col("_hash").alias("h"),
        F.concat(none, F.slice("_hash", 1, F.greatest(n - 1, F.lit(0)))).alias("a"), F.concat(F.slice("_hash", 2, F.greatest(n - 1, F.lit(0))), none).alias("b")))
    twice = F.filter("_near", lambda x: F.coalesce(x["h"] == x["a"], F.lit(False)) | F.coalesce(x["h"] == x["b"], F.lit(False)))
    df = df.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"])))
    # a window covers five words, or those up to the next window
    m = F.size("_starts")
    df = df.withColumn("_next", F.concat(F.slice("_starts", 2, F.greatest(m - 1, F.lit(0))), F.array(F.lit(2_000_000_000))))
    covered = F.aggregate(F.zip_with("_starts", "_next", lambda a, b: F.least(b - a, F.lit(5))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("bigint"))
    return df.drop("_lines", "_at", "_grams", "_again", "_sorted", "_hash", "_near", "_starts", "_next")


def _shares(counts: list[Column], total: Column) -> Column:
    return F.array(*[c.cast("double") / total for c in counts])


def _histograms(df: DataFrame) -> DataFrame:
    """Adds _ph (shares of the classes) and _pw (shares of the common words and the rest)."""
    long_enough = F.col("word_chars") >= MIN_CHARS
    df = df.withColumn("_ph", F.when(long_enough, _shares([F.col(f"_c_{c}") for c in CLASSES], F.col("word_chars"))))
    total = F.col("n_words").cast("double")
    seen = [F.col("_common")[i].cast("double") / total for i in range(10)]
    rest = (total - sum(F.col("_common")[i] for i in range(10))) / total
    return df.withColumn("_pw", F.when((F.col("n_words") >= MIN_WORDS) & F.col("_common").isNotNull(), F.array(*seen, rest)))


def references(df: DataFrame) -> DataFrame:
    """(_of, _qh, _qw): median shares by language, scaled to a sum of 1; the row without a language is the pooled one.

    df: features, with _lang.
    """
    def medians(col: str, n: int) -> list[Column]:
        return [F.coalesce(F.percentile(F.round(F.col(col)[i] * 1000, 0), F.lit(0.5)), F.lit(0.0)).alias(f"{col}{i}") for i in range(n)]

    long_ = df.where(F.col("_ph").isNotNull())
    own = long_.where(F.col("_lang").isNotNull()).groupBy("_lang").agg(F.count("*").alias("_docs"), *medians("_ph", 6), *medians("_pw", 10)).where(F.col("_docs") >= MIN_REFERENCE)
    pooled = long_.agg(F.count("*").alias("_docs"), *medians("_ph", 6)).where("_docs > 0").withColumns({"_lang": F.lit(None).cast("string")} | {f"_pw{i}": F.lit(None).cast("double") for i in range(10)})

    def scaled(col: str, n: int, rest: bool) -> Column:
        parts = [F.col(f"{col}{i}") for i in range(n)]
        if rest:
            return F.when(parts[0].isNotNull(), F.array(*[p / 1000 for p in parts], F.lit(1.0) - sum(parts) / 1000))
        total = sum(parts)
        return F.when(total > 0, F.array(*[p / total for p in parts]))

    return own.unionByName(pooled).select(F.col("_lang").alias("_of"), scaled("_ph", 6, False).alias("_qh"), scaled("_pw", 10, True).alias("_qw"))


def js_distance(p: str, q: str, n: int) -> Column:
    total = F.lit(0.0)
    for i in range(n):
        a, b = F.col(p)[i], F.col(q)[i]
        m = (a + b) / 2
        total = total + F.when(a > 0, a * F.log2(a / m)).otherwise(0.0) / 2 + F.when(b > 0, b * F.log2(b / m)).otherwise(0.0) / 2
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with RESULTS: the base counts, base_failed, the distances (null where not judged) and kept.

    drop: columns of docs, such as the text, that the result need not carry. A column of docs that has the name of
    a result becomes <name>_given.
    """
    inner, col = sheltered(docs)
    gone = [f"_in{i}" for i, c in enumerate(docs.columns) if c.lower() in {d.lower() for d in drop}]
    # one pass over the texts; the references and the verdicts come from the features it leaves
    full = inner.withColumns({"_text": col("text"), "_lang": col("lang")})
    full = with_repeats(with_common(with_characters(with_words(full, "_text"), "_text"), lang="_lang"), "_text")
    full = written(_histograms(full.drop("_words", "_text", *gone)))
    # a reference is made of MIN_REFERENCE texts at least
    found = written(in_parts(references(full), full.count() // MIN_REFERENCE))
    n = found.count()
    pooled = found.where("_of is null").select(F.col("_qh").alias("_pooled"))  # one row at most
    own = found.where("_of is not null")
    full = full.join(F.broadcast(own) if n <= BROADCAST_LANGUAGES else own, F.col("_lang") == F.col("_of"), "left").join(F.broadcast(pooled), F.lit(True), "left")
    full = full.withColumn("_far", F.col("_of").isNull()).withColumn("_qh", F.when(F.col("_far"), F.col("_pooled")).otherwise(F.col("_qh")))
    full = full.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "char_distance": F.when(F.col("_ph").isNotNull() & F.col("_qh").isNotNull(), js_distance("_ph", "_qh", 6)),
        "word_distance": F.when(F.col("_pw").isNotNull() & F.col("_qw").isNotNull(), js_distance("_pw", "_qw", 11)),
    })

    def near(distance: str, n: str, shift: Column, noise: float) -> Column:
        return F.coalesce(F.col(distance) <= shift + noise / F.sqrt(F.col(n).cast("double")), F.lit(True))

    char_shift = F.when(F.col("_far"), POOLED_SHIFT).otherwise(CHAR_SHIFT)
    kept = ~F.col("base_failed") & near("char_distance", "word_chars", char_shift, CHAR_NOISE) & near("word_distance", "n_words", F.lit(WORD_SHIFT), WORD_NOISE)
    return restored(full.withColumn("kept", kept), docs.columns, RESULTS, drop)


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep."""
    full = judge(docs).where("kept")
    return full.select(*[F.col(n).alias(c) for n, c in zip(kept_names(docs.columns, RESULTS), docs.columns, strict=True)])


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(docs, drop=("text",)).select("doc_id", *BASE, "base_failed", "kept")


def _oracle() -> str:
    listed = "CASE lang " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(w) for w in ws)}]" for k, ws in COMMON.items()) + " END"
    cs = [f"c{i}" for i in range(6)]
    med = lambda e, n: ", ".join(f"coalesce(quantile_cont(round({e.format(i)} * 1000), 0.5), 0.0) AS m{i}{n}" for i in range({"h": 6, "w": 10}[n]))
    js = lambda n, k: " + ".join(f"CASE WHEN p{k}{i} > 0 THEN p{k}{i} * log2(p{k}{i} / ((p{k}{i} + q{k}{i}) / 2)) ELSE 0.0 END / 2 + CASE WHEN q{k}{i} > 0 THEN q{k}{i} * log2(q{k}{i} / ((p{k}{i} + q{k}{i}) / 2)) ELSE 0.0 END / 2" for i in range(n))
    total_h, total_w = " + ".join(f"m{i}h" for i in range(6)), " + ".join(f"m{i}w" for i in range(10))
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS r0, {listed} AS common FROM d),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL),
s AS (SELECT rid, i, least(coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5), 5) AS cover FROM t WHERE n > 1),
rep AS (SELECT rid, sum(cover)::BIGINT AS n_repeat_words FROM s GROUP BY rid),
c AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(r0)::BIGINT AS word_chars, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(r0, '[^a-z]', '', 'g')) AS c0, length(regexp_replace(r0, '[^A-Z]', '', 'g')) AS c1, length(regexp_replace(r0, '[^0-9]', '', 'g')) AS c2,
  length(regexp_replace(r0, '[^#*$%&|<>]', '', 'g')) AS c3, length(regexp_replace(r0, '[a-zA-Z0-9#*$%&|<>]|[^\x00-\x7F]', '', 'g')) AS c4, length(regexp_replace(r0, '[\x00-\x7F]', '', 'g')) AS c5,
  {", ".join(f"len(list_filter(ws, lambda x: lower(x) = common[{i + 1}])) AS k{i}" for i in range(10))}
  FROM w LEFT JOIN rep USING (rid)),
p AS (SELECT *, {", ".join(f"CASE WHEN word_chars >= {MIN_CHARS} THEN {x}::DOUBLE / word_chars END AS ph{i}" for i, x in enumerate(cs))},
  {", ".join(f"CASE WHEN n_words >= {MIN_WORDS} AND common IS NOT NULL THEN k{i}::DOUBLE / n_words END AS pw{i}" for i in range(10))},
  CASE WHEN n_words >= {MIN_WORDS} AND common IS NOT NULL THEN (n_words - {" - ".join(f"k{i}" for i in range(10))})::DOUBLE / n_words END AS pw10 FROM c),
m AS (SELECT lang, {med("ph{}", "h")}, {med("pw{}", "w")} FROM p WHERE lang IS NOT NULL AND ph0 IS NOT NULL GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}),
om AS (SELECT {med("ph{}", "h")} FROM p WHERE ph0 IS NOT NULL HAVING count(*) > 0),
o AS (SELECT {", ".join(f"m{i}h / nullif({total_h}, 0) AS oh{i}" for i in range(6))} FROM om),
q AS (SELECT lang AS of_lang, {", ".join(f"m{i}h / nullif({total_h}, 0) AS qh{i}" for i in range(6))}, {", ".join(f"m{i}w / 1000 AS qw{i}" for i in range(10))}, 1.0 - ({total_w}) / 1000 AS qw10 FROM m),
pq AS (SELECT p.*, of_lang IS NULL AS far, {", ".join(f"CASE WHEN of_lang IS NULL THEN oh{i} ELSE qh{i} END AS qh{i}" for i in range(6))}, {", ".join(f"qw{i}" for i in range(11))} FROM p LEFT JOIN q ON q.of_lang = p.lang LEFT JOIN o ON true),
j AS (SELECT *, CASE WHEN ph0 IS NOT NULL AND qh0 IS NOT NULL THEN sqrt(greatest({js(6, "h")}, 0.0)) END AS dh, CASE WHEN pw0 IS NOT NULL AND qw0 IS NOT NULL THEN sqrt(greatest({js(11, "w")}, 0.0)) END AS dw FROM pq),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, c3::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(dh <= CASE WHEN far THEN {POOLED_SHIFT} ELSE {CHAR_SHIFT} END + {CHAR_NOISE} / sqrt(word_chars), true) AND coalesce(dw <= {WORD_SHIFT} + {WORD_NOISE} / sqrt(n_words), true) AS kept
FROM b
"""


ORACLE = _oracle()
