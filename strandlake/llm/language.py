"""Language identification: code lengths under one frozen byte-context model (PPM) for each language.

The model of a language is fitted on a bounded sample of its labelled documents: of the distinct texts the
SAMPLE_DOCS with the smallest hashes, each up to SAMPLE_CHARS code points; where there are very many languages, fewer
of each, so that the whole sample keeps to SAMPLE_TOTAL. A document is given to the language whose model codes it in
the fewest bits; the score is that language's share of the probability, all languages being equally likely beforehand.

Defined cases: null and empty texts and texts without a letter are ``und`` with score 0, as is everything when no
language has a sample; ties go to the first language by code point; documents without a language are never learned
from; repeated rows are each judged, and copies are learned from once; a column that has the name of a result is kept
as <name>_given; an empty table gives no rows; a very long text is judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm import ppm
from strandlake.llm.common import restored, sheltered

ORDER = 3
#: The sample's bounds: documents a language, code points a document, code points in all (one document a language at least).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 300, 10_000, 100_000_000
BROADCAST_HASHES = 1_000_000
#: Bytes of text that are scored together.
BATCH_BYTES = 2_000_000
_LETTER = regex.compile(r"\p{L}")


def remainder(col: str, n: int) -> Column:
    """crc32(doc_id as text) mod n; of the empty text where doc_id is null."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def sample(docs: DataFrame, learn: Column) -> DataFrame:
    """(lang, text): the bounded sample of the documents to learn from.

    Hashes are chosen first, without the texts; the rank is cut on the map side, so that no task sorts a language.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("_h"))
    known = rows.select("lang", "_h").distinct()
    langs = rows.agg(F.countDistinct("lang")).first()[0]
    most = max(1, min(SAMPLE_DOCS, SAMPLE_TOTAL // (SAMPLE_CHARS * max(1, langs))))
    least = known.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("_h"))).where(F.col("_n") <= most).drop("_n")
    least = F.broadcast(least) if langs * most <= BROADCAST_HASHES else least
    return rows.join(least, ["lang", "_h"], "left_semi").groupBy("lang", "_h").agg(F.min(F.substring("text", 1, SAMPLE_CHARS)).alias("text")).select("lang", "text")


def fit(rows: list[tuple[str, str]]) -> dict[str, list[ppm.Level]]:
    """A frozen model for each language."""
    by: dict[str, list[bytes]] = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(_folded(text))
    out = {}
    for lang in sorted(by):
        g, _ = ppm.grams(sorted(by[lang]), ORDER)
        keys, counts = np.unique(g, return_counts=True)
        out[lang] = ppm.levels(keys, counts, ORDER)
    return out


def judge(model: dict[str, list[ppm.Level]], texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text."""
    langs = list(model)
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    todo = [i for i, t in enumerate(texts) if langs and t and _LETTER.search(t)]
    at = 0
    while at < len(todo):
        part, size = [], 0
        while at < len(todo) and (not part or size < BATCH_BYTES):
            part.append(todo[at])
            size += len(texts[todo[at]])
            at += 1
        g, starts = ppm.grams([_folded(texts[i]) for i in part], ORDER)
        code, uniq = ppm.distinct(g)
        cost = np.stack([np.add.reduceat(ppm.bits(model[k], uniq)[code], starts) for k in langs])
        best = cost.argmin(0)
        score = 1 / np.exp2(np.maximum(cost.min(0) - cost, -1000.0)).sum(0)
        for j, i in enumerate(part):
            out[i] = langs[best[j]], float(score[j])
    return out


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """docs with lang_pred and score. learn: which rows the models may be fitted on."""
    spark = docs.sparkSession
    rows = [(r["lang"], r["text"]) for r in sample(docs, learn).collect()]  # bounded, see above
    model = spark.sparkContext.broadcast(fit(rows))

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = judge(model.value, [t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    inner, col = sheltered(docs)
    return restored(inner.withColumn("_l", run(col("text"))).select(*inner.columns, "_l.*"), docs.columns, ["lang_pred", "score"])


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = remainder("doc_id", 5) == 0
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")
