"""Language-model scores by prediction by partial matching, beside a base score from token counts.

The model is a byte-context trie of ORDER symbols over all texts learned from (A-Z lower-cased, UTF-8), with
escapes and symbol exclusion as in ``ppm``; each document gets the log10 probability that the frozen model gives
to its whole text, its end included.

No table of the corpus reaches one task or the driver. Texts are packed into chunks of about CHUNK_BYTES, each
with the distinct words and grams it holds and their counts. Counts are summed by key across chunks; grams are
resolved to code lengths in buckets of their last two context symbols, whose longer contexts all lie in the same
bucket (only the two shortest levels, at most 258 * 257 counts, are shared); and each chunk gets back the values
of its own keys, then scores its documents.

Words travel as 62 bits of their hash: two of a billion distinct words share one with a chance of about a tenth.

Defined cases: null and empty texts have one token, the end, and one symbol; without any text to learn from every
symbol costs 257 evenly likely ones; repeated rows are learned from and scored each, and no score depends on an order;
other columns are not looked at, whatever their names; an empty table gives no rows; a very long text is scored whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm import ppm
from strandlake.llm.common import chunk_count, release_memory, text_of, written
from strandlake.llm.language import remainder

ORDER = 4
#: Levels whose counts all tasks share: contexts of 0 and of 1 symbol.
SHARED = 2
CHUNK_BYTES = 16 << 20
#: Text whose grams, or words, are held as objects at once.
BATCH_BYTES = 256 << 10
#: Text whose grams make a bucket, about, and the buckets at most: as many as there are pairs of context symbols.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 2 << 20, 64, 257 * 257
WORD_BIT = 1 << 62
DOCS = -1
_PACKED = "chunk long, key long, n long, blob binary"
_SCORED = "doc string, n_tokens long, n_known long, known_log double, score double, chunk_words long, chunk_docs long, chunk_kinds long, is_doc boolean"


def _batches(table: pa.Table) -> Iterator[tuple[list[bytes], list[bool], list[str]]]:
    """Lower-cased texts, whether they are learned from, and ids, of rows that make BATCH_BYTES, one row at least."""
    ends = np.cumsum(pc.binary_length(table["data"]).to_numpy())
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
        part = table.slice(at, end - at)
        yield [t.lower() for t in part["data"].to_pylist()], part["learn"].to_pylist(), part["doc"].to_pylist()
        at = end


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 2 | WORD_BIT


def _words(table: pa.Table) -> Counter:
    """How often each word of the chunk occurs in the texts to learn from."""
    found: Counter = Counter()
    for texts, learn, _ in _batches(table):
        for t, use in zip(texts, learn, strict=True):
            if use:
                found.update(t.split())
            else:
                for w in t.split():
                    found.setdefault(w, 0)
    return found


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    del order
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _chunk_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a chunk, grams and words, with their counts in the texts to learn from."""
    words = _words(table)
    done = _summed(np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
    del words
    parts, size = [], 0
    for texts, learn, _ in _batches(table):
        g, starts = ppm.grams(texts, ORDER)
        code, u = ppm.distinct(g)
        use = np.repeat(np.array(learn, np.int64), np.diff(np.append(starts, len(g))))
        parts.append((u, np.bincount(code, use, len(u)).astype(np.int64)))
        size += len(u)
        # what is held besides the sums is never more than they are
        if size > max(len(done[0]), BATCH_BYTES):
            done = _summed(*[np.concatenate(x) for x in zip(done, *parts, strict=True)])
            parts, size = [], 0
    return _summed(*[np.concatenate(x) for x in zip(done, *parts, strict=True)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size, no, part = 0, 0, TaskContext.get().partitionId()

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size, no
        table = pa.Table.from_batches(held).combine_chunks()
        chunk = part << 32 | no
        no, size = no + 1, 0
        held.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield _rows([chunk], [DOCS], [0], [sink.getvalue().to_pybytes()])
        del sink
        keys, counts = _chunk_keys(table)
        del table
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield _rows(np.full(len(k), chunk, np.int64), k, counts[at : at + 100_000], pa.nulls(len(k), pa.binary()))

    for b in batches:
        # a batch may hold far more than a chunk
        for at in range(0, b.num_rows, 1000):
            piece = b.slice(at, 1000)
            held.append(piece)
            size += piece["data"].nbytes
            if size >= CHUNK_BYTES:
                yield from flush()
    if held:
        yield from flush()
    release_memory()


def _rows(chunk, key, n, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int64()), pa.array(blob, pa.binary()) if isinstance(blob, list) else blob], names=["chunk", "key", "n", "blob"])


def _resolver(low: list[tuple[np.ndarray, np.ndarray]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = pdf["key"].to_numpy(), pdf["n"].to_numpy()
        table: list[ppm.Level] = []
        for k, c in low:
            table.append(ppm.Level(k, c, len(table) + 1, table[-1] if table else None))
        seen = counts > 0
        for k in range(SHARED, ORDER + 1):
            table.append(ppm.Level(*_summed(keys[seen] & ppm.mask(k + 1), counts[seen]), k + 1, table[-1]))
        out = pd.DataFrame({"key": keys, "value": ppm.bits(table, keys)})
        del table
        release_memory()
        return out

    return run


def _scored(docs: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of a chunk, and one row without a document that sums up the chunk."""
    out: list[tuple] = []
    key, value = values["key"].to_numpy(), values["value"].to_numpy()
    order = np.argsort(key)
    key, value = key[order], value[order]
    at = int(np.searchsorted(key, WORD_BIT))
    kinds = int((values["first"].to_numpy()[order[at:]] * (value[at:] > 0)).sum())
    (grams, bits), (known, totals) = (key[:at], value[:at]), (key[at:], value[at:])
    del order, values
    for blob in docs["blob"]:
        table = pa.ipc.open_stream(blob.as_buffer()).read_all()
        local = _words(table)
        trained = sum(local.values())
        found, there = ppm.find(known, np.fromiter(map(word_key, local), np.int64, len(local)))
        kinds += sum(n > 0 and not t for n, t in zip(local.values(), there, strict=True))
        logs = local  # 0 only for words that were not learned
        for w, i, t in zip(list(local), found, there, strict=True):
            logs[w] = math.log10((totals[i] if t else local[w]) + 1)
        for texts, _, ids in _batches(table):
            g, starts = ppm.grams(texts, ORDER)
            code, u = ppm.distinct(g)
            score = (np.add.reduceat(bits[np.searchsorted(grams, u)][code], starts) * -math.log10(2)).tolist()
            for i, t, x in zip(ids, texts, score, strict=True):
                each = [logs[w] for w in t.split()]
                out.append((i, len(each) + 1, len(each) - each.count(0.0), math.fsum(each), x, None, None, None, True))
        out.append((None, None, None, None, None, trained, pc.sum(table["learn"]).as_py(), kinds, False))
        kinds = 0
        del logs, local, table
    del key, value, grams, bits, known, totals
    release_memory()
    names = ["doc", "n_tokens", "n_known", "known_log", "score", "chunk_words", "chunk_docs", "chunk_kinds", "is_doc"]
    kind = dict(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()], strict=True))
    return pa.table({n: pa.array([r[i] for r in out], kind[n]) for i, n in enumerate(names)})


def score(docs: DataFrame, learn: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    given = docs.select(F.col(doc).cast("string").alias("doc"), text_of(text).cast("binary").alias("data"), F.coalesce(learn, F.lit(False)).alias("learn"))
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, chunk_count(given, "data", BUCKET_BYTES)))
    store = written(given.mapInArrow(_packed, _PACKED))
    keys = store.where(F.col("key") >= 0).select("chunk", "key", "n")

    # words: the chunk knows its own count already, so only other totals go back; one shuffle serves both sums
    by = W.partitionBy("key").orderBy(F.col("n").desc(), "chunk")
    words = keys.where(F.col("key") >= WORD_BIT)
    words = words.withColumns({"total": F.sum("n").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "first": (F.row_number().over(by) == 1).cast("long")})
    words = words.where("total != n").select("chunk", "key", F.col("total").cast("double").alias("value"), "first")

    grams = keys.where(F.col("key") < WORD_BIT)
    low = []
    for k in range(SHARED):  # at most 257 and 258 * 257 rows
        rows = grams.where("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(ppm.mask(k + 1))).alias("key")).agg(F.sum("n").alias("n")).toPandas().sort_values("key")
        low.append((rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)))
    context = F.shiftright("key", ppm.BITS).bitwiseAND(F.lit(ppm.mask(SHARED)))
    totals = grams.groupBy("key").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(context), F.lit(buckets)))
    resolved = totals.groupBy("bucket").applyInPandas(_resolver(low), "key long, value double")
    back = words.unionByName(grams.select("chunk", "key").join(resolved, "key").select("chunk", "key", "value", F.lit(0).cast("long").alias("first")))

    texts = store.where(F.col("key") == DOCS).select(F.col("chunk").alias("of"), "blob")
    out = written(texts.groupBy("of").cogroup(back.groupBy("chunk")).applyInArrow(_scored, _SCORED))
    n, d, v = out.agg(*[F.coalesce(F.sum(f"chunk_{x}"), F.lit(0)) for x in ("words", "docs", "kinds")]).first()
    n, v = n + d, v + (d > 0)
    base = F.col("known_log") + math.log10(d + 1) - F.col("n_tokens") * math.log10(n + v + 1)
    return out.where("is_doc").select(
        F.col("doc").cast(docs.schema[doc].dataType).alias(doc), "n_tokens", (F.col("n_known") + int(d > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = remainder("doc_id", 7) == 2
    return score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
