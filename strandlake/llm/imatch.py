"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon keeps the words whose inverse document frequency lies in a band: ln(N / df) / ln(N) between LOW and
HIGH, df counted over all documents. LEXICONS gives random sub-lexicons of several densities, to which a word
belongs by its hash; a document's distinct words of a sub-lexicon, sorted, hash to one signature. One more signature,
the first, hashes all distinct words, so that documents of few words differ too. Equal texts have equal fingerprints;
the likeness of two fingerprints is the share of equal signatures among those that either document has. Sparse
sub-lexicons still agree when half of a text was replaced, dense ones only for near copies, so the share falls off
gradually. A word's sub-lexicons follow from its hash, so words of none are left out from the start.

A document's edited text takes its tail from the next document (descending doc_id). So the texts, compressed one by
one, are sorted by ranges of doc_id; a task reads its range as a stream and cuts it into units of UNIT_BYTES. The last
document of a range meets the first of the next range in a second, small step. A unit keeps its documents' words as
numbers into its own list of words, which goes in pieces to buckets of the words' hashes; a bucket sums the counts
and answers each unit which of its words are in the band.

Defined cases: a null text is empty; a document without words has an empty fingerprint (all zero), and the likeness
of two such is 1 if their texts are equal, else 0; rows that repeat a doc_id, null ids too, follow each other by the
hash of their text, and may lie in several ranges; a null doc_id comes last; a table of one row is its own next
document; other columns are not looked at, whatever their names; an empty table gives no rows; a very long text is a
unit of its own.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.common import release_memory, text_of, written
from strandlake.llm.jaccard import _planes, _unplanes, mixed

LOW, HIGH = 0.1, 0.9
#: (rate, sub-lexicons): a word is in a sub-lexicon of that rate with the chance 1 / rate.
LEXICONS = ((8, 1), (32, 5), (128, 12), (512, 22), (2048, 23))
RATES = [rate for rate, n in LEXICONS for _ in range(n)]
#: Signatures of a fingerprint.
SIGNATURES = 1 + len(RATES)
#: Text of a unit, of a range, and of the words of a bucket, about.
UNIT_BYTES, RANGE_BYTES, BUCKET_BYTES = 6 << 20, 16 << 20, 16 << 20
#: Ranges at most: a range is a stream, so a longer one only means fewer tasks.
MOST_RANGES = 50_000
#: Rows of the store: a unit's documents, a piece of its words, the first and the last document of a range.
DOCS, WORDS, HEAD, TAIL = range(4)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STORE = "kind int, unit long, bucket int, doc long, a binary, b binary"


def memberships(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a word, sub-lexicon) of all memberships of words (hashes), by word."""
    at, of = [], []
    for j, rate in enumerate(RATES):
        mine = np.flatnonzero(mixed(words ^ np.uint64((j + 1) * int(_STEP) & (1 << 64) - 1)) % np.uint64(rate) == 0)
        at.append(mine)
        of.append(np.full(len(mine), j, np.int32))
    at_, of_ = np.concatenate(at), np.concatenate(of)
    order = np.argsort(at_, kind="stable")
    return at_[order], of_[order]


def signatures(doc: np.ndarray, words: np.ndarray, docs: int) -> np.ndarray:
    """A row a document, a column a sub-lexicon: the hash of the sorted distinct words that belong to it; 0 if none.

    doc, words: the documents' distinct words in the band, as hashes.
    """
    out = np.zeros((docs, len(RATES)), np.uint32)
    known, back = np.unique(words, return_inverse=True)
    at, of = memberships(known)
    n = np.bincount(at, minlength=len(known))
    first = np.cumsum(n) - n
    # every (document, word) as often as the word has sub-lexicons
    times = n[back]
    row = np.repeat(np.arange(len(words)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    place = doc[row].astype(np.int64) * len(RATES) + of[first[back[row]] + nth]
    order = np.lexsort((back[row], place))
    place, word = place[order], known[back[row][order]]
    if not len(place):
        return out
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.append(starts, len(place))))
    listed = np.add.reduceat(mixed(word ^ (rank.astype(np.uint64) + np.uint64(1)) * _STEP), starts)
    out.ravel()[place[starts]] = np.maximum(mixed(listed).astype(np.uint32), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Of each two rows: equal signatures among those that either has; where neither has any, whether texts are equal."""
    told = (a != 0) | (b != 0)
    n = told.sum(1)
    return np.where(n > 0, ((a == b) & told).sum(1) / np.maximum(n, 1), equal.astype(float))


def printed(row: np.ndarray) -> str:
    return row.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the next one, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


# --- order -------------------------------------------------------------------------------------------------------


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        for at in range(0, b.num_rows, 1000):
            some = b.slice(at, 1000)
            texts = some["data"].to_pylist()
            ties = [xxhash.xxh3_128_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays([some["doc"], pa.array(ties, pa.binary()), pa.array(map(pack, texts), pa.binary())], names=["doc", "tie", "data"])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "unit", "bucket", "doc", "a", "b"])


def _cut(buckets: int):
    """A range in order, as units; its last document waits for the next range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        part, no, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        blob = None

        def unit() -> Iterator[pa.RecordBatch]:
            nonlocal held, no, size
            n = len(held) - 1
            rows = _unit(part << 32 | no, [d for d, _ in held[:n]], [t for _, t in held], np.arange(n), np.arange(1, n + 1), buckets)
            held, size, no = held[n:], 0, no + 1
            yield _rows(rows)

        for b in batches:
            for doc, z in zip(b["doc"].to_pylist(), b["data"].to_pylist(), strict=True):
                if blob is None:
                    yield _rows([(HEAD, part, None, None, z, None)])
                blob = z
                held.append((doc, unpack(z)))
                size += len(held[-1][1])
                if size >= UNIT_BYTES and len(held) > 1:
                    yield from unit()
        if len(held) > 1:
            yield from unit()
        if held:
            yield _rows([(TAIL, part, None, held[0][0], blob, None)])
        held.clear()
        release_memory()

    return run


def _last(buckets: int):
    """Units of single documents with the one that follows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            docs, own, after = (b[c].to_pylist() for c in ("doc", "own", "after"))
            for at in range(0, len(docs), 100):
                n = len(docs[at : at + 100])
                texts = [unpack(z) for z in (*own[at : at + n], *after[at : at + n])]
                yield _rows(_unit(1 << 62 | part << 32 | no, docs[at : at + n], texts, np.arange(n), np.arange(n, 2 * n), buckets))
                no += 1
        release_memory()

    return run


# --- units -------------------------------------------------------------------------------------------------------


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(list, value) of all values."""
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists) if lists else np.zeros(0, np.int64)


def _whole(of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """The signature of all distinct words of each list; 0 if none."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, of, mixed(hashes))
    return np.where(np.bincount(of, minlength=n) > 0, np.maximum(mixed(out).astype(np.uint32), 1), 0).astype(np.uint32)


def _unit(unit: int, docs: list, raw: list[bytes], own: np.ndarray, after: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of the store for documents whose texts are raw[own], each followed by raw[after].

    The edited text's words are told by those of the two texts: a bit for each word of either, and the few words that
    the cuts make.
    """
    number: dict[bytes, int] = {}
    df: Counter = Counter()
    counted = set(own.tolist())

    def listed(text: bytes) -> np.ndarray:
        mine = {number.setdefault(w, len(number)) for w in text.lower().split()}
        return np.fromiter(mine, np.int64, len(mine))

    lists = []
    for i, t in enumerate(raw):
        lists.append(listed(t))
        if i in counted:
            df.update(lists[-1].tolist())
    texts = [t.decode("utf-8", "replace") for t in raw]
    changed, sha, same, again, chars = [], [], [], [], []
    for i, j in zip(own.tolist(), after.tolist(), strict=True):
        e = edited(texts[i], texts[j])
        data = e.encode("utf-8", "replace")
        changed.append(listed(data))
        sha.append(hashlib.sha256(data).digest())
        same.append(e == texts[i])
        again.append(texts[i] == texts[j])
        chars.append(len(texts[i]))
    del texts
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    count = np.fromiter((df.get(i, 0) for i in range(len(number))), np.int64, len(number))
    number.clear()
    of, word = _flat(lists)
    cof, cword = _flat(changed)
    whole, cwhole = _whole(of, hashes[word], len(lists)), _whole(cof, hashes[cword], len(changed))

    # numbers by hash, of words that are in a sub-lexicon
    known = np.unique(memberships(hashes)[0])
    known = known[np.argsort(hashes[known], kind="stable")]
    new = np.full(len(hashes), -1)
    new[known] = np.arange(len(known))
    hashes, count = hashes[known], count[known]

    def renumbered(of: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = new[word]
        of, word = of[word >= 0], word[word >= 0]
        order = np.lexsort((word, of))
        return of[order], word[order]

    (of, word), (cof, cword) = renumbered(of, word), renumbered(cof, cword)
    sizes = np.bincount(of, minlength=len(lists))
    ends = np.cumsum(sizes)
    room = max(len(known), 1)
    code = cof * room + cword

    def entries(of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, word) of the lists of one text a document."""
        n = sizes[of_doc]
        doc = np.repeat(np.arange(len(of_doc)), n)
        at = np.arange(n.sum()) + np.repeat(ends[of_doc] - n - (np.cumsum(n) - n), n)
        return doc, word[at]

    (d, w), (x, y) = entries(own), entries(after)
    in_own, in_after = d * room + w, x * room + y
    extra = code[~(np.isin(code, in_own) | np.isin(code, in_after))]
    delta = np.diff(word, prepend=0)
    starts = (ends - sizes)[sizes > 0]
    delta[starts] = word[starts]
    blob = {
        "docs": docs, "chars": chars, "sha": sha, "same": same, "again": again, "own": own, "after": after, "whole": whole, "cwhole": cwhole, "sizes": sizes, "delta": _planes(delta.astype(np.int32)),
        "in_own": np.packbits(np.isin(in_own, code)), "in_after": np.packbits(np.isin(in_after, code) & ~np.isin(in_after, in_own)), "extra": extra, "room": room,
    }
    rows = [(DOCS, unit, None, None, zstandard.compress(pickle.dumps(blob), 3), None)]
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    rows += [(WORDS, unit, b, None, _planes(hashes[s:e]), _planes(count[s:e].astype(np.int32))) for b, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s]
    return rows


def _band(least: float, most: float):
    """Which words of each unit in one bucket are in the band: the bits, and the hashes of those that are."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [_unplanes(x, np.uint64) for x in rows["a"].to_pylist()]
        counts = [_unplanes(x, np.int32) for x in rows["b"].to_pylist()]
        known, back = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(back, np.concatenate(counts), len(known))
        good = ((df >= least) & (df <= most))[back]
        edge = np.cumsum([len(k) for k in keys])[:-1]
        parts = [(np.packbits(g).tobytes(), _planes(k[g])) for k, g in zip(keys, np.split(good, edge), strict=True)]
        n = [len(k) for k in keys]
        del keys, counts, known, back, good
        release_memory()
        return pa.table({"of": rows["unit"], "bucket": rows["bucket"], "n": pa.array(n, pa.int64()), "bits": pa.array([p[0] for p in parts], pa.binary()), "keys": pa.array([p[1] for p in parts], pa.binary())})

    return run


def _printed(docs: pa.Table, band: pa.Table) -> pa.Table:
    """Fingerprints of a unit's documents."""
    out: dict[str, list] = {k: [] for k in ("doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
    pieces = sorted(band.to_pylist(), key=lambda r: r["bucket"])
    none = [np.zeros(0, bool)]
    good = np.concatenate([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in pieces] or none)
    keys = np.concatenate([_unplanes(r["keys"], np.uint64) for r in pieces] or [np.zeros(0, np.uint64)])
    place = np.cumsum(good) - 1
    for blob in docs["a"].to_pylist():
        u = pickle.loads(zstandard.decompress(blob))
        sizes, own, after, room = u["sizes"], u["own"], u["after"], u["room"]
        ends = np.cumsum(sizes)
        word = _unplanes(u["delta"], np.int32).astype(np.int64)
        # sums of differences, anew for each list
        total = np.cumsum(word)
        starts = (ends - sizes)[sizes > 0]
        word = total - np.repeat((total - word)[starts], sizes[sizes > 0]) if len(word) else word

        def entries(of_doc: np.ndarray, sizes=sizes, ends=ends, word=word) -> tuple[np.ndarray, np.ndarray]:
            n = sizes[of_doc]
            at = np.arange(n.sum()) + np.repeat(ends[of_doc] - n - (np.cumsum(n) - n), n)
            return np.repeat(np.arange(len(of_doc)), n), word[at]

        def signed(doc: np.ndarray, word: np.ndarray, whole: np.ndarray) -> np.ndarray:
            use = good[word] if len(word) else np.zeros(0, bool)
            return np.column_stack([whole, signatures(doc[use], keys[place[word[use]]], len(whole))])

        every = signed(np.repeat(np.arange(len(sizes)), sizes), word, u["whole"])
        (d, w), (x, y) = entries(own), entries(after)
        a, b = (np.unpackbits(u[k], count=len(v)).astype(bool) for k, v in (("in_own", d), ("in_after", x)))
        changed = signed(np.concatenate([d[a], x[b], u["extra"] // room]), np.concatenate([w[a], y[b], u["extra"] % room]), u["cwhole"])
        out["doc"] += u["docs"]
        out["n_chars"] += u["chars"]
        out["edited_sha256"] += [x.hex() for x in u["sha"]]
        out["fingerprint"] += map(printed, every[own])
        out["edited_fingerprint"] += map(printed, changed)
        out["near_edited"] += likeness(every[own], changed, np.array(u["same"], bool)).tolist()
        out["near_next"] += likeness(every[own], every[after], np.array(u["again"], bool)).tolist()
    release_memory()
    return pa.table({k: pa.array(v, {"doc": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}.get(k, pa.string())) for k, v in out.items()})


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", range_bytes: int = RANGE_BYTES, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row. doc: a whole number."""
    given = docs.select(F.col(doc).cast("long").alias("doc"), text_of(text).cast("binary").alias("data"))
    n, size = given.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()
    ranges = min(MOST_RANGES, 1 + size // range_bytes)
    buckets = 1 + size // BUCKET_BYTES
    # rows that are equal in all but their place may go to different ranges
    packed = given.mapInArrow(_compressed, "doc long, tie binary, data binary").withColumn("at", F.monotonically_increasing_id())
    order = [F.col("doc").desc_nulls_last(), F.col("tie"), F.col("at")]
    store = written(packed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc", "data").mapInArrow(_cut(buckets), _STORE))

    # one row a range: the next one, and the first after the last
    tails = store.where(F.col("kind") == TAIL).select(F.col("unit").alias("range"), "doc", F.col("a").alias("own"))
    heads = store.where(F.col("kind") == HEAD).select(F.col("unit").alias("next"), F.col("a").alias("after"))
    of_all = W.partitionBy(F.lit(0)).orderBy("range")
    follows = tails.select("range").withColumn("next", F.coalesce(F.lead("range").over(of_all), F.first("range").over(of_all)))
    ends = tails.join(follows, "range").join(heads, "next").select("doc", "own", "after")
    ends = written(ends.mapInArrow(_last(buckets), _STORE))
    store = store.where(F.col("kind").isin(DOCS, WORDS)).unionByName(ends)

    words = store.where(F.col("kind") == WORDS).select("unit", "bucket", "a", "b")
    band = words.groupBy("bucket").applyInArrow(_band(math.pow(n, 1 - high), math.pow(n, 1 - low)), "of long, bucket int, n long, bits binary, keys binary")
    units = store.where(F.col("kind") == DOCS).select("unit", "a")
    kind = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    done = units.groupBy("unit").cogroup(band.groupBy("of")).applyInArrow(_printed, kind)
    return done.select(F.col("doc").cast(docs.schema[doc].dataType).alias(doc), *done.columns[1:])


def op4_imatch(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
