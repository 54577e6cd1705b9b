"""N-gram Jaccard join by a token-group matrix: which documents share so many word shingles that they are near copies.

Every document is the set of its distinct 5-word shingles (tokens). Documents with equal sets are one from the
start. Links between different sets are found without a pair of documents ever being formed from a frequent token:

* Tokens are dealt to buckets. Up to MOST sets that share a token are paired there, and the pairs' counts are
  summed over the buckets: for sets that share no frequent token this is the size of the intersection itself.
* A frequent token (of more than MOST sets) makes no pairs. A pair is undecided if its count may still reach the
  threshold with the frequent tokens of the smaller set; only then are the two sets' frequent tokens intersected.
* What remains are sets made almost wholly of frequent tokens, which may share no rare one: large families of near
  copies. They are partitioned into groups of similar sets: sets with the same least hash are compared with one of
  them, and those linked to it form a family, dealt to groups of at most GROUP sets. Each group stores its token
  union. A set's overlap with a foreign group's union bounds its overlap with every member; only groups whose bound
  reaches the threshold are opened, and their members compared.

All steps are exact, given that different shingles of compared documents have different 64-bit hashes.

Links are 100 * intersection >= threshold * union. Defined cases: a text of fewer than five words is one shingle,
the whole sequence; a null text or one without words is the empty set, linked with nothing, its own component;
repeated rows and equal texts share a component; a row without a doc is linked as any other, and a component takes the
smallest doc of those that have one; other columns are kept as they are, whatever their names; an empty table gives no
rows; a very long text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, chunk_count, in_parts, release_memory, restored, sheltered, text_of, written
from strandlake.llm.components import components

WORDS, PERCENT = 5, 75
#: Sets that share a token and are still paired for it.
MOST = 32
#: Documents that are there several times are broadcast up to this many.
BROADCAST_KEYS = 100_000
#: Sets of a group of the matrix.
GROUP = 256
#: Text that is cut into sets at a time.
PIECE_BYTES = 4 << 20
#: Text a bucket's tokens come from, about.
BUCKET_BYTES = 12 << 20
#: Frequent tokens of a bucket of the matrix: the fewer buckets, the more sets fail in one alone.
MATRIX_TOKENS = 3_000_000
#: Pairs of sets, or sets with their tokens, of a task and its file.
PART_ROWS = 2000
#: Independent least hashes by which sets look for their family.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8, any case)."""
    number: dict[bytes, int] = {}
    flat: list[int] = []
    ends = []
    for t in texts:
        flat.extend(number.setdefault(w, len(number)) for w in t.lower().split())
        ends.append(len(flat))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
    h = hashes[np.array(flat, np.int64)] if flat else np.zeros(0, np.uint64)
    out, start = [], 0
    n = max(0, len(h) - words + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(words):
        grams += mixed(h[k : k + n] + _PLACES[k % 5] * np.uint64(k // 5 + 1))
    grams = mixed(grams)
    for end in ends:
        size = end - start
        if size >= words:
            out.append(np.unique(grams[start : end - words + 1]))
        elif size:
            whole = mixed(sum((mixed(h[start + k : start + k + 1] + _PLACES[k % 5]) for k in range(size)), np.zeros(1, np.uint64)) + np.uint64(size))
            out.append(whole)
        else:
            out.append(grams[:0])
        start = end
    return out


def set_id(tokens: np.ndarray) -> int:
    """A signed 64-bit fingerprint of a set; 0 only for the empty set."""
    return (xxhash.xxh3_64_intdigest(tokens.tobytes()) or 1) - (1 << 63) or 1 if len(tokens) else 0


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes, compressed: of sorted ones the high bytes take next to no room."""
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), 1)


def _unplanes(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


# --- sets and tokens ---------------------------------------------------------------------------------------------

_MEMBERS = "doc string, tie string, sid long, n long"
_DEALT = "bucket int, tokens binary, place binary, sids binary, sizes binary"


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Batches of about so many bytes of text."""
    held, size = [], 0
    for b in batches:
        for at in range(0, b.num_rows, 500):
            held.append(b.slice(at, 500))
            size += held[-1]["data"].nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _member_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, PIECE_BYTES):
            sets = shingle_sets(table["data"].to_pylist(), words)
            yield pa.RecordBatch.from_arrays([table["doc"].combine_chunks(), table["tie"].combine_chunks(), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc", "tie", "sid", "n"])
        release_memory()

    return run


def _dealer(words: int, buckets: int):
    """Each piece's distinct sets, their tokens dealt to buckets: sorted tokens, and whose they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _pieces(batches, PIECE_BYTES):
            sets = {set_id(s): s for s in shingle_sets(table["data"].to_pylist(), words) if len(s)}
            if not sets:
                continue
            sids, sizes = np.array(list(sets), np.int64), np.array([len(s) for s in sets.values()], np.int64)
            tokens = np.concatenate(list(sets.values()))
            place = np.repeat(np.arange(len(sids), dtype=np.int32), sizes)
            sets.clear()
            bucket = (tokens % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((tokens, bucket))
            tokens, place, bucket = tokens[order], place[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                t, p = tokens[edge[b] : edge[b + 1]], place[edge[b] : edge[b + 1]]
                if len(t):
                    u, p = np.unique(p, return_inverse=True)
                    row = [b, _planes(t), _planes(p.astype(np.int32)), _planes(sids[u]), _planes(sizes[u].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "tokens", "place", "sids", "sizes"])
        release_memory()

    return run


# --- buckets -----------------------------------------------------------------------------------------------------

#: What a bucket finds, packed, for one part of the sets or pairs: the sets and their sizes, and a line a pair (first,
#: second and how much they share) or a line a frequent token (whose, and the token).
_FOUND = "pairs boolean, part int, lines long, sids binary, sizes binary, first binary, second binary, value binary"
_KINDS = (pa.bool_(), pa.int32(), pa.int64(), *[pa.binary()] * 5)


def _part_of(x: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(x.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _found(pairs: bool, part: np.ndarray, ids: np.ndarray, size: np.ndarray, first: np.ndarray, second: np.ndarray | None, value: np.ndarray) -> list[tuple]:
    """A row for each part; first and second are places in ids."""
    order = np.argsort(part, kind="stable")
    starts = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else []
    out = []
    for mine in np.split(order, starts[1:]) if len(part) else []:
        both = first[mine] if second is None else np.concatenate([first[mine], second[mine]])
        u, at = np.unique(both, return_inverse=True)
        at = at.astype(np.int32)
        n = len(mine)
        out.append((pairs, int(part[mine[0]]), n, _planes(ids[u]), _planes(size[u].astype(np.int32)), _planes(at[:n]), b"" if second is None else _planes(at[n:]), _planes(value[mine])))
    return out


def _bucket(percent: int, most: int, parts: int):
    def run(rows: pa.Table) -> pa.Table:
        # sets are numbered over the whole bucket, so that a token carries four bytes of whose it is
        met = [_unplanes(x, np.int64) for x in rows["sids"].to_pylist()]
        ids, first, number = np.unique(np.concatenate(met), return_index=True, return_inverse=True)
        size = np.concatenate([_unplanes(x, np.int32) for x in rows["sizes"].to_pylist()])[first].astype(np.int64)
        number = np.split(number.astype(np.int32), np.cumsum([len(x) for x in met])[:-1])
        token = np.concatenate([_unplanes(x.as_py(), np.uint64) for x in rows["tokens"]])
        at = np.concatenate([own[_unplanes(x.as_py(), np.int32)] for own, x in zip(number, rows["place"], strict=True)])
        del met, number, rows
        order = np.argsort(token, kind="stable")
        token = token[order]
        # tokens of one set end here
        same = np.zeros(len(token) + 1, bool)
        same[1:-1] = token[1:] == token[:-1]
        keep = np.flatnonzero(same[1:] | same[:-1])
        token, at = token[keep], at[order[keep]]
        del same, keep, order
        # a set met in several pieces counts once
        order = np.lexsort((at, token))
        token, at = token[order], at[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (at[1:] != at[:-1])
        token, at = token[new], at[new]
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        count = np.diff(np.append(starts, len(token)))
        many = np.repeat(count > most, count)
        out = _found(False, _part_of(ids[at[many]], parts), ids, size, at[many], None, token[many])
        token, at = token[~many], at[~many]
        codes = []
        for d in range(1, most):
            hit = np.flatnonzero(token[d:] == token[:-d]) if d < len(token) else token[:0]
            if not len(hit):
                break
            a, b = at[hit].astype(np.int64), at[hit + d].astype(np.int64)
            na, nb = size[a], size[b]
            # with these sizes alone, too few can be shared
            near = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            codes.append(np.unique(a[near] * len(ids) + b[near], return_counts=True))
        if codes:
            code, back = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
            shared = np.bincount(back, np.concatenate([n for _, n in codes]), len(code)).astype(np.int32)
            a, b = code // len(ids), code % len(ids)
            out += _found(True, _part_of(ids[a] * 3 + ids[b], parts), ids, size, a, b, shared)
        del token, at, codes
        release_memory()
        return pa.table({name: pa.array([r[i] for r in out], k) for i, (name, k) in enumerate(zip(("pairs", "part", "lines", "sids", "sizes", "first", "second", "value"), _KINDS, strict=True))})

    return run


def _summed_pairs(rows: pa.Table) -> pa.Table:
    """The pairs of one part over all buckets: (a, b, na, nb, shared)."""
    parts = []
    for r in rows.to_pylist():
        sids, sizes = _unplanes(r["sids"], np.int64), _unplanes(r["sizes"], np.int32)
        a, b = _unplanes(r["first"], np.int32), _unplanes(r["second"], np.int32)
        parts.append((sids[a], sids[b], sizes[a], sizes[b], _unplanes(r["value"], np.int32)))
    a, b, na, nb, shared = (np.concatenate([p[i] for p in parts]) for i in range(5))
    order = np.lexsort((b, a))
    a, b, na, nb, shared = a[order], b[order], na[order], nb[order], shared[order]
    starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    total = np.add.reduceat(shared.astype(np.int64), starts)
    return pa.table({"a": a[starts], "b": b[starts], "na": na[starts].astype(np.int64), "nb": nb[starts].astype(np.int64), "shared": total})


def _summed_tokens(rows: pa.Table) -> pa.Table:
    """The frequent tokens of the sets of one part: (sid, n, h, tokens), the tokens sorted."""
    parts = []
    for r in rows.to_pylist():
        at = _unplanes(r["first"], np.int32)
        parts.append((_unplanes(r["sids"], np.int64)[at], _unplanes(r["sizes"], np.int32)[at], _unplanes(r["value"], np.uint64)))
    sid, n, token = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((token, sid))
    sid, n, token = sid[order], n[order], token[order]
    starts = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
    return pa.table({"sid": sid[starts], "n": n[starts].astype(np.int64), "h": np.diff(np.append(starts, len(sid))), "tokens": pa.array([x.tobytes() for x in np.split(token, starts[1:])], pa.binary())})


def linked(shared: Column, na: Column, nb: Column, percent: int = PERCENT) -> Column:
    return (100 + percent) * shared >= percent * (na + nb)


def _common(a: bytes, b: bytes) -> int:
    return len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))


def _shared_tokens(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """How many tokens two columns of packed tokens share."""

    @F.pandas_udf("long")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_common(i, j) for i, j in zip(x, y, strict=True)], dtype="int64")

    return df.withColumn(out, run(F.col(a), F.col(b)))


# --- families of frequent tokens ---------------------------------------------------------------------------------


def _least_hashes(blob: bytes) -> list[int]:
    t = np.frombuffer(blob, np.uint64)
    return [int(mixed(t * np.uint64(s)).min().astype(np.int64)) for s in SEEDS]


def _family_links(hot: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of sets to one of those that have a least hash in common with them. hot: (sid, n, h, tokens).

    The one is that with the smallest share of rare tokens: the origin of a family has none, its edited copies do.
    """

    @F.pandas_udf("array<long>")
    def least(tokens: pd.Series) -> pd.Series:
        return tokens.map(_least_hashes)

    rare = (F.col("n") - F.col("h")) / F.col("n")
    keys = hot.select("sid", rare.alias("rare"), F.posexplode(least("tokens")).alias("seed", "key"))
    heads = keys.groupBy("seed", "key").agg(F.min(F.struct("rare", "sid")).alias("first")).select("seed", "key", F.col("first.sid").alias("head"))
    pairs = keys.join(heads, ["seed", "key"]).where("sid != head").select("sid", "head").distinct()
    return _compared(pairs.select(F.col("sid").alias("a"), F.col("head").alias("b")), hot, percent)


def _compared(pairs: DataFrame, hot: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that are linked by the tokens in hot alone."""
    x = hot.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = hot.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    near = pairs.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return _shared_tokens(near, "ta", "tb", "shared").where(linked(F.col("shared"), F.col("na"), F.col("nb"), percent)).select("a", "b")


def _matrix(percent: int):
    """Rows (sid, n, h, family, grp, g_n, g_h, tokens) of one bucket: how many tokens a set shares with foreign groups.

    Two sets that share frequent tokens only share at most as many as the poorer of them has, so the smaller of two
    linked sets is made of them but for a seventh (at 75 percent): only such sets ask. A group is asked only if its
    richest member has enough for the sizes (g_n: its smallest member's, g_h: the most frequent tokens of one).
    """

    def run(rows: pa.Table) -> pa.Table:
        got = {c: rows[c].to_numpy() for c in ("sid", "n", "h", "g_n", "g_h")}
        parts = [np.frombuffer(x, np.uint64) for x in rows["tokens"].to_pylist()]
        row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        token = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        family = np.unique(rows["family"].to_numpy(), return_inverse=True)[1]
        names, group = np.unique(np.array(rows["grp"].to_pylist()), return_inverse=True)
        n, h = got["n"], got["h"]
        asks = (100 + percent) * h >= 2 * percent * n
        of, g_n, g_h = (np.zeros(len(names), np.int64) for _ in range(3))
        of[group], g_n[group], g_h[group] = family, got["g_n"], got["g_h"]
        order = np.lexsort((family[row], token))
        token, row = token[order], row[order]
        # tokens of one family tell nothing
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(token))
        several = family[row[starts]] != family[row[ends - 1]] if len(token) else np.zeros(0, bool)
        found: list[np.ndarray] = []
        size = 0
        code, count = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fold() -> tuple[np.ndarray, np.ndarray]:
            u, back = np.unique(np.concatenate([code, *found]), return_inverse=True)
            weight = np.concatenate([count, np.ones(sum(map(len, found)), np.int64)])
            return u, np.bincount(back, weight, len(u)).astype(np.int64)

        for s, e in zip(starts[several], ends[several], strict=True):
            r = row[s:e]
            g = np.unique(group[r])
            r = r[asks[r]]
            for part in np.array_split(r, len(r) * len(g) // 500_000 + 1):
                a, b = part[:, None], g[None, :]
                near = (family[a] != of[b]) & ((100 + percent) * np.minimum(h[a], g_h[b]) >= percent * (n[a] + g_n[b]))
                x, y = np.nonzero(near)
                found.append(part[x] * len(names) + g[y])
                size += len(x)
                if size > 1_000_000:
                    code, count = fold()
                    size = 0
                    found.clear()
        code, count = fold()
        place = max(len(names), 1)
        # a set that misses more than a seventh of itself in one bucket alone is not near
        z = code // place
        spare = n - -(-2 * percent * n // (100 + percent))
        near = np.array([len(p) for p in parts], np.int64)[z] - count <= spare[z]
        code, count = code[near], count[near]
        release_memory()
        return pa.table({"sid": pa.array(got["sid"][code // place], pa.int64()), "grp": pa.array([str(x) for x in names[code % place]] if len(code) else [], pa.string()), "shared": pa.array(count, pa.int64())})

    return run


def _opened(percent: int):
    """The members of one group against the sets that may be near one of them."""

    def run(members: pa.Table, askers: pa.Table) -> pa.Table:
        mine = [(i, n, np.frombuffer(t, np.uint64)) for i, n, t in zip(*members.select(["sid", "n", "tokens"]).to_pydict().values(), strict=True)]
        out = []
        for i, n, t in zip(*askers.select(["sid", "n", "tokens"]).to_pydict().values(), strict=True):
            t = np.frombuffer(t, np.uint64)
            for j, m, u in mine:
                if 100 * min(n, m) >= percent * max(n, m) and (100 + percent) * len(np.intersect1d(t, u, assume_unique=True)) >= percent * (n + m):
                    out.append((i, j))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


_PLACED = ("bucket", "sid", "n", "h", "family", "grp", "g_n", "g_h", "tokens")


def _split_tokens(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                t = np.frombuffer(r["tokens"], np.uint64)
                of = t % np.uint64(buckets)
                rows += [(int(k), *[r[c] for c in _PLACED[1:-1]], t[of == k].tobytes()) for k in np.unique(of)]
            kinds = (pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 2, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(_PLACED))

    return run


def _cross_family(hot: DataFrame, links: DataFrame, percent: int, group: int) -> DataFrame:
    """Links between different families: by the matrix of tokens and groups, then inside the groups it leaves."""
    family = components(links)
    placed = hot.join(family.withColumnRenamed("node", "sid"), "sid", "left").withColumn("family", F.coalesce("component", "sid")).drop("component")
    # families are dealt to groups of about half the size allowed, by hash
    sizes = placed.groupBy("family").agg(F.ceil(F.count("*") * 2 / group).alias("parts"))
    placed = placed.join(sizes, "family").withColumn("grp", F.concat_ws(":", "family", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("string")))
    placed = written(in_parts(placed.select("sid", "n", "h", "tokens", "family", "grp"), hot.count(), PART_ROWS))
    of_group = placed.groupBy("grp").agg(F.min("n").alias("g_n"), F.max("h").alias("g_h"))
    buckets = 1 + (placed.agg(F.sum("h")).first()[0] or 0) // MATRIX_TOKENS
    dealt = placed.join(of_group, "grp").mapInArrow(_split_tokens(buckets), "bucket int, sid long, n long, h long, family long, grp string, g_n long, g_h long, tokens binary")
    bound = dealt.groupBy("bucket").applyInArrow(_matrix(percent), "sid long, grp string, shared long").groupBy("sid", "grp").agg(F.sum("shared").alias("shared"))
    # the asking set is the smaller one: all but a seventh of it (at 75 percent) is shared with a member
    asked = bound.join(placed.select("sid", "n", "tokens"), "sid").where((100 + percent) * F.col("shared") >= 2 * percent * F.col("n")).select(F.col("grp").alias("to"), "sid", "n", "tokens")
    salted = asked.withColumn("part", F.pmod(F.xxhash64("sid"), F.lit(16)).cast("int"))
    rooms = placed.join(asked.select("to").distinct(), F.col("grp") == F.col("to"), "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return rooms.groupBy("grp", "salt").cogroup(salted.groupBy("to", "part")).applyInArrow(_opened(percent), "a long, b long")


# --- the join ----------------------------------------------------------------------------------------------------


def near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, most: int = MOST, group: int = GROUP, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc (as text), tie (the digest of the text), sid and n of every row; links has pairs (a, b) of sids.

    The links given connect all that are connected; links inside a family need not all be there.
    """
    given = docs.select(F.col(doc).cast("string").alias("doc"), text_of(text).cast("binary").alias("data"))
    members = written(given.withColumn("tie", F.md5("data")).mapInArrow(_member_rows(words), _MEMBERS))
    buckets = chunk_count(given, "data", bucket_bytes)
    dealt = given.select("data").mapInArrow(_dealer(words, buckets), _DEALT)
    found = written(dealt.groupBy("bucket").applyInArrow(_bucket(percent, most, buckets), _FOUND))

    hot = written(found.where("not pairs").groupBy("part").applyInArrow(_summed_tokens, "sid long, n long, h long, tokens binary"))
    light = hot.select("sid", "h")
    pairs = found.where("pairs").groupBy("part").applyInArrow(_summed_pairs, "a long, b long, na long, nb long, shared long")
    pairs = pairs.join(light.select(F.col("sid").alias("a"), F.col("h").alias("ha")), "a", "left").join(light.select(F.col("sid").alias("b"), F.col("h").alias("hb")), "b", "left")
    rest = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    most_pairs = found.where("pairs").agg(F.sum("lines")).first()[0] or 0
    pairs = written(in_parts(pairs.where(linked(F.col("shared") + rest, F.col("na"), F.col("nb"), percent)).drop("ha", "hb"), most_pairs))
    sure = linked(F.col("shared"), F.col("na"), F.col("nb"), percent)
    links = pairs.where(sure).select("a", "b")
    open_ = pairs.where(~sure).join(hot.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a").join(hot.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    open_ = _shared_tokens(open_, "ta", "tb", "more").where(linked(F.col("shared") + F.col("more"), F.col("na"), F.col("nb"), percent))
    links = links.unionByName(open_.select("a", "b"))

    # sets that may be linked without a rare token in common
    hot = hot.where(100 * F.col("h") >= percent * F.col("n"))
    n, n_hot = pairs.count(), hot.count()
    if n_hot:
        links = written(in_parts(links.unionByName(_family_links(hot, percent)), n + len(SEEDS) * n_hot, PART_ROWS))
        n = links.count()
        links = links.unionByName(_cross_family(hot, links, percent, group))
    return members, written(in_parts(links.distinct(), n + n_hot, PART_ROWS))


def _named(docs: DataFrame, doc: str, text: str, **options) -> DataFrame:
    """doc, n_shingles, tie (the text's digest) and component (a set's number) of every row."""
    members, links = near_copies(docs, doc, text, **options)
    family = components(links)
    named = members.select(F.col("doc").cast(docs.schema[doc].dataType).alias(doc), "sid", "tie", F.col("n").alias("n_shingles"))
    named = named.join(family.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")).drop("sid")
    return written(in_parts(named, members.count()))


def with_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc, n_shingles and component_id of every row of docs; component_id is null only where no row reached has a doc."""
    named = _named(docs, doc, text, **options)
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min(doc).alias("component_id"))
    full = named.where("n_shingles > 0").join(least, "component").select(doc, "n_shingles", "component_id")
    return full.unionByName(named.where("n_shingles = 0").select(doc, "n_shingles", F.col(doc).alias("component_id")))


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: that with the smallest doc, rows without one last, then with the least digest.

    Of rows that have doc and text in common the least by all columns stays. A row without words is linked with
    nothing, so it stays.
    """
    named = _named(docs.select(doc, text), doc, text, **options).where("n_shingles > 0")
    same = named.groupBy("component", doc, "tie").agg(F.count("*").alias("copies"))
    first = same.groupBy("component").agg(F.min(F.struct(F.col(doc).isNull().alias("none"), F.col(doc).alias("d"), "tie", "copies")).alias("k"))
    keys = written(in_parts(first.select(F.col("k.d").alias("_kd"), F.col("k.tie").alias("_kt"), F.col("k.copies").alias("_kn")), named.count()))
    inner, col = sheltered(docs)
    rows = inner.withColumns({"_d": col(doc), "_t": F.md5(text_of(col(text)).cast("binary"))})
    is_key = F.col("_d").eqNullSafe(F.col("_kd")) & (F.col("_t") == F.col("_kt"))
    once = rows.join(keys.where("_kn = 1"), is_key, "left_semi")
    several = keys.where("_kn > 1")
    n = several.count()
    if n:
        again = rows.join(F.broadcast(several) if n <= BROADCAST_KEYS else several, is_key, "left_semi")
        # what is equal is brought together before the shuffle
        again = again.groupBy("_d", "_t").agg(F.min(F.struct(*inner.columns)).alias("r")).select("r.*", "_d", "_t")
        once = once.unionByName(again.select(once.columns))
    wordless = rows.where(~text_of(col(text)).rlike(WORD))
    return restored(once.unionByName(wordless), docs.columns, [])


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return with_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT doc_id, rid, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS ss FROM w),
t AS (SELECT rid, unnest(ss) AS g FROM s),
f AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
u AS (SELECT t.* FROM t JOIN f USING (g)),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS i FROM u x JOIN u y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN s sa ON sa.rid = p.a JOIN s sb ON sb.rid = p.b WHERE 100 * i >= 75 * (len(sa.ss) + len(sb.ss) - i)),
r AS (SELECT rid AS a, rid AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT r.a, min(s.doc_id) AS component_id FROM r JOIN s ON s.rid = r.b GROUP BY r.a)
SELECT doc_id, len(ss)::BIGINT AS n_shingles, component_id FROM s JOIN m ON m.a = s.rid
"""
