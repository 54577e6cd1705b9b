"""SentencePiece encoding and decoding, by backtracking over longest matches.

A merge-type (BPE) encoding is the only split of a text into pieces in which every two neighbours are compatible:
merging their joined text again gives the two of them. The encoder finds that split directly: an Aho-Corasick
automaton gives the longest piece at each position, a piece is accepted if it is compatible with the last one,
shorter pieces are tried otherwise, and a bitfield marks positions from which no split goes on.

No piece of the model joins a space to the end of a word, so the words are encoded apart, and a bounded cache
keeps the ids and the decoded text of those that come again. Characters without a piece become byte pieces, which the
library decodes; other pieces decode to what they spell. Pieces of equal score, such as runs of spaces, are merged
leftmost first, and the compatibility test knows that.

Defined cases: null and empty texts have no ids and decode to the empty text; rows that repeat are each encoded, and
no result depends on another row, so there are no ties; a column that has the name of a result is kept as
<name>_given; an empty table gives no rows; a very long text is encoded whole, also one that is a single word, in
time linear in its length but for the rare backtracking.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import kept_between_tasks, release_memory, restored, sheltered, text_of

SPACE = "▁"
#: Words that each worker keeps, in two generations of this size, and the longest that is kept.
CACHE_WORDS, CACHE_LENGTH = 120_000, 48
#: Those that an idle worker holds: the first that it met, which are the most frequent.
IDLE_WORDS = 40_000
#: Texts that are encoded at a time.
TEXTS = 500
CACHE_PAIRS = 500_000


def numbers(said: str) -> np.ndarray:
    """Decimals joined by commas as numbers of four bytes each."""
    return np.fromstring(said, np.int32, sep=",") if said else np.zeros(0, np.int32)


class PieceEncoder:
    """Encodes like the sentencepiece library does with a BPE model that has byte pieces and identity normalisation."""

    def __init__(self, model: bytes):
        self.model = model
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.lib, self.lib.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        self.bytes_ = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(lib.is_byte, self.bytes_)):
            raise ValueError("the model has no byte pieces")
        self.text = [lib.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.text) if i not in special}
        self.score = [lib.get_score(i) for i in range(n)]
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("pieces must not cross words, and each of their characters must be a piece")
        # pieces that no merges give cannot stand in an encoding; the others have a last merge
        self.halves: dict[int, tuple[int, int]] = {}
        real = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merge(p, i) == [i]}
        self.automaton = ahocorasick.Automaton()
        for p, i in real.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.length = [len(p) for p in self.text]
        self.reach = max(map(len, real))
        self.decimal = [str(i) for i in range(n)]
        self.shorter = [next((real[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in real), -1) for p in self.text]
        alone = [p for p in self.ids if len(p) == 1]
        self.known = re.compile("[" + "".join(map(re.escape, alone)) + "]+|[\\s\\S]")
        self.plain = re.compile(f"{SPACE}?[" + "".join(map(re.escape, (p for p in alone if p not in (SPACE, "\n")))) + "]+")
        self.fallback = {*special, *self.bytes_}
        self.first = next(i for p, i in sorted(self.ids.items()) if len(p) == 1 and p.isalpha())
        self.segments = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.joined = {a << 20 | b: self.score[i] for p, i in self.ids.items() for k in range(1, len(p)) if (a := real.get(p[:k])) is not None and (b := real.get(p[k:])) is not None}
        self.edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def merge(self, s: str, whole: int = -1) -> list[int]:
        """The encoding by its definition: join the neighbours whose piece has the highest score, leftmost first.

        whole: a piece whose last merge, if it comes about, is noted.
        """
        ids, score = self.ids, self.score
        parts: list[str | None] = list(s)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := ids.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score[i], a, len(parts[a]) + len(parts[b])))

        for a in range(n - 1):
            offer(a, a + 1)
        while heap:
            _, a, size = heapq.heappop(heap)
            if parts[a] is None or (b := right[a]) < 0 or len(parts[a]) + len(parts[b]) != size:
                continue
            if size == n and whole >= 0:
                self.halves[whole] = ids[parts[a]], ids[parts[b]]
            parts[a] += parts[b]
            parts[b] = None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [ids[p] for p in parts if p is not None]

    def edge(self, piece: int, side: int) -> list[tuple[int, float]]:
        """What stands at a piece's end (side 1) or start (side 0) while it is merged: each part, smallest first,
        with the score of the merge that takes it up; the piece itself is never taken up."""
        found = self.edges[side].get(piece)
        if found is None:
            found, above = [], float("-inf")
            part = piece
            while True:
                found.append((part, above))
                if part not in self.halves:
                    break
                above = self.score[part]
                part = self.halves[part][side]
            found.reverse()
            self.edges[side][piece] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the two pieces' joined text again gives the two.

        Only merges across the border can differ: the parts that meet there are followed as they grow, and a
        piece of the two must not score above both merges that take them up. At the same score the leftmost
        merge comes first: that of the left part before the border, the border before that of the right part.
        """
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(self.edge(a, 1), self.edge(b, 0))
        return known

    def _apart(self, ends: list[tuple[int, float]], starts: list[tuple[int, float]]) -> bool:
        i = j = 0
        while True:
            (x, left), (y, right) = ends[i], starts[j]
            across = self.joined.get(x << 20 | y)
            if across is not None and across > left and across >= right:
                return False
            if left >= right and i + 1 < len(ends):
                i += 1
            elif j + 1 < len(starts):
                j += 1
            else:
                return True

    def backtrack(self, s: str) -> list[int]:
        """The encoding of a text of known characters."""
        pairs, compatible, longest = self.pairs, self.compatible, self.automaton.iter_long
        out: list[int] = []
        # the longest piece at each position in turn, as long as it is compatible with the last one
        last = -1
        for end, (size, token) in longest(s):
            if last >= 0:
                fits = pairs.get(last << 20 | token)
                if not (compatible(last, token) if fits is None else fits):
                    break
            out.append(token)
            last = token
        else:
            return out
        length, shorter, reach, n = self.length, self.shorter, self.reach, len(s)
        failed = bytearray((n >> 3) + 1)
        pos, token = end + 1 - size, shorter[token]
        while pos < n or token >= 0:
            if token >= 0:
                end = pos + length[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or compatible(out[-1], token)):
                    out.append(token)
                    pos = end
                    token = next(longest(s[end : end + reach]))[1][1] if end < n else -1
                else:
                    token = shorter[token]
            else:
                # nothing goes on from here: the piece before must be another one
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= length[token]
                token = shorter[token]
        return out

    def word(self, s: str) -> list[int]:
        """The ids of one segment."""
        out: list[int] = []
        for part in self.known.findall(s):
            if part[0] not in self.ids:
                out.extend(self.bytes_[b] for b in part.encode("utf-8", "replace"))
            else:
                out.extend(self.backtrack(part))
        return out

    def spelled(self, s: str) -> tuple[str, str]:
        """The ids, as decimals joined by commas, of some whole segments, and the text that they decode to."""
        decimal, text = self.decimal, self.text
        if self.plain.fullmatch(s):
            ids = self.backtrack(s)
        else:
            ids = [i for x in self.segments.findall(s) for i in self.word(x)]
            if not self.fallback.isdisjoint(ids):
                # the library drops a space that comes first: another piece stands before
                return ",".join([decimal[i] for i in ids]), self.lib.decode([self.first, *ids])[len(text[self.first]) :]
        return ",".join([decimal[i] for i in ids]), "".join([text[i] for i in ids]).replace(SPACE, " ")

    def look_up(self, unit: str) -> tuple[str, str]:
        """What a unit gives: a word with the space before it, or a line feed and the word that it stands before."""
        found = self.older.get(unit)
        if found is None:
            found = self.spelled(unit if unit[0] == "\n" else SPACE + unit)
        if len(unit) <= CACHE_LENGTH:
            if len(self.units) >= CACHE_WORDS:
                self.older, self.units = self.units, {}
            self.units[unit] = found
        return found

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same as decimals joined by commas."""
        said, _ = self.coded(text)
        return numbers(said).tolist(), said

    def coded(self, text: str) -> tuple[str, str]:
        """The ids as decimals joined by commas, and the text that they decode to."""
        if not text:
            return "", ""
        if text[0] in " \n" or text[-1] == " " or "  " in text or " \n" in text or SPACE in text:
            said, decoded = [], []
            for s in self.segments.findall(SPACE + text.replace(" ", SPACE)):
                a, b = self.look_up(s[1:]) if s[0] == SPACE and len(s) > 1 and s[1] != SPACE else self.spelled(s)
                said.append(a)
                decoded.append(b)
        else:
            units = text.replace("\n", " \n").split(" ")
            found = list(map(self.units.get, units))
            if None in found:
                found = [self.look_up(u) if x is None else x for u, x in zip(units, found, strict=True)]
            said, decoded = [x[0] for x in found], [x[1] for x in found]
        # the library puts a space before the text, and takes it away again
        return ",".join(said), "".join(decoded)[1:]

    def forget(self) -> None:
        """Lets most units go, so that an idle worker holds little more than the model."""
        first = self.older or self.units
        self.older, self.units = {}, dict(islice(first.items(), IDLE_WORDS))
        self.pairs.clear()
        for edges in self.edges:
            edges.clear()


_LOADED: dict[str, PieceEncoder] = kept_between_tasks()


def encoder(model: bytes) -> PieceEncoder:
    """The worker's encoder for this model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceEncoder(model)
    return _LOADED[key]


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs with n_tokens, ids (array<int>) and decoded (string); a column that has such a name becomes <name>_given.

    digests: instead of ids and decoded, their ids_sha256 and decoded_sha256, made where the ids are.
    The model is read on the driver and travels with the task, a file of a few hundred kB.
    """
    model = Path(model_path).read_bytes()
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        use = encoder(model)
        try:
            for texts in batches:
                for at in range(0, len(texts), TEXTS):
                    yield pd.DataFrame(_rows(use, texts.iloc[at : at + TEXTS], digests), columns=["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])])
        finally:
            use.forget()
            release_memory(_LOADED)

    inner, col = sheltered(docs)
    results = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    return restored(inner.withColumn("_e", run(text_of(col(text)))).select(*inner.columns, "_e.*"), docs.columns, results)


def _rows(use: PieceEncoder, texts: Iterable[str], digests: bool) -> list[tuple]:
    out = []
    for t in texts:
        said, decoded = use.coded(t)
        if digests:
            out.append((said.count(",") + 1 if said else 0, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        else:
            ids = numbers(said)
            out.append((len(ids), ids, decoded))
    return out


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
