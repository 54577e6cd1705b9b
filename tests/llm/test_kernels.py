"""Kernels against brute force: exact round trips, counts and probabilities."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from helpers import SMALL
from pyspark.sql import functions as F

from strandlake.llm import html_extract, imatch, jaccard, language, lm_score, pieces, pii, ppm, url_filter


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]


# --- prediction by partial matching ---


def slow_bits(train: list[bytes], text: bytes, order: int) -> float:
    count: dict = defaultdict(Counter)
    seq = lambda t: [ppm.START] * order + list(t) + [ppm.END]
    for t in train:
        s = seq(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                count[tuple(s[i - k : i])][s[i]] += 1
    total, s = 0.0, seq(text)
    for i in range(order, len(s)):
        out: set = set()
        p, known = 1.0, False
        for k in range(order, -1, -1):
            c = count.get(tuple(s[i - k : i]))
            if not c:
                continue
            live = {x: n for x, n in c.items() if x not in out}
            n, d = sum(live.values()), len(live)
            if s[i] in live:
                p, known = p * live[s[i]] / (n + d), True
                break
            p = p * d / (n + d) if d else p
            out |= set(c)
        total -= math.log2(p if known else p / (ppm.SYMBOLS - len(out)))
    return total


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_ppm(order):
    train = [b"the cat sat on the mat", b"a thing", b"", "théâtre".encode()]
    asked = [b"the bat zat", b"", "ñ the".encode(), b"the cat sat on the mat"]
    g, _ = ppm.grams(train, order)
    table = ppm.levels(*np.unique(g, return_counts=True), order)
    g, starts = ppm.grams(asked, order)
    code, u = ppm.distinct(g)
    assert np.allclose(np.add.reduceat(ppm.bits(table, u)[code], starts), [slow_bits(train, t, order) for t in asked])


def test_ppm_is_a_distribution():
    g, _ = ppm.grams([b"abracadabra", b"abacab"], 2)
    table = ppm.levels(*np.unique(g, return_counts=True), 2)
    for context in (b"ab", b"xx", b"ra"):
        keys = np.array([context[0] << 18 | context[1] << 9 | s for s in range(ppm.SYMBOLS)], np.int64)
        assert abs(np.exp2(-ppm.bits(table, keys)).sum() - 1) < 1e-9


def test_lm_score(spark, docs, texts, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 100_000)
    got = {r["doc_id"]: r for r in lm_score.op5_lm_score(spark, SMALL).collect()}
    low = {d: t.encode().lower() for d, t in texts}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in low}
    count: Counter = Counter()
    for d, t in low.items():
        if not held[d]:
            count.update([*t.split(), None])
    n, v = sum(count.values()), len(count)
    g, _ = ppm.grams([t for d, t in low.items() if not held[d]], lm_score.ORDER)
    table = ppm.levels(*np.unique(g, return_counts=True), lm_score.ORDER)
    for d, t in low.items():
        words = [*t.split(), None]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert math.isclose(r["score"], -math.log10(2) * ppm.bits(table, ppm.grams([t], lm_score.ORDER)[0]).sum(), rel_tol=1e-9)


def test_language_accuracy(spark, docs):
    got = {r["doc_id"]: r for r in language.op9_language(spark, SMALL).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [d for d, r in got.items() if r["held_out"]]
    assert sum(got[d]["lang_pred"] == truth[d] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.judge({}, ["text"]) == [("und", 0.0)]


def test_language_like_brute_force(spark):
    """Every prediction and score by the definition of the models, copies counted once."""
    random.seed(6)
    word = {"aa": lambda: "".join(random.choices("abcde", k=4)), "bb": lambda: "".join(random.choices("cdefg", k=5)), "cc": lambda: "".join(random.choices("xyzé", k=3))}
    rows = [(i, " ".join(word[k]() for _ in range(random.randint(1, 8))), k) for i, k in enumerate(["aa", "bb", "cc"] * 6)]
    rows += [(50, rows[0][1], "aa"), (51, None, "aa"), (52, "²½ 12 _", "bb"), (53, "Abc DEF", None), (54, "", "cc"), (55, "cde", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = {k: sorted({t for _, t, x in rows if x == k and t is not None}) for k in word}
    for r in language.identify(df, F.lit(True)).collect():
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cost = {k: slow_bits([t.lower().encode() for t in train[k]], r["text"].lower().encode(), language.ORDER) for k in sorted(train)}
        best = min(cost, key=cost.get)
        assert r["lang_pred"] == best and math.isclose(r["score"], 1 / sum(2 ** max(cost[best] - c, -1000) for c in cost.values()), rel_tol=1e-9)


# --- url filters ---


def test_url_list_whatever_the_joins(spark, monkeypatch):
    """A filter that is full and a list that is shuffled give the same verdicts."""
    rows = [(i, f"http://{'spam-' if i % 7 == 0 else ''}h{i % 50}.example.com/p{i % 90}/?a={i % 3}&utm_x=1") for i in range(3000)] + [(3000, None), (3001, ""), (3002, "x" * 10_000 + "://y")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    listed = url_filter.listed_urls(df)
    whole = sorted(map(tuple, url_filter.url_filter(df, listed).collect()), key=repr)
    assert sum(r[-1] == "block" for r in whole) == sum(i % 7 == 0 for i in range(3000))
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    assert sorted(map(tuple, url_filter.url_filter(df, listed).collect()), key=repr) == whole


# --- pieces ---


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return pieces.PieceEncoder(f.read())


def test_pieces_like_the_library(encoder, texts):
    random.seed(1)
    letters = list("abcdet hr ▁ \n.,é漢😀01<>")
    some = [p.replace("▁", " ") for p in list(encoder.ids)[:6000]]
    odd = [" a", "a  b", "   ", "\t\tx\n\n y", "▁a ▁", "日本語テスト 漢字", "a" * 5000, " " * 3001, "ab " * 50 + "    ", "\x00\x01z", "<0x0A>", "<s>", "import   numpy    as", "\r\n a", "0" * 2000]
    odd += ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(3000)] + ["".join(random.choices(some, k=random.randint(1, 12))) for _ in range(3000)]
    for t in [*odd, *(t for _, t in texts)]:
        ids, said = encoder.encode(t)
        assert ids == encoder.lib.encode(t) and said == ",".join(map(str, ids))


def test_compatible_is_merging_again(encoder):
    random.seed(2)
    real = [v[1] for v in encoder.automaton.values()]
    for _ in range(20_000):
        a, b = random.choice(real), random.choice(real)
        assert encoder.compatible(a, b) == (encoder.merge(encoder.text[a] + encoder.text[b]) == [a, b])


def test_pieces_query(spark, encoder, texts):
    got = {r["doc_id"]: r for r in pieces.op6_pieces(spark, SMALL).collect()}
    for d, t in texts:
        ids = encoder.lib.encode(t)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[d])[1:] == (len(ids), digest(",".join(map(str, ids))), digest(encoder.lib.decode(ids)))


# --- near copies ---


def slow_components(rows: list[tuple[int, str]], percent: int = 75) -> dict[int, int]:
    sets = {}
    for d, t in rows:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("options", [{}, {"most": 2, "group": 4, "bucket_bytes": 20_000}, {"most": 3, "bucket_bytes": 50_000}])
def test_families_of_copies(spark, options):
    """A large family of edited copies, some at the threshold, beside texts that share a long passage."""
    random.seed(3)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(random.randint(0, 9)):
            w[random.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join([*passage, *(word() for _ in range(random.randint(1, 30)))])) for i in range(60)]
    rows += [(200 + i, " ".join(word() for _ in range(50))) for i in range(10)] + [(300, rows[3][1]), (301, "a b"), (302, "a  b"), (303, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.with_components(df, **options).collect()}
    assert got == slow_components(rows)
    assert {r["doc_id"] for r in jaccard.one_of_each(df, **options).collect()} == set(got.values())


# --- fingerprints ---


def slow_mixed(x: int) -> int:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = ((x ^ x >> shift) * factor) % 2**64
    return x


def slow_fingerprint(words: set[bytes], lexicon: set[bytes]) -> list[int]:
    """By the definition: the hash of all words, then of each sub-lexicon's words in order of their hashes."""
    step = 0x9E3779B97F4A7C15
    number = {w: xxhash.xxh3_64_intdigest(w) for w in words}
    out = [max(1, slow_mixed(sum(slow_mixed(h) for h in number.values()) % 2**64) % 2**32) if words else 0]
    for j, rate in enumerate(imatch.RATES):
        mine = sorted(number[w] for w in words & lexicon if slow_mixed(number[w] ^ (j + 1) * step % 2**64) % rate == 0)
        total = sum(slow_mixed(h ^ (i + 1) * step % 2**64) for i, h in enumerate(mine)) % 2**64
        out.append(max(1, slow_mixed(total) % 2**32) if mine else 0)
    return out


def slow_likeness(a: list[int], b: list[int], equal: bool) -> float:
    told = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in told) / len(told) if told else float(equal)


def slow_matches(rows: list[tuple]) -> list[tuple]:
    down = sorted(rows, key=lambda r: xxhash.xxh3_128_digest((r[1] or "").encode()))
    down = [(d, t or "") for d, t in sorted(down, key=lambda r: math.inf if r[0] is None else -r[0])]
    df = Counter(w for _, t in down for w in imatch_words(t))
    n = len(down)
    lexicon = {w for w, c in df.items() if n ** (1 - imatch.HIGH) <= c <= n ** (1 - imatch.LOW)}
    out = []
    for i, (d, t) in enumerate(down):
        after = down[(i + 1) % n][1]
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        x, y, z = (slow_fingerprint(imatch_words(v), lexicon) for v in (t, e, after))
        shown = ["".join(f"{k:08x}" for k in v) for v in (x, y)]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), *shown, round(slow_likeness(x, y, t == e), 12), round(slow_likeness(x, z, t == after), 12)))
    return sorted(out, key=repr)


def matches_of(df) -> list[tuple]:
    return sorted(((*tuple(r)[:5], round(r[5], 12), round(r[6], 12)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("unit", [None, 3000])
def test_fingerprints(spark, docs, texts, unit, monkeypatch):
    """The whole operator by its definition, at two sizes of units and ranges."""
    if unit:
        monkeypatch.setattr(imatch, "UNIT_BYTES", unit)
    got = matches_of(imatch.fingerprints(docs.select("doc_id", "text"), range_bytes=imatch.RANGE_BYTES if unit is None else 20_000))
    assert got == slow_matches(texts)
    same = defaultdict(set)
    for (_, t), r in zip(sorted(texts), sorted(got), strict=True):
        same[r[3]].add(frozenset(imatch_words(t)))
    # one fingerprint, one set of words: none is all zero but that of texts without words
    assert all(len(x) == 1 for x in same.values())
    assert sum(r[5] > r[6] for r in got) > 0.85 * len(got)


def test_fingerprints_of_odd_rows(spark):
    rows = [(None, "a b c"), (None, None), (None, "a b c"), (3, ""), (3, "x y " * 50), (3, "x y " * 50), (2, "é " * 30), (1, "w" * 5000), (0, " \n "), (-7, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert matches_of(imatch.fingerprints(df, range_bytes=1)) == slow_matches(rows) == matches_of(imatch.fingerprints(df))
    one = imatch.fingerprints(df.where("doc_id = 2")).first()
    assert (one["near_next"], one["edited_sha256"]) == (1.0, hashlib.sha256(("é " * 30).encode()).hexdigest())


def imatch_words(t: str) -> set[bytes]:
    return set(t.encode().lower().split())


# --- personal data ---

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(x) * (2 if i % 2 else 1), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def slow_spans(t: str) -> list[str]:
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_spans(spark, texts):
    random.seed(4)
    parts = ["a.b@c.d-e.f", "x@y", "@", "1.2.3.4", "999.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "+1 (743) 555-3824", "++49 30 1234567", "12 34", " ", "é", "\n", "a_b@c.dd@e.ff", "0000.0.0.001", "5" * 40, "😀"]
    made = [(10_000 + i, "".join(random.choices(parts, k=random.randint(0, 14)))) for i in range(400)]
    rows = [*texts, *made, (99_999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df)
    for r in found.collect():
        base = [f"{s['kind']}:{s['s']}:{s['e']}" for s in r["spans"] if s["kind"] in pii.BASE]
        assert base == slow_spans(r["text"] or "")
        more = [s for s in r["spans"] if s["kind"] not in pii.BASE]
        assert all(not any(s["s"] < int(b.split(":")[2]) and int(b.split(":")[1]) < s["e"] for b in base) for s in more)
        tokens = re.findall(r'token = "[0-9a-f]{32,}', r["text"] or "")
        assert sum(s["kind"] == "secret" for s in more) >= len(tokens)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert all(not slow_spans(clean[d] or "") or slow_spans(t or "") for d, t in rows)


def test_many_spans_of_one_text(spark):
    """Hundreds of spans in one text, of several kinds, some of which overlap."""
    random.seed(10)
    parts = ["a.b@c.example.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (743) 555-3824", "é", "plain words", "\n", "x1.2.3.4@d.example.com"]
    rows = [(i, " ".join(random.choices(parts, k=n))) for i, n in enumerate((700, 129, 128, 64, 65, 1, 0))]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    for r in found.collect():
        assert [f"{s['kind']}:{s['s']}:{s['e']}" for s in r["spans"] if s["kind"] in pii.BASE] == slow_spans(r["text"])
        out, at = "", 0
        for s, e, kind in sorted((x["s"], x["e"], x["kind"]) for x in r["spans"]):
            if s >= at:
                out += r["text"][at:s] + f"<{kind.upper()}>"
            at = max(at, e)
        assert clean[r["doc_id"]] == out + r["text"][at:]


def test_estimate():
    p = pii.estimate({(1, 1, 1): 50, (0, -1, 0): 200, (1, -1, 0): 5, (0, -1, -1): 30})
    assert p[1, 1, 1] > 0.9 and p[0, -1, 0] < 0.1


# --- pages ---


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.op1_html_extract(spark, SMALL).collect()}
    again = {r["page_id"]: r["text"] for r in html_extract.extract(pages, 7).collect()}
    assert got == again
    import html as html_lib

    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html_lib.unescape(re.sub("<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:h1|p|br|b)>", inner)]
        assert got[r["page_id"]] == "\n\n".join(x for x in blocks if x)


def slow_extract(rows: list[tuple]) -> dict:
    """The whole query, a host at a time: runs of nearly equal pages, and the nearest pages around each."""
    place = lambda u: re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
    hosts = defaultdict(list)
    for p, u, h in rows:
        m = place(u)
        hosts[m[1].lower() if m else ""].append((m[2] if m else "", u or "", str(p), html_extract.lines_of(h or "")))
    out = {}
    for pages in hosts.values():
        runs: list[list] = []
        for x in sorted(pages, key=lambda x: x[:3]):
            if runs and html_extract.alike(runs[-1][-1][-1], x[-1]):
                runs[-1].append(x)
            else:
                runs.append([x])
        for i, run in enumerate(runs):
            before, after = [r[-1][-1] for r in reversed(runs[:i])], [r[0][-1] for r in runs[i + 1 :]]
            around = []
            for k in range(html_extract.WITNESSES):
                around += before[k : k + 1] + after[k : k + 1]
            for j, x in enumerate(run):
                near = before[:1] + after[:1]
                if not near:
                    near = [next((y[-1] for y in side if y[-1] != x[-1]), None) for side in (run[:j][::-1], run[j + 1 :])]
                out[int(x[2])] = html_extract.main_text(x[-1], [y for y in near if y is not None], around[: html_extract.WITNESSES])
    return out


def test_pages_like_brute_force(spark):
    """Neighbours, runs and deleted lines of the driver's pages, with and without the part that they declare."""
    given = [tuple(r)[:3] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", "html").collect()]
    bare = [(1000 + p, u.replace("://", "://bare."), re.sub(r"</?article>", "", h)) for p, u, h in given]
    # one notice that all pages of a host share, in plain markup
    bare = [(p, u, h.replace("<body>", "<body><div>Shared line of the site</div>")) for p, u, h in bare]
    copies = [(5000 + p, u, h) for p, u, h in bare[:9]] + [(9000, None, "<p>x"), (9001, None, None), (9002, "", "<p>x<p>y")]
    rows = [*given, *bare, *copies]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = slow_extract(rows)
    for n in (3, 2000):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, n).collect()} == want
    hosts = Counter(u.split("/")[2] for _, u, _ in bare)
    assert all("Shared line" not in want[p] for p, u, _ in bare if hosts[u.split("/")[2]] > 1) and max(hosts.values()) > 1


def test_differencing(spark):
    """Without a declared main part, what two pages of a site share is its template."""
    page = lambda body: f"<html><body><div>My site</div><ul><li><a href=/>Home</a></li></ul><div>{body}</div><p>Imprint 2020</p></body></html>"
    rows = [(1, "http://x.org/a/1", page("First story")), (2, "http://x.org/a/2", page("Second story<p>Its end</p>")), (3, "http://y.org/a", page("Alone"))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First story", 2: "Second story\n\nIts end", 3: "My site\n\nHome\n\nAlone\n\nImprint 2020"}


@pytest.mark.parametrize(("page", "want"), [
    ("<main><h1>T</h1><p>a <b>b</b> c&nbsp;d<p>e<script>x</script></main><div>out</div>", ["T", "a b c d", "e"]), ("<p>a<!-- b --></p><style>c</style>", ["a"]), ("a < b &lt; c", ["a < b < c"]),
    ("<article><div class='article-header'><h1 class='entry-header'>T</h1><p>lead</div><p>body", ["T", "lead", "body"]), ("<div class='content share'><p>x</div><div class='share-bar'>y</div>", ["x"]),
    ("<article><header>by me</header><div class='comments'>no</div><p>yes</article>", ["by me", "yes"]), ("<article>x<form>y</form>z<aside>w</aside></article>", ["x", "z"]),
])
def test_lines(page, want):
    lines = html_extract.lines_of(page)
    assert html_extract.main_text(lines, []).split("\n\n") == want


def test_shared_is_longest():
    random.seed(5)
    for _ in range(200):
        a, b = (random.choices("abcd", k=random.randint(0, 9)) for _ in range(2))
        got = html_extract.shared(a, b)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in it for i in sorted(got))


def test_shared_of_long_pages():
    """Repeated lines of long pages are aligned as those of short ones."""
    posts = lambda who: [t for i in range(3000) for t in (f"{who} {i}", "Reply", "Share")]
    a, b = [*posts("x"), "end x"], [*posts("y"), "end y"]
    assert [a[i] for i in sorted(html_extract.shared(a, b))] == ["Reply", "Share"] * 3000


def site_page(k, body):
    own = "".join(f"<p>Story {k} says line {i} of number {k * 7 + i}</p>" for i in range(12))
    return f"<html><body><div>My site</div>{own}{body}<p>Imprint 2020</p></body></html>"


@pytest.mark.parametrize("copies", [1, 3, 60])
def test_copies_are_no_template(spark, copies):
    """Copies and near copies side by side are compared with the pages around them, at every place of the borders."""
    rows = [(100 + i, f"http://x.org/{100 + i}", site_page(i, "")) for i in range(30)]
    rows += [(130 + i, f"http://x.org/{130 + i}", site_page(99, f"<p>{i % 2}</p>")) for i in range(2 * copies)]
    rows += [(130 + 2 * copies + i, f"http://x.org/{130 + 2 * copies + i}", site_page(99, "<p>1</p>")) for i in range(copies)]
    rows += [(400 + i, f"http://x.org/{400 + i}", site_page(200 + i, "")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {p: "\n\n".join(re.findall(r"<p>((?!Imprint).*?)</p>", h)) for p, _, h in rows}
    for n in (1, 5, 2000):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, n).collect()} == want


def test_template_inside_the_main_part(spark):
    """What every page of a host repeats in its article is template; what a few quote is not."""
    page = lambda k, more: "<article>" + "".join(f"<p>Story {k} says line {i} of number {k * 7 + i}</p>" for i in range(12)) + f"{more}<p>We may earn money by links.</p></article>"
    rows = [(k, f"http://x.org/{100 + k}", page(k, "<p>A quoted passage.</p>" if k in (0, 1, 20, 21, 22, 39) else "")) for k in range(40)]
    rows += [(50, "http://y.org/1", page(50, "")), (51, "http://y.org/2", page(51, ""))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {p: "\n\n".join(x for x in re.findall(r"<p>(.*?)</p>", h) if p >= 50 or not x.startswith("We may")) for p, _, h in rows}
    for n in (4, 2000):
        assert {r["page_id"]: r["text"] for r in html_extract.extract(df, n).collect()} == want
