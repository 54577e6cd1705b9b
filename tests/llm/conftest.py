"""Small documents and pages with every odd case, as a folder that the queries can read."""

from __future__ import annotations

import pytest

WORDS = "the of and a river house under blue tree walks slowly to its own green garden while some birds sing above it".split()


def prose(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * 7 + i * i * (seed + 1) + seed) % len(WORDS)] + (f"{(i * 31 + seed) % 97}" if i % 3 == 0 else "") for i in range(n))


def odd_documents() -> list[tuple]:
    base = prose(200)
    near = base.replace("river", "stream", 2)
    return [
        (1, base, "en", "src0", 10), (2, base, "en", "src0", 10), (3, near, "en", None, 10), (4, None, "en", "src1", None), (5, "", None, "src1", 0),
        (6, "   \n\t ", "en", "src2", 6), (7, "one two", "fr", "src2", 7), (8, "one two", "fr", "src2", 7), (8, "one two", "fr", "src2", 7), (None, prose(30, 3), "en", "src0", 5),
        (9, prose(20_000, 5), "en", "src0", 1), (10, "x" * 30_000, None, None, 1), (11, "call +1 (743) 555-3824 or a.b@c.example.com ip 10.0.0.300 1.2.3.4 card 4111 1111 1111 1111", "de", "src1", 1),
        (12, "ÀÉ 😀 日本語 \x00 ▁ " + prose(12, 7), "es", "src3", 1), (13, prose(60, 9) + "\n" + prose(60, 9), "en", "src0", 1), (14, "1 " * 3000, "en", "src0", 1),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use names like, in either case.
CLASHES = ("size", "Kept", "SPANS", "n_tokens", "score", "_key", "n_words", "sid", "range", "taken", "ids")


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(odd_documents(), SCHEMA)
    for c in CLASHES:
        docs = docs.selectExpr("*", f"'clash' AS `{c}`")
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    pages = [(1, "http://a.example.com/en/1", "<p>one</p>"), (2, None, None), (3, "nothing", ""), (3, "nothing", ""), (4, "https://b.net/x", "<article>a &amp; b<br>c"), (None, "://", "<<<>>><p"), (5, "http://a.example.com/en/2", "<div>" * 3000 + "deep")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "'clash' AS Text").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "pages"):
        spark.read.parquet(f"{odd}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder
