"""Personal data: base patterns, then weakly supervised kinds.

Base kinds (email, ip, card, phone) are found by pattern and kept as they are. The further kinds have loose
candidate patterns; three labelers vote on each candidate (its shape, a gazetteer, its context), expectation
maximisation over the table of votes estimates how reliable each labeler is, and a logistic span classifier is
trained on the estimated labels with the candidate's own features. Candidates it accepts are added.

Positions come without user code: the pieces between the matches of a pattern and the matches themselves have
lengths, and their running sums are the spans, in code points. The tables that leave the executors are counts by
vote pattern and by feature bucket, whose sizes are fixed by the number of labelers and buckets.

Patterns use possessive repeats, and start a match only where a run starts (or where the last match ended): the
same matches as the plain patterns, in time linear in the text. Runs of digits too short for a card are left out.

Defined cases: null and empty texts have no spans; repeated rows are each searched; spans of a kind do not overlap, and
of those of several kinds that do the first counts when they are replaced; without candidates nothing is added; a
column that has the name of a result is kept as <name>_given; an empty table gives no rows; a very long text is searched
whole, in time linear in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import kept_names, restored, sheltered, text_of

BASE = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9\x20-]{13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is tried.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Words before a value that say what it is; a labeler looks this many code points back.
BACK = 24
#: Candidates of the further kinds: group 0 is the span.
LOOSE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
# Words that name a kind, and what values of a kind begin with.
GAZETTEER = {
    "national_id": r"(?i)\b(ssn|social|security|insurance|national|tax)\b",
    "secret": r"(?i)(token|secret|passw(or)?d|pwd|api_?key|access_?key|private_?key|auth|bearer|credential)s?\W*$",
}
SHAPE = {
    "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "secret": r"^([0-9a-f]{32,}|[0-9A-F]{32,}|(AKIA|ASIA)[A-Z0-9]{16}|(gh[pousr]_|sk-|xox[abp]-)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_=-]{20,})$",
}
CONTEXT = {"national_id": r"(?i)(no|number|id|nr|#|:|=)\W*$", "secret": r"[=:]\s*[\"']?$"}
ADDED = tuple(sorted(LOOSE))
KINDS = BASE + ADDED
RESULTS = ["spans", *(f"n_{k}" for k in BASE)]
#: Spans of a block, inside which running values are listed one after another.
BLOCK = 64
LABELERS = ("shape", "gazetteer", "context")
#: Buckets of the classifier's own features: length, and share of digits.
LENGTHS, DIGITS = (12, 24, 32, 48), (0.1, 0.3, 0.6, 0.95)


def running(values: Column, step, zero: int = 0) -> Column:
    """What step makes of all values before each; in blocks, so that the work follows the number of values."""
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / BLOCK).cast("int") - 1, F.lit(0))), lambda i: F.slice(values, i * BLOCK + 1, BLOCK))

    def scan(items: Column, start: Column, value) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, first, lambda acc, x: F.struct(step(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    starts = scan(blocks, F.lit(zero), lambda block: F.aggregate(block, F.lit(zero), lambda a, x: step(a, x)))
    return F.flatten(F.zip_with(blocks, starts, lambda block, start: scan(block, start, lambda x: x)))


def with_matches(docs: DataFrame, text: Column, pattern: str, worth: Column, out: str) -> DataFrame:
    """Adds out, array<struct<s, e, m>>: spans (code points, end exclusive) and texts of all matches, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    docs = docs.withColumn("_found", F.when(worth, found).otherwise(F.array().cast("array<string>")))
    pieces = F.when(F.size("_found") > 0, F.split(text, pattern, -1))
    sizes = F.zip_with(F.slice(pieces, 1, F.size("_found")), "_found", lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("l"), m.alias("m")))
    docs = docs.withColumn("_sizes", sizes)
    docs = docs.withColumn("_before", F.when(F.size("_found") > 0, running(F.transform("_sizes", lambda x: x["p"] + x["l"]), lambda a, x: a + x)))
    spans = F.zip_with("_sizes", "_before", lambda x, at: F.struct((at + x["p"]).alias("s"), (at + x["p"] + x["l"]).alias("e"), x["m"].alias("m")))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return docs.withColumn(out, F.when(F.size("_found") > 0, spans).otherwise(none)).drop("_found", "_sizes", "_before")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(backwards, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255"))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["m"])


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _email, _ip, _card and _phone: spans of the base kinds."""
    t = text_of(text)
    docs = docs.withColumn("_digits", t.rlike("[0-9]"))
    for kind in BASE:
        worth = F.contains(t, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
        worth = worth if kind == "email" else worth & F.col("_digits")
        if kind == "card":
            worth = worth & t.rlike(r"[0-9](?:[\x20-]?+[0-9]){12}")
        if kind == "ip":
            worth = worth & t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
        docs = with_matches(docs, t, PATTERNS[kind], worth, f"_{kind}")
        docs = docs.withColumn(f"_{kind}", F.filter(f"_{kind}", _keeps(kind)))
    return docs.drop("_digits")


def _overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))


def _votes(kind: str, text: Column, x: Column) -> Column:
    """A candidate with its labelers' votes (1, 0 or -1, an abstention) and its feature buckets."""
    before = F.substr(text, F.greatest(x["s"] - BACK, F.lit(0)) + 1, F.least(x["s"], F.lit(BACK)))
    named, told = before.rlike(GAZETTEER[kind]), before.rlike(CONTEXT[kind])
    digits = F.length(F.regexp_replace(x["m"], "[^0-9]", "")) / F.length(x["m"])
    return F.struct(
        F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"),
        x["m"].rlike(SHAPE[kind]).cast("int").alias("shape"),
        # a name nearby speaks for the kind; its absence says little
        F.when(named, 1).otherwise(-1).alias("gazetteer"),
        F.when(told, 1).otherwise(F.when(before.rlike(r"\w\s*$"), 0).otherwise(-1)).alias("context"),
        sum((F.length(x["m"]) >= v).cast("int") for v in LENGTHS).alias("length"),
        sum((digits >= v).cast("int") for v in DIGITS).alias("digits"),
    )


def _voter(kind: str, text: Column):
    return lambda x: _votes(kind, text, x)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _loose: candidates of the further kinds that overlap no base span, with votes and features."""
    t = text_of(text)
    base = F.concat(*[F.col(f"_{k}") for k in BASE])
    out = []
    for kind in ADDED:
        docs = with_matches(docs, t, LOOSE[kind], t.rlike(LOOSE[kind]), f"_loose_{kind}")
        # candidates without any digit are words
        found = F.filter(f"_loose_{kind}", lambda x: x["m"].rlike("[0-9]") & ~_overlaps(x, base))
        out.append(F.transform(found, _voter(kind, t)))
    return docs.withColumn("_loose", F.concat(*out)).drop(*[f"_loose_{k}" for k in ADDED])


def estimate(counts: dict[tuple, int], rounds: int = 50) -> dict[tuple, float]:
    """Probability of each vote pattern's candidates being real, by expectation maximisation.

    counts: how many candidates have each pattern of votes. Labelers are taken as independent given the truth;
    each has a rate of every vote in either class, with one pseudo-count that favours a vote for the truth.
    """
    p = {v: min(0.9, max(0.1, 0.5 + 0.2 * sum(1 if x == 1 else -1 if x == 0 else -0.5 for x in v))) for v in counts}
    n = sum(counts.values())
    for _ in range(rounds if n else 0):
        real = sum(p[v] * c for v, c in counts.items())
        rates = []
        for i in range(len(next(iter(counts)))):
            rates.append({})
            for vote in (-1, 0, 1):
                yes = sum(p[v] * c for v, c in counts.items() if v[i] == vote)
                all_ = sum(c for v, c in counts.items() if v[i] == vote)
                for truth, got, of in ((1, yes, real), (0, all_ - yes, n - real)):
                    rates[i][truth, vote] = (got + (2.0 if vote == truth else 0.5)) / (of + 3.0)
        prior = (real + 1) / (n + 2)
        for v in p:
            a = math.log(prior) + sum(math.log(rates[i][1, x]) for i, x in enumerate(v))
            b = math.log(1 - prior) + sum(math.log(rates[i][0, x]) for i, x in enumerate(v))
            p[v] = 1 / (1 + math.exp(min(500, b - a)))
    return p


def features(row) -> list[float]:
    """Of the classifier: a constant, the votes for and against, the buckets of length and digits."""
    votes = [float(row[x] == v) for x in LABELERS for v in (1, 0)]
    return [1.0, *votes, *[float(row["length"] == i) for i in range(len(LENGTHS) + 1)], *[float(row["digits"] == i) for i in range(len(DIGITS) + 1)]]


def train(rows: list[dict], rounds: int = 300, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic classifier for rows with their count n and estimated label p, by gradient steps."""
    xs = [(features(r), r["p"], r["n"]) for r in rows]
    n = sum(c for *_, c in xs)
    w = [0.0] * len(xs[0][0]) if xs else []
    for _ in range(rounds if n else 0):
        grad = [decay * x for x in w]
        for f, p, c in xs:
            z = sum(a * b for a, b in zip(w, f, strict=True))
            d = (1 / (1 + math.exp(-max(-500, min(500, z)))) - p) * c / n
            for i, b in enumerate(f):
                grad[i] += d * b
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def classifier(docs: DataFrame) -> dict[str, list[float]]:
    """Weights by kind, from the votes and features of all candidates: at most 27 x 25 counts a kind."""
    cells = docs.select(F.explode("_loose").alias("c")).groupBy(*[F.col(f"c.{x}").alias(x) for x in ("kind", *LABELERS, "length", "digits")]).count()
    rows = [r.asDict() for r in cells.collect()]
    model = {}
    for kind in ADDED:
        mine = sorted((r for r in rows if r["kind"] == kind), key=lambda r: [r[x] for x in (*LABELERS, "length", "digits")])
        votes: dict[tuple, int] = {}
        for r in mine:
            v = tuple(r[x] for x in LABELERS)
            votes[v] = votes.get(v, 0) + r["count"]
        p = estimate(votes)
        model[kind] = train([r | {"n": r["count"], "p": p[tuple(r[x] for x in LABELERS)]} for r in mine])
    return model


def _score(x: Column, w: list[float]) -> Column:
    if not w:
        return F.lit(-1.0)
    z = F.lit(w[0])
    at = 1
    for lab in LABELERS:
        for v in (1, 0):
            z, at = z + F.when(x[lab] == v, w[at]).otherwise(0.0), at + 1
    for name, n in (("length", len(LENGTHS) + 1), ("digits", len(DIGITS) + 1)):
        for i in range(n):
            z, at = z + F.when(x[name] == i, w[at]).otherwise(0.0), at + 1
    return z


def _accepts(kind: str, w: list[float]):
    return lambda x: (x["kind"] == kind) & (_score(x, w) > 0)


def _span(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with spans: array<struct<kind, s, e>>, by kind as listed in KINDS, then start; and n_<kind> of base kinds.

    A column of docs that has such a name becomes <name>_given.
    """
    inner, col = sheltered(docs)
    model = classifier(with_candidates(with_base(inner.select(col(text).alias("_text")), "_text"), "_text"))
    full = with_candidates(with_base(inner.withColumn("_text", col(text)), "_text"), "_text")
    parts = [F.transform(F.col(f"_{k}"), _span(k)) for k in BASE]
    parts += [F.transform(F.filter("_loose", _accepts(k, model[k])), _span(k)) for k in ADDED]
    counts = {f"n_{k}": F.size(f"_{k}").cast("bigint") for k in BASE}
    return restored(full.withColumns({"spans": F.concat(*parts)} | counts), docs.columns, RESULTS)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces each span of the text by its kind in angle brackets; overlapping spans go together, as the first.

    The text is cut at every BLOCK-th span first, so that no cut counts its code points from the start of the text.
    """
    names = docs.columns
    order = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    full = docs.withColumn("_order", F.when(F.size("spans") > 0, order))
    # where the spans before have ended: a span that starts earlier belongs to them
    full = full.withColumn("_at", F.when(F.size("spans") > 0, running(F.transform("_order", lambda x: x["e"]), lambda a, x: F.greatest(a, x))))
    cuts = F.zip_with("_order", "_at", lambda x, at: F.struct(at.alias("at"), x["s"].alias("s"), F.greatest(at, x["e"]).alias("to"), F.upper(x["kind"]).alias("kind")))
    full = full.withColumn("_cuts", F.filter(cuts, lambda x: x["s"] >= x["at"]))
    whole, n = F.col(text), F.size("_cuts")

    def block(i: Column) -> Column:
        some = F.slice("_cuts", i * BLOCK + 1, BLOCK)
        start = some[0]["at"]
        part = F.struct(F.substr(whole, start + 1, F.element_at(some, -1)["s"] - start).alias("t"), start.alias("from"), some.alias("cuts"))
        return F.concat_ws("", F.transform(F.array(part), lambda p: F.concat_ws("", F.transform(p["cuts"], lambda x: F.concat(F.substr(p["t"], x["at"] - p["from"] + 1, x["s"] - x["at"]), F.lit("<"), x["kind"], F.lit(">"))))))

    body = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), block))
    last = F.array_max(F.transform("_order", lambda x: x["e"]))
    done = F.concat(body, F.substr(whole, last + 1, F.length(whole)))
    return full.withColumn(text, F.when(F.size("spans") > 0, done).otherwise(whole)).select(*names)


def clean_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, with the spans that are found in the text replaced."""
    full = redact(find(docs, text), text)
    return full.select(*[F.col(n).alias(c) for n, c in zip(kept_names(docs.columns, RESULTS), docs.columns, strict=True)])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return docs.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
