"""Personal data in texts: fixed patterns, and spans that several weak labelers and a classifier agree on.

DataFrame functions only. The base kinds are found by patterns. Looser patterns give candidates of further kinds
(``number``, ``person``, ``address``), on which labelers of three sorts vote for, against or not at all: patterns of
formats and checksums, gazetteers, and the words around. How reliable each labeler is isn't known, so expectation-
maximisation estimates it from how often they agree, over all candidates: what goes to the driver are the counts of vote
patterns, at most 3 kinds by 3^6. The votes' posteriors train
the final classifier, a Bayesian one over hashed features of form and context that sees no votes: for each of ``BUCKETS``
features a sum of posteriors over all candidates. What it accepts is added; what a base span touches is no candidate.

Positions come from the texts between matches: their lengths are added up by a window over the matches of a text, one row
a match, so a text with very many of them takes linear time and a text itself never moves.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "person", "address")
#: Words that end a street's name.
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Dr Boulevard Blvd Square Court Way Terrace"
#: The base patterns are the agreed ones; possessive, and begun only where a run begins (or a match ended), they take linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"\(?[0-9]++(?:[ .()-]{1,2}+[0-9]++)*+",
    "person": r"\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2}+",
    "address": r"(?<![0-9])[0-9]{1,5} (?:\p{Lu}[\p{L}'-]{1,30} ){1,3}(?:" + STREETS.replace(" ", "|") + r")\b",
}
BEFORE, AFTER = 40, 24
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
NUMBER_DIGITS = (7, 19)

#: Gazetteers and words of the labelers, in lower case.
FIRST_NAMES = """james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah
charles karen anna maria peter hans klaus ursula monika sabine pierre marie jean claude nathalie isabelle jose juan carlos carmen ana luis
ahmed fatima mohamed wei ming yuki olga ivan elena""".split()
NO_NAMES = """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november
december the this that these those chapter section table figure new north south east west united street avenue university""".split()
CUES = "phone telephone tel call mobile cell fax contact mail email card visa account iban ssn passport name mr mrs ms dr dear sir address lives"
COUNTER_CUES = "version isbn issn order invoice page pages figure table total price chapter section room year line row id item build"
UNITS = r"^ ?(?:%|€|\$|£|kg|km|cm|mm|mb|gb|ms|years?|pages?|items?|times|euros?|dollars?|people)"
FORMATS = r"^(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ -][0-9]{5,8})$"
NO_FORMATS = r"^(?:(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}|[0-9]{1,2}[.-][0-9]{1,2}[.-](?:19|20)?[0-9]{2}|[0-9]+\.[0-9]+|[0-9]{1,3}(?:\.[0-9]{3})+)$"

LABELERS = ("format", "checksum", "gazetteer", "cue", "unit", "unlikely")
#: How sure a labeler is taken to be before any data, and by how many cases; and the share of candidates that are personal data.
TRUST, CASES, SHARE, ROUNDS = 0.8, 50.0, {"number": 0.2, "person": 0.1, "address": 0.6}, 40
BUCKETS, BINS, LEAST_LOGIT = 4_096, 320, 0.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 19 digits pass Luhn's test."""
    back = F.reverse(digits)

    def add(total, i):
        x = F.substring(back, i, 1).cast("int")
        return total + F.when(i % 2 == 1, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))

    return F.when(F.length(digits).between(1, 19), F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0).otherwise(False)


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, id, kind, match, start, end, before, after``: all matches of ``PATTERNS``; one row with null kind for a text without any."""
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), content.alias("text"))
    found = found.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in PATTERNS.items()])
    found = found.select("*", *[F.when(F.size(k) > 0, F.split("text", p, -1)).alias(f"{k}_gaps") for k, p in PATTERNS.items()])

    def of(place: int, kind: str) -> Column:
        gap = lambda i: F.get(f"{kind}_gaps", i)
        one = lambda m, i: F.struct(F.lit(place).alias("kind"), i.alias("i"), F.length(gap(i)).cast("long").alias("gap"), m.alias("match"), F.right(gap(i), F.lit(BEFORE)).alias("before"), F.left(gap(i + 1), F.lit(AFTER)).alias("after"))
        return F.transform(kind, one)

    rows = found.select("row", "id", F.inline_outer(F.concat(*[of(i, k) for i, k in enumerate(KINDS)])))
    end = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("row", "id", "kind", "match", (end - F.length("match")).alias("start"), end.alias("end"), "before", "after")


def judged(found: DataFrame) -> DataFrame:
    """With ``digits``, ``base`` (a base span) and ``candidate`` (a candidate that no base span touches); failing matches are neither."""
    d = _digits(F.col("match"))
    n = F.length(d)
    sound = (
        F.when(F.col("kind") == 1, F.col("match").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(F.col("kind") == 2, n.between(12, 19) & luhn(d))
        .when(F.col("kind") == 3, n.between(9, 15))
        .when(F.col("kind") == 4, n.between(*NUMBER_DIGITS) & ~F.col("before").rlike(r"[\p{L}0-9_/=.#+-]$") & ~F.col("after").rlike(r"^[\p{L}0-9_/=#]"))
        .otherwise(True)
    )
    of_base = F.col("kind") < len(BASE)
    sure = lambda c: F.coalesce(c, F.lit(False))
    good = found.withColumn("digits", F.when(F.col("kind").isin(2, 3, 4), d)).withColumn("sound", sure(sound & F.col("kind").isNotNull())).withColumn("base", sure(of_base) & F.col("sound"))
    so_far = lambda *order: Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("base"), F.col("end"))).over(so_far("start", F.desc("base")))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(so_far(F.desc("start"), "base"))  # a frame that looks ahead would take the square of the rows
    touched = sure(before > F.col("start")) | sure(after < F.col("end"))
    return good.withColumn("candidate", F.col("sound") & ~F.col("base") & ~touched).drop("sound")


def _any(words: str) -> str:
    return "|".join(words.split())


def votes() -> dict[str, Column]:
    """1, 0 or -1 of each labeler."""
    kind = lambda *names: F.col("kind").isin(*[KINDS.index(k) for k in names])
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    match, digits, before, after = F.col("match"), F.col("digits"), F.lower("before"), F.col("after")
    n, words = F.length(digits), F.split(F.lower("match"), " ")
    is_in = lambda c, names: F.array_contains(F.lit(names), c)
    named = F.coalesce(F.arrays_overlap(words, F.lit(NO_NAMES)), F.lit(False))
    long = kind("number") & (n >= 12)
    differing = F.size(F.array_distinct(F.split(digits, "")))
    return {
        "format": vote(kind("address") | (kind("number") & match.rlike(FORMATS)), kind("number")),
        "checksum": vote(long & luhn(digits), long),
        "gazetteer": vote((kind("person") & is_in(words[0], FIRST_NAMES)) | (kind("address") & (F.size(words) >= 3)), kind("person")),
        "cue": vote(before.rlike(rf"(?<![\p{{L}}])(?:{_any(CUES)})[^\p{{L}}]{{0,4}}$"), before.rlike(rf"(?<![\p{{L}}])(?:{_any(COUNTER_CUES)})[^\p{{L}}]{{0,4}}$")),
        "unit": vote(F.lit(False), after.rlike(UNITS)),
        "unlikely": vote(F.lit(False), (kind("number") & ((differing <= 3) | match.rlike(NO_FORMATS) | match.contains("  "))) | (kind("person") & (named | (F.size(F.array_distinct(words)) < F.size(words))))),
    }


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[dict[int, float], list[float]]:
    """Log odds of each kind, and of each labeler's vote, from (kind, votes, count) by expectation-maximisation.

    Whether a labeler votes says nothing; that its vote is right has one probability, which is independent of the other
    votes, and at least a half. It begins with ``TRUST``, which counts as ``CASES`` cases throughout, as the shares of
    personal data do, so without candidates that is what comes out.
    """
    begin = {KINDS.index(k): s for k, s in SHARE.items()}
    shares, right = dict(begin), [TRUST] * len(LABELERS)
    for _ in range(rounds):
        weight = {k: [CASES * (1 - s), CASES * s] for k, s in begin.items()}
        agreed, voted = [CASES * TRUST] * len(LABELERS), [CASES] * len(LABELERS)
        for kind, vs, n in patterns:
            p = posterior(_logit(shares[kind]), [_logit(r) for r in right], vs)
            weight[kind][0] += n * (1 - p)
            weight[kind][1] += n * p
            for j, v in enumerate(vs):
                if v:
                    agreed[j] += n * (p if v > 0 else 1 - p)
                    voted[j] += n
        shares = {k: yes / (no + yes) for k, (no, yes) in weight.items()}
        right = [max(0.5, a / n) for a, n in zip(agreed, voted, strict=True)]
    return {k: _logit(s) for k, s in shares.items()}, [_logit(r) for r in right]


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def posterior(kind: float, odds: list[float], vs: tuple[int, ...]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, kind + sum(o * v for o, v in zip(odds, vs, strict=True))))))


def _posteriors(kinds: dict[int, float], odds: list[float]) -> Column:
    logit = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("kind")]
    for name, o in zip(LABELERS, odds, strict=True):
        logit += F.lit(o) * F.col(name)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))


def features() -> Column:
    """Buckets of a span's features: its form and the words around it, of its kind."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("match", r"[0-9]", "9"), r"\p{Lu}", "A"), r"\p{Ll}++", "a"), r"9{5,}", "9+")
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    parts = [
        F.concat(F.lit("shape "), shape),
        F.concat(F.lit("length "), F.floor(F.log2(F.length("match"))).cast("string")),
        F.concat(F.lit("digits "), F.coalesce(F.length("digits"), F.lit(0)).cast("string")),
        F.concat(F.lit("before "), word("before", r"(\p{L}++)[^\p{L}]*+$")),
        F.concat(F.lit("sign before "), F.right("before", F.lit(1))),
        F.concat(F.lit("after "), word("after", r"^[^\p{L}]*+(\p{L}++)")),
        F.concat(F.lit("sign after "), F.left("after", F.lit(1))),
        F.concat(F.lit("head "), word("match", r"^([\p{L}0-9]{1,12}+)")),
        F.concat(F.lit("tail "), word("match", r"([\p{L}0-9]{1,12})$")),
    ]
    return F.array(*[F.pmod(F.xxhash64("kind", p), F.lit(BUCKETS)).cast("int") for p in parts])


def fitted(bins: list[tuple[float, float, float]], steps: int = 50) -> tuple[float, float]:
    """The line a + b * x that fits log odds best to (x, yes, no), by Newton's method; held a little to the share of all and to a slope of 0.2, which is not below 0."""
    yes, no = sum(r[1] for r in bins) + 0.5, sum(r[2] for r in bins) + 0.5
    a0, b0 = math.log(yes / no), 0.2
    a, b = a0, b0
    for _ in range(steps):
        ga, gb, aa, ab, bb = a - a0, b - b0, 1.0, 0.0, 1.0
        for x, y, n in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
            g, h = p * (y + n) - y, p * (1 - p) * (y + n)
            ga, gb, aa, ab, bb = ga + g, gb + g * x, aa + h, ab + h * x, bb + h * x * x
        det = aa * bb - ab * ab
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        size = max(1.0, abs(da), abs(db) * 4)  # no leaps
        a, b = a - da / size, max(0.0, b - db / size)
    return a, b


def classifier(rows: DataFrame, p: Column) -> Column:
    """A span's log odds from its features, fitted to the posteriors ``p`` of all rows.

    A feature's weight is the log odds of the spans that have it, less those of all of its kind. As features
    depend on one another, a line is fitted to the weights' sum for each kind. Sums are of whole thousandths, so that reruns
    agree. The driver gets a row a bucket, and one for each kind and ``BINS`` bins of sums.
    """
    soft = F.round(p * 1000).cast("long")
    labelled = rows.select("kind", features().alias("f"), soft.alias("yes"), (1000 - soft).alias("no"))
    total = lambda df, *by: df.groupBy(*by).agg((F.sum("yes") / 1000).alias("yes"), (F.sum("no") / 1000).alias("no")).collect()
    share = {r["kind"]: (r["yes"] + 0.5) / (r["yes"] + r["no"] + 1) for r in total(labelled, "kind")}
    weights = [0.0] * BUCKETS
    for r in total(labelled.select("kind", F.explode("f").alias("f"), "yes", "no"), "kind", "f"):
        s = share[r["kind"]]  # smoothed towards it, so a feature that was hardly seen weighs nothing
        weights[r["f"]] += math.log((r["yes"] + 2 * s) / (r["no"] + 2 * (1 - s))) - _logit(s)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    of = lambda f: F.aggregate(f, F.lit(0.0), lambda t, x: t + F.get(table, x))
    binned = labelled.select("kind", F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), of(F.col("f")))) * (BINS / 80)).alias("bin"), "yes", "no")
    bins: dict[int, list] = {k: [] for k in share}
    for r in sorted(total(binned, "kind", "bin")):
        bins[r["kind"]].append(((r["bin"] + 0.5) * 80 / BINS, r["yes"], r["no"]))
    lines = {k: fitted(b) for k, b in bins.items()}
    logit = F.lit(None).cast("double")
    for k, (a, b) in lines.items():
        logit = F.when(F.col("kind") == k, F.lit(a) + F.lit(b) * of(features())).otherwise(logit)
    return logit


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", report: dict | None = None) -> DataFrame:
    """One row a document: the key, ``n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    Positions count code points, ends exclusive. ``spans`` lists base and added spans (kind:start:end) by start, then
    kind; ``base_sha256`` is the digest of the base ones alone. A null or empty text has none, and the digest of an empty
    list. Every row is its own result, so repeated rows, ties and null keys stay; an empty table gives an empty one; columns
    other than key and text are not read. Texts of any length are searched whole. ``report`` gets the labelers' log odds.
    """
    rows = materialize(judged(matches(docs, key, text)), "pii-matches")
    spans = rows.filter("candidate").select("*", *[v.cast("int").alias(name) for name, v in votes().items()])
    counted = spans.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # patterns: 3 * 3^6 at most
    kinds, odds = reliabilities(sorted((r["kind"], tuple(r[x] for x in LABELERS), r["n"]) for r in counted))
    if report is not None:
        report.update(kinds={KINDS[k]: x for k, x in kinds.items()}, labelers=dict(zip(LABELERS, odds, strict=True)))
    added = F.col("candidate") & (classifier(spans, _posteriors(kinds, odds)) > LEAST_LOGIT)
    chosen = rows.select("row", "id", "kind", "start", "end", "base", F.coalesce(added, F.lit(False)).alias("added"))
    span = F.struct("start", "kind", "end")
    n = lambda i: F.count_if(F.col("base") & (F.col("kind") == i))
    listed = lambda which: F.sort_array(F.collect_list(F.when(which, span)))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat(F.element_at(F.lit(list(KINDS)), s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    whole = chosen.groupBy("row", "id").agg(*[n(i).alias(f"n_{k}") for i, k in enumerate(BASE)], listed(F.col("base")).alias("b"), listed(F.col("base") | F.col("added")).alias("s"), F.count_if("added").alias("n_added"))
    return whole.select(F.col("id").alias(key), *[f"n_{k}" for k in BASE], F.sha2(written("b"), 256).alias("base_sha256"), written("s").alias("spans"), "n_added")
