"""Collocations, clusters and personal data on small tables, against plain versions."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

llm = pytest.importorskip("readgraph.llm")
from pyspark.sql import functions as F  # noqa: E402

from readgraph.llm import clusters, collocations, pii  # noqa: E402

# ---------------------------------------------------------------- collocations


def plain_phrases(rows, most, least, first, percent):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    key = lang, tuple(words[i : i + k])
                    f[key] = f.get(key, 0) + 1
    out = {}
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in many.items():
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = lambda x, w=w: any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))
        if not any(m == lang and len(x) > len(w) and inside(x) and 100 * b >= percent * a for (m, x), b in many.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:first]))


@pytest.mark.parametrize(("most", "budget"), [(3, 10**6), (3, 40), (4, 25)])
def test_collocations(spark, most, budget):
    """All sorts of texts; with a small budget prefixes are extended, up to whole leaves."""
    r = random.Random(most + budget)
    words = ["the", "of", "The", "a\x01b", "ça", "中", "x" * 50, "new", "york", "\xa0", "the\x1f"]
    weights = [9, 7, 3, 1, 1, 1, 1, 3, 3, 1, 1]
    text = lambda n: "".join(w + r.choice([" ", " ", "  ", "\t", " ", ". ", "\n", ",", "!"]) for w in r.choices(words, weights, k=n))
    rows = [(r.choice(["en", "en", "de", None]), text(r.randint(0, 60))) for _ in range(60)] + [("en", None), (None, ""), ("en", "  ,, \t"), ("en", text(4_000)), ("en", "new york " * 300), ("de", "same text"), ("de", "same text")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "lang string, text string, phrase string").repartition(5)
    got = collocations.mine(df, max_words=most, least=4, first=15, budget=budget)
    assert sorted(tuple(x) for x in got.collect()) == plain_phrases(rows, most, 4, 15, 50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_extended_prefixes_and_empty_tables(spark):
    plain = collocations.normalised(spark.createDataFrame([("en", "a b a c a b d")] * 30 + [("en", "rare words here")], "lang string, text string").repartition(4))
    extended, total, budget = collocations.extended_prefixes(plain, 3, 50, 100)
    assert (total, budget) == (213, 50) and [len(x) for x in extended] == [0, 2, 1]  # a and b are above 50, and a b
    assert collocations.extended_prefixes(plain, 3, 1, 2)[2] > 100  # so few may be extended that the budget rises
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


# ---------------------------------------------------------------- clusters


def plain_clusters(rows, k, rounds, dims, seed=3):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda x: (hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest(), x[0], x[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            if own := [v for (_, v), c in zip(kept, of, strict=True) if c == i]:
                centroids[i] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    return sorted((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in found)


def test_clusters(spark):
    r = np.random.default_rng(5)
    centers = r.normal(size=(6, 4))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 6] + 0.3 * r.normal(size=4)]) for i in range(400)]
    rows += [(7, rows[7][1]), (500, None), (501, [1.0, 2.0]), (502, [1.0, None, 0.0, 0.0]), (503, [float("nan")] + [0.0] * 3), (504, [float("inf")] + [0.0] * 3), (505, [0.0] * 4), (506, [0.0] * 4)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id bigint, embedding array<double>, cluster string").repartition(3)
    compared = []
    got = clusters.cluster(df, clusters=5, rounds=6, dimensions=4, report=compared)
    assert sorted(tuple(x) for x in got.collect()) == plain_clusters(rows, 5, 6, 4)
    assert compared[0] == 403 and max(compared[2:]) < 200  # the bounds spare most comparisons
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>")
    assert sorted(tuple(x) for x in clusters.cluster(few, dimensions=4).collect()) == plain_clusters(rows[:3], 8, 10, 4)
    assert clusters.cluster(df.limit(0), dimensions=4).count() == 0 == clusters.cluster(few.filter("false")).count()
    beyond = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 5.0])], "vec_id bigint, embedding array<double>")
    assert {x["vec_id"] for x in clusters.cluster(beyond, dimensions=2, clusters=1).collect()} == {2, None}


def test_no_point_of_a_sphere_comes_nearer_than_the_tight_drift():
    r = np.random.default_rng(1)
    below = 0
    for _ in range(300):
        old, new, center = (r.integers(-2000, 2000, 5) for _ in range(3))
        radius = float(r.uniform(1, 2500))
        bound = clusters.tight_drift(center, radius, old, new)
        full = float(np.linalg.norm(new - old))
        points = r.normal(size=(200, 5))
        points = center + radius * points / np.linalg.norm(points, axis=1, keepdims=True) * r.uniform(0, 1, (200, 1)) ** 0.2
        nearer = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        assert nearer.max() <= bound + 1e-6 and bound <= full
        below += bound < 0.9 * full
    assert below > 50
    assert clusters.tight_drift(np.zeros(3), 1.0, np.ones(3, int), np.ones(3, int)) == 0


# ---------------------------------------------------------------- personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(found)


def test_base_spans(spark):
    r = random.Random(8)
    parts = ["a@b.c-x_y@d.e", "@", ".", "..", "-", " ", "  ", "+", "1", "25", "255.0.0.1", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (509) 555-6973", "+12", "é", "😀", "x%y", "(", ")", "\n", "me@mail.example.com", "a" * 9, "9" * 13]
    texts = [None, "", "none here", *("".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(300))]
    texts += ["a" * 2_000, "1 " * 2_000, "9" * 2_000, "1." * 2_000, "a@" * 2_000, "x@y." * 2_000, "me@mail.example.com " * 2_000, "+1-" * 2_000, "same 1.2.3.4", "same 1.2.3.4"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, kind int").repartition(4)
    found = pii.find(df)
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {x["doc_id"]: x for x in found.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = plain_base(t or "")
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[1] == k for x in base) for k in range(4)], t and t[:80]
        written = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = [x for x in got[i]["spans"].split(",") if x]
        assert [x for x in spans if x.split(":")[0] in pii.BASE] == written and len(spans) == len(written) + got[i]["n_added"]
    assert pii.find(df.limit(0)).count() == 0
    keys = spark.createDataFrame([(None, "1.2.3.4"), (None, "1.2.3.4"), (1, None)], "doc_id bigint, text string")
    assert sorted(x["n_ip"] for x in pii.find(keys).collect()) == [0, 1, 1]


def test_very_long_runs_take_linear_time(spark):
    began = time.time()
    texts = [x * (400_000 // len(x)) for x in ("a", "1 ", "9", "1.", "a@", "x@y.", "me@mail.example.com ", "+1-", "Ab ", "(1) ")]
    got = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(got) == 10 and sorted(x["n_email"] for x in got)[-2:] == [20_000, 50_000] and time.time() - began < 120


def test_labelers_agree_on_further_spans(spark):
    r = random.Random(2)
    words = lambda n: " ".join(r.choice("the ereon tion anha with report house garden value river".split()) for _ in range(n))
    number = lambda: f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    cases = [lambda: ("phone: " + number(), 1), lambda: ("dear Maria Lopez", 1), lambda: (f"lives {r.randrange(1, 99)} Green River Street", 1), lambda: (number(), 1), lambda: ("order 12345678", 0), lambda: ("Tion Anha", 0), lambda: ("version 12.3.4.5678999", 0), lambda: (str(r.randrange(2 * 10**15, 3 * 10**15)), 0)]
    rows, truth = [], []
    for i in range(800):
        text, label = cases[i % 8]()
        rows.append((i, f"{words(r.randint(3, 12))} {text} {words(5)}"))
        truth.append(label and not plain_base(rows[-1][1]))
    report = {}
    got = {x["doc_id"]: x["n_added"] for x in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"), report=report).collect()}
    wrong = Counter(i % 8 for i in range(800) if (got[i] > 0) != bool(truth[i]))
    assert sum(wrong.values()) <= 16, wrong
    assert report["labelers"]["cue"] > 1 and report["labelers"]["format"] > 1


def test_reliabilities_are_learned_from_agreement():
    """Two labelers that are right nine times in ten, one that guesses."""
    r = random.Random(3)
    seen = Counter()
    for _ in range(20_000):
        y = r.random() < 0.3
        vote = lambda right, y=y: (1 if y else -1) * (1 if r.random() < right else -1)
        seen[4, (vote(0.9), vote(0.9), vote(0.5), vote(0.9), 0, 0)] += 1
    kinds, odds = pii.reliabilities([(k, v, n) for (k, v), n in sorted(seen.items())])
    share = 1 / (1 + np.exp(-kinds[4]))
    right = 1 / (1 + np.exp(-np.array(odds)))
    assert abs(share - 0.3) < 0.03 and np.allclose(right, [0.9, 0.9, 0.5, 0.9, 0.8, 0.8], atol=0.03)
