"""Toxicity: a sparse linear classifier that is regularised by counterfactuals.

Features are words and their beginnings; each counts twice, by number and by rate. In the labelled texts,
sentences with identity terms are rewritten with another term in each one's place, and the change of the score
is penalised while fitting. So a term alone earns no weight, however often it stands beside insults in the
sample; an L1 penalty keeps the rest sparse.

Terms are of two kinds. Listed ones are names of groups that people belong to; each is swapped for the next
of its list. Learned ones are words that the sample itself holds against a text although most of what mentions
them is harmless: more frequent in label 1 than chance allows, yet with most of their texts in label 0. Each is
swapped for a word that is as frequent and has no leaning.

The sample's texts stay in Spark: tasks count features, and then give the driver each text's counts of the
chosen features and the differences that swaps make.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, is_held_out, materialize
from .sampling import labelled_sample

#: The classifier is fitted on about so many labelled documents, and on at most so many sentences of each for the swaps.
SAMPLE, PAIRS_PER_TEXT = 6_000, 64
BEGINNINGS = (4, 5, 6, 7)
LEAST_DOCS, LEAST_Z, MOST_FEATURES = 4, 3.0, 20_000
L1, SWAP_PENALTY, STEPS = 3e-4, 4.0, 1_000
#: Learned terms: in so many texts at least, leaning to label 1 by so many deviations; and how much a word without leaning may lean.
TERM_DOCS, TERM_Z, MOST_TERMS = 20, 2.0, 500
NEUTRAL_Z, MOST_NEUTRAL = 0.5, 5_000
CACHE_WORDS, HELD_FEATURES = 400_000, 400_000
WORDS = re.compile(r"[^\W\d_]+")

#: Identity terms by kind; a term is swapped for the next of its list.
IDENTITY = [
    "women men girls boys".split(),
    "woman man girl boy".split(),
    "gay lesbian straight bisexual transgender queer heterosexual".split(),
    "muslims christians jews hindus buddhists atheists catholics sikhs".split(),
    "muslim christian jewish hindu buddhist atheist catholic sikh".split(),
    "black white asian latino hispanic arab african european".split(),
    "immigrants refugees foreigners natives migrants citizens".split(),
    "americans mexicans chinese russians germans french indians turks poles".split(),
    "old young elderly teenage".split(),
    "disabled blind deaf autistic".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden hindus buddhisten atheisten".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs hindous bouddhistes athées".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos hindúes budistas ateos".split(),
]
SWAP = {w: ws[(i + 1) % len(ws)] for ws in reversed(IDENTITY) for i, w in enumerate(ws)}


def of_word(word: str) -> list[str]:
    return ["=" + word] + ["^" + word[:k] for k in BEGINNINGS if len(word) > k]


def counts(text: str) -> tuple[Counter, int]:
    words = WORDS.findall(text.lower())
    return Counter(f for w in words for f in of_word(w)), len(words)


def values(count, n_words):
    """The two values of a feature: by number and by rate."""
    return np.log1p(count), np.log1p(200.0 * np.asarray(count) / np.maximum(n_words, 1))


def sparse(text: str, index: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Places and numbers of the features of ``index`` in a text, and its number of words."""
    found, n = counts(text)
    keep = sorted((index[f], c) for f, c in found.items() if f in index)
    return [j for j, _ in keep], [c for _, c in keep], n


def swapped_sentences(text: str, swaps: dict[str, str], most: int = PAIRS_PER_TEXT) -> list[tuple[str, str]]:
    """Sentences with terms, each with its counterfactual; of more than ``most``, so many at even distances."""
    found = [x for x in re.split(r"(?<=[.!?])\s+|\n", text.lower()) if any(w in swaps for w in WORDS.findall(x))]
    if len(found) > most:
        found = [found[i] for i in np.linspace(0, len(found) - 1, most).round().astype(int)]
    return [(x, WORDS.sub(lambda m: swaps.get(m[0], m[0]), x)) for x in found]


def difference(pair: tuple[str, str], index: dict[str, int]) -> tuple[list[tuple[int, int, int]], int]:
    """(place, number before, number after) of the features that a swap changes, and the number of words, which it doesn't."""
    (before, n), (after, _) = map(counts, pair)
    return [(index[f], before[f], after[f]) for f in sorted(before.keys() | after.keys()) if f in index and before[f] != after[f]], n


class _Rows:
    """A sparse matrix with two columns for each feature, of its places and numbers by row."""

    def __init__(self, n_rows: int, n_features: int, row, place, first, second=None):
        self.shape = (n_rows, 2 * n_features)
        row, place = np.asarray(row, int), np.asarray(place, int)
        self.row, self.col = np.concatenate([row, row]), np.concatenate([2 * place, 2 * place + 1])
        self.val = np.concatenate(first) if second is None else np.concatenate(first) - np.concatenate(second)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])


class SwapRegularised:
    """score = sigmoid(bias + number and rate of each feature, weighted)."""

    def __init__(self, bias: float = 0.0, weights: dict[str, tuple[float, float]] | None = None):
        self.bias, self.weights = bias, weights or {}
        self.swaps: dict[str, str] = {}
        #: Counterfactual pairs of sentences in the fit: all, those with a listed term, and those that change a feature. Of none the penalty is without effect.
        self.n_pairs = self.n_listed = self.n_acting = 0
        self._words: dict[str, tuple] = {}

    def __getstate__(self):
        return {**self.__dict__, "_words": {}}

    def solve(self, x: _Rows, y: np.ndarray, swaps: _Rows, names: list[str], swap_penalty: float) -> SwapRegularised:
        """Mean log loss of the rows ``x``, L1, and the mean squared change of the score over all pairs; rows of ``swaps`` are those that change it."""
        n, ones, m = len(y), y.sum(), max(self.n_pairs, 1)
        curve = lambda w: 2 * swap_penalty / m * swaps.back(swaps.times(w))
        v = np.ones(2 * len(names) + 1)
        for _ in range(30):  # the largest curvature, by power iteration
            v /= np.linalg.norm(v)
            u = x.times(v[:-1]) + v[-1]
            v = np.r_[x.back(u) / (4 * n) + curve(v[:-1]), u.sum() / (4 * n)]
        step = 0.9 / max(np.linalg.norm(v), 1e-9)
        w = ahead = np.zeros(2 * len(names))
        bias = bias_ahead = float(np.log(ones / (n - ones)))
        t = 1.0
        for _ in range(STEPS):  # accelerated proximal gradient
            p = 1 / (1 + np.exp(-np.clip(x.times(ahead) + bias_ahead, -40, 40)))
            r = (p - y) / n
            new = ahead - step * (x.back(r) + curve(ahead))
            new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
            new_bias = bias_ahead - step * r.sum()
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, bias_ahead = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
            w, bias, t = new, new_bias, t_new
        self.bias = float(bias)
        self.weights = {f: (float(w[2 * i]), float(w[2 * i + 1])) for i, f in enumerate(names) if w[2 * i] or w[2 * i + 1]}
        return self

    def _features(self, token: str) -> tuple[int, tuple[str, ...]]:
        """Number of words in a token, and the weighted features of them."""
        words = WORDS.findall(token.lower())
        found = len(words), tuple(f for w in words for f in of_word(w) if f in self.weights)
        if len(self._words) >= CACHE_WORDS:
            self._words.clear()
        if len(token) <= 64:
            self._words[token] = found
        return found

    def score(self, text: str) -> float:
        """The whole text, token by token; only features with a weight are counted."""
        known, n, count = self._words.get, 0, Counter()
        for token in text.split():
            words, features = known(token) or self._features(token)
            n += words
            if features:
                count.update(features)
        logit = self.bias
        for f, c in count.items():
            by_number, by_rate = values(c, n)
            logit += self.weights[f][0] * by_number + self.weights[f][1] * by_rate
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, docs, hits``: texts with each feature, and those of label 1."""

    def tally(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, hits = Counter(), Counter()
        listed = lambda: pd.DataFrame({"feature": list(docs), "docs": list(docs.values()), "hits": [hits[f] for f in docs]})
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                seen = counts(text)[0].keys()
                docs.update(seen)
                if label:
                    hits.update(seen)
                if len(docs) > HELD_FEATURES:
                    yield listed()
                    docs, hits = Counter(), Counter()
        yield listed()

    return sample.select("text", "label").mapInPandas(tally, "feature string, docs long, hits long").groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))


def learned_swaps(leaning: DataFrame) -> dict[str, str]:
    """Terms that the sample holds against harmless texts, each with a word as frequent that has no leaning (``feature, docs, hits, z`` in)."""
    words = leaning.filter(F.col("feature").startswith("=")).withColumn("feature", F.substr("feature", F.lit(2)))
    terms = words.filter((F.col("docs") >= TERM_DOCS) & (F.col("z") >= TERM_Z) & (2 * F.col("hits") < F.col("docs"))).orderBy(F.desc("z"), "feature").limit(MOST_TERMS).collect()
    neutral = words.filter((F.col("docs") >= LEAST_DOCS) & (F.abs("z") < NEUTRAL_Z)).orderBy(F.desc("docs"), "feature").limit(MOST_NEUTRAL).collect()
    return {t["feature"]: min(neutral, key=lambda w: (abs(w["docs"] - t["docs"]), w["feature"]))["feature"] for t in terms if neutral}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE, swaps: dict[str, str] | None = None, swap_penalty: float = SWAP_PENALTY) -> SwapRegularised:
    """Fitted on about ``sample`` labelled rows outside the held-out fold; ``swaps`` gives listed terms and what each is swapped for."""
    listed = SWAP if swaps is None else swaps
    taken = labelled_sample(docs, labels, "toxic", folds, held_out, sample)
    n, ones = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).head()
    if not 0 < ones < n:
        return SwapRegularised(float(np.log((ones + 1) / (n - ones + 1))))
    expected = F.col("docs") * (ones / n)
    leaning = materialize(feature_counts(taken).withColumn("z", (F.col("hits") - expected) / F.sqrt(expected * (1 - ones / n))), "toxic-features")
    chosen = leaning.filter((F.col("docs") >= LEAST_DOCS) & (F.abs("z") > LEAST_Z)).orderBy(F.desc(F.abs("z")), "feature").limit(MOST_FEATURES)
    names = [r["feature"] for r in chosen.select("feature").collect()]
    model = SwapRegularised()
    model.swaps = learned_swaps(leaning) | listed
    shared = docs.sparkSession.sparkContext.broadcast(({f: i for i, f in enumerate(names)}, model.swaps))

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, swaps_ = shared.value
        for frame in frames:
            rows = []
            for text in frame["text"]:
                pairs = swapped_sentences(text, swaps_)
                changed = [difference(p, index) for p in pairs]
                by_list = sum(any(w in listed for w in WORDS.findall(a)) for a, _ in pairs)
                flat = [(k, *c, n_words) for k, (cs, n_words) in enumerate(x for x in changed if x[0]) for c in cs]
                rows.append((*sparse(text, index), len(pairs), by_list, *([x[i] for x in flat] for i in range(5))))
            out = pd.DataFrame(rows, columns=["place", "number", "n", "pairs", "listed", "pair", "at", "before", "after", "words"])
            yield pd.concat([frame["doc_id"].astype(str), frame["label"], out], axis=1)

    ints = ", ".join(f"{c} array<int>" for c in ("pair", "at", "before", "after", "words"))
    found = taken.select("doc_id", "label", "text").mapInPandas(vectors, f"doc_id string, label int, place array<int>, number array<int>, n int, pairs int, listed int, {ints}").toPandas().sort_values("doc_id")
    model.n_pairs, model.n_listed = int(found["pairs"].sum()), int(found["listed"].sum())
    joined = lambda c: np.concatenate([np.asarray(x, int) for x in found[c]])
    each = [len(x) for x in found["place"]]
    x = _Rows(len(found), len(names), np.repeat(np.arange(len(found)), each), joined("place"), values(joined("number"), np.repeat(found["n"].to_numpy(), each)))
    of_text = [1 + max(p, default=-1) for p in found["pair"]]  # pairs that change something
    model.n_acting = sum(of_text)
    first = np.repeat(np.cumsum([0, *of_text[:-1]]), [len(p) for p in found["pair"]])
    words = joined("words")
    changes = _Rows(model.n_acting, len(names), first + joined("pair"), joined("at"), values(joined("before"), words), values(joined("after"), words))
    return model.solve(x, found["label"].to_numpy(float), changes, names, swap_penalty)


def score(docs: DataFrame, model: SwapRegularised, key: str = "doc_id", text: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Adds ``held_out, score, predicted`` to the rows of ``docs``, in place of columns of those names.

    Every row is scored by its whole text. A null or empty text has the score of the bias alone. Repeated
    rows and ties get the same score; a null key is not held out; an empty table gives an empty one. Labels
    of documents that are absent, or that are null, are not learned from; a sample with one label gives
    every text the same score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(series_iter: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for series in series_iter:
            yield pd.Series([own.score(t) for t in series], dtype="float64")

    scored = F.pandas_udf(run, "double")
    numbered, named = carried(docs, "held_out", "score", "predicted")
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(*numbered, is_held_out(F.col(f"`{key}`"), folds, held_out).alias("held_out"), scored(content).alias("score"))
    return found.select(*named, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
