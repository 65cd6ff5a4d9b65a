"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters run over the
embedded bytes of a chunk and are max-pooled; a hidden layer turns the maxima into a few chunk features,
and the features' maximum and mean over the chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, is_held_out, let_go
from .sampling import labelled_sample

CHUNK, STRIDE, WIDTH, DIM, FILTERS, HIDDEN = 256, 224, 8, 4, 24, 16
PAD = 256
#: The network is fitted on about so many labelled documents, each by at most so many chunks, spread over all of it.
SAMPLE, SAMPLE_CHUNKS = 4_000, 128
EPOCHS, BATCH, RATE, SEED = 6, 32, 4e-3, 11
#: A small sample is gone over until so many steps are made.
LEAST_STEPS = 200
BLOCK = 64  # chunks at a time, so that the windows stay in the processor's cache


def chunks(text: str) -> np.ndarray:
    """All chunks of a text, one row each; an empty text has one chunk of padding."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = 1 + max(0, -(-(len(data) - CHUNK) // STRIDE))
    padded = np.full((n - 1) * STRIDE + CHUNK, PAD, np.int16)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STRIDE]


def spread(rows: np.ndarray, most: int = SAMPLE_CHUNKS) -> np.ndarray:
    """At most so many rows, at even distances from the first to the last."""
    return rows if len(rows) <= most else rows[np.linspace(0, len(rows) - 1, most).round().astype(int)]


class ByteConvNet:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "bytes": f32(PAD + 1, DIM, scale=0.5),
            "filters": f32(WIDTH * DIM, FILTERS, scale=(WIDTH * DIM) ** -0.5),
            "filter_bias": np.zeros(FILTERS, np.float32),
            "hidden": f32(FILTERS, HIDDEN, scale=FILTERS**-0.5),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": f32(2 * HIDDEN, scale=HIDDEN**-0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def windows(self, ids: np.ndarray) -> np.ndarray:
        x = self.p["bytes"][ids]
        n, length, dim = x.shape
        s = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - WIDTH + 1, WIDTH * dim), (s[0], s[1], s[2]))

    def convolve(self, ids: np.ndarray) -> np.ndarray:
        """Filter, chunk, position."""
        w = self.windows(ids)
        return (self.p["filters"].T @ w.reshape(-1, w.shape[2]).T).reshape(FILTERS, w.shape[0], w.shape[1])

    def features(self, ids: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.convolve(ids).max(axis=2).T + self.p["filter_bias"], 0)
        return np.maximum(pooled @ self.p["hidden"] + self.p["hidden_bias"], 0)

    def scores(self, texts) -> np.ndarray:
        """Probabilities of label 1; texts of any length, ``BLOCK`` chunks in memory at a time."""
        texts = list(texts)
        top, total = np.zeros((len(texts), HIDDEN), np.float32), np.zeros((len(texts), HIDDEN), np.float64)
        count = np.zeros(len(texts))
        waiting, owners, held = [], [], 0

        def flush():
            nonlocal waiting, owners, held
            if held:
                owner = np.concatenate(owners)
                z = self.features(np.concatenate(waiting))
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                who = owner[first]
                top[who] = np.maximum(top[who], np.maximum.reduceat(z, first))
                total[who] += np.add.reduceat(z.astype(np.float64), first)
            waiting, owners, held = [], [], 0

        for i, text in enumerate(texts):
            rows = chunks(text)
            count[i] = len(rows)
            for at in range(0, len(rows), BLOCK):
                part = rows[at : at + BLOCK]
                if held + len(part) > BLOCK:
                    flush()
                waiting.append(part)
                owners.append(np.full(len(part), i))
                held += len(part)
        flush()
        logit = np.hstack([top, total / np.maximum(count, 1)[:, None]]) @ self.p["out"].astype(np.float64) + float(self.p["out_bias"][0])
        # the last bits of 32-bit sums depend on which chunks were summed together
        return np.round(1 / (1 + np.exp(-np.clip(logit, -40, 40))), 6)

    def _step(self, rows: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss of some texts, each given by its chunks."""
        p, ids = self.p, np.concatenate(rows)
        start = np.cumsum([0] + [len(r) for r in rows[:-1]])
        count = np.array([len(r) for r in rows], np.float32)[:, None]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        best = np.empty((len(ids), FILTERS), np.int64)
        peak = np.empty((len(ids), FILTERS), np.float32)
        for at in range(0, len(ids), BLOCK):
            conv = self.convolve(ids[at : at + BLOCK])
            best[at : at + BLOCK] = conv.argmax(axis=2).T
            peak[at : at + BLOCK] = conv.max(axis=2).T
        pooled = np.maximum(peak + p["filter_bias"], 0)
        z = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
        top, mean = np.maximum.reduceat(z, start), np.add.reduceat(z, start) / count
        both = np.hstack([top, mean])
        score = 1 / (1 + np.exp(-np.clip(both @ p["out"] + p["out_bias"], -40, 40)))
        g_out = ((score - y) / len(y)).astype(np.float32)
        g_both = g_out[:, None] * p["out"]
        is_top = z == top[owner]
        g_z = (g_both[:, :HIDDEN][owner] * is_top + (g_both[:, HIDDEN:] / count)[owner]) * (z > 0)
        g_pooled = (g_z @ p["hidden"].T) * (pooled > 0)
        live = np.nonzero(g_pooled)
        g = g_pooled[live]
        place = best[live][:, None] + np.arange(WIDTH)
        byte = ids[live[0][:, None], place].astype(np.int64)
        window = p["bytes"][byte].reshape(len(g), -1)
        g_filters = np.zeros_like(p["filters"])
        g_bytes = np.zeros_like(p["bytes"])
        for f in range(FILTERS):
            mine = live[1] == f
            g_filters[:, f] = g[mine] @ window[mine]
        g_window = (g[:, None] * p["filters"].T[live[1]]).reshape(-1, DIM)
        for d in range(DIM):
            g_bytes[:, d] = np.bincount(byte.ravel(), g_window[:, d], PAD + 1)
        return {
            "bytes": g_bytes, "filters": g_filters, "filter_bias": g_pooled.sum(0), "hidden": pooled.T @ g_z,
            "hidden_bias": g_z.sum(0), "out": both.T @ g_out, "out_bias": g_out.sum(keepdims=True),
        }

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteConvNet:
        """Adam over shuffled batches of texts, given by their chunks, with a falling rate; it sets out from the labels' shares."""
        y = np.asarray(labels, np.float32)
        self.p["out_bias"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        epochs = max(epochs, -(-LEAST_STEPS * BATCH // len(rows)))
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps = epochs * -(-len(rows) // BATCH)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                grads = self._step([rows[i] for i in pick], y[pick])
                t += 1
                rate = RATE * (1 - (t - 1) / steps)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


class Constant:
    """What a sample without both labels allows: one smoothed share for every text."""

    def __init__(self, labels: np.ndarray):
        self.share = (float(np.sum(labels)) + 1) / (len(labels) + 2)

    def scores(self, texts) -> np.ndarray:
        return np.full(len(list(texts)), self.share)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = SAMPLE):
    """Fitted on about ``sample`` labelled rows outside the held-out fold; the driver gets at most SAMPLE_CHUNKS chunks of each."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype(str), "label": frame["label"], "rows": [spread(chunks(t)).tobytes() for t in frame["text"]]})

    taken = labelled_sample(docs, labels, "quality", folds, held_out, sample)
    found = taken.mapInPandas(cut, "doc_id string, label int, rows binary").toPandas().sort_values("doc_id")  # so that reruns agree
    y = found["label"].to_numpy()
    if len(set(y)) < 2:
        return Constant(y)
    return ByteConvNet().fit([np.frombuffer(r, np.int16).reshape(-1, CHUNK) for r in found["rows"]], y)


def score(docs: DataFrame, model, key: str = "doc_id", text: str = "text", folds: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """Adds ``held_out, score, predicted`` to the rows of ``docs``, in place of columns of those names.

    Every row is scored by its whole text. Null counts as empty, and an empty text gets the score of a chunk
    of padding. Repeated rows and ties get the same score; a null key is not held out; an empty table gives
    an empty one. Labels of documents that are absent, or that are null, are not learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(series_iter: Iterator[pd.Series]) -> Iterator[pd.Series]:
        let_go()
        for series in series_iter:
            yield pd.Series(shared.value.scores(series), dtype="float64")

    scored = F.pandas_udf(run, "double")
    numbered, named = carried(docs, "held_out", "score", "predicted")
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(*numbered, is_held_out(F.col(f"`{key}`"), folds, held_out).alias("held_out"), scored(content).alias("score"))
    return found.select(*named, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
