"""Secrets in texts: fixed patterns, and strings that look drawn at random.

The base kinds are found by patterns. The kind ``random`` comes from two character Markov models, one of
random strings and one of ordinary identifiers: a run of characters, or else the best-scoring stretches of
it, are reported when the log-likelihood ratio of the two is high enough, in all and per character. Only
the characters that base spans cover are left out.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so this equals runs of any length, filtered
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: Runs that the models look at, of any length.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
CACHE_RUNS = 200_000
WIDEN, SEPARATORS = 12, "+/_-="
LONG = 20  # a run of so many characters with a digit is first looked at as a whole
LEAST_RATIO, LEAST_PER_CHAR = 12.0, 0.6
#: In a stretch a pair of characters adds at most so much, so that a few pairs rare in identifiers don't make a foreign word random.
MOST_PER_CHAR = 2.5
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="


class MarkovModel:
    """Order-1 chain over ``ALPHABET`` with additive smoothing; state 0 is the start, or any other character."""

    place = {c: i + 1 for i, c in enumerate(ALPHABET)}

    def __init__(self, samples, smoothing: float = 0.5):
        counts = np.full((len(ALPHABET) + 1,) * 2, smoothing)
        for s in samples:
            before = 0
            for c in s:
                now = self.place.get(c, 0)
                counts[before, now] += 1
                before = now
        self.log = np.log(counts / counts.sum(1, keepdims=True))


class RandomStrings:
    """Two models trained from labelled samples (string, 1 if random)."""

    def __init__(self, samples: list[tuple[str, int]]):
        both = [MarkovModel([s for s, label in samples if label == k]).log for k in (0, 1)]
        self.ratio_of = (both[1] - both[0]).tolist()
        self.gain_of = [[min(v, MOST_PER_CHAR) - LEAST_PER_CHAR for v in row] for row in self.ratio_of]
        self.least_length = math.ceil(LEAST_RATIO / MOST_PER_CHAR)  # shorter stretches can't reach LEAST_RATIO
        self._runs: dict[str, tuple[tuple[int, int], ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_runs": {}}

    def ratio(self, token: str) -> float:
        place, ratio_of, total, before = MarkovModel.place, self.ratio_of, 0.0, 0
        for c in token:
            now = place.get(c, 0)
            total += ratio_of[before][now]
            before = now
        return total

    def is_random(self, token: str) -> bool:
        r = self.ratio(token)
        return r >= LEAST_RATIO and r >= LEAST_PER_CHAR * len(token)

    def stretches(self, run: str) -> tuple[tuple[int, int], ...]:
        """(start, end) of what is random in a run: all of it, or the stretches whose ratio is largest above the least per character."""
        if len(run) < self.least_length:
            return ()
        found = self._runs.get(run)
        if found is None:
            long = len(run) >= LONG and any(c.isdigit() for c in run)
            found = ((0, len(run)),) if long and self.is_random(run) else tuple(self._widened(run))
            if len(run) <= 64:
                if len(self._runs) >= CACHE_RUNS:
                    self._runs.clear()
                self._runs[run] = found
        return found

    def _widened(self, run: str) -> Iterator[tuple[int, int]]:
        """Best stretches with up to WIDEN characters more, where a separator or the run's end is so near."""
        last = 0
        for start, end in self._best(run):
            before = next((k for k in range(start, max(last, start - WIDEN) - 1, -1) if k == last or run[k - 1] in SEPARATORS), start)
            last = next((k for k in range(end, min(len(run), end + WIDEN) + 1) if k == len(run) or run[k] in SEPARATORS), end)
            yield before, last

    def _best(self, run: str) -> Iterator[tuple[int, int]]:
        """Running sums from where they are above zero; a stretch ends at its largest sum, when the sum is back at zero or has lost LEAST_RATIO."""
        place, gain_of = MarkovModel.place, self.gain_of
        states = [0, *(place.get(c, 0) for c in run)]
        i = start = end = 0
        total = top = 0.0
        while True:
            if i < len(run):
                total += gain_of[states[i]][states[i + 1]]
                i += 1
                if total > top:
                    top, end = total, i
                    continue
                if total > 0 and top - total < LEAST_RATIO:
                    continue
            if top + LEAST_PER_CHAR * (end - start) >= LEAST_RATIO:
                yield start, end
                i = end  # what comes after it may hold another one
            elif i < len(run) and total > 0:
                continue
            elif i >= len(run):
                return
            start = end = i
            total = top = 0.0


#: Words of ordinary identifiers and paths, from which the default sample is put together.
WORDS = """account action active address admin agent alert alias amount api app archive array asset async attr audio auth author average
backup balance base batch billing binary block body bool border bucket buffer build button bytes cache call cancel card cart case category
center channel char chart check child class clean click client close cloud cluster code color column command comment commit common config
connect content context control cookie copy core count country create credit current custom data date debug default delete detail device
digest directory disk display document domain download draft driver edit element email enable encode end engine entry error event example
export extend external factory feature field file filter final first flag float folder font form format frame function gateway general
global graph group handle hash head header height hidden history home host html http icon image import index info init input insert instance
integer internal item json key label language last layer layout length level library limit line link list load local lock log login main
manager map mask master match member memory menu message meta method metric mode model module month mount move name network next node
notify null number object offset open option order output owner package page panel param parent parse partition path payment pending period
person phone pixel player plugin point policy pool port position post prefix preview price print private process product profile project
property provider proxy public query queue random range rate read record region release remote remove render report request reset resource
response result return review role root route row rule run sample save scale schema scope screen script search section security select send
sequence server service session setting shape share signal simple size sort source space stack start state static status step storage store
stream string struct style submit sum support switch sync system table tag target task temp template test text theme thread time title total
track transaction transfer tree type unit update upload url user utility valid value variable vector version video view visible width window
worker write year zone""".split()


def default_samples(n: int = 4_000, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled samples made by rule: random strings over usual alphabets; words joined as identifiers are."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for _ in range(n):
        out.append(("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), 1))
        words = rng.choices(WORDS, k=rng.randint(2, 7))
        style = rng.randrange(6)
        if rng.random() < 0.5:
            words.insert(rng.randint(1, len(words)), str(rng.choice([rng.randrange(100), rng.randrange(1900, 2100), 10 ** rng.randrange(1, 9), 20_000_101 + rng.randrange(300_000)])))
        joined = ("_".join(words), "-".join(words), "/".join(words), "".join(words), "".join(w.capitalize() for w in words), "_".join(words).upper())[style]
        out.append((joined, 0))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end), in order; leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], model: RandomStrings) -> list[tuple[int, int, int]]:
    found, k = [], 0
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < model.least_length:
            continue
        while k < len(base) and base[k][2] <= m.start():  # a run's end may be within a base span that holds the next
            k += 1
        at, parts = m.start(), []
        for start, _, end in itertools.islice(base, k, None):
            if start >= m.end():
                break
            if start > at:
                parts.append((at, start))
            at = max(at, end)
        if at < m.end():
            parts.append((at, m.end()))
        for a, b in parts:
            found += [(a + start, 3, a + end) for start, end in model.stretches(text[a:b])]
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, text: str = "text", samples: list[tuple[str, int]] | None = None) -> DataFrame:
    """Adds ``n_assign, n_access, n_hex, base_sha256, spans, n_random`` to the rows, without ``text``.

    Positions count code points, ends exclusive. ``spans`` lists base and random spans by start, then
    kind. A null or empty text has none, and the digest of an empty list. Every row is its own result:
    repeated rows and ties stay, an empty table gives an empty one, other columns pass through, and columns
    of the added names are replaced. Texts of any length are scanned whole.
    """
    model = RandomStrings(samples or default_samples())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"]

    def run(series_iter: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = shared.value
        for series in series_iter:
            rows = []
            for value in series:
                base = base_spans(value)
                more = random_spans(value, base, found)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more)), len(more)))
            yield pd.DataFrame(rows, columns=added)

    udf = F.pandas_udf(run, "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string, n_random: bigint>")
    numbered, named = carried(docs, text.lower(), *added)
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(*numbered, udf(content).alias("found")).select(*named, "found.*")
