"""Phrases of words that occur together more often than their parts suggest, from suffix trees built in parts.

Every word begins a suffix of its piece, truncated to ``max_words`` words: these are the leaves of a suffix tree of
that depth, and a phrase occurs as often as the leaves below its node say. The tree is partitioned vertically:

1. prefixes of one word are counted, and those with more suffixes than the budget are extended by a word, and again,
2. prefixes are put into groups by a hash, so many that a group's suffixes come to half the budget on average,
3. each task counts the leaves of its own rows, some words at a time, and sends each group one sorted, compressed run of
   them, so that a phrase that is everywhere arrives once each time,
4. each group's subtrees are built on their own, within the budget: the runs' leaves are sorted together, and a node's count
   is the sum of the leaves that begin with it.

A node above an extended prefix has its leaves in several groups, whose sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_WORDS, LEAST, FIRST, COVER_PERCENT = 3, 10, 2_000, 50
BREAKS = ".,;:!?\n\x0b\x0c\r"
#: Suffixes below one prefix, and twice the mean of a group's; and the most prefixes that may be extended, by length, as they are broadcast.
BUDGET, MOST_EXTENDED = 2_000_000, 500_000
#: Words that a task counts at a time.
AT_ONCE = 500_000
#: Bytes of texts that a task splits into words at a time; a longer text is split alone.
BYTES_AT_ONCE = 8_000_000
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 32


def normalised(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, text``: A to Z in lower case, words separated by spaces, pieces by line feeds."""
    plain = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), ascii_uppercase + "\t" + BREAKS, ascii_lowercase + " " + "\n" * len(BREAKS))
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), plain.alias("text"))


def _words(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """For each language the words of the batch's texts, and the number of the piece that each is in."""
    for lang in pc.unique(batch["lang"]):
        all_ = batch["text"].filter(pc.equal(batch["lang"], lang))
        part = np.cumsum(pc.binary_length(all_).to_numpy(zero_copy_only=False)) // BYTES_AT_ONCE
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(all_)]
        for start, stop in zip(bounds, bounds[1:], strict=False):
            parts = pc.split_pattern(pc.split_pattern(all_.slice(start, stop - start), "\n").flatten(), " ")
            words, piece = parts.flatten(), pc.list_parent_indices(parts)
            full = pc.not_equal(words, "")
            yield lang.as_py(), words.filter(full), piece.filter(full).to_numpy()


class Leaves:
    """Different leaves in order, as numbers of words in ``words`` from 1 on (0: none, the piece has ended), with their counts."""

    def __init__(self, words: pa.Array, columns: list[np.ndarray], counts: np.ndarray | None = None):
        """Of leaves in any order, each once or as often as ``counts``; equal ones are added up."""
        n, self.words, self._of_word = len(words) + 1, words, None
        if packs := n ** len(columns) < 2**63:
            key = columns[0].astype(np.int64)
            for c in columns[1:]:
                key = key * n + c
        if packs and counts is None:
            key.sort()
            starts = self._changes([key])
            self.counts, key = np.diff(starts, append=len(key)), key[starts]
            self.columns = []
            for _ in columns:
                key, c = np.divmod(key, n)
                self.columns.insert(0, c.astype(np.int32))
            return
        order = np.argsort(key) if packs else np.lexsort(columns[::-1])
        columns = [c[order].astype(np.int32) for c in columns]
        starts = self._changes(columns)
        self.columns, counts = [c[starts] for c in columns], np.ones(len(order), np.int64) if counts is None else counts[order]
        self.counts = np.add.reduceat(counts, starts) if len(starts) else counts

    @staticmethod
    def _changes(columns: list[np.ndarray]) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def nodes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first leaf of each node of k words, and the sum of all of its leaves."""
        starts = self._changes(self.columns[:k])
        sums = np.add.reduceat(self.counts, starts) if len(starts) else self.counts[:0]
        whole = self.columns[k - 1][starts] > 0
        return starts[whole], sums[whole]

    def hashes(self, lang: str, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the first k words of leaves, and the language."""
        columns = self.columns if at is None else [c[at] for c in self.columns]
        if self._of_word is None:
            self._of_word = pd.util.hash_array(np.array(["", *self.words.to_pylist()], object), categorize=False)
        found = np.full(len(columns[0]), pd.util.hash_array(np.array([lang], object), categorize=False)[0])
        for c in columns[:k]:
            found = (found ^ self._of_word[c]) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
        return found

    def phrases(self, k: int, at: np.ndarray) -> list[str]:
        columns = [self.words.take(pa.array(c[at] - 1)).to_pylist() for c in self.columns[:k]]
        return [" ".join(x) for x in zip(*columns, strict=True)]


def leaves_of(batches: Iterator[pa.RecordBatch], max_words: int) -> Iterator[tuple[str, int, Leaves]]:
    """Language, number of words and leaves, for at most ``AT_ONCE`` words at a time."""
    for batch in batches:
        for lang, words, piece in _words(batch):
            for start in range(0, len(words), AT_ONCE):
                n = min(AT_ONCE, len(words) - start)
                coded = words.slice(start, n + max_words - 1).dictionary_encode()
                order = pc.sort_indices(coded.dictionary)
                rank = np.empty(len(order), np.int32)
                rank[order.to_numpy()] = np.arange(1, len(order) + 1, dtype=np.int32)
                ids, own = rank[coded.indices.to_numpy()], piece[start : start + n + max_words - 1]
                columns = [ids[:n]]
                for k in range(1, max_words):
                    ahead = np.zeros(n, np.int32)
                    more = min(n, len(ids) - k)
                    if more > 0:
                        ahead[:more] = np.where(own[k : k + more] == own[:more], ids[k : k + more], 0)
                    columns.append(ahead)
                yield lang, n, Leaves(coded.dictionary.take(order), columns)


def extended_prefixes(plain: DataFrame, max_words: int, budget: int, most_extended: int) -> tuple[list[np.ndarray], int, int]:
    """For each length below ``max_words`` the hashes of the prefixes of more suffixes than the budget; the number of words; the budget.

    The budget is raised if so many prefixes could be above it that they couldn't be broadcast. Of each stretch of words
    only prefixes above their share of a quarter of the budget are reported, so their sums fall short by that at most:
    prefixes are extended from three quarters on, which are those above the budget and some more.
    """
    most = (plain.agg(F.sum(F.length("text") + 1)).head()[0] or 0) // 2 + 1  # words, each with what separates it from the next
    budget = max(budget, -(-most // most_extended))
    share = budget / 4 / most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, n, leaves in leaves_of(batches, max(1, max_words - 1)):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["k", "h", "n"])
            for k in range(1, max_words):
                at, sums = leaves.nodes(k)
                large = sums > share * n
                if large.any():
                    h = leaves.hashes(lang, k, at[large]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k), pa.int32()), pa.array(h), pa.array(sums[large])], names=["k", "h", "n"])

    sums = materialize(plain.mapInArrow(run, "k int, h bigint, n bigint").groupBy("k", "h").agg(F.sum("n").alias("n")), "phrase-prefixes")
    total = sums.filter("k = 0").agg(F.sum("n")).head()[0] or 0
    found: list[list[int]] = [[] for _ in range(max_words)]
    for k, h in sums.filter("k > 0").filter(F.col("n") > 0.75 * budget).select("k", "h").collect():  # fewer than 4 / 3 * total / budget for each k
        found[k].append(h)
    return [np.array(sorted(x), np.int64).astype(np.uint64) for x in found], total, budget


RUN = pa.schema([("group", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("numbers", pa.binary())])


def _squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _released(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed(leaves: Leaves, at: np.ndarray) -> tuple[bytes, bytes]:
    columns = [c[at] for c in leaves.columns]
    is_used = np.zeros(len(leaves.words) + 1, bool)
    for c in columns:
        is_used[c] = True
    is_used[0] = True
    place = (np.cumsum(is_used) - 1).astype("<i4")
    numbers = np.concatenate([*(place[c] for c in columns), leaves.counts[at].astype("<i4")])
    words = "\n".join(leaves.words.take(pa.array(np.flatnonzero(is_used)[1:] - 1)).to_pylist())
    return _squeezed(words.encode()), _squeezed(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())  # bytes of one rank together


def _unpacked(words: bytes, numbers: bytes, max_words: int) -> tuple[list[str], list[np.ndarray]]:
    flat = np.ascontiguousarray(np.frombuffer(_released(numbers), np.uint8).reshape(4, -1).T).view("<i4").ravel()
    *columns, counts = np.split(flat, max_words + 1)
    return _released(words).decode().split("\n"), [*columns, counts.astype(np.int64)]


def leaf_runs(plain: DataFrame, extended, n_groups: int, max_words: int) -> DataFrame:
    """``group, lang, words, numbers``: the leaves of each task's rows, in a run for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, _, leaves in leaves_of(batches, max_words):
            of = leaves.hashes(lang, 1)
            open_ = np.ones(len(of), bool)
            for k in range(1, max_words):
                open_ &= np.isin(of, extended.value[k])
                of = np.where(open_, leaves.hashes(lang, k + 1), of)
            group = (of % np.uint64(n_groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            parts = np.split(order, cuts) if len(order) else []
            rows = [(int(group[p[0]]), lang, *_packed(leaves, p)) for p in parts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RUN.types, strict=True)], schema=RUN)

    return plain.mapInArrow(run, "group int, lang string, words binary, numbers binary")


def subtree_nodes(runs: DataFrame, extended, max_words: int, least: int) -> DataFrame:
    """``lang, words, phrase, f`` of the nodes of each group's subtrees.

    A node that is whole in its group is left out below ``least``; the root (no words) and extended prefixes are parts,
    to be added up.
    """

    def build(table: pa.Table) -> pa.Table:
        by_lang: dict[str, list] = {}
        for lang, words, numbers in zip(*(table[c].to_pylist() for c in ("lang", "words", "numbers")), strict=True):
            by_lang.setdefault(lang, []).append(_unpacked(words, numbers, max_words))
        out: list[tuple[str, int, str, int]] = []
        for lang, runs_ in by_lang.items():
            coded = pa.array([w for words, _ in runs_ for w in words]).dictionary_encode()
            ids, at, columns = coded.indices.to_numpy() + np.int32(1), 0, []
            for words, numbers in runs_:
                own = np.concatenate([np.zeros(1, np.int32), ids[at : at + len(words)]])
                columns.append([own[c] for c in numbers[:-1]] + [numbers[-1]])
                at += len(words)
            *columns, counts = (np.concatenate(c) for c in zip(*columns, strict=True))
            leaves = Leaves(coded.dictionary, columns, counts)
            out.append((lang, 0, "", int(counts.sum())))
            for k in range(1, max_words + 1):
                at, sums = leaves.nodes(k)
                shown = sums >= least
                if k < max_words:
                    shown |= np.isin(leaves.hashes(lang, k, at), extended.value[k])
                out += zip([lang] * shown.sum(), [k] * shown.sum(), leaves.phrases(k, at[shown]), sums[shown].tolist(), strict=True)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "words", "phrase", "f"])

    found = runs.groupBy("group").applyInArrow(build, "lang string, words int, phrase string, f bigint")
    return found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, text: str = "text", lang: str = "lang", budget: int = BUDGET, most_extended: int = MOST_EXTENDED) -> DataFrame:
    """``lang, words, phrase, f`` of phrases of at most ``max_words`` words that occur ``least`` times, and each language's number of words as that of no words."""
    plain = normalised(docs, text, lang)
    extended, total, budget = extended_prefixes(plain, max_words, budget, most_extended)
    shared = docs.sparkSession.sparkContext.broadcast(extended)
    return subtree_nodes(leaf_runs(plain, shared, -(-2 * total // budget) + 1, max_words), shared, max_words, least).filter((F.col("f") >= least) | (F.col("words") == 0))


def mine(
    docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, first: int = FIRST, cover_percent: int = COVER_PERCENT,
    text: str = "text", lang: str = "lang", budget: int = BUDGET, most_extended: int = MOST_EXTENDED,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` phrases of 2 to ``max_words`` words.

    Texts are lower-cased in A to Z and split into pieces at punctuation and line ends, and those into words at spaces
    and tabs. A phrase occurs ``a`` times, and at least ``least``; cut in two where the parts bind least, its parts
    occur ``l`` and ``r`` times; ``score`` is floor(1000000 * a * a / (l * r)), in exact decimals. A phrase within a
    longer one that occurs in ``cover_percent`` of its cases or more is left out. Ties go by ``a``, then the phrase.

    A null text counts as empty, a null language as ``und``. Repeated rows count each. An empty table, or one without
    phrases, gives an empty result. Columns other than text and language are not read. Texts of any length are
    read whole.
    """
    nodes = materialize(phrase_counts(docs, max_words, least, text, lang, budget, most_extended), "phrase-nodes")
    phrases = nodes.filter("words >= 2")
    w = F.split("phrase", " ")
    sub = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), sub(F.lit(1), k).alias("first"), sub(k + 1, F.col("words") - k).alias("rest"))))
    parts = phrases.withColumn("w", w).select("lang", "phrase", F.col("f").alias("a"), cut.alias("c")).select("lang", "phrase", "a", "c.*")
    count = lambda name, f: nodes.filter("words >= 1").select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = parts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"])
    exact = {c: F.col(c).cast("decimal(18,0)") for c in "alr"}
    both = both.select("lang", "phrase", "a", "l", "r", "k", (exact["a"] * exact["a"] * F.lit(1_000_000).cast("decimal(7,0)")).alias("over"), (exact["l"] * exact["r"]).alias("under"))
    weakest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("m"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: sub(i, k))))
    longest = phrases.filter("words >= 3").withColumn("w", w).select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = weakest.join(longest, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a")))

    total = nodes.filter("words = 0").select("lang", F.col("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = free.join(total, "lang").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    # a language may hold all rows, so its first ones are taken in parts before they meet
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("place") <= first)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM starts, range(1, 4) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
candidates AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS j FROM candidates),
scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score FROM cuts c
           JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1:], ' ')
           QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.j) = 1),
longer AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, n.n, s.score
FROM scored s LEFT JOIN longer g USING (lang, phrase) JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1) n USING (lang)
WHERE g.longer IS NULL OR 100 * g.longer < 50 * s.a QUALIFY rank <= 2000
"""
