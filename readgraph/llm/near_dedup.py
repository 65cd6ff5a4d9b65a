"""Near duplicates by ProbMinHash, banding and exact verification.

A text is a weighted set: its shingles of five words, each with its number of occurrences. Its signature
is drawn by Poisson processes. Every shingle sends arrivals at the rate of its weight, each to one of the
registers, by a random sequence that depends on the shingle alone; a register keeps the shingle whose
arrival came first. A shingle stops as soon as its next arrival would come after the latest first arrival
of all registers. Two texts agree in a register with the probability that is their probability Jaccard
similarity, sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i); for weights that are all
equal this is the Jaccard similarity.

1. Sketch: one pass over the texts. Texts with equal words are one node from here on.
2. Banding: nodes that agree in a band share a bucket.
3. Links: each member of a bucket is compared with the bucket's first, exactly. That settles a bucket of
   near copies of one text: pairs within it are never listed. Where a bucket's members are then still of
   several classes, those outside its largest class are compared with all of other classes. This is done
   in tiles of bounded size: within one, signatures tell the first band that two nodes share, in which they
   are compared exactly if they agree in enough registers, and one link is reported for two classes. No pair
   is a row.
4. Classes: connected components of the links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import carried, let_go, materialize

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold shares a bucket with probability 1 - (1 - 0.8**5)**20 = 0.9996.
BANDS, ROWS = 20, 5
#: Pairs in a tile that agree in less than this share of registers aren't compared: of pairs at the threshold less than 1 in
#: 500,000 does, a hundredth of those that share no bucket.
LEAST_AGREEMENT = 0.6
#: Members, and nodes to compare with them, in a tile, and bytes of either's shingle sets.
TILE, TILE_BYTES = 512, 16 << 20
#: Classes with more than this share of all rows are joined by broadcast: there are less than its inverse.
HOT_SHARE = 1 / 256
CACHE_WORDS = 400_000
WORDS = re.compile(r"\w+")
PRIME, GOLD, MASK = np.uint64(0x100000001B3), 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit function of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler(dict):
    """Words to hashes, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "little")
        if len(self) >= CACHE_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def words(self, text: str) -> list[str]:
        """Words in lower case without punctuation; the text's parts between spaces if it has no words."""
        return WORDS.findall(text.lower()) or text.split()

    def weighted(self, words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles, ascending, and how often each occurs; fewer words than ``size`` are one shingle."""
        if not words:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        w = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = min(size, len(words))
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h = mixed(h * PRIME + w[k : len(words) - n + 1 + k])
        return np.unique(h, return_counts=True)


def signature(shingles: np.ndarray, weights: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The shingle (32 bits of its hash) that arrives first at each register."""
    first = np.full(registers, np.inf)
    taken = np.zeros(registers, np.uint64)
    live, at, rate = shingles, np.zeros(len(shingles)), weights.astype(float)
    draw = 0
    while len(live):
        draw += 1
        r = mixed(live + np.uint64(draw * GOLD & MASK))
        at = at - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        register = (mixed(r) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, register, at)
        won = at == first[register]
        taken[register[won]] = live[won]
        going = at < first.max()
        live, at, rate = live[going], at[going], rate[going]
    return taken.astype("<u4")


def probability_jaccard(a: np.ndarray, a_weight: np.ndarray, b: np.ndarray, b_weight: np.ndarray) -> float:
    """Of two weighted sets given by ascending hashes."""
    common, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(common):
        return 1.0 if not len(a) and not len(b) else 0.0
    x, y = a_weight[i].astype(float), b_weight[j].astype(float)
    only_a, only_b = a_weight.sum() - x.sum(), b_weight.sum() - y.sum()
    total = 0.0
    ratio = x / y
    for r, times in zip(*np.unique(ratio, return_counts=True), strict=True):
        # sum over j of max(x_j, r * y_j), over x_i, for all common i of this ratio
        of = np.maximum(x, r * y).sum() + only_a + r * only_b
        mine = x[ratio == r]
        total += mine.sum() / of if times else 0.0
    return float(total)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, hash, node, signature`` of every row; node is a digest of the words."""
    read = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("hash", F.xxhash64("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        shingler = Shingler()
        for frame in frames:
            known: dict[bytes, bytes | None] = {}
            nodes = []
            for t in frame["t"]:
                words = shingler.words(t)
                node = hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()
                if node not in known:
                    shingles, weights = shingler.weighted(words)
                    known[node] = signature(shingles, weights).tobytes() if len(shingles) else None
                nodes.append(node)
            yield pd.DataFrame({"id": frame["id"], "hash": frame["hash"], "node": nodes, "signature": [known[n] for n in nodes]})

    return read.mapInPandas(run, "id long, hash long, node binary, signature binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``node, size, shingles, weights`` of ``node, t``: ascending 64-bit hashes and 32-bit counts, packed, and their bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        shingler = Shingler()
        for frame in frames:
            sets = [shingler.weighted(shingler.words(t)) for t in frame["t"]]
            yield pd.DataFrame({"node": frame["node"], "size": [12 * len(s) for s, _ in sets], "shingles": [s.tobytes() for s, _ in sets], "weights": [w.astype("<u4").tobytes() for _, w in sets]})

    return texts.mapInPandas(run, "node binary, size long, shingles binary, weights binary")


def similarity(a: bytes, a_weight: bytes, b: bytes, b_weight: bytes) -> float:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    return probability_jaccard(x, np.frombuffer(a_weight, "<u4").astype(np.int64), y, np.frombuffer(b_weight, "<u4").astype(np.int64))


def _parts(n) -> F.Column:
    return F.ceil(n / TILE).cast("int")


def _part(n) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(n)), F.col(n)).cast("int")


def pivot_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` of a pivot and a member of one of its buckets whose similarity reaches the threshold.

    The members of a pivot are dealt in parts by the size of their largest bucket. The pivot's set goes once to
    each part, ahead of the members, which pass by it one at a time.
    """
    asks = members.filter("node <> pivot").groupBy("pivot", "node").agg(_parts(F.max("n")).alias("parts"))
    asks = asks.select("pivot", _part("parts").alias("part"), "node", F.lit(True).alias("asks"))
    firsts = members.groupBy("pivot").agg(_parts(F.max("n")).alias("parts")).select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("node"), F.lit(False).alias("asks"))
    dealt = asks.unionByName(firsts).join(sets.drop("size"), "node").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "asks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        first = None
        for f in frames:
            found = []
            for pivot, node, member, *own in zip(f["pivot"], f["node"], f["asks"], f["shingles"], f["weights"], strict=True):
                if not member:
                    first = own
                elif similarity(*first, *own) >= threshold - 1e-12:
                    found.append((pivot, node))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="object")

    return dealt.mapInPandas(run, "a binary, b binary")


def tile_links(band: int, members: list[tuple], asked: list[tuple], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links between asked nodes and members of other classes, one for two classes.

    Both are rows of node, class, signature, shingles and weights.
    """
    parent: dict[bytes, bytes] = {}

    def root(c: bytes) -> bytes:
        while (up := parent.get(c, c)) != c:
            c = up
        return c

    table = np.stack([np.frombuffer(m[2], "<u4") for m in members])
    links = []
    for node, component, sig, shingles, weights in asked:
        same = table == np.frombuffer(sig, "<u4")
        shared = same.reshape(len(members), BANDS, ROWS).all(axis=2)
        share = same.mean(axis=1)
        likely = np.flatnonzero((share >= LEAST_AGREEMENT) & (shared.argmax(axis=1) == band) & shared[:, band])
        for k in likely[np.argsort(-share[likely], kind="stable")]:  # the likeliest first, as a link settles its class
            other = members[k]
            here, there = root(component), root(other[1])
            if here != there and similarity(shingles, weights, other[3], other[4]) >= threshold - 1e-12:
                links.append((node, other[0]))
                parent[max(here, there)] = min(here, there)
    return links


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_size, kept, __hash``: one row per row of ``docs``.

    Documents are linked when the probability Jaccard similarity of their shingles (five words, in lower
    case, without punctuation) is ``threshold`` or more, and a class is what links connect; class_id is its
    smallest key, and the document with that key is kept. A null text counts as empty; texts without words
    are alike, and texts of fewer than five words are one shingle. Rows with equal words are always of one
    class. Repeated rows share their fate; a null key is in a class as any other and is its name only if
    there is no other. An empty table gives an empty one; other columns are not read.
    """
    rows = materialize(sketch(docs, key, text), "near-sketch")
    nodes = materialize(
        rows.groupBy("node").agg(F.min(F.struct("id", "hash")).alias("r"), F.max("signature").alias("signature")).select("node", F.col("r.id").alias("rep_id"), F.col("r.hash").alias("rep_hash"), "signature"),
        "near-nodes",
    )
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.substr("signature", i * (4 * ROWS) + 1, F.lit(4 * ROWS))).alias("bucket")))
    banded = nodes.filter("signature IS NOT NULL").select("node", F.explode(each).alias("b")).select("node", "b.band", "b.bucket")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).filter("n > 1")
    members = materialize(banded.join(shared, "bucket"), "near-members")
    active = materialize(nodes.join(members.select("node").distinct(), "node", "left_semi"), "near-active")
    full = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).withColumn("hash", F.xxhash64("t"))
    own = full["id"].eqNullSafe(active["rep_id"]) & (full["hash"] == active["rep_hash"])
    texts = full.join(active.select("node", "rep_id", "rep_hash"), own).select("node", "t").dropDuplicates(["node"])
    sets = materialize(shingle_sets(texts), "near-sets")

    found = _links(members, active.select("node", "signature"), sets, threshold)
    named = rows.select("id", "hash", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "near-named")
    names = materialize(named.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "near-names")
    hot = F.broadcast(names.filter(F.col("class_size") > named.count() * HOT_SHARE))
    # the rows of a large class stay where they are
    out = named.join(hot, "component").unionByName(named.join(hot.select("component"), "component", "left_anti").join(names, "component"))
    return out.select(F.col("id").alias(key), "class_id", "class_size", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), F.col("hash").alias("__hash"))


def _links(members: DataFrame, signatures: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``node, component`` of the nodes that have links."""
    links = materialize(pivot_links(members, sets, threshold), "near-links")
    labels = components(links, "a", "b")

    # buckets in which nodes are of several classes, with the largest of these
    classed = members.select("node", "band", "bucket").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classed = materialize(classed.join(sets.select("node", "size"), "node"), "near-classed")
    sizes = classed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    mixed_buckets = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "size")).alias("m"), F.sum("n").alias("all"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k")).filter("k > 1 AND all > 2")
    by_bytes = lambda n: F.ceil(n / TILE_BYTES).cast("int")
    chunks = F.greatest(_parts(F.col("all")), by_bytes(F.col("bytes"))).alias("chunks")
    groups = F.greatest(_parts(F.col("all") - F.col("m.n")), by_bytes(F.col("bytes") - F.col("m.size"))).alias("groups")
    rows = materialize(classed.drop("size").join(mixed_buckets.select("bucket", F.col("m.component").alias("main"), chunks, groups), "bucket"), "near-tiled")
    if rows.isEmpty():
        return labels
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.select("bucket", "band", "node", "component", F.lit(False).alias("asks"), _part("chunks").alias("chunk"), every("groups").alias("group"))
    asking = rows.filter("component <> main").select("bucket", "band", "node", "component", F.lit(True).alias("asks"), every("chunks").alias("chunk"), _part("groups").alias("group"))
    keys = ["bucket", "chunk", "group"]
    dealt = held.unionByName(asking).join(signatures, "node").join(sets.drop("size"), "node").repartition(*keys).sortWithinPartitions(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        tile, at, band = ([], []), None, 0

        def done() -> pd.DataFrame:
            return pd.DataFrame(tile_links(band, *tile, threshold) if all(tile) else [], columns=["a", "b"], dtype="object")

        for f in frames:
            places = zip(f["bucket"], f["chunk"], f["group"], strict=True)
            rest = zip(f["band"], f["asks"], f["node"], f["component"], f["signature"], f["shingles"], f["weights"], strict=True)
            for place, (b, asks, *row) in zip(places, rest, strict=True):
                if place != at:
                    yield done()
                    tile, at, band = ([], []), place, b
                tile[asks].append(tuple(row))
        yield done()

    more = materialize(dealt.mapInPandas(run, "a binary, b binary"), "near-more")
    if more.isEmpty():
        return labels
    return components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class, the one with the smallest key; a null text comes back as it is."""
    kept = classes(docs, key, text, threshold).filter("kept").select(F.col(f"`{key}`").alias("__id"), F.col("__hash").alias("__h"), "class_id")
    # rows of one key and different texts may both bear their class's name: one of them stays
    chosen = kept.groupBy("class_id", "__id").agg(F.min("__h").alias("__h")).select("__id", "__h")
    numbered, named = carried(docs)
    keyed = docs.select(*numbered, F.col(f"`{key}`").alias("key"), F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("own"))
    joined = keyed.join(chosen, keyed["key"].cast("long").eqNullSafe(chosen["__id"]) & (keyed["own"] == chosen["__h"]), "left_semi")
    return joined.dropDuplicates(["key", "own"]).select(*named)
