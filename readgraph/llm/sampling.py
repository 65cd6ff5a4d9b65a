"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, materialize

HASH_BITS = 60


def hashed(value) -> F.Column:
    """A number of HASH_BITS bits, evenly spread."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def below(value, share: float) -> F.Column:
    """Whether a value's hash is within this share of all hashes."""
    return hashed(value) < F.lit(int(min(share, 1.0) * 2**HASH_BITS))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """About ``most`` rows ``doc_id, text, label`` (all, if fewer), with whole texts, written to the shared folder.

    Labelled rows are counted, and those below a threshold of a hash of their id are taken, so their number
    is ``most`` give or take a few times its root. They are broadcast to one pass over the documents. Rows with a null id or label, or with an id of the held-out fold,
    are not used. An id counts once, by its smallest label and text. Nothing is sent to the driver.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id"), folds, held_out))
    n = known.count()
    candidates = known.filter(below(F.col("doc_id"), most / max(n, 1))).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(candidates), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return materialize(found, f"sample-{label}")
