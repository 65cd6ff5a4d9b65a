"""Exact duplicates by skew-safe combining, with DataFrame functions only.

Equal texts are combined in three stages, and each compares digest and full text:

1. locally: the map side of the first aggregation keeps one row per digest, salt and text of a task,
2. by salt: a digest's rows meet in one of ``salts`` groups by the task that they come from. A task gives
   one row for a text that a third of all rows hold, and these are spread over as many tasks,
3. globally: at most ``salts`` winners of a text meet and leave the final one.

The result of stage 3 (one small row for each digest, without text) is written to the shared folder.
Each document then finds its group by digest; Spark's skew join splits the rows of a large group. Two
texts under one digest are told apart by stage 3; their documents are matched by digest and text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import materialize

SALTS = 64


def sha256_binary(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _texts(docs: DataFrame, key: str, text: str, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").alias("__id"), content.alias("__text"), digest(content).alias("__digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256_binary, salts: int = SALTS) -> DataFrame:
    """One row per different text: ``__digest, __text, keep_id, group_size``."""
    salted = _texts(docs, key, text, digest, salts).groupBy("__digest", "__salt", "__text").agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.repartition(F.col("__digest")).groupBy("__digest", "__text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def annotate(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256_binary, salts: int = SALTS) -> DataFrame:
    """One row per document: the key, ``keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest key stays. A null text counts as empty. A null key is
    smaller than any other; a group of null keys only has a null ``keep_id`` and keeps those rows.
    Repeated rows with one key are one document and share its fate, each counted in ``group_size``.
    An empty table gives an empty one; columns other than key and text are not read.
    """
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`"), digest(content).alias("__digest"))
    found = materialize(
        groups(docs, key, text, digest, salts)
        .groupBy("__digest")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("__texts")),
        "exact-groups",
    )
    out = rows.join(found.filter("__texts = 1").drop("__texts"), "__digest")
    several = found.filter("__texts > 1").select("__digest")
    if not several.isEmpty():  # different texts with one digest
        full = docs.select(F.col(f"`{key}`"), content.alias("__text"), digest(content).alias("__digest")).join(several, "__digest", "left_semi")
        own = groups(docs, key, text, digest, salts).join(several, "__digest", "left_semi")
        out = out.unionByName(full.join(own, ["__digest", "__text"]).drop("__text"))
    # the digest of the operator may be another than SHA-256, which is always reported
    sha = F.lower(F.hex("__digest")) if digest is sha256_binary else F.lit(None).cast("string")
    return out.select(F.col(f"`{key}`"), "keep_id", "group_size", F.col(f"`{key}`").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256_binary, salts: int = SALTS) -> DataFrame:
    """The rows that stay, whole: exactly one row of each different text, the one with the largest key.

    The text itself is the grouping key and the row's other columns travel beside it, so no join back is
    needed. Rows that tie in the key are ordered by their other columns (those of a type with an order).
    A null text comes back as empty.
    """
    rest = [c for c in docs.columns if c not in (key, text)]
    orderable = [c for c, t in docs.dtypes if c in rest and "map<" not in t and "variant" not in t]
    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(orderable)])
    payload = F.struct(F.col(f"`{key}`").alias("k"), *[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(rest)])
    texts = docs.select(digest(content).alias("__digest"), F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"), content.alias("__text"), row.alias("__order"), payload.alias("__row"))

    def best(grouped):
        return grouped.agg(F.max_by("__row", "__order").alias("__row"), F.max("__order").alias("__order"))

    won = best(best(texts.groupBy("__digest", "__salt", "__text")).groupBy("__digest", "__text"))
    place = {c: f"__row.p{i}" for i, c in enumerate(rest)} | {key: "__row.k", text: "__text"}
    return won.select(*[F.col(place[c]).alias(c) for c in docs.columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
