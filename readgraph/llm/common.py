"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..plans.lineage import materialize

__all__ = ["carried", "held", "is_held_out", "let_go", "materialize", "table"]

#: What this process, a worker, holds between its tasks: the tables of one call of an operator.
_held: tuple[str, Any] | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``, is ``fold``; false where doc_id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def carried(docs: DataFrame, *but: str) -> tuple[list[Column], list[Column]]:
    """All columns but the named ones (in any case): numbered, so that no name is in an operator's way, and then under their names again."""
    names = [c for c in docs.columns if c.lower() not in but]
    return [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]


def held(call: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, once a worker for all its tasks of a call. Spark gives a worker one operator's tasks after another's, so those of another call are freed first."""
    global _held
    if _held is None or _held[0] != call:
        let_go()
        _held = call, build()
    return _held[1]


def let_go() -> None:
    """Frees what a worker holds; for tasks of operators that hold nothing."""
    global _held
    _held = None
