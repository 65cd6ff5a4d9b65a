"""Cutting lineage by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Folders that this process has written, by application; and those that are kept for a whole session, by name.
_written: dict[str, list[str]] = {}
_kept: dict[tuple[str, str], str] = {}
#: The catalogue's names of folders that are tables in buckets.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the session has none (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="readgraph-")
        sc.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder's path in the shared folder, noted for ``release``."""
    path = f"{shared_dir(spark)}/readgraph-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Spark's switch for dropping an execution's shuffle files as soon as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs within drops its shuffle files as it ends: nothing that is written or counted here is run a second time."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def write(df: DataFrame, path: str) -> None:
    """``df`` as Parquet in zstd; its shuffle files go at once."""
    with short_lived_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor repeats only what follows. The folder may be
    removed as soon as the results built on it have been written (``release``).
    """
    path = new_folder(df.sparkSession, name)
    write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """``materialize``, and the number of rows (or another aggregate), observed as they are written."""
    seen = Observation()
    found = materialize(df.observe(seen, (F.count(F.lit(1)) if what is None else what).alias("n")), name)
    return found, seen.get["n"] or 0


def bucketed(df: DataFrame, name: str, buckets: int, *columns: str) -> DataFrame:
    """As ``materialize``, in a number of buckets by columns: tables with as many are joined on these without a shuffle."""
    path, table = new_folder(df.sparkSession, name), f"readgraph_{uuid.uuid4().hex}"
    with short_lived_shuffles(df.sparkSession):
        df.write.format("parquet").bucketBy(buckets, *columns).sortBy(*columns).option("path", path).option("compression", "zstd").saveAsTable(table)
    _tables[path] = table
    return df.sparkSession.table(table)


def mark(spark: SparkSession) -> int:
    """Where the tables that are written from now on begin, for ``trim``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def trim(spark: SparkSession, since: int, last: int) -> int:
    """Removes the tables written after a ``mark``, but for the last ones: those of a loop's earlier rounds."""
    written = _written.get(spark.sparkContext.applicationId, [])
    gone = written[since : len(written) - last]
    _remove(spark, gone)
    written[since : len(written) - last] = []
    return len(gone)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def changed(spark: SparkSession, path: str) -> int:
    """When a table's files, or the folder itself, were last changed; in milliseconds."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = files.getFileStatus(place)
    return max([status.getModificationTime(), *(f.getModificationTime() for f in files.listStatus(place))])


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], source: str | None = None) -> DataFrame:
    """What ``build`` gives, written once a session; written anew if the folder has been removed meanwhile, or ``source`` has changed."""
    key = (spark.sparkContext.applicationId, f"{name} as of {changed(spark, source)}" if source else name)
    if key in _kept:
        try:
            return spark.read.parquet(_kept[key])
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # the folder is gone, or empty
                raise
    df = build()
    _kept[key] = f"{shared_dir(spark)}/readgraph-kept-{uuid.uuid4().hex}"
    write(df, _kept[key])
    return spark.read.parquet(_kept[key])


def release(spark: SparkSession, whole: bool = False) -> int:
    """Removes the tables that this session's operators have written so far, and says how many.

    Results that are built on them must have been written before. With ``whole`` the tables that are kept
    for the session go too.
    """
    app = spark.sparkContext.applicationId
    paths = _written.pop(app, [])
    if whole:
        paths += [_kept.pop(key) for key in [k for k in _kept if k[0] == app]]
    _remove(spark, paths)
    return len(paths)
