"""The shared folder for intermediate tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of stored tables that one part of a job takes, unless that makes more than MOST_PARTS parts.
PART_BYTES, MOST_PARTS = 256 << 20, 4


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode only, a fresh one if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="eventmirror-")
    return _LOCAL[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs that are started within delete their shuffle files as they end, not when the driver collects garbage. For jobs whose plan
    runs once."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREED) if before is None else spark.conf.set(_FREED, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, so that what follows does not compute it again. Starts a job.

    discard() deletes it; what a lazy result still reads stays until the folder is cleared.
    """
    return stored_in_parts(df.sparkSession, lambda cut: df, name, 1)


def stored_in_parts(spark: SparkSession, make: Callable[[Callable[..., DataFrame]], DataFrame], name: str, parts: int) -> DataFrame:
    """stored(), in one job for each part, so that only a part's rows lie in shuffle files at a time.

    make(cut) gives the rows of a part: cut(rows, *keys) are the rows of one of `parts` parts of the hashes of these keys. Every row of the
    result must come from exactly one part, as those of joins and groups by the keys do if all their sides are cut.
    """
    path = fresh_path(spark, name)
    for part in range(parts):
        df = make(lambda rows, *keys: rows if parts == 1 else rows.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == part))  # noqa: B023
        with shuffles_freed(spark):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def parts_for(*tables: DataFrame) -> int:
    """Parts in which tables made by stored() are joined: more for larger ones, MOST_PARTS at most, as each part reads all of them."""
    total = 0
    for df in tables:
        fs, where = _files(df.sparkSession, df._scratch)
        total += fs.getContentSummary(where).getLength()
    return max(1, min(MOST_PARTS, -(-total // PART_BYTES)))


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing lazy reads any more."""
    for df in tables:
        fs, where = _files(df.sparkSession, df._scratch)
        fs.delete(where, True)
