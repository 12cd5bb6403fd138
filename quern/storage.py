"""Tables in the shared folder that cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders by application, for sessions on one machine that name no shared folder.
_LOCAL: dict[str, str] = {}
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and the master is this machine."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
    return _LOCAL[context.applicationId]


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted at the end of the enclosing ``scratch`` and in any case when the JVM ends."""
    path = f"{shared_folder(spark)}/quern-{name}-{uuid.uuid4().hex}"
    target, system = _hadoop(spark, path)
    system.deleteOnExit(target)
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def local_file(path: str) -> str:
    """A path in the shared folder for programs that know local files only."""
    kind, colon, rest = path.partition(":")
    if colon and kind != "file":
        raise RuntimeError(f"{path} is not a local file: spark.checkpoint.dir must name a folder of local files for this")
    return "/" + (rest if colon else path).lstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read from the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := table.__dict__.get("_quern_path"):
            target, system = _hadoop(table.sparkSession, path)
            system.delete(target, True)


@contextmanager
def scratch(spark: SparkSession, keep: list[DataFrame]) -> Iterator[None]:
    """Delete at its end what was written inside, but for the tables put into ``keep``."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        kept = {t.__dict__.get("_quern_path") for t in keep}
        for path in made:
            if path not in kept:
                target, system = _hadoop(spark, path)
                system.delete(target, True)
        outer = _MADE.get()
        if outer is not None:
            outer += [p for p in made if p in kept]
