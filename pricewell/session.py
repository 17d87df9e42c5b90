"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings. They change results (time zone, duplicate JSON keys) or keep
# plans safe at scale (adaptive splitting of skewed joins, few rows of a scan at once, as a
# row may be a page of a few hundred kilobytes); none sizes a cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.columnarReaderBatchSize": "64",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "pricewell", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else made."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def importable(spark: SparkSession) -> SparkSession:
    """Put this package on the path of the Python workers, which need it where a job runs Python; with it installed there, no call is needed."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path for staged data, reachable from every executor.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local
    master, where driver and executors share one disk, may fall back to a temp folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="pricewell-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside it an action unlinks its shuffle files when it ends, not when the driver happens to collect its garbage.

    For steps that stage their rows and go on from there, so that the disk holds one step's shuffles and not those of all. A
    DataFrame executed twice inside it shuffles twice.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def _folder(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder of staged data that nothing reads any more."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder. Asks the file system, without a job."""
    folder, files = _folder(spark, path)
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def write_lines(spark: SparkSession, path: str, lines: list[str]) -> None:
    """One small file, a manifest, that appears whole: written under another name, then renamed. In place of one that is there."""
    file, files = _folder(spark, path)
    hidden = _folder(spark, f"{file.getParent().toString()}/_{uuid.uuid4().hex}")[0]
    stream = files.create(hidden, True)
    try:
        stream.write(bytearray("\n".join(lines) + "\n", "utf-8"))
    finally:
        stream.close()
    files.delete(file, False)
    if not files.rename(hidden, file):
        raise OSError(f"could not write {path}")


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of one small file, a manifest, without a job."""
    file, files = _folder(spark, path)
    stream = files.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
