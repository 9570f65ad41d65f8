"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Staged tables between two calls of ``release``.
RELEASE_EVERY = 3
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[tuple[SparkSession, str]] = []


def build_session(app: str = "sievedeck", master: str | None = None, cores: int = 8) -> SparkSession:
    """A session with adaptive execution on and shuffle partitions sized to the cores.

    On a cluster pass ``master=None`` and set sizes with spark-submit; nothing
    below overrides what the submitter has set except the SQL defaults.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole documents small, where the session has Spark's default of 10,000 rows.

    Both the JVM and the worker hold a batch outside the heap. Queries and pipelines over whole documents ask for it.
    """
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the repository is not installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, local mode (tests) gets a temporary folder; a cluster gets an error.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", "")
        if not named:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="sievedeck-")
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage as checkpoint() does, in columnar compressed form: a lost
    executor costs the re-read of a file and no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievedeck-{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    _MADE.append((spark, path))
    if len(_MADE) % RELEASE_EVERY == 0:
        release(spark)
    made = spark.read.schema(df.schema).parquet(path)
    made._staged_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._staged_path)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: Spark deletes those of an execution when it is over.

    For actions whose result is read, not their plan again.
    """
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the broadcast tables of jobs that are over.

    Executors hold them until the driver has collected its references to them, which on a quiet
    heap may be long after; Spark itself asks for that twice an hour (spark.cleaner.periodicGC.interval).
    """
    spark._jvm.System.gc()


def forget(spark: SparkSession, path: str) -> None:
    """Remember a folder for deletion at exit."""
    _MADE.append((spark, path))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``df`` has them (names of columns ignore case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _clean() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # gone already, or the session is
            continue


atexit.register(_clean)
