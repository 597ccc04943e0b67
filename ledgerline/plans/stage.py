"""Written stages: cut the plan where several readers share one result.

A stage is a parquet table in the folder that the cluster names in
``spark.checkpoint.dir``.  Unlike executor-local storage it survives the loss of
an executor, and unlike an RDD checkpoint it keeps column pruning and statistics.

A stage is written while the plan is being built and stays until the folder is
cleared, unless it is written inside ``passing_stages``.

Spark compares the bytes of the files with its broadcast threshold.  A written
table of keys and short lists takes a hundredth of what its rows take in a hash
table, so what is too long to broadcast says so by a hint.
"""

import contextlib
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SEQ = itertools.count()
_ROOTS: dict = {}
_PASSING: list = []
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A row in a hash table takes at least so many bytes for each of its columns.
COLUMN_BYTES = 16
#: Files larger than so many times the threshold stay above it with the few columns that joins read.
FAR_ABOVE = 16


def stage_root(spark: SparkSession) -> str:
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            base = tempfile.mkdtemp(prefix="ledgerline-", dir="/tmp")
            sc.setCheckpointDir(base)
        _ROOTS[app] = f"{base.rstrip('/')}/ledgerline-{uuid.uuid4().hex[:12]}"
    return _ROOTS[app]


@contextlib.contextmanager
def passing_stages(spark: SparkSession):
    """Stages written inside are deleted at the end, but for those written with ``keep``."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path beside the stages."""
    return f"{stage_root(spark)}/{next(_SEQ):05d}-{name}"


def unbroadcast(df: DataFrame) -> DataFrame:
    """df, one side of an equi-join, with the advice to sort and merge: its size is more than Spark can see."""
    return df.hint("merge")


def by_rows(table: DataFrame) -> DataFrame:
    """A written table, marked where its rows are too many to broadcast though its files are small."""
    limit = int(table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if limit <= 0 or size > limit * FAR_ABOVE:
        return table
    # the footers of the files hold the number
    return unbroadcast(table) if table.count() * COLUMN_BYTES * len(table.columns) > limit else table


@contextlib.contextmanager
def releasing_shuffles(spark: SparkSession):
    """Shuffle files of the plans run inside are deleted when the plan ends.

    Otherwise they stay until the driver's JVM happens to find the plan unused, beside
    those of the next stages.
    """
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old) if old is not None else spark.conf.unset(CLEANUP)


def write_stage(df: DataFrame, name: str, keep: bool = False, by: list[str] | None = None) -> DataFrame:
    """df written and read again, in folders by the columns of ``by`` if there are any."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    if _PASSING and not keep:
        _PASSING[-1].append(path)
    with releasing_shuffles(spark):
        df.write.mode("errorifexists").parquet(path, partitionBy=by)
    table = spark.read.schema(df.schema).parquet(path)
    return table if by else by_rows(table)
