"""Session, table and durability helpers shared by the whole library."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "problems", "reasoning_paths", "judge_verdicts", "dpo_pairs_v1", "sample_pairs", "eval_items",
)


def local_session(cores: str | int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tracemill")
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; a missing or unknown name raises."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, sf_dir: str, name: str) -> DataFrame:
    """df, a selection of the rows of one table, dealt out to all cores if the table is a single file.

    A file of one row group is read by one task, which would then do all the work
    on its texts. Tables of many files are split as they are read and stay.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile() else df


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and interim tables.

    It is the one the session names in spark.checkpoint.dir. Only a local[N]
    session without that setting gets a temporary folder of its own; a cluster
    without it is refused, since a machine-local folder is lost with the machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


_FOLDERS: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder by the session's file system, if the session still runs."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before; its owner clears the folder
        pass


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark, folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    The application's checkpoints lie in a folder of their own, which is removed
    when its driver ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    _remove_at_end(spark, context.getCheckpointDir().get())
    return df.checkpoint(eager=True)


def interim_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all of an application's are removed when its driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/interim/{spark.sparkContext.applicationId}"
    _remove_at_end(spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def interim_table(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet to the shared folder and read it back.

    Cheaper on disk than a checkpoint for wide rows, and survives lost executors.
    """
    path = interim_path(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each evaluated once per row.

    A plain projection is merged with what uses it, so that a costly expression
    used several times is repeated; a generator of one row keeps it apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
