"""Spark session for local runs, tests and the bench."""

import atexit
import os
import pathlib
import re
import shutil
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Names that fresh_path gives.
_OURS = re.compile(r"-[0-9a-f]{32}(\.\w+)?$")


def get_spark(app: str = "lodeseek", cpus: int | None = None) -> SparkSession:
    """Return the running session, or start a local one sized for this machine."""
    cores = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodeseek-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Of intermediate tables, which are read a few times and go.
CODEC = "zstd"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts lineage so that a lost executor costs only the running stage, and gives joins on the
    table plain exchanges, which adaptive execution can split where a key is hot.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a file of a small table, and the files that even the smallest may have.
FILE_ROWS, LEAST_FILES = 50_000, 8


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows are at most `rows`, in fewer partitions than a shuffle has if there is no work for all of them.

    Every file costs a task and some processes of the file system, which small tables needn't pay.
    """
    files = max(LEAST_FILES, -(-rows // FILE_ROWS))
    return df.coalesce(files) if files < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it has fewer partitions than there are cores: small files come as one. Larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


class Scratch:
    """Tables that an operator writes on its way, so that it can remove those that its result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write df as a table and read it again; in few files if it has no more than so many rows."""
        df = df if rows is None else few_files(df, rows)
        path = fresh_path(self.spark, name)
        df.write.option("compression", CODEC).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((path, table))
        return table

    def clear(self, *kept: DataFrame) -> None:
        """Remove all tables but those kept."""
        for path, table in self.tables:
            if not any(table is k for k in kept):
                remove(self.spark, path)
        self.tables = [(p, t) for p, t in self.tables if any(t is k for k in kept)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Remove what is older than so many hours from the shared folder, and return how many folders went.

    Results are lazy, so the tables that they read stay until they are no longer wanted: the caller says when.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs, before, gone = place.getFileSystem(spark._jsc.hadoopConfiguration()), (time.time() - 3600 * hours) * 1000, 0
    for entry in fs.listStatus(place) if fs.exists(place) else []:
        if entry.getModificationTime() <= before and _OURS.search(entry.getPath().getName()):
            gone += bool(fs.delete(entry.getPath(), True))
    return gone


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lodeseek_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lodeseek-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = pathlib.Path(folder) / "lodeseek-package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(target))
    context._lodeseek_shipped = True
