"""Session settings and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_spark(app: str = "moorage", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    n = str(os.cpu_count() or 8) if cpus == "*" else str(cpus)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": n,
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one under /tmp on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir: the executors of {master} need a folder that all of them see")
        folder = "file:///tmp/checkpoints/moorage"
    return folder.rstrip("/")


#: Rows and bytes of text that Python workers get at once: texts may be long, and a worker holds a batch several times.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python can import it wherever it runs.

    Also sets the size of Arrow batches where the application has set none.
    """
    context = spark.sparkContext
    if getattr(context, "_moorage_shipped", False):
        return
    for key, value in BATCHES.items():
        if not context.getConf().contains(key):
            spark.conf.set(key, value)
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="moorage-"), "moorage_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.join("moorage", os.path.relpath(whole, package)))
    context.addPyFile(path)
    context._moorage_shipped = True


_written: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in _written.items():
        try:
            _remove(spark, path)
        except Exception:  # the session may be gone already; the folder is then left to the cluster's own clean-up
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    Later stages read files that outlive any executor, each column is read only
    where it is used, and a second use does not compute the input again.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/moorage-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._moorage_path = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Deletes the files of frames made by ``cut_lineage``; all that was made of them must be written by now."""
    for df in frames:
        path = getattr(df, "_moorage_path", None) if df is not None else None
        if path and _written.pop(path, None):
            _remove(df.sparkSession, path)


def give_back_disk(spark: SparkSession) -> None:
    """Has the driver collect its garbage: executors keep the shuffle files of finished queries until it does, which a driver with little to do may put off for long."""
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, by default ``names``, that no column of ``df`` has (upper and lower case alike)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``, by any path that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files are too few for that; an input of more partitions than cores is not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df
