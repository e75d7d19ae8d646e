"""Where intermediate tables go.

A stage that is read more than once, or whose recomputation after a lost executor would be dear, is written
once to the folder that the cluster names in ``spark.checkpoint.dir`` and read back. All executors share that
folder, so a lost executor costs a task and no more.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only in local mode (tests), where all share it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or getattr(work_dir, "own", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        work_dir.own = shared = tempfile.mkdtemp(prefix="spark-")
    return shared


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{work_dir(spark).rstrip('/')}/depchron-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back, so its lineage ends here."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes what this package has written to the shared folder; for the end of a job, when no result is still to be read."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark).rstrip('/')}/depchron-*")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(pattern) or []:
        files.delete(found.getPath(), True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of its Python workers; called before Python code goes to executors."""
    context = spark.sparkContext
    if getattr(shipped, "to", None) != context.applicationId:
        root = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        shipped.to = context.applicationId
    return spark
