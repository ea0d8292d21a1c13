"""Where tables live: the input tables, and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_OWN_CODE: list[str] = []
#: Paths and catalog tables that this application wrote to the shared folder.
_PATHS: list[str] = []
_TABLES: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, as a file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A folder of this machine is made only where the setting is absent and the executors are threads of this process; on a cluster
    its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="tripleflow-"))
        found = f"file://{_OWN[0]}"
    return found.rstrip("/")


def local_path(url: str) -> str | None:
    """The path of a ``file:`` URL or plain path, else None."""
    if re.match(r"^file:/", url):
        return "/" + url.split(":", 1)[1].lstrip("/")
    return url if url.startswith(os.sep) else None


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes all that this application wrote to the shared folder, and drops its tables. To be called when the results are written."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _PATHS:
        _delete(spark, _PATHS.pop())


@atexit.register
def _forget() -> None:
    """What is left at the end of the application, after failures too."""
    import shutil

    active = SparkSession._instantiatedSession
    for path in _PATHS:
        local = local_path(path)
        if local:
            shutil.rmtree(local, ignore_errors=True)
        elif active is not None:
            with contextlib.suppress(Exception):
                _delete(active, path)
    for path in _OWN + _OWN_CODE:
        shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted by ``cleanup`` or at the end of the application."""
    path = f"{shared_dir(spark)}/tripleflow/{name}-{uuid.uuid4().hex[:12]}"
    _PATHS.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``new_path`` that is no longer read."""
    _delete(spark, path)
    _PATHS.remove(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, and survives the loss of executors. An action."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, partition_by: str | None = None) -> str:
    """``df`` written to the shared folder in ``buckets`` hash buckets of ``key``; gives the catalog name of the table. An action.

    One task writes one bucket, so that a bucket is one file (one for each value of ``partition_by``).
    """
    spark = df.sparkSession
    full = re.sub(r"\W", "_", f"tripleflow_{name}_{uuid.uuid4().hex[:12]}")
    writer = df.repartition(buckets, key).write.format("parquet").option("path", new_path(spark, name))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(full)
    _TABLES.append(full)
    return full


def buckets_for(spark: SparkSession, rows: int, rows_per_bucket: int = 500_000) -> int:
    """How many buckets hold ``rows``: as many as the cluster's cores at least, but none for less than 1,000 rows."""
    return max(1, -(-rows // rows_per_bucket), min(2 * spark.sparkContext.defaultParallelism, rows // 1000))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files under ``path``, by the Hadoop file system that serves it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python finds it wherever the driver was started."""
    import pathlib
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_tripleflow_shipped", False):
        return
    here = pathlib.Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="tripleflow-code-")
    _OWN_CODE.append(folder)
    with zipfile.ZipFile(target := f"{folder}/tripleflow_code.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, f"{here.name}/{p.relative_to(here)}")
    context.addPyFile(target)
    context._tripleflow_shipped = True
