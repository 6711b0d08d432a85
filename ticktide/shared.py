"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: Schemes of Spark's connectors, and those of pyarrow's file systems.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss", "wasb": "abfs"}
#: Bytes of rows that a task of ``stored`` gathers for a row group.
GROUP_BYTES = 8 << 20


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where that is unset and the session runs on this machine alone, a temporary
    folder is made and set for the session; on a cluster its absence is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ticktide-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{folder(spark)}/ticktide/{spark.conf.get('spark.app.id', 'session')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and it survives the loss of executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """As ``written``, without a process for each file.

    Without its native library, Hadoop's local file system starts a ``chmod`` for every
    file and folder; until that runs, it is a twin of the executor, and what sums up the
    memory of processes counts the executor twice. So Python workers write tables of a
    local folder, a file per task; files get their names when all tasks are done, so
    that those of failed attempts are not read.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    local = re.fullmatch("file:(?://)?(/[^/].*)", path)
    if not local:
        return written(df, label)
    root = local[1]
    os.makedirs(root)
    for (name,) in df.mapInArrow(_storing(root), "name string").collect():
        os.rename(f"{root}/_{name}", f"{root}/{name}")
    return spark.read.schema(df.schema).parquet(path)


def _storing(root: str):
    """mapInArrow that writes the rows of a task to a hidden file of the folder and returns its later name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        name, writer, rows = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.parquet", None, []
        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
            if sum(b.nbytes for b in rows) >= GROUP_BYTES:
                writer = writer or pq.ParquetWriter(f"{root}/_{name}", batch.schema)
                writer.write_table(pa.Table.from_batches(rows))
                rows = []
        if rows:
            writer = writer or pq.ParquetWriter(f"{root}/_{name}", rows[0].schema)
            writer.write_table(pa.Table.from_batches(rows))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return run


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of the session's JVM, or None where the session has none, as under Spark Connect."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a folder its name, which must be free."""
    if own := _hadoop(spark, new):
        store, at = own
        if store.exists(at) or not store.rename(_hadoop(spark, old)[1], at):
            raise FileExistsError(new)
        return
    from pyarrow.fs import FileType

    store, at = store_of(new)
    if store.get_file_info(at).type != FileType.NotFound:
        raise FileExistsError(new)
    store.move(store_of(old)[1], at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    if own := _hadoop(spark, path):
        own[0].delete(own[1], True)
        return
    from pyarrow.fs import FileType

    store, at = store_of(path)
    if store.get_file_info(at).type != FileType.NotFound:
        store.delete_dir(at)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def store_of(url: str):
    """(file system, path) of pyarrow for a folder that Spark names by ``url``; a path without a scheme is local."""
    from pyarrow import fs

    scheme, found, rest = url.partition(":")
    if found and "/" not in scheme:
        url = f"{_SCHEMES.get(scheme, scheme)}:{rest}"
        if rest.startswith("/") and not rest.startswith("//"):  # file:/x
            url = f"{_SCHEMES.get(scheme, scheme)}://{rest}"
    return fs.FileSystem.from_uri(url)
