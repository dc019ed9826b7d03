"""Tables in the folder which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder which a cluster names in ``spark.checkpoint.dir``.

    On one machine (a local master) a temporary folder is made where it is
    unset; a cluster without the setting is an error, as executors' own folders
    are lost with them.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder which all machines share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, which cuts its lineage.

    All tables of an application lie in one folder, which :func:`forget` or an
    operator of the cluster may delete after it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table which nothing reads any more."""
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        remove(df.sparkSession, folder)


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; results which were not read yet cannot be after this."""
    remove(spark, f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")


def _file_system(spark: SparkSession, path: str):
    name = spark._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), name


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    fs, folder = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, name = _file_system(spark, path)
    stream = fs.open(name)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file which must not be there yet; false if another writer has made it."""
    fs, name = _file_system(spark, path)
    try:
        stream = fs.create(name, False)
    except Exception:
        if fs.exists(name):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, name = _file_system(spark, path)
    fs.delete(name, True)
