"""Files of any store that Hadoop reaches, by path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system that holds ``path``, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def files_in(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files right in ``folder``."""
    fs, target = file_system(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(target) if f.isFile())


def folders_in(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folders right in ``folder``; none if it is not there."""
    fs, target = file_system(spark, folder)
    if not fs.exists(target):
        return []
    return sorted(f.getPath().toString() for f in fs.listStatus(target) if f.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    if not fs.mkdirs(target):
        raise OSError(f"could not make {path}")


def rename_new(spark: SparkSession, source: str, path: str) -> bool:
    """Rename to a path that does not exist; false if something got there first."""
    fs, target = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        context.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(source)), target, none)
    except Exception:
        if fs.exists(target):
            return False
        raise
    return True


def replace(spark: SparkSession, source: str, path: str) -> None:
    """Put the file ``source`` at ``path`` in one step; a folder there is removed first."""
    fs, target = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    if fs.exists(target) and fs.getFileStatus(target).isDirectory():
        fs.delete(target, True)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(jvm.org.apache.hadoop.fs.Path(source)), target, over)


def read_text(spark: SparkSession, path: str) -> str:
    """A short file whole."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
