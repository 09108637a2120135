"""Small steps on the files of a store that Spark reaches: listing, writing and renaming without overwriting."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system of path, the Path class)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p(path))


def statuses(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """(name, seconds since the epoch of its last change) of what lies in a folder; nothing if there is none."""
    fs, p = file_system(spark, path)
    try:
        return sorted((s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(p(path)))
    except Exception as error:
        if "FileNotFoundException" in str(error):
            return []
        raise


def children(spark: SparkSession, path: str) -> list[str]:
    return [name for name, _ in statuses(spark, path)]


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p(path), True)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder or file to a name that nothing has; false, and nothing done, where something has it.

    The file system decides in one step, so that of two that ask for a name one gets it.
    """
    sc = spark.sparkContext
    jvm, p = sc._jvm, sc._jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p(target).getFileSystem(sc._jsc.hadoopConfiguration()).getUri(), sc._jsc.hadoopConfiguration())
    none = sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(p(source)), context.makeQualified(p(target)), none)
    except Exception as error:
        if exists(spark, target):
            return False
        raise error
    return True


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that nothing has, whole or not at all."""
    folder, _, name = path.rpartition("/")
    fs, p = file_system(spark, path)
    aside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    out = fs.create(p(aside), False)
    out.write(bytearray(text.encode()))
    out.close()
    done = rename_new(spark, aside, path)
    if not done:
        fs.delete(p(aside), False)
    return done
