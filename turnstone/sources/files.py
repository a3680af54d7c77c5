"""Small files on whatever file system a path names, through Spark's own Hadoop clients."""

from __future__ import annotations

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def system(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return system(spark, path).exists(path_of(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none where there is no folder."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in system(spark, folder).listStatus(path_of(spark, folder)))


def read(spark: SparkSession, path: str) -> str | None:
    """A file's text; None where there is no file."""
    if not exists(spark, path):
        return None
    stream = system(spark, path).open(path_of(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """The whole file appears at once, by a rename; without replace an existing file is an error."""
    staged = f"{path}.{spark._jvm.java.util.UUID.randomUUID()}.tmp"
    stream = system(spark, path).create(path_of(spark, staged), True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    chosen = spark.sparkContext._gateway.new_array(options, 1)
    chosen[0] = options.OVERWRITE if replace else options.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path_of(spark, path).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(path_of(spark, staged), path_of(spark, path), chosen)
    except Exception:
        delete(spark, staged)
        raise


def append(spark: SparkSession, folder: str, text: str) -> None:
    """Adds text to a folder as a file of its own, so that writers never meet."""
    write(spark, f"{folder}/{spark._jvm.java.lang.System.currentTimeMillis():015d}-{spark._jvm.java.util.UUID.randomUUID()}", text)


def delete(spark: SparkSession, path: str) -> None:
    system(spark, path).delete(path_of(spark, path), True)
