"""Small files beside the tables, through the file system that Spark itself uses for a path."""

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder with the time of their last change in milliseconds; empty if there is no such folder."""
    fs, place = _at(spark, folder)
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(place)} if fs.exists(place) else {}


def read(spark: SparkSession, path: str) -> str:
    fs, place = _at(spark, path)
    stream = fs.open(place)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that is not there yet; False if it is. The file appears whole, by a rename that does not overwrite."""
    jvm = spark._jvm
    folder, _, name = path.rpartition("/")
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    fs, place = _at(spark, draft)
    stream = fs.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(place, jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as error:  # py4j wraps the exception of the file system
        fs.delete(place, False)
        if "FileAlreadyExistsException" in str(error):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)
