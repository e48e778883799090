"""Session settings and lineage cutting shared by the whole package."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sensorframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    Shuffle partition counts are left to the cluster's own defaults; AQE
    coalesces them when the data is small and splits skewed join partitions.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the calling line of every column costs as much as building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The JVM leaves methods above 8000 bytes of bytecode uncompiled; wide projections
        # then run faster operator by operator.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of this application's tables: below ``spark.checkpoint.dir``, else below the warehouse.

    Both are folders that all machines of a cluster share. ``release`` removes it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/sensorframe-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage, survives executor loss, fixes values that depend on the
    physical plan (partition ids), and keeps column pruning for later reads.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all tables this application wrote to the shared folder.

    For the owner of the session, once results were read: a DataFrame that still
    reads one of the tables fails afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class SharedFiles:
    """Small text files on the file system of a path, through Spark's own file access."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def create(self, path: str, text: str) -> bool:
        """Write a file that does not exist; False if it does."""
        files, place = self._at(path)
        try:
            out = files.create(place, False)
        except Exception as error:
            if files.exists(place):
                return False
            raise error
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, path: str) -> str:
        files, place = self._at(path)
        stream = files.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def age(self, path: str) -> float | None:
        """Seconds since a file was written; None without the file."""
        files, place = self._at(path)
        if not files.exists(place):
            return None
        return (self._jvm.java.lang.System.currentTimeMillis() - files.getFileStatus(place).getModificationTime()) / 1000

    def listed(self, path: str) -> list[tuple[float, str]]:
        """``(age in seconds, path)`` of the files in a folder, all at one reading of the clock."""
        files, place = self._at(path)
        if not files.exists(place):
            return []
        now = self._jvm.java.lang.System.currentTimeMillis()
        return [((now - s.getModificationTime()) / 1000, s.getPath().toString()) for s in files.listStatus(place) if s.isFile()]

    def folders(self, path: str) -> list[str]:
        files, place = self._at(path)
        if not files.exists(place):
            return []
        return [s.getPath().toString() for s in files.listStatus(place) if s.isDirectory()]

    def delete(self, path: str) -> None:
        files, place = self._at(path)
        files.delete(place, True)
