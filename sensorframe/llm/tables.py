"""Tables between the steps of an operator, and values that its tasks share."""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from sensorframe.session import SharedFiles, materialize

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; the shuffle files of the job that wrote it are dropped at once."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return materialize(df)
    finally:
        conf.set(CLEANUP, before)


def drop_stored(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more: all that was made of them is stored itself."""
    for table in tables:
        folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
        for folder in folders:
            SharedFiles(table.sparkSession).delete(folder)


def free_name(taken: Iterable[str], name: str = "key") -> str:
    """A column name that no column of ``taken`` has, in whatever case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


class Shared:
    """A broadcast value of bounded size; its classes travel with it, so executors need no copy of the package."""

    def __init__(self, spark: SparkSession, value: Any):
        self._data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = value

    def __getstate__(self) -> dict:
        return {"_data": self._data, "_value": None}

    @property
    def value(self) -> Any:
        if self._value is None:
            self._value = pickle.loads(self._data.value)
        return self._value
