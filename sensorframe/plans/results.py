"""Results kept by the content of their request, so that equal requests are computed once.

A result lies in the folder of its key: the rows as Parquet, and beside them, written last,
a record of the answer. Callers of one key each put down a ticket; the oldest ticket computes
the answer, and the others wait for its record. A ticket that has
run out (its holder was lost) is removed.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from sensorframe.plans.fetch import fetch
from sensorframe.plans.plot import PlotResult
from sensorframe.plans.requests import REQUEST_DEFAULTS, REQUEST_SCHEMA
from sensorframe.session import SharedFiles
from sensorframe.sources.streams import Stream

# Fixed value: how long a result is given out again.
REUSE = timedelta(minutes=55)
LEASE = timedelta(minutes=15)
POLL_SECONDS = 0.5
# After this time all tickets as old as one's own can be seen; more than the file system's clock tick.
SETTLE_SECONDS = 0.2


@dataclass(frozen=True)
class StoredResult:
    """An answer as data: the rows (None where there are none) and what is known of them."""

    data: DataFrame | None
    count: int
    shaded: bool
    msg: str
    status: str
    #: Folder of an export.
    path: str | None = None
    n_files: int = 0
    #: Whether the answer was there before the call.
    reused: bool = False


def result_key(request: Mapping, catalog: Mapping[str, Stream], options: Mapping) -> str:
    """Equal for requests that agree in every field and option, on streams with equal records."""
    fields = {**REQUEST_DEFAULTS, **request}
    streams = []
    for name in dict.fromkeys(fields["ref"].split(",")):
        known = catalog[name].statistics if name in catalog else None
        streams.append([name, None if known is None else asdict(known)])
    content = [[fields.get(n) for n in REQUEST_SCHEMA.names], streams, sorted(options.items())]
    return hashlib.sha256(json.dumps(content, default=str).encode()).hexdigest()


def fetch_once(
    spark: SparkSession,
    request: Mapping,
    catalog: Mapping[str, Stream],
    root: str,
    reuse: timedelta = REUSE,
    lease: timedelta = LEASE,
    **options,
) -> StoredResult:
    """``fetch``, but an equal request that was answered within ``reuse`` is answered from ``root``.

    ``root`` lies on a file system that all callers share. Finding a kept answer starts no job. Failed answers
    are not given out again. Downloads are written below ``root`` too. An answer that takes
    longer than ``lease`` may be computed twice, which does no harm.
    """
    files = SharedFiles(spark)
    key = result_key(request, catalog, options)
    folder, tickets = f"{root}/request_id={key}", f"{root}/leases/{key}"
    kept = _kept(spark, files, folder, reuse)
    if kept is not None:
        return kept
    ticket = f"{tickets}/{uuid.uuid4().hex}"
    try:
        while True:
            if files.create(ticket, ""):
                time.sleep(SETTLE_SECONDS)
            turn = _turn(files, tickets, ticket, lease)
            # The holder before may have finished in the meantime.
            kept = _kept(spark, files, folder, reuse)
            if kept is not None:
                return kept
            if turn:
                return _compute(spark, files, request, catalog, folder, options)
            time.sleep(POLL_SECONDS)
    finally:
        files.delete(ticket)


def _turn(files: SharedFiles, tickets: str, ticket: str, lease: timedelta) -> bool:
    """Whether ``ticket`` is the oldest one; those that have run out are removed."""
    waiting = []
    for age, path in files.listed(tickets):
        if age > lease.total_seconds():
            files.delete(path)
        else:
            waiting.append((-age, path.rsplit("/", 1)[-1]))
    return bool(waiting) and min(waiting)[1] == ticket.rsplit("/", 1)[-1]


def _compute(spark, files, request, catalog, folder, options) -> StoredResult:
    place = f"{folder}/{uuid.uuid4().hex}"
    found = fetch(request, catalog, f"{place}/export", **options)
    record = {"msg": found.msg, "status": found.status, "rows": False, "count": 0, "shaded": False, "path": None, "n_files": 0}
    if isinstance(found, PlotResult):
        record |= {"count": found.count, "shaded": found.shaded, "rows": found.data is not None}
        if found.data is not None:
            found.data.write.parquet(f"{place}/data")
    else:
        record |= {"count": found.n_rows, "path": found.path, "n_files": found.n_files}
    files.create(f"{place}/record.json", json.dumps(record))
    return _answer(spark, place, record, reused=False)


def _kept(spark, files, folder: str, reuse: timedelta) -> StoredResult | None:
    """The latest finished answer of a folder, if it is young enough."""
    ages = []
    for place in files.folders(folder):
        age = files.age(f"{place}/record.json")
        if age is not None and age <= reuse.total_seconds():
            ages.append((age, place))
    for _, place in sorted(ages):
        record = json.loads(files.read(f"{place}/record.json"))
        if record["status"] != "failed":
            return _answer(spark, place, record, reused=True)
    return None


def _answer(spark, place: str, record: dict, reused: bool) -> StoredResult:
    data = spark.read.parquet(f"{place}/data") if record["rows"] else None
    names = ("count", "shaded", "msg", "status", "path", "n_files")
    return StoredResult(data, **{n: record[n] for n in names}, reused=reused)
