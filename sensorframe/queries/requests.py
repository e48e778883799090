"""Queries over request batches, sizes, export plans and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorframe.functions.values import size_text
from sensorframe.operators.select import coverage, empty_streams, stream_extents
from sensorframe.plans.export import count_files, export, measure, read_result, write_result
from sensorframe.plans.limits import plan_csv, plan_slices, slice_bounds
from sensorframe.plans.requests import (
    dedupe_requests,
    expand_requests,
    request_outcomes,
    request_totals,
    selected_rows,
    stream_sizes,
    with_request_id,
)
from sensorframe.queries.bindings import NATION_REQUESTS_SQL, event_streams, nation_requests, table
from sensorframe.session import shared_folder
from sensorframe.sources.samples import to_records
from sensorframe.plans.fetch import fetch
from sensorframe.plans.plot import list_pages, plot
from sensorframe.plans.results import fetch_once
from sensorframe.sources.streams import build_manifest, open_stream, recorded_manifest, write_stream

FOLDER_BYTES = 400_000


def _numbered(spark, sf_dir, df, *columns):
    """Results by request number; the request id is an md5 that SQL need not rebuild."""
    numbers = nation_requests(spark, sf_dir).select("request_id", "request_no")
    return df.join(numbers, "request_id").select("request_no", *columns)


def request_expansion(spark, sf_dir):
    rows = expand_requests(nation_requests(spark, sf_dir))
    return _numbered(
        spark, sf_dir, rows, "stream", F.array_join("wanted", ",").alias("wanted"), "start", "end"
    )


def _coverage(mode):
    def query(spark, sf_dir):
        expanded = expand_requests(nation_requests(spark, sf_dir))
        found = coverage(expanded, stream_extents(event_streams(spark, sf_dir)), mode)
        return _numbered(spark, sf_dir, found, "stream", "covered")

    return query


def match_counts(spark, sf_dir):
    expanded = expand_requests(nation_requests(spark, sf_dir))
    found = selected_rows(expanded, event_streams(spark, sf_dir))
    return _numbered(spark, sf_dir, found, "stream", "n_match", "n_rows")


def empty_stream_list(spark, sf_dir):
    expanded = expand_requests(nation_requests(spark, sf_dir))
    found = selected_rows(expanded, event_streams(spark, sf_dir)).where(F.col("n_rows") > 0)
    return _numbered(spark, sf_dir, empty_streams(expanded, found), "empty_streams")


def size_check(spark, sf_dir):
    expanded = expand_requests(nation_requests(spark, sf_dir))
    sizes = stream_sizes(expanded, build_manifest(event_streams(spark, sf_dir)))
    totals = request_totals(sizes, max_dimension_bytes=40_000)
    return _numbered(spark, sf_dir, totals, "total_size", "total_dim_size", "msg", "admitted")


def stream_size_check(spark, sf_dir):
    expanded = expand_requests(nation_requests(spark, sf_dir))
    sizes = stream_sizes(expanded, build_manifest(event_streams(spark, sf_dir)))
    return _numbered(spark, sf_dir, sizes, "stream", "known", "total_size")


def outcomes(spark, sf_dir):
    streams = event_streams(spark, sf_dir)
    found = request_outcomes(
        nation_requests(spark, sf_dir),
        streams,
        build_manifest(streams),
        time_ordered=True,
        part_bytes={"csv": 20_000},
        max_files=100,
    )
    return _numbered(spark, sf_dir, found, "n_streams", "merged_rows", "outcome", "reason", "status", "msg")


def outcomes_whole(spark, sf_dir):
    """Every way a request can end, in all columns: more requests and streams are made from the events.

    One instant of a single stream leaves no row after the cut; the same instant of two
    streams that hold samples twice leaves rows, but no tick of a grid.
    """
    events = event_streams(spark, sf_dir)
    doubled = F.explode(F.array([F.struct(F.lit(s).alias("stream"), F.lit(k).alias("k")) for s in ("pair", "pair2") for k in (0, 1)]))
    middle = events.agg(F.expr("percentile(_pos, 0.5, 1)").cast("bigint").alias("m"))
    near = events.join(F.broadcast(middle), F.col("_pos") % 10 == F.col("m") % 10)
    pairs = near.withColumn("d", doubled).select("d.stream", "time", "value", "user_id", (F.col("_pos") * 2 + F.col("d.k")).alias("_pos"))
    streams = events.union(pairs)
    one = events.join(F.broadcast(middle), F.col("_pos") == F.col("m"))
    at = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    more = one.select(
        F.explode(F.array(F.struct(F.lit(100).alias("no"), F.col("stream").alias("ref")), F.struct(F.lit(101).alias("no"), F.lit("pair,pair2").alias("ref")))).alias("r"),
        at.alias("start_dt"),
    ).select(
        F.col("r.no").alias("request_no"),
        F.col("r.ref").alias("ref"),
        F.lit("time").alias("x"),
        F.lit("value").alias("y"),
        "start_dt",
        F.col("start_dt").alias("end_dt"),
        F.lit("").alias("z"),
        F.lit("").alias("color"),
        F.lit("netcdf").alias("download_format"),
        F.lit(False).alias("download"),
    )
    requests = nation_requests(spark, sf_dir).drop("request_id").unionByName(with_request_id(more).drop("request_id"))
    requests = with_request_id(requests)
    limit = 4 * events.count()
    found = request_outcomes(
        requests,
        streams,
        build_manifest(streams),
        time_ordered=True,
        max_dimension_bytes=limit,
        part_bytes={"csv": 20_000},
        max_files=100,
    )
    return found.join(requests.select("request_id", "request_no"), "request_id").drop("request_id")


def request_dedupe(spark, sf_dir):
    """Requests made from every order; many of them agree in all fields."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "click,view").otherwise("error").alias("ref"),
        F.lit("time").alias("x"),
        F.lit("value").alias("y"),
        F.concat(month, F.lit("-01")).alias("start_dt"),
        F.concat(month, F.lit("-28")).alias("end_dt"),
        F.substring("o_orderpriority", 1, 1).alias("color"),
    )
    return dedupe_requests(rows).drop("request_id")


def _line_sizes(spark, sf_dir):
    return measure(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


def slice_plan(spark, sf_dir):
    return plan_slices(_line_sizes(spark, sf_dir), slice_bytes=100_000, max_files=8)


def slice_plan_bounds(spark, sf_dir):
    return slice_bounds(plan_slices(_line_sizes(spark, sf_dir), slice_bytes=100_000))


def csv_part_plan(spark, sf_dir):
    sized = plan_csv(_line_sizes(spark, sf_dir), part_bytes=100_000, max_files=8)
    return sized.withColumn("size_text", size_text(F.col("size")))


def table_sizes(spark, sf_dir):
    names = ("events", "lineitem", "orders", "customer", "supplier", "part", "nation", "region", "embeddings")
    found = None
    for name in names:
        rows = measure(table(spark, sf_dir, name)).select(F.lit(name).alias("table"), "rows", "size")
        found = rows if found is None else found.unionByName(rows)
    return found.withColumn("text", size_text(F.col("size")))


def _folder(spark, name):
    return f"{shared_folder(spark)}/sensorframe-{name}-{uuid.uuid4().hex}"


def _timed_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "time")


def _export(spark, sf_dir, kind, name):
    root = _folder(spark, name)
    rows = _timed_lines(spark, sf_dir)
    axes = {"x": "time", "y": "l_quantity", "z": ""}
    return export(rows, root, "1995-01-01", "2003-01-01", kind, ["lineitem"], axes, part_bytes=FOLDER_BYTES)


def csv_roundtrip(spark, sf_dir):
    done = _export(spark, sf_dir, "csv", "csv")
    schema = _timed_lines(spark, sf_dir).schema
    read = spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return read.csv(f"{done.path}/data")


def _noted_events(spark, sf_dir):
    """Events with a text of quotes, commas and line breaks."""
    note = F.concat(F.lit('he said "'), "props", F.lit('", then\n'), "event_type")
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("ts").cast("timestamp_ntz").alias("time"), "event_id", note.alias("note"))


def csv_quoted_roundtrip(spark, sf_dir):
    """Text that needs quoting, out and in again; beside it whether the number of files is the reported one."""
    rows = _noted_events(spark, sf_dir)
    done = export(rows, _folder(spark, "quoted"), "2024-01-01", "2024-02-01", "csv", part_bytes=100_000)
    read = spark.read.schema(rows.schema).option("header", True).option("multiLine", True)
    read = read.option("quote", '"').option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    listed = count_files(spark, f"{done.path}/data")
    return read.csv(f"{done.path}/data").withColumn("files_agree", F.lit(listed == done.n_files))


def json_roundtrip(spark, sf_dir):
    done = _export(spark, sf_dir, "json", "json")
    schema = _timed_lines(spark, sf_dir).schema
    read = spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return read.json(f"{done.path}/data")


def sliced_roundtrip(spark, sf_dir):
    """Rows and time span of every slice of an export."""
    done = _export(spark, sf_dir, "netcdf", "slices")
    slices = spark.read.parquet(f"{done.path}/data")
    return slices.groupBy(F.col("slice_id").cast("bigint").alias("slice_id")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


def sliced_events(spark, sf_dir):
    """Every row of an export with the slice it lies in."""
    rows = table(spark, sf_dir, "events").withColumnRenamed("ts", "time")
    done = export(rows, _folder(spark, "events"), "2024-01-01", "2024-02-01", "netcdf", part_bytes=30_000)
    return spark.read.parquet(f"{done.path}/data").withColumn("slice_id", F.col("slice_id").cast("bigint"))


def export_manifest(spark, sf_dir):
    done = _export(spark, sf_dir, "netcdf", "manifest")
    meta = spark.read.json(f"{done.path}/meta")
    return meta.select(
        F.array_join("reference_designators", ",").alias("streams"),
        F.col("axis_parameters")["x"].alias("x"),
        F.col("axis_parameters")["y"].alias("y"),
        "start_datetime",
        "end_datetime",
        "n_files",
        "n_rows",
    )


def stored_results(spark, sf_dir):
    """Two results stored under their request ids; writing the second keeps the first."""
    root = _folder(spark, "results")
    events = event_streams(spark, sf_dir)
    write_result(events.where(F.col("stream") == "click"), root, "first")
    write_result(events.where(F.col("stream") != "click"), root, "second")
    return read_result(spark, root, "first").unionByName(read_result(spark, root, "second"))


def stored_results_mixed(spark, sf_dir):
    """Results with different columns; each one comes back with its own."""
    root = _folder(spark, "mixed")
    events = event_streams(spark, sf_dir)
    write_result(events.where(F.col("stream") == "click").select("time", "value"), root, "first")
    write_result(events.where(F.col("stream") == "view").select("time", "user_id"), root, "second")
    return read_result(spark, root, "second")


def stored_stream(spark, sf_dir):
    """A stream written in day folders, opened by name and cut by time."""
    root = _folder(spark, "streams")
    write_stream(event_streams(spark, sf_dir), root, "events")
    stream = open_stream(spark, root, "events", time_ordered=True)
    cut = stream.project(["time", "value", "nothing"]).select(time=slice("2024-01-10", "2024-01-12T06:00:00"))
    return cut.df.select("time", "value", "_pos")


def _stored_events(spark, sf_dir, name):
    root = _folder(spark, name)
    write_stream(event_streams(spark, sf_dir).drop("stream"), root, "events")
    return open_stream(spark, root, "events")


def stream_record(spark, sf_dir):
    """What is recorded of a stream as it is written, one row per variable."""
    known = _stored_events(spark, sf_dir, "record").statistics
    whole = (known.rows, known.first_time, known.last_time, known.ordered, known.unique)
    rows = [(*whole, v.variable, v.dtype, v.n_present, v.n_values, v.n_bytes) for v in known.variables]
    return spark.createDataFrame(
        rows,
        "rows bigint, first_time timestamp_ntz, last_time timestamp_ntz, ordered boolean, unique boolean, "
        "variable string, dtype string, n_present bigint, n_values bigint, n_bytes bigint",
    )


def recorded_manifest_rows(spark, sf_dir):
    """The manifest of a stored stream, from its record alone."""
    found = recorded_manifest(spark, {"events": _stored_events(spark, sf_dir, "recorded")})
    return found.withColumns({"dims": F.array_join("dims", ","), "attrs": F.size("attrs")})


def stored_plot(spark, sf_dir):
    """A plot request on a stored stream: its record decides on size and coverage."""
    request = {"ref": "events", "x": "time", "y": "value", "color": "user_id", "start_dt": "2024-01-05", "end_dt": "2024-01-19T18:00:00"}
    done = fetch(request, {"events": _stored_events(spark, sf_dir, "plot")}, max_dimension_bytes=1 << 40)
    return done.data.withColumn("count", F.lit(done.count))


def reused_result(spark, sf_dir):
    """The same request twice: both answers, and whether they were kept ones."""
    root, catalog = _folder(spark, "kept"), {"events": _stored_events(spark, sf_dir, "reused")}
    request = {"ref": "events", "x": "time", "y": "value", "start_dt": "2024-01-05", "end_dt": "2024-01-19T18:00:00"}
    answers = [fetch_once(spark, request, catalog, root) for _ in range(2)]
    shown = [a.data.withColumns({"reused": F.lit(a.reused), "count": F.lit(a.count)}) for a in answers]
    return shown[0].unionByName(shown[1])


def list_page_rows(spark, sf_dir):
    """A plot of all clicks as pages of 150 rows; lists are shown as text."""
    rows = event_streams(spark, sf_dir).where(F.col("stream") == "click").select("time", "user_id")
    pages = list_pages(plot(rows, "time", "user_id"), 150, ["time"])
    return pages.select("page", *[F.array_join(c, ",").alias(c) for c in ("time", "user_id")], F.size("time").alias("n"))


def json_records(spark, sf_dir):
    return to_records(table(spark, sf_dir, "customer"))


QUERIES = {
    "request_expansion": request_expansion,
    "coverage_reference": _coverage("reference"),
    "coverage_overlap": _coverage("overlap"),
    "match_counts": match_counts,
    "empty_streams": empty_stream_list,
    "size_check": size_check,
    "stream_size_check": stream_size_check,
    "request_outcomes": outcomes,
    "request_outcomes_whole": outcomes_whole,
    "request_dedupe": request_dedupe,
    "slice_plan": slice_plan,
    "slice_bounds": slice_plan_bounds,
    "csv_part_plan": csv_part_plan,
    "table_sizes": table_sizes,
    "csv_roundtrip": csv_roundtrip,
    "csv_quoted_roundtrip": csv_quoted_roundtrip,
    "json_roundtrip": json_roundtrip,
    "sliced_roundtrip": sliced_roundtrip,
    "sliced_events": sliced_events,
    "export_manifest": export_manifest,
    "stored_results": stored_results,
    "stored_results_mixed": stored_results_mixed,
    "stored_stream": stored_stream,
    "stream_record": stream_record,
    "recorded_manifest": recorded_manifest_rows,
    "list_pages": list_page_rows,
    "stored_plot": stored_plot,
    "reused_result": reused_result,
    "json_records": json_records,
}

_MATCHES = """
matches AS (
  SELECT request_no, stream, count(event_id) AS n_match, CAST(greatest(count(event_id) - 1, 0) AS BIGINT) AS n_rows
  FROM expanded LEFT JOIN events ON event_type = stream AND ts BETWEEN st AND en GROUP BY 1, 2)"""


def _size_sql(column: str) -> str:
    """Readable size of a byte column."""
    steps = ["bytes", "KB", "MB", "GB"]
    cases = " ".join(
        f"WHEN {column} < {1024 ** (i + 1)} THEN printf('%.1f {unit}', {column} / {float(1024**i)})"
        for i, unit in enumerate(steps)
    )
    return f"CASE {cases} END"


_COVERED = {
    "reference": "(st >= first_time AND st < last_time) OR (en >= first_time AND en < last_time)",
    "overlap": "st <= en AND st <= last_time AND en >= first_time",
}
_WIDE = "8 * n + CASE WHEN color = '' THEN 8 * n ELSE 16 * n END"
# Width of a line item: 3 ids, a line number, 4 amounts, 2 flags of one letter, a time.
_LINE_BYTES = "sum(3 * 8 + 4 + 4 * 8 + strlen(l_returnflag) + strlen(l_linestatus) + 8)"
_LINES_SIZE = f"""
  SELECT l_returnflag, l_linestatus, count(*) AS rows, CAST({_LINE_BYTES} AS BIGINT) AS size FROM lineitem GROUP BY 1, 2"""
_SLICED = f"SELECT *, CAST(ceil(rows / (size / 100000.0::DOUBLE)) AS BIGINT) AS rows_per_slice FROM ({_LINES_SIZE})"
_LINE_TABLE = "SELECT * EXCLUDE (l_shipdate), l_shipdate AS time FROM lineitem"
_LINE_PLAN = f"""
plan AS (SELECT count(*) AS n, CAST(ceil(count(*) / ({_LINE_BYTES} / {float(FOLDER_BYTES)}::DOUBLE)) AS BIGINT) AS step
         FROM lineitem)"""

ORACLES = {
    "request_expansion": f"""
  WITH {NATION_REQUESTS_SQL}
  SELECT request_no, stream, CASE WHEN color = '' THEN 'time,value' ELSE 'time,value,user_id' END AS wanted,
         st AS start, en AS "end" FROM expanded""",
    **{
        f"coverage_{mode}": f"""
  WITH {NATION_REQUESTS_SQL}
  SELECT request_no, stream, coalesce({test}, FALSE) AS covered FROM expanded LEFT JOIN extents USING (stream)"""
        for mode, test in _COVERED.items()
    },
    "match_counts": f"""
  WITH {NATION_REQUESTS_SQL}, {_MATCHES} SELECT * FROM matches WHERE n_match > 0""",
    "empty_streams": f"""
  WITH {NATION_REQUESTS_SQL}, {_MATCHES}
  SELECT request_no, string_agg(stream, ',' ORDER BY stream) AS empty_streams FROM matches WHERE n_rows = 0
  GROUP BY 1""",
    "size_check": f"""
  WITH {NATION_REQUESTS_SQL},
  t AS (SELECT request_no, CAST(coalesce(sum({_WIDE}), 0) AS BIGINT) AS total_size,
               CAST(coalesce(sum(8 * n), 0) AS BIGINT) AS total_dim_size
        FROM expanded LEFT JOIN extents USING (stream) GROUP BY 1)
  SELECT *, 'Max data request: ' || {_size_sql("total_size")} AS msg, total_dim_size <= 40000 AS admitted FROM t""",
    "stream_size_check": f"""
  WITH {NATION_REQUESTS_SQL}
  SELECT request_no, stream, n IS NOT NULL AS known, CAST(coalesce({_WIDE}, 0) AS BIGINT) AS total_size
  FROM expanded LEFT JOIN extents USING (stream)""",
    "request_outcomes": f"""
  WITH {NATION_REQUESTS_SQL}, {_MATCHES},
  per AS (
    SELECT request_no, count(*) AS n_streams, bool_or(n IS NULL) AS unknown, bool_or(st IS NULL OR en IS NULL) AS undated,
           bool_or(coalesce({_COVERED["reference"]}, FALSE) AND n_match = 0) AS unmatched,
           bool_or(NOT coalesce({_COVERED["reference"]}, FALSE)) AS uncovered, bool_or(n_rows = 0) AS hollow,
           CAST(sum(n_rows) AS BIGINT) AS n_selected, first(color) AS color,
           first(CAST(greatest(ceil((epoch_us(en) - epoch_us(st)) / 1e6), 0) AS BIGINT)) AS ticks
    FROM expanded LEFT JOIN extents USING (stream) JOIN matches USING (request_no, stream) GROUP BY 1),
  sized AS (
    SELECT *, CASE WHEN n_streams = 1 THEN n_selected ELSE ticks END AS merged_rows,
           CASE WHEN color = '' THEN 16 ELSE 24 END AS width,
           CASE WHEN coalesce(download_format, '') = '' THEN 'netcdf' ELSE download_format END AS format
    FROM per JOIN (SELECT request_no, start_dt, end_dt, download, download_format FROM requests) USING (request_no)),
  told AS (
    SELECT *, CASE WHEN unknown THEN 'failed:unknown stream' WHEN undated THEN 'failed:unreadable time'
                   WHEN unmatched THEN 'failed:no matching rows' WHEN uncovered THEN 'no data:not covered'
                   WHEN hollow THEN 'no data:empty streams' WHEN merged_rows = 0 THEN 'no data:merged empty'
                   WHEN download AND format = 'csv' AND ceil(merged_rows * width / 20000.0) > 100
                     THEN 'refused:too many files'
                   WHEN download AND format NOT IN ('csv', 'json', 'netcdf') THEN 'failed:unknown format'
                   WHEN download THEN 'file:download' ELSE 'plot:plot' END AS found FROM sized)
  SELECT request_no, n_streams, merged_rows, split_part(found, ':', 1) AS outcome, split_part(found, ':', 2) AS reason,
         CASE WHEN found LIKE 'failed%' THEN 'failed' ELSE 'completed' END AS status,
         CASE split_part(found, ':', 1) WHEN 'no data' THEN 'No data found for ' || start_dt || ' to ' || end_dt
              WHEN 'refused' THEN 'The amount of data to be downloaded is too large for CSV data format. Please make a smaller request.'
              WHEN 'failed' THEN 'Request failed: ' || split_part(found, ':', 2) ELSE 'Result finished.' END AS msg
  FROM told""",
    "request_outcomes_whole": f"""
  WITH {NATION_REQUESTS_SQL},
  samples AS (SELECT event_type AS stream, ts, event_id FROM events
              UNION ALL SELECT s, ts, 2 * event_id + k FROM events, (VALUES ('pair'), ('pair2')) a(s), (VALUES (0), (1)) b(k)
              WHERE event_id % 10 = (SELECT CAST(floor(quantile_cont(event_id, 0.5)) AS BIGINT) FROM events) % 10),
  middle AS (SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS moment FROM events
             WHERE event_id = (SELECT CAST(floor(quantile_cont(event_id, 0.5)) AS BIGINT) FROM events)),
  asked AS (SELECT * FROM requests
            UNION ALL SELECT 100, event_type, moment, moment, '', 'netcdf', FALSE FROM middle
            UNION ALL SELECT 101, 'pair,pair2', moment, moment, '', 'netcdf', FALSE FROM middle),
  each AS (SELECT DISTINCT request_no, unnest(string_split(ref, ',')) AS stream, color, TRY_CAST(start_dt AS TIMESTAMP) AS st,
                  TRY_CAST(end_dt AS TIMESTAMP) AS en FROM asked),
  spans AS (SELECT stream, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n FROM samples GROUP BY 1),
  found AS (SELECT request_no, e.stream, count(event_id) AS n_match,
                   CAST(greatest(count(event_id) - 1, 0) AS BIGINT) AS n_rows
            FROM each e LEFT JOIN samples s ON e.stream = s.stream AND ts BETWEEN st AND en GROUP BY 1, 2),
  per AS (
    SELECT request_no, count(*) AS n_streams, bool_or(n IS NULL) AS unknown, bool_or(st IS NULL OR en IS NULL) AS undated,
           CAST(sum(coalesce({_WIDE}, 0)) AS BIGINT) AS total_size, CAST(sum(coalesce(8 * n, 0)) AS BIGINT) AS total_dim_size,
           bool_or(coalesce({_COVERED["reference"]}, FALSE) AND n_match = 0) AS unmatched,
           bool_or(NOT coalesce({_COVERED["reference"]}, FALSE)) AS uncovered,
           coalesce(string_agg(CASE WHEN n_rows = 0 THEN stream END, ',' ORDER BY stream), '') AS empty_streams,
           CAST(sum(n_rows) AS BIGINT) AS n_selected, first(color) AS color, bool_or(n IS NOT NULL) AS is_known,
           first(CAST(greatest(ceil((epoch_us(en) - epoch_us(st)) / 1e6), 0) AS BIGINT)) AS ticks
    FROM each LEFT JOIN spans USING (stream) JOIN found USING (request_no, stream) GROUP BY 1),
  sized AS (
    SELECT *, CASE WHEN n_streams = 1 THEN n_selected ELSE ticks END AS merged_rows,
           CASE WHEN color = '' THEN 16 ELSE 24 END AS width,
           CASE WHEN coalesce(download_format, '') = '' THEN 'netcdf' ELSE download_format END AS format
    FROM per JOIN (SELECT request_no, start_dt, end_dt, download, download_format FROM asked) USING (request_no)),
  planned AS (SELECT *, merged_rows * CASE WHEN n_streams = 1 AND NOT is_known THEN 0 ELSE width END AS merged_bytes FROM sized),
  counted AS (
    SELECT *, CAST(CASE WHEN NOT download THEN 0
                   WHEN format = 'netcdf' THEN ceil(merged_rows / nullif(ceil(merged_rows / nullif(merged_bytes / 1e8, 0)), 0))
                   WHEN format IN ('csv', 'json') THEN greatest(ceil(merged_bytes / 20000.0), 1) END AS BIGINT) AS n_files
    FROM planned),
  told AS (
    SELECT *, CASE WHEN unknown THEN 'failed:unknown stream' WHEN undated THEN 'failed:unreadable time'
                   WHEN total_dim_size > 4 * (SELECT count(*) FROM events) THEN 'no data:too large'
                   WHEN unmatched THEN 'failed:no matching rows' WHEN uncovered THEN 'no data:not covered'
                   WHEN empty_streams <> '' THEN 'no data:empty streams' WHEN merged_rows = 0 THEN 'no data:merged empty'
                   WHEN download AND n_files > 100 THEN 'refused:too many files'
                   WHEN download AND format NOT IN ('csv', 'json', 'netcdf') THEN 'failed:unknown format'
                   WHEN download THEN 'file:download' ELSE 'plot:plot' END AS result FROM counted)
  SELECT request_no, n_streams, total_size, total_dim_size, empty_streams, merged_rows, merged_bytes, n_files,
         split_part(result, ':', 1) AS outcome, split_part(result, ':', 2) AS reason,
         CASE WHEN result LIKE 'failed%' THEN 'failed' ELSE 'completed' END AS status,
         CASE split_part(result, ':', 1) WHEN 'no data' THEN 'No data found for ' || start_dt || ' to ' || end_dt
              WHEN 'refused' THEN 'The amount of data to be downloaded is too large for CSV data format. Please make a smaller request.'
              WHEN 'failed' THEN 'Request failed: ' || split_part(result, ':', 2) ELSE 'Result finished.' END AS msg
  FROM told""",
    "request_dedupe": """
  SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'click,view' ELSE 'error' END AS ref, 'time' AS x, 'value' AS y,
         strftime(o_orderdate, '%Y-%m') || '-01' AS start_dt, strftime(o_orderdate, '%Y-%m') || '-28' AS end_dt,
         '' AS z, o_orderpriority[1] AS color, 'netcdf' AS download_format, FALSE AS download FROM orders""",
    "slice_plan": f"""
  SELECT *, n_files <= 8 AS allowed, CASE WHEN n_files > 8 THEN 'refused' WHEN n_files = 1 THEN 'file' ELSE 'folder' END
         AS layout
  FROM (SELECT *, CAST(ceil(rows / rows_per_slice) AS BIGINT) AS n_files FROM ({_SLICED}))""",
    "slice_bounds": f"""
  SELECT l_returnflag, l_linestatus, rows, size, slice_id, slice_id * rows_per_slice AS start_row,
         (slice_id + 1) * rows_per_slice AS end_row
  FROM (SELECT *, unnest(range(CAST(ceil(rows / rows_per_slice) AS BIGINT))) AS slice_id FROM ({_SLICED}))""",
    "csv_part_plan": f"""
  SELECT *, n_files <= 8 AS allowed, CASE WHEN n_files > 8 THEN 'The amount of data to be downloaded is too large for CSV data format. Please make a smaller request.' END AS msg,
         {_size_sql("size")} AS size_text
  FROM (SELECT *, CAST(ceil(size / 100000.0) AS BIGINT) AS n_files FROM ({_LINES_SIZE}))""",
    "table_sizes": f"""
  SELECT *, {_size_sql("size")} AS text FROM (
    SELECT 'events' AS "table", count(*) AS rows,
           CAST(sum(32 + strlen(event_type) + strlen(props)) AS BIGINT) AS size FROM events
    UNION ALL SELECT 'lineitem', count(*), CAST({_LINE_BYTES} AS BIGINT) FROM lineitem
    UNION ALL SELECT 'orders', count(*), CAST(sum(32 + strlen(o_orderstatus) + strlen(o_orderpriority)) AS BIGINT)
      FROM orders
    UNION ALL SELECT 'customer', count(*), CAST(sum(20 + strlen(c_name) + strlen(c_mktsegment)) AS BIGINT) FROM customer
    UNION ALL SELECT 'supplier', count(*), CAST(sum(20 + strlen(s_name)) AS BIGINT) FROM supplier
    UNION ALL SELECT 'part', count(*), CAST(sum(20 + strlen(p_name) + strlen(p_brand) + strlen(p_type)) AS BIGINT)
      FROM part
    UNION ALL SELECT 'nation', count(*), CAST(sum(8 + strlen(n_name)) AS BIGINT) FROM nation
    UNION ALL SELECT 'region', count(*), CAST(sum(4 + strlen(r_name)) AS BIGINT) FROM region
    UNION ALL SELECT 'embeddings', count(*), CAST(sum(12 + 4 * len(embedding)) AS BIGINT) FROM embeddings)""",
    "csv_roundtrip": _LINE_TABLE,
    "csv_quoted_roundtrip": """
  SELECT ts AS time, event_id, 'he said "' || props || '", then' || chr(10) || event_type AS note, true AS files_agree
  FROM events""",
    "json_roundtrip": _LINE_TABLE,
    "sliced_roundtrip": f"""
  WITH {_LINE_PLAN},
  r AS (SELECT l_shipdate AS time, row_number() OVER (ORDER BY l_shipdate) - 1 AS i FROM lineitem)
  SELECT i // step AS slice_id, count(*) AS rows, min(time) AS first_time, max(time) AS last_time
  FROM r, plan GROUP BY 1""",
    "sliced_events": """
  WITH p AS (SELECT CAST(ceil(count(*) / (sum(32 + strlen(event_type) + strlen(props)) / 30000.0::DOUBLE)) AS BIGINT) AS step
             FROM events)
  SELECT event_id, ts AS time, user_id, event_type, value, props, (row_number() OVER (ORDER BY ts) - 1) // step AS slice_id
  FROM events, p""",
    "export_manifest": f"""
  WITH {_LINE_PLAN}
  SELECT 'lineitem' AS streams, 'time' AS x, 'l_quantity' AS y, '1995-01-01' AS start_datetime,
         '2003-01-01' AS end_datetime, CAST(ceil(n / step) AS BIGINT) AS n_files, n AS n_rows FROM plan""",
    "stored_results_mixed": "SELECT ts AS time, user_id FROM events WHERE event_type = 'view'",
    "stored_results": """
  SELECT event_type AS stream, ts AS time, value, user_id, event_id AS _pos FROM events""",
    "stored_stream": """
  WITH b AS (SELECT max(event_id) AS z FROM events
             WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:00:00')
  SELECT ts AS time, value, event_id AS _pos FROM events, b
  WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 06:00:00' AND event_id < z""",
    "stream_record": """
  SELECT n AS rows, a AS first_time, b AS last_time, TRUE AS ordered, n = u AS "unique", variable, dtype, n AS n_present,
         n AS n_values, 8 * n AS n_bytes
  FROM (SELECT count(*) AS n, min(ts) AS a, max(ts) AS b, count(DISTINCT ts) AS u FROM events),
       (VALUES ('time', 'timestamp_ntz'), ('value', 'double'), ('user_id', 'bigint'), ('_pos', 'bigint')) v(variable, dtype)""",
    "recorded_manifest": """
  SELECT 'events' AS stream, variable, 'time' AS dims, 0::INTEGER AS attrs, dtype, 8::INTEGER AS item_bytes, n AS n_values,
         8 * n AS n_bytes, variable = 'time' AS is_dim
  FROM (SELECT count(*) AS n FROM events),
       (VALUES ('time', 'timestamp_ntz'), ('value', 'double'), ('user_id', 'bigint')) v(variable, dtype)""",
    "stored_plot": """
  WITH m AS (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-19 18:00:00')
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, value, user_id, (SELECT count(*) - 1 FROM m) AS count
  FROM m WHERE event_id < (SELECT max(event_id) FROM m)""",
    "list_pages": """
  WITH r AS (SELECT ts, user_id, row_number() OVER (ORDER BY ts) - 1 AS i FROM events WHERE event_type = 'click')
  SELECT i // 150 AS page, string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ',' ORDER BY i) AS time,
         string_agg(user_id, ',' ORDER BY i) AS user_id, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY 1""",
    "reused_result": """
  WITH m AS (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-19 18:00:00')
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, value, reused, (SELECT count(*) - 1 FROM m) AS count
  FROM m, (VALUES (FALSE), (TRUE)) v(reused) WHERE event_id < (SELECT max(event_id) FROM m)""",
    "json_records": """
  SELECT CAST(to_json({c_custkey: c_custkey, c_name: c_name, c_nationkey: c_nationkey, c_acctbal: c_acctbal,
                       c_mktsegment: c_mktsegment})
              AS VARCHAR) AS record FROM customer""",
}
