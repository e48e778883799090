"""How the given tables stand for streams, requests and sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorframe.plans.requests import with_request_id

# The whole span of the event table, as the time range of a request.
START, END = "2024-01-01T00:00:00", "2024-01-31T00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: one stream per event type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stream"),
        F.col("ts").alias("time"),
        "value",
        "user_id",
        F.col("event_id").alias("_pos"),
    )


def nation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per nation, covering the outcomes a request can have."""
    n = F.col("n_nationkey")
    day = F.lpad(((n % 9) + 2).cast("string"), 2, "0")
    last = F.lpad(((n % 9) + 4).cast("string"), 2, "0")
    ref = (
        F.when(n % 5 == 0, "click")
        .when(n % 5 == 1, "click,view")
        .when(n % 5 == 2, "error,error")
        .when(n % 5 == 3, "signup,purchase,view")
        .otherwise("view")
    )
    start = F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00"))
    end = F.concat(F.lit("2024-01-"), last, F.lit(" 12:30:00"))
    rows = table(spark, sf_dir, "nation").select(
        n.alias("request_no"),
        F.when(n == 7, "click,unheard").otherwise(ref).alias("ref"),
        F.lit("time").alias("x"),
        F.lit("value").alias("y"),
        F.when(n == 3, "2023-01-01").when(n == 4, "2023-12-01").when(n == 8, end).otherwise(start).alias("start_dt"),
        F.when(n == 3, "2023-02-01")
        .when(n == 4, "2024-03-01")
        .when(n == 8, start)
        .when(n == 11, start)
        .when(n == 12, "soon")
        .otherwise(end)
        .alias("end_dt"),
        F.lit("").alias("z"),
        F.when(n % 2 == 0, "user_id").otherwise("").alias("color"),
        F.when(n % 7 == 1, "csv").when(n % 7 == 2, "").when(n % 7 == 5, "netcdf4").otherwise("netcdf").alias(
            "download_format"
        ),
        (n % 3 == 1).alias("download"),
    )
    return with_request_id(rows)


# The same requests as SQL, for the check.
NATION_REQUESTS_SQL = """
requests AS (
  SELECT n AS request_no,
         CASE WHEN n = 7 THEN 'click,unheard' WHEN n % 5 = 0 THEN 'click' WHEN n % 5 = 1 THEN 'click,view'
              WHEN n % 5 = 2 THEN 'error,error' WHEN n % 5 = 3 THEN 'signup,purchase,view' ELSE 'view' END AS ref,
         CASE WHEN n = 3 THEN '2023-01-01' WHEN n = 4 THEN '2023-12-01' WHEN n = 8 THEN e ELSE s END AS start_dt,
         CASE WHEN n = 3 THEN '2023-02-01' WHEN n = 4 THEN '2024-03-01' WHEN n = 8 THEN s WHEN n = 11 THEN s
              WHEN n = 12 THEN 'soon' ELSE e END AS end_dt,
         CASE WHEN n % 2 = 0 THEN 'user_id' ELSE '' END AS color,
         CASE WHEN n % 7 = 1 THEN 'csv' WHEN n % 7 = 2 THEN '' WHEN n % 7 = 5 THEN 'netcdf4' ELSE 'netcdf' END
           AS download_format,
         n % 3 = 1 AS download
  FROM (SELECT n_nationkey AS n,
               '2024-01-' || lpad(CAST(n_nationkey % 9 + 2 AS VARCHAR), 2, '0') || 'T00:00:00' AS s,
               '2024-01-' || lpad(CAST(n_nationkey % 9 + 4 AS VARCHAR), 2, '0') || ' 12:30:00' AS e FROM nation)),
expanded AS (
  SELECT DISTINCT request_no, unnest(string_split(ref, ',')) AS stream, color,
         TRY_CAST(start_dt AS TIMESTAMP) AS st, TRY_CAST(end_dt AS TIMESTAMP) AS en FROM requests),
extents AS (SELECT event_type AS stream, min(ts) AS first_time, max(ts) AS last_time, count(*) AS n
            FROM events GROUP BY 1)"""


def raw_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dirty sample rows: every column text, with markers and bad values."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("string")
    station = (
        F.when(k % 6 == 0, "Slope Base")
        .when(k % 6 == 1, "CEO2SHBP")
        .when(k % 6 == 2, "Axial Caldera")
        .when(k % 6 == 3, "CE04OSBP")
        .when(k % 6 == 4, "Southern Hydrate Ridge")
        .otherwise("CE09OSSM")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("cruise-"), F.col("o_orderstatus")).alias("cruise_id"),
        F.when(k % 2 == 0, "RS").otherwise("CE").alias("array_rd"),
        F.when(k % 11 == 0, "-9999999").otherwise(F.concat(F.lit("C"), F.col("o_custkey"))).alias("cruise"),
        station.alias("station"),
        F.when(k % 13 == 0, "unknown")
        .when(k % 13 == 1, "-9999999")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("start_time"),
        F.when(k % 7 == 0, "-9999999.0").when(k % 7 == 1, "n/a").when(k % 7 == 2, "bad").otherwise(price).alias(
            "ctd_temperature_1"
        ),
        F.when(k % 5 == 0, "").otherwise((k % 100).cast("string")).alias("ctd_temperature_2"),
        F.when(k % 3 == 0, "-9999999").otherwise((k % 1000).cast("string")).alias("ctd_conductivity_1"),
        (k % 50).cast("string").alias("ctd_conductivity_2"),
        (k % 35).cast("string").alias("ctd_salinity_1"),
        F.lit("").alias("ctd_salinity_2"),
        (k % 5000).cast("string").alias("ctd_pressure"),
        F.when(k % 17 == 0, "flagged").otherwise("0").alias("ctd_pressure_flag"),
        F.concat(F.lit("cast"), k % 9).alias("ctd_file"),
        F.when(k % 4 == 0, F.lit("trace")).otherwise((k % 77).cast("string")).alias("discrete_oxygen"),
        F.lit("-9999999").alias("calculated_dic"),
        (k % 3).cast("string").alias("calculated_pco2"),
    )


# The same rows, cleaned, as SQL.
CLEAN_SAMPLES_SQL = """
raw AS (
  SELECT o_orderkey AS k, 'cruise-' || o_orderstatus AS cruise_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'RS' ELSE 'CE' END AS array_rd,
         CASE WHEN o_orderkey % 11 <> 0 THEN 'C' || CAST(o_custkey AS VARCHAR) END AS cruise,
         CASE o_orderkey % 6 WHEN 0 THEN 'Slope Base' WHEN 1 THEN 'CEO2SHBP' WHEN 2 THEN 'Axial Caldera'
              WHEN 3 THEN 'CE04OSBP' WHEN 4 THEN 'Southern Hydrate Ridge' ELSE 'CE09OSSM' END AS st,
         CASE WHEN o_orderkey % 13 > 1 THEN o_orderdate END AS start_time,
         CASE WHEN o_orderkey % 7 > 2 THEN o_totalprice END AS ctd_temperature_1,
         CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) END AS ctd_temperature_2,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 1000 AS DOUBLE) END AS ctd_conductivity_1,
         CAST(o_orderkey % 50 AS DOUBLE) AS ctd_conductivity_2,
         CAST(o_orderkey % 35 AS DOUBLE) AS ctd_salinity_1, CAST(NULL AS DOUBLE) AS ctd_salinity_2,
         CAST(o_orderkey % 5000 AS DOUBLE) AS ctd_pressure,
         CASE WHEN o_orderkey % 17 <> 0 THEN 0.0::DOUBLE END AS ctd_pressure_flag,
         'cast' || CAST(o_orderkey % 9 AS VARCHAR) AS ctd_file,
         CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 77 AS DOUBLE) END AS discrete_oxygen,
         CAST(NULL AS DOUBLE) AS calculated_dic, CAST(o_orderkey % 3 AS DOUBLE) AS calculated_pco2
  FROM orders),
clean AS (
  SELECT * EXCLUDE (k, st), CASE WHEN array_rd = 'CE' THEN replace(st, 'O', '0') ELSE st END AS station
  FROM raw WHERE cruise IS NOT NULL AND start_time IS NOT NULL),
derived AS (
  SELECT *, coalesce(ctd_temperature_1, ctd_temperature_2) AS ctd_temperature,
         coalesce(ctd_conductivity_1, ctd_conductivity_2) AS ctd_conductivity,
         coalesce(ctd_salinity_1, ctd_salinity_2) AS ctd_salinity, strftime(start_time, '%Y-%m') AS date,
         CASE WHEN lower(station) LIKE '%slope base%' THEN 'oregon-slope-base'
              WHEN lower(station) LIKE '%axial caldera%' THEN 'axial-caldera'
              WHEN lower(station) LIKE '%hydrate ridge%' THEN 'southern-hydrate-ridge'
              WHEN lower(station) LIKE '%ce02%' THEN 'oregon-shelf'
              WHEN lower(station) LIKE '%ce04%' THEN 'oregon-offshore'
              WHEN lower(station) LIKE '%ce09%' THEN 'washington-offshore' END AS area_rd
  FROM clean)"""
