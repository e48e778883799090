"""Queries over cruise samples: headers, cleaning, areas, labels, tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sensorframe.functions.cftime import parse_datetime, year_month
from sensorframe.functions.samples import repair_station, station_area
from sensorframe.operators.clean import (
    cast_measurements,
    distinct_values,
    drop_empty_columns,
    drop_empty_rows,
    invalid_values,
    null_sentinels,
)
from sensorframe.operators.labels import latest_labels, lookup_labels, merge_labels, parse_headers
from sensorframe.operators.merge import tagged_union
from sensorframe.operators.split import OPTIONAL_COLUMNS, derive_columns, pick_sensors, split_samples
from sensorframe.plans.cruise import clean_samples, load_cruises, store_cruises
from sensorframe.queries.bindings import CLEAN_SAMPLES_SQL, raw_samples, table
from sensorframe.session import shared_folder
from sensorframe.sources.samples import (
    read_cruises,
    read_labels,
    read_samples,
    read_sources,
    write_labels,
    write_samples,
    write_sources,
)


def _folder(spark, name):
    return f"{shared_folder(spark)}/sensorframe-{name}-{uuid.uuid4().hex}"


def header_parse(spark, sf_dir):
    """Headers made from part names, with the misspellings the repair knows."""
    k = F.col("p_partkey")
    words = F.initcap("p_name")
    raw = (
        F.when(k % 9 == 0, F.concat(words, F.lit(" Fluorescense"), F.lit(" ["), F.col("p_brand"), F.lit("]")))
        .when(k % 9 == 1, F.concat(F.lit("CTD Flourescence "), words))
        .when(k % 9 == 2, F.concat(words, F.lit(" Start Positioning Depth [m]")))
        .when(k % 9 == 3, F.concat(words, F.lit(" pHAnalysis")))
        .when(k % 9 == 4, F.lit("CTD Transmissometer Flag"))
        .when(k % 9 == 5, F.concat(words, F.lit(" (mL/L)")))
        .when(k % 9 == 6, F.concat(words, F.lit(" Closure-Time [UTC]")))
        .otherwise(F.concat(words, F.lit(" ["), F.lower("p_type"), F.lit("]")))
    )
    return parse_headers(table(spark, sf_dir, "part").select("p_partkey", raw.alias("header")))


def cleaned_samples(spark, sf_dir):
    return clean_samples(raw_samples(spark, sf_dir))


def strict_cast(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("cruise_id", "ctd_temperature_1", "ctd_pressure", "calculated_dic")
    cast = cast_measurements(null_sentinels(rows), strict=True, by=["cruise_id"])
    return cast.groupBy("cruise_id").agg(
        *[F.count(c).alias(c) for c in ("ctd_temperature_1", "ctd_pressure", "calculated_dic")]
    )


def sentinel_nulls(spark, sf_dir):
    """Number and text markers put in by rule, then nulled; empty rows are dropped."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        F.when(k % 4 != 0, F.when(k % 3 == 0, F.lit(-9999999.0)).otherwise(F.col("c_acctbal"))).alias("amount"),
        F.when(k % 4 != 0, F.when(k % 5 == 0, F.lit("-9999999")).otherwise(F.col("c_name"))).alias("name"),
    )
    return drop_empty_rows(null_sentinels(rows))


def time_parsing(spark, sf_dir):
    """One instant of every order, written in many ways."""
    k, t = F.col("o_orderkey"), F.timestamp_add("SECOND", F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz"))
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyyMMdd'T'HHmmss", "M/d/yyyy H:mm:ss", "yyyy/M/d H:mm:ss"]
    text = F.lit("not a time")
    for i, form in enumerate(forms):
        text = F.when(k % 6 == i, F.date_format(t, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_datetime(text).alias("time"))


def time_forms(spark, sf_dir):
    """One minute of every order, in the forms of spreadsheets."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    t = F.timestamp_add("MINUTE", F.pmod(k, F.lit(1440)).cast("int"), day)
    forms = [
        "M/d/yy H:mm",
        "d-MMM-yyyy H:mm",
        "M/d/yyyy h:mm a",
        "yyyy-MM-dd hh:mm a",
        "d MMM yyyy H:mm",
        "yyyyMMdd HH:mm:ss",
        "MMMM d, yyyy",
    ]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k % 7 == i, F.date_format(t, form)).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", parse_datetime(text).alias("time"))


def area_of_station(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("array_rd", "station")
    fixed = rows.withColumn("station", repair_station(F.col("station"), F.col("array_rd")))
    counted = fixed.withColumn("area_rd", station_area(F.col("station"), "null"))
    return counted.groupBy("array_rd", "station", "area_rd").agg(F.count(F.lit(1)).alias("n"))


def code_repair(spark, sf_dir):
    rows = raw_samples(spark, sf_dir).select("array_rd", "station")
    fixed = rows.withColumn("station", repair_station(F.col("station"), F.col("array_rd"), only_codes=True))
    return distinct_values(fixed, "station")


def order_months(spark, sf_dir):
    months = table(spark, sf_dir, "orders").select(year_month(F.col("o_orderdate")).alias("date"))
    return months.groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def double_sensor(spark, sf_dir):
    k = F.col("l_linenumber") + F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(k % 3 != 0, F.col("l_quantity")).alias("ctd_temperature_1"),
        F.when(k % 5 != 0, F.col("l_discount")).alias("ctd_temperature_2"),
    )
    return pick_sensors(rows, ("ctd_temperature",))


def union_missing(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    return tagged_union({"RS": customers, "CE": suppliers}, "array_rd")


def _part_labels(spark, sf_dir):
    """Labels as read from files: parts are header cells, brands the order of the files."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(k % 3 == 0, "RS").otherwise("CE").alias("array_rd"),
        F.col("p_size").cast("bigint").alias("source_order"),
        F.concat(F.lit("v"), (k % 40).cast("string")).alias("name"),
        F.col("p_name").alias("display_name"),
        F.when(k % 2 == 0, F.col("p_type")).alias("unit"),
    )


def last_labels(spark, sf_dir):
    return latest_labels(_part_labels(spark, sf_dir))


def _nation_labels(spark, sf_dir, regions):
    rows = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(*regions))
    return rows.select(
        F.concat(F.lit("v"), (F.col("n_nationkey") % 12).cast("string")).alias("name"),
        F.col("n_name").alias("display_name"),
        F.col("n_regionkey").cast("string").alias("unit"),
    )


def label_precedence(spark, sf_dir):
    return merge_labels(_nation_labels(spark, sf_dir, (0, 1)), _nation_labels(spark, sf_dir, (2, 3, 4)))


def label_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("NATION_"), (F.col("c_custkey") % 30).cast("string")).alias("name")
    )
    labels = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("name"), F.lower("n_name").alias("display_name"), F.lit("km").alias("unit")
    )
    return lookup_labels(names.distinct(), labels)


def invalid_report(spark, sf_dir):
    return invalid_values(null_sentinels(raw_samples(spark, sf_dir), ("cruise_id", "array_rd")))


def _derived(spark, sf_dir):
    return derive_columns(clean_samples(raw_samples(spark, sf_dir)))


def profile_table(spark, sf_dir):
    return split_samples(_derived(spark, sf_dir))[0]


def discrete_table(spark, sf_dir):
    discrete = split_samples(_derived(spark, sf_dir))[1]
    return drop_empty_columns(discrete, OPTIONAL_COLUMNS)


# Headers of the written sample files, by column; some need the spelling repair.
FILE_HEADERS = {
    "cruise": "Cruise",
    "station": "Station",
    "start_time": "Start Time [UTC]",
    "ctd_temperature_1": "CTD Temperature 1 [deg C]",
    "ctd_temperature_2": "CTD Temperature 2 [deg C]",
    "ctd_conductivity_1": "CTD Conductivity 1 [S/m]",
    "ctd_conductivity_2": "CTD Conductivity 2 [S/m]",
    "ctd_salinity_1": "CTD Salinity 1 [psu]",
    "ctd_salinity_2": "CTD Salinity 2 [psu]",
    "ctd_pressure": "CTD Pressure [db]",
    "ctd_pressure_flag": "CTD Pressure Flag",
    "ctd_file": "CTD File",
    "discrete_oxygen": "Discrete Oxygen [mL/L]",
    "calculated_dic": "Calculated DIC [umol/kg]",
    "calculated_pco2": "Calculated pCO2 [uatm]",
}


def _stored_cruises(spark, sf_dir):
    """Raw samples written as CSV files per cruise and array, then loaded from a source list."""
    root = _folder(spark, "cruise")
    raw = raw_samples(spark, sf_dir)
    named = raw.select(
        F.concat_ws("_", "cruise_id", "array_rd").alias("part"), *[F.col(c).alias(h) for c, h in FILE_HEADERS.items()]
    )
    named.write.option("header", True).partitionBy("part").csv(f"{root}/files")
    found = spark.read.format("binaryFile").load(f"{root}/files").select("path", "part")
    sources = found.select(
        F.split("part", "_")[0].alias("cruise_id"),
        F.split("part", "_")[1].alias("array_rd"),
        F.col("path").alias("summary_url"),
        F.hash("path").cast("bigint").alias("source_order"),
    )
    write_sources(sources, f"{root}/list")
    tables = load_cruises(spark, read_sources(spark, f"{root}/list"))
    store_cruises(tables, sources, root)
    return root


def cruise_profile(spark, sf_dir):
    return read_samples(spark, _stored_cruises(spark, sf_dir), "profile")


def cruise_discrete(spark, sf_dir):
    return read_samples(spark, _stored_cruises(spark, sf_dir), "discrete")


def cruise_labels(spark, sf_dir):
    return read_labels(spark, f"{_stored_cruises(spark, sf_dir)}/labels")


def cruise_quoted_header(spark, sf_dir):
    """Files whose headers and cells hold line breaks, commas and quotes, as they are read."""
    root = _folder(spark, "quoted")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("part"),
        F.concat(F.lit("C"), "o_orderkey").alias("Cruise"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("Start\nTime [UTC]"),
        F.concat(F.lit('said "'), "o_orderpriority", F.lit('",\nthen\n'), "o_custkey").alias("Remark of\ncrew [text]"),
    )
    rows.write.option("header", True).option("escape", '"').partitionBy("part").csv(f"{root}/files")
    found = spark.read.format("binaryFile").load(f"{root}/files")
    sources = found.select(F.col("part").alias("cruise_id"), F.lit("RS").alias("array_rd"), F.col("path").alias("summary_url"))
    return read_cruises(spark, sources)[0]


def label_roundtrip(spark, sf_dir):
    root = _folder(spark, "labels")
    write_labels(_part_labels(spark, sf_dir), root)
    return read_labels(spark, root)


def sample_roundtrip(spark, sf_dir):
    root = _folder(spark, "tables")
    write_samples(table(spark, sf_dir, "supplier"), f"{root}/profile", partitions=2)
    return read_samples(spark, root, "profile")


QUERIES = {
    "header_parse": header_parse,
    "cruise_quoted_header": cruise_quoted_header,
    "clean_samples": cleaned_samples,
    "strict_cast": strict_cast,
    "sentinel_nulls": sentinel_nulls,
    "time_parsing": time_parsing,
    "time_forms": time_forms,
    "station_area": area_of_station,
    "station_code_repair": code_repair,
    "year_months": order_months,
    "double_sensor": double_sensor,
    "union_missing": union_missing,
    "latest_labels": last_labels,
    "label_precedence": label_precedence,
    "label_lookup": label_lookup,
    "invalid_value_report": invalid_report,
    "profile_table": profile_table,
    "discrete_table": discrete_table,
    "cruise_profile": cruise_profile,
    "cruise_discrete": cruise_discrete,
    "cruise_labels": cruise_labels,
    "label_roundtrip": label_roundtrip,
    "sample_roundtrip": sample_roundtrip,
}

_PROFILE = "ctd_pressure, cruise_id, ctd_temperature, ctd_conductivity, ctd_salinity, date, area_rd, array_rd"
_DISCRETE = "ctd_pressure, cruise_id, discrete_oxygen, calculated_pco2, date, area_rd, array_rd"
_PART_LABELS = """
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'RS' ELSE 'CE' END AS array_rd, CAST(p_size AS BIGINT) AS source_order,
         'v' || CAST(p_partkey % 40 AS VARCHAR) AS name, p_name AS display_name,
         CASE WHEN p_partkey % 2 = 0 THEN p_type END AS unit FROM part"""
_NATION_LABELS = """
  SELECT 'v' || CAST(n_nationkey % 12 AS VARCHAR) AS name, n_name AS display_name,
         CAST(n_regionkey AS VARCHAR) AS unit FROM nation"""
_PART_WORDS = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_LABEL_ROWS = ", ".join(
    f"('{name}', '{header.split(' [')[0]}', {repr(header.split(' [')[1][:-1]) if ' [' in header else 'NULL'})"
    for name, header in FILE_HEADERS.items()
)

ORACLES = {
    "cruise_quoted_header": """
  SELECT o_orderstatus AS cruise_id, 'RS' AS array_rd, 'C' || o_orderkey AS cruise,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_time,
         'said "' || o_orderpriority || '",' || chr(10) || 'then' || chr(10) || o_custkey AS remark_of_crew FROM orders""",
    "header_parse": f"""
  WITH w AS (SELECT p_partkey, p_partkey % 9 AS k, {_PART_WORDS} AS w, p_brand, lower(p_type) AS t FROM part),
  h AS (
    SELECT p_partkey, k, w,
           CASE k WHEN 0 THEN w || ' Fluorescense [' || p_brand || ']' WHEN 1 THEN 'CTD Flourescence ' || w
                  WHEN 2 THEN w || ' Start Positioning Depth [m]' WHEN 3 THEN w || ' pHAnalysis'
                  WHEN 4 THEN 'CTD Transmissometer Flag' WHEN 5 THEN w || ' (mL/L)'
                  WHEN 6 THEN w || ' Closure-Time [UTC]' ELSE w || ' [' || t || ']' END AS header,
           CASE k WHEN 0 THEN w || ' Fluorescence' WHEN 1 THEN 'CTD Fluorescence ' || w
                  WHEN 2 THEN 'Bottom Depth at Start Position' WHEN 3 THEN w || ' pH Analysis'
                  WHEN 4 THEN 'CTD Beam Transmissometer Flag' WHEN 5 THEN w WHEN 6 THEN w || ' Closure-Time'
                  ELSE w END AS display_name,
           CASE k WHEN 0 THEN p_brand WHEN 2 THEN 'm' WHEN 6 THEN 'UTC' WHEN 7 THEN t WHEN 8 THEN t END AS unit FROM w)
  SELECT p_partkey, header, replace(lower(display_name), ' ', '_') AS name, display_name, unit FROM h""",
    "clean_samples": f"WITH {CLEAN_SAMPLES_SQL} SELECT * FROM clean",
    "strict_cast": f"""
  WITH {CLEAN_SAMPLES_SQL}
  SELECT cruise_id, CAST(0 AS BIGINT) AS ctd_temperature_1, count(ctd_pressure) AS ctd_pressure,
         count(calculated_dic) AS calculated_dic FROM raw GROUP BY 1""",
    "sentinel_nulls": """
  SELECT * FROM (SELECT CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS amount,
                        CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS name FROM customer WHERE c_custkey % 4 <> 0)
  WHERE amount IS NOT NULL OR name IS NOT NULL""",
    "time_forms": """
  SELECT o_orderkey, date_trunc('day', o_orderdate)
         + CASE WHEN o_orderkey % 7 = 6 THEN INTERVAL 0 MINUTE ELSE to_minutes(o_orderkey % 1440) END AS time
  FROM orders""",
    "time_parsing": """
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN o_orderdate + to_seconds(o_orderkey) END AS time FROM orders""",
    "station_area": f"""
  WITH {CLEAN_SAMPLES_SQL},
  fixed AS (SELECT array_rd, CASE WHEN array_rd = 'CE' THEN replace(st, 'O', '0') ELSE st END AS station FROM raw)
  SELECT array_rd, station,
         CASE WHEN regexp_matches(lower(station), '(oregon\\s+)?slope\\s+base') THEN 'oregon-slope-base'
              WHEN regexp_matches(lower(station), 'axial\\s+caldera') THEN 'axial-caldera'
              WHEN regexp_matches(lower(station), '(southern\\s+)?hydrate\\s+ridge') THEN 'southern-hydrate-ridge'
              WHEN regexp_matches(lower(station), 'oregon\\s+shelf|ce02') THEN 'oregon-shelf'
              WHEN regexp_matches(lower(station), 'oregon\\s+offshore|ce04') THEN 'oregon-offshore'
              WHEN regexp_matches(lower(station), 'washington\\s+offshore|ce09') THEN 'washington-offshore' END
           AS area_rd, count(*) AS n FROM fixed GROUP BY ALL""",
    "station_code_repair": f"""
  WITH {CLEAN_SAMPLES_SQL}
  SELECT DISTINCT CASE WHEN array_rd = 'CE' THEN regexp_replace(st, 'CEO(\\d)', 'CE0\\1', 'g') ELSE st END AS station
  FROM raw""",
    "year_months": "SELECT strftime(o_orderdate, '%Y-%m') AS date, count(*) AS n FROM orders GROUP BY 1",
    "double_sensor": """
  WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_linenumber + l_partkey) % 3 <> 0 THEN l_quantity END
                      AS ctd_temperature_1,
                    CASE WHEN (l_linenumber + l_partkey) % 5 <> 0 THEN l_discount END AS ctd_temperature_2
             FROM lineitem)
  SELECT *, coalesce(ctd_temperature_1, ctd_temperature_2) AS ctd_temperature FROM r""",
    "union_missing": """
  SELECT c_name AS name, c_acctbal, c_mktsegment, 'RS' AS array_rd FROM customer
  UNION ALL BY NAME SELECT s_name AS name, s_suppkey, 'CE' AS array_rd FROM supplier""",
    "latest_labels": f"""
  WITH l AS ({_PART_LABELS}) SELECT * FROM l
  WHERE source_order = (SELECT max(source_order) FROM l AS o WHERE o.array_rd = l.array_rd)""",
    "label_precedence": f"""
  WITH a AS ({_NATION_LABELS} WHERE n_regionkey < 2), b AS ({_NATION_LABELS} WHERE n_regionkey >= 2)
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM a)""",
    "label_lookup": """
  SELECT q.name, lower(n_name) AS display_name, CASE WHEN n_name IS NOT NULL THEN 'km' END AS unit,
         CASE WHEN n_name IS NULL THEN q.name || ' not found.' END AS msg
  FROM (SELECT DISTINCT 'NATION_' || CAST(c_custkey % 30 AS VARCHAR) AS name FROM customer) q
  LEFT JOIN nation ON n_name = q.name""",
    "invalid_value_report": """
  SELECT 'ctd_temperature_1' AS "column", 'bad' AS invalid_value, count(*) AS n FROM orders WHERE o_orderkey % 7 = 2
  UNION ALL SELECT 'ctd_pressure_flag', 'flagged', count(*) FROM orders WHERE o_orderkey % 17 = 0
  UNION ALL SELECT 'discrete_oxygen', 'trace', count(*) FROM orders WHERE o_orderkey % 4 = 0""",
    "profile_table": f"WITH {CLEAN_SAMPLES_SQL} SELECT {_PROFILE} FROM derived",
    "discrete_table": f"WITH {CLEAN_SAMPLES_SQL} SELECT {_DISCRETE} FROM derived",
    "cruise_profile": f"WITH {CLEAN_SAMPLES_SQL} SELECT {_PROFILE} FROM derived",
    "cruise_discrete": f"WITH {CLEAN_SAMPLES_SQL} SELECT {_DISCRETE} FROM derived",
    "cruise_labels": f"SELECT * FROM (VALUES {_LABEL_ROWS}) AS t(name, display_name, unit)",
    "label_roundtrip": f"SELECT name, display_name, unit FROM ({_PART_LABELS})",
    "sample_roundtrip": "SELECT * FROM supplier",
}
