"""Sample rows into the profile and discrete tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.functions.cftime import year_month
from sensorframe.functions.samples import station_area
from sensorframe.functions.values import first_sensor
from sensorframe.operators.clean import columns_matching

# Doubled sensors, the column patterns of both tables, droppable columns.
DOUBLE_SENSORS = ("ctd_temperature", "ctd_conductivity", "ctd_salinity")
PROFILE_COLUMNS = r"ctd|date|area_rd|cruise_id"
PROFILE_EXCLUDED = (
    r"flag",
    r"file|bottle_closure_time|depth|latitude|longitude|beam_attenuation|oxygen_saturation|_2|_1",
)
DISCRETE_COLUMNS = r"area_rd|cruise_id|date|ctd_pressure|discrete|calculated"
DISCRETE_EXCLUDED = (r"flag",)
OPTIONAL_COLUMNS = ("calculated_dic", "calculated_pco2")


def pick_sensors(df: DataFrame, variables: tuple[str, ...] = DOUBLE_SENSORS) -> DataFrame:
    """One column per doubled sensor: the primary reading, else the secondary."""
    for name in variables:
        for part in (f"{name}_1", f"{name}_2"):
            if part not in df.columns:
                raise ValueError(f"sample table lacks the column '{part}'")
    return df.withColumns({v: first_sensor(F.col(f"{v}_1"), F.col(f"{v}_2")) for v in variables})


def derive_columns(df: DataFrame, on_unknown: str = "error") -> DataFrame:
    """Picked sensors, ``date`` (year and month) and ``area_rd``."""
    return pick_sensors(df).withColumns(
        {"date": year_month(F.col("start_time")), "area_rd": station_area(F.col("station"), on_unknown)}
    )


def profile_columns(names: list[str]) -> list[str]:
    return columns_matching(names, PROFILE_COLUMNS, *PROFILE_EXCLUDED)


def discrete_columns(names: list[str]) -> list[str]:
    return columns_matching(names, DISCRETE_COLUMNS, *DISCRETE_EXCLUDED)


def split_samples(df: DataFrame, tags: tuple[str, ...] = ("array_rd",)) -> tuple[DataFrame, DataFrame]:
    """(profile, discrete): pure projections, so each reads only its own columns."""
    derived = [c for c in df.columns if c not in tags]
    return df.select(*profile_columns(derived), *tags), df.select(*discrete_columns(derived), *tags)
