"""Text functions of the cruise-sample tables: headers, stations, areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: words of a header, then an optional unit in square brackets.
HEADER_PATTERN = r"(?U)(((\w+-?\w?)\s?)+)(\[.*\])?"

# Station patterns in order of precedence, and their areas.
AREAS = (
    (r"(oregon\s+)?slope\s+base", "oregon-slope-base"),
    (r"axial\s+base", "axial-base"),
    (r"axial\s+caldera", "axial-caldera"),
    (r"(southern\s+)?hydrate\s+ridge", "southern-hydrate-ridge"),
    (r"mid\s+plate", "mid-plate"),
    (r"oregon\s+inshore|ce01", "oregon-inshore"),
    (r"oregon\s+shelf|ce02", "oregon-shelf"),
    (r"oregon\s+offshore|ce04", "oregon-offshore"),
    (r"washington\s+inshore|ce06", "washington-inshore"),
    (r"washington\s+shelf|ce07", "washington-shelf"),
    (r"washington\s+offshore|ce09", "washington-offshore"),
)


def header_words(header: Column) -> Column:
    """The words of a header without its unit; empty when there are none."""
    words = F.regexp_extract(header, HEADER_PATTERN, 1)
    return F.regexp_replace(words, r"(?U)^\s+|\s+$", "")


def header_unit(header: Column) -> Column:
    bracket = F.regexp_extract(header, HEADER_PATTERN, 4)
    return F.when(bracket != "", F.btrim(bracket, F.lit("[]")))


def repair_spelling(name: Column) -> Column:
    """Known misspellings in header names; the first rule that applies wins."""
    low = F.lower(name)
    fluorescence = F.replace(name, F.lit("Fluorescense"), F.lit("Fluorescence"))
    fluorescence = F.replace(fluorescence, F.lit("Flourescence"), F.lit("Fluorescence"))
    return (
        F.when(low.contains("fluorescense") | low.contains("flourescence"), fluorescence)
        .when(low.contains("start positioning"), F.lit("Bottom Depth at Start Position"))
        .when(low.contains("phanalysis"), F.replace(name, F.lit("pHAnalysis"), F.lit("pH Analysis")))
        .when(low == "ctd transmissometer flag", F.lit("CTD Beam Transmissometer Flag"))
        .otherwise(name)
    )


def header_display(header: Column) -> Column:
    return repair_spelling(header_words(header))


def header_name(header: Column) -> Column:
    return F.replace(F.lower(header_display(header)), F.lit(" "), F.lit("_"))


def repair_station(station: Column, array_rd: Column, only_codes: bool = False) -> Column:
    """Letter O to digit 0 in the stations of array ``CE``.

    ``only_codes`` limits it to codes such as ``CEO2`` and leaves words alone.
    """
    if only_codes:
        fixed = F.regexp_replace(station, r"CEO(\d)", "CE0$1")
    else:
        fixed = F.replace(station, F.lit("O"), F.lit("0"))
    return F.when(array_rd == "CE", fixed).otherwise(station)


def station_area(station: Column, on_unknown: str = "error") -> Column:
    """Area of a station; an unknown one is an error, or null on request."""
    if on_unknown not in ("error", "null"):
        raise ValueError("on_unknown is 'error' or 'null'")
    low = F.lower(station)
    area = F.when(low.isNull(), F.lit(None).cast("string"))
    for pattern, name in AREAS:
        area = area.when(low.rlike(pattern), F.lit(name))
    if on_unknown == "null":
        return area
    return area.otherwise(F.raise_error(F.concat(F.lit("Unknown area: "), low)).cast("string"))
