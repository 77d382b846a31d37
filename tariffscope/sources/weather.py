"""Weather history: parallel daily arrays to one row per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.schemas import WEATHER_RESPONSE

# The location used when none is given.
DEFAULT_LAT, DEFAULT_LON = 42.89, -78.86


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WEATHER_RESPONSE).json(path)


def daily_rows(responses: DataFrame) -> DataFrame:
    """One row per day with both temperatures; other days are skipped.

    Responses with empty arrays contribute no days.
    """
    d = F.col("daily")
    days = F.explode(
        F.arrays_zip(
            d["time"].alias("time"),
            d["temperature_2m_max"].alias("tmax"),
            d["temperature_2m_min"].alias("tmin"),
        )
    )
    return (
        responses.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), days.alias("x"))
        .select(
            F.try_to_date(F.col("x.time"), "yyyy-MM-dd").alias("obs_date"), "lat", "lon", "x.tmax", "x.tmin"
        )
        .filter("tmax IS NOT NULL AND tmin IS NOT NULL")
    )
