"""Degree days and whether they explain a bill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.operators.nearest import nearest, nearest_point
from tariffscope.sources.weather import DEFAULT_LAT, DEFAULT_LON

#: How far (degrees) a grid point may lie from the location it stands for.
GRID_DEGREES = 0.25
# Base temperature (°F) and the thresholds of the weather test.
BASE_TEMP = 65.0
QUIET_MONTH = 5
MIN_DEVIATION = 10
EXPLAINED_SHARE = 0.6
# How far weather drives the bills of an industry (gas, electric).
SENSITIVITY = {
    "Healthcare": (0.4, 0.3),
    "Manufacturing": (0.2, 0.2),
    "Food Service": (0.3, 0.5),
    "Education": (0.9, 0.6),
    "Retail": (0.7, 0.7),
}
DEFAULT_SENSITIVITY = 0.5

_TENTH = "DECIMAL(12,1)"


def degree_days(daily: DataFrame) -> DataFrame:
    """Heating and cooling degree days per location and calendar month."""
    mean = "(tmax + tmin) / 2"

    def tenths(value: str) -> str:
        return f"CAST(bround(CAST({value} AS DECIMAL(24,6)), 1) AS {_TENTH})"

    return (
        daily.filter("tmax IS NOT NULL AND tmin IS NOT NULL")
        .selectExpr("lat", "lon", "year(obs_date) AS year", "month(obs_date) AS month", f"{mean} AS mean")
        .groupBy("lat", "lon", "year", "month")
        .agg(
            F.expr(f"{tenths(f'sum(greatest(0D, {BASE_TEMP}D - mean))')} AS hdd"),
            F.expr(f"{tenths(f'sum(greatest(0D, mean - {BASE_TEMP}D))')} AS cdd"),
            F.expr(f"{tenths('avg(mean)')} AS avg_temp"),
            F.expr("count(*) AS days"),
        )
    )


def month_baselines(monthly: DataFrame, bill_months: DataFrame) -> DataFrame:
    """Mean degree days of each calendar month over the years that have bills."""

    def mean(column: str) -> str:
        quotient = f"CAST(sum({column}) AS DECIMAL(20,1)) / CAST(count({column}) AS DECIMAL(10,0))"
        return f"CAST(bround({quotient}, 1) AS {_TENTH})"

    return (
        monthly.join(bill_months, ["year", "month"], "left_semi")
        .groupBy("month")
        .agg(F.expr(f"{mean('hdd')} AS avg_hdd"), F.expr(f"{mean('cdd')} AS avg_cdd"))
    )


def bill_months(bills: DataFrame) -> DataFrame:
    return (
        bills.filter("billing_date IS NOT NULL")
        .selectExpr("year(billing_date) AS year", "month(billing_date) AS month")
        .distinct()
    )


def here(daily: DataFrame, lat: float, lon: float, within: float = GRID_DEGREES) -> DataFrame:
    """Days of the grid point nearest to a location; none if no point is near enough."""
    point = nearest_point(daily, lat, lon, within)
    return daily.filter((F.col("lat") == point[0]) & (F.col("lon") == point[1])) if point else daily.filter(F.lit(False))


def weather_table(
    bills: DataFrame, daily: DataFrame, lat: float = DEFAULT_LAT, lon: float = DEFAULT_LON, within: float = GRID_DEGREES
) -> DataFrame:
    """(year, month, hdd, cdd, avg_hdd, avg_cdd) of one location, for the months of bills.

    A weather service answers for the nearest point of its grid, so its coordinates
    aren't those that were asked for.
    """
    months = bill_months(bills)
    monthly = degree_days(here(daily, lat, lon, within))
    # Twelve rows at most.
    usual = F.broadcast(month_baselines(monthly, months))
    return monthly.join(months, ["year", "month"], "left_semi").join(usual, "month").select(
        "year", "month", "hdd", "cdd", "avg_hdd", "avg_cdd"
    )


def unmatched_locations(locations: DataFrame, daily: DataFrame, within: float = GRID_DEGREES) -> DataFrame:
    """Locations for which no weather is near enough."""
    return nearest(locations, daily.select("lat", "lon"), within).filter("distance_km IS NULL").select(*locations.columns)


def sensitivity(industry: str, utility: str) -> str:
    """SQL text of the weather weight of an industry and utility."""
    steps = " ".join(
        f"WHEN {industry} = '{name}' AND lower({utility}) = '{kind}' THEN {weight}D"
        for name, weights in SENSITIVITY.items()
        for kind, weight in zip(("gas", "electric"), weights)
    )
    return f"CASE {steps} ELSE {DEFAULT_SENSITIVITY}D END"


def with_weather(features: DataFrame, weather: DataFrame) -> DataFrame:
    """Add weather columns to bills having year, month, industry and pct_above_monthly.

    ``weather`` is a weather_table: one row per calendar month of one location,
    under 120,000 rows for every representable date, so it is broadcast.
    """
    gas = "lower(utility_type) = 'gas'"
    known = "(hdd IS NOT NULL AND avg_hdd IS NOT NULL)"

    def chosen(heating: str, cooling: str) -> str:
        return f"CASE WHEN {known} THEN CAST(CASE WHEN {gas} THEN {heating} ELSE {cooling} END AS DOUBLE) ELSE 0D END"

    deviation = (
        f"CASE WHEN weather_historical >= {QUIET_MONTH} "
        "THEN (weather_actual - weather_historical) / weather_historical * 100 ELSE 0D END"
    )
    explains = (
        f"weather_actual > 0 AND weather_historical > 0 AND weather_deviation > {MIN_DEVIATION} "
        f"AND weather_deviation * sensitivity >= pct_above_monthly * {EXPLAINED_SHARE}D"
    )
    return (
        features.join(F.broadcast(weather), ["year", "month"], "left")
        .selectExpr(
            *features.columns, f"{known} AS weather_available",
            f"CASE WHEN {known} THEN CASE WHEN {gas} THEN 'HDD' ELSE 'CDD' END END AS weather_metric",
            f"{chosen('hdd', 'cdd')} AS weather_actual", f"{chosen('avg_hdd', 'avg_cdd')} AS weather_historical",
            f"{sensitivity('industry', 'utility_type')} AS sensitivity",
        )
        .selectExpr("*", f"{deviation} AS weather_deviation")
        .selectExpr(
            "*", f"CASE WHEN weather_available THEN {explains} END AS weather_explains",
            "bround(weather_deviation, 1) AS weather_deviation_pct",
        )
    )
