"""The nearest point of a grid for each location, by cells and their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _within(lat: Column, lon: Column, point_lat: Column, point_lon: Column, degrees: float) -> Column:
    turn = F.abs(lon - point_lon)
    return (F.abs(lat - point_lat) <= degrees) & (F.least(turn, 360.0 - turn) <= degrees)


def nearest_point(points: DataFrame, lat: float, lon: float, within: float) -> tuple[float, float] | None:
    """Latitude and longitude of the point nearest to one place, by the rules of ``nearest``; the driver gets one row."""
    here = F.lit(float(lat)), F.lit(float(lon))
    there = F.col("lat"), F.col("lon")
    best = F.min(F.struct(distance_km(*here, *there).alias("distance_km"), "lat", "lon")).alias("best")
    found = points.filter(_within(*here, *there, within)).agg(best).first()["best"]
    return (found["lat"], found["lon"]) if found else None


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def nearest(locations: DataFrame, points: DataFrame, within: float) -> DataFrame:
    """``locations`` (lat, lon, ...) with ``point_lat, point_lon, distance_km`` of the nearest of ``points`` (lat, lon).

    A point counts if it lies within ``within`` degrees of latitude and of longitude
    (180 and -180 are one meridian). Points fall into cells of that size and each
    distinct location asks its own and the eight around it, so nothing is compared
    with more than it may match. Ties go to the smaller latitude, then longitude.
    A location without such a point, or without coordinates, keeps nulls.
    """
    around = F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])
    east = F.pmod(F.col("lon") + 180.0, F.lit(360.0))
    columns = round(360.0 / within) if 360.0 % within == 0 else int(360.0 / within) + 1
    places = points.filter("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.col("lat").alias("point_lat"), F.col("lon").alias("point_lon"),
        _cell(F.col("lat"), within).alias("row"), F.least(_cell(east, within), F.lit(columns - 1).cast("long")).alias("column"),
    ).distinct()
    asked = locations.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    # The last column may be narrower than the others: a location also asks one beyond the seam.
    seam = F.least(_cell(east, within), F.lit(columns - 1).cast("long"))
    steps = F.array(*[F.lit(k).cast("long") for k in (-2, -1, 0, 1, 2)])
    wanted = (
        asked.withColumn("row", F.explode(F.transform(around, lambda k: _cell(F.col("lat"), within) + k)))
        .withColumn("column", F.explode(F.array_distinct(F.transform(steps, lambda k: F.pmod(seam + k, F.lit(columns))))))
        .join(places, ["row", "column"])
    )
    ends = [F.col(c) for c in ("lat", "lon", "point_lat", "point_lon")]
    close, far = _within(*ends, within), distance_km(*ends)
    best = wanted.filter(close).groupBy("lat", "lon").agg(F.min(F.struct(far.alias("distance_km"), "point_lat", "point_lon")).alias("best"))
    best = best.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "best.point_lat", "best.point_lon", "best.distance_km")
    same = (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))
    return locations.join(best, same, "left").drop("_lat", "_lon")
