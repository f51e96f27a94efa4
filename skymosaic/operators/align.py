"""Coordinate systems of truth and predictions brought together; systems are EPSG numbers, None where a file names none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import centroid
from ..functions.projections import from_utm, to_utm

WGS84 = 4326
#: Below this, a first centroid is taken for a longitude.
MOST_DEGREES = 180


def utm_zone(epsg: int) -> tuple[int, bool] | None:
    """(zone, south) of a UTM system on WGS84, else None."""
    for first, south in ((32600, False), (32700, True)):
        if first < epsg <= first + 60:
            return epsg - first, south
    return None


def reproject(points: Column, source: int, target: int) -> Column:
    """Points of one system in another: WGS84 longitudes and latitudes, or UTM zones on WGS84."""
    if source == target:
        return points
    zones = {e: utm_zone(e) for e in (source, target)}
    unknown = [e for e, z in zones.items() if e != WGS84 and z is None]
    if unknown:
        raise ValueError(f"no projection for EPSG:{unknown[0]}")
    if zones[source]:
        points = F.transform(points, lambda p: from_utm(p["x"], p["y"], *zones[source]))
    if zones[target]:
        points = F.transform(points, lambda p: to_utm(p["x"], p["y"], *zones[target]))
    return points


def align_projections(truth: DataFrame, predictions: DataFrame, truth_crs: int | None, pred_crs: int | None, forced: int | None = None, order: str = "ann_id", points: str = "points") -> tuple[DataFrame, DataFrame, int | None]:
    """(truth, predictions, system of both).

    Predictions without a system have the forced one, else that of the truth. Truth without one is in degrees if the
    centroid of its first polygon (by `order`) lies below MOST_DEGREES, else in the system of the predictions. Truth is then
    brought into the system of the predictions. One value comes to the driver, and only where truth names no system.
    """
    if pred_crs is None:
        pred_crs = forced if forced is not None else truth_crs
    if truth_crs is None:
        first = truth.agg(F.min_by(centroid(F.col(points))["x"], F.col(order))).first()[0]
        truth_crs = WGS84 if first is not None and first < MOST_DEGREES else pred_crs
    if truth_crs is not None and pred_crs is not None and truth_crs != pred_crs:
        truth = truth.withColumn(points, reproject(F.col(points), truth_crs, pred_crs))
    return truth, predictions, pred_crs


def crs_number(name: Column) -> Column:
    """EPSG number of a name as GeoJSON writes it (EPSG:32739, urn:ogc:def:crs:EPSG::32739, urn:ogc:def:crs:OGC:1.3:CRS84)."""
    number = F.regexp_extract(name, r"EPSG:+(?:[\d.]*:)?(\d+)$", 1)
    return F.when(name.rlike("CRS84$"), F.lit(WGS84)).when(number != "", number.cast("int"))
