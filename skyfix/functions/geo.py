"""Georeferencing: validation messages, pixel to latitude and longitude, ground distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320.0
EARTH_RADIUS = 6_371_000.0


def _number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def bbox_error(north: Column, south: Column, west: Column, east: Column, width: Column, height: Column) -> Column:
    """The first fault of a bounding box, or null. An east below west is allowed."""
    out = F
    for name, c, bound in (("north", north, 90), ("south", south, 90), ("west", west, 180), ("east", east, 180)):
        out = out.when(~_number(c), F.lit(f"{name}_not_a_number")).when(F.abs(c) > bound, F.lit(f"{name}_out_of_range"))
    out = out.when(north <= south, F.lit("north_not_above_south")).when(east == west, F.lit("no_width"))
    return out.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), F.lit("map_size_unknown"))


def corners_error(corners: Column, width: Column, height: Column) -> Column:
    """The first fault of an array of [latitude, longitude] corners, or null."""
    outside = F.exists(corners, lambda p: ~F.coalesce((F.abs(F.get(p, 0)) <= 90) & (F.abs(F.get(p, 1)) <= 180), F.lit(False)))
    out = F.when(corners.isNull() | (F.size(corners) != 4), F.lit("needs_four_corners")).when(outside, F.lit("corner_out_of_range"))
    return out.when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), F.lit("map_size_unknown"))


def bbox_latlon(x: Column, y: Column, north: Column, south: Column, west: Column, east: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel, linear in the box, to 7 decimals."""
    u = x.cast("double") / F.greatest(width, F.lit(1))
    v = y.cast("double") / F.greatest(height, F.lit(1))
    return F.round(north + (south - north) * v, 7), F.round(west + (east - west) * u, 7)


def square_to_quad(px: list[Column], py: list[Column]) -> list[Column]:
    """The homography (9 entries, last 1) of the unit square (0,0) (1,0) (1,1) (0,1) to a quadrilateral, in closed form."""
    sx, sy = px[0] - px[1] + px[2] - px[3], py[0] - py[1] + py[2] - py[3]
    dx1, dx2, dy1, dy2 = px[1] - px[2], px[3] - px[2], py[1] - py[2], py[3] - py[2]
    det = F.nullif(dx1 * dy2 - dx2 * dy1, F.lit(0.0))
    g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
    return [px[1] - px[0] + g * px[1], px[3] - px[0] + h * px[3], px[0], py[1] - py[0] + g * py[1], py[3] - py[0] + h * py[3], py[0], g, h, F.lit(1.0)]


def corners_latlon(x: Column, y: Column, corners: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a pixel under the projective map through four [lat, lon] corners, clockwise from the top left."""
    lat, lon = [corners[i][0] for i in range(4)], [corners[i][1] for i in range(4)]
    a = square_to_quad(lon, lat)
    u, v = x / width, y / height
    w = F.nullif(a[6] * u + a[7] * v + a[8], F.lit(0.0))
    return F.round((a[3] * u + a[4] * v + a[5]) / w, 7), F.round((a[0] * u + a[1] * v + a[2]) / w, 7)


def ground_sample_distance(north: Column, south: Column, west: Column, east: Column, width: Column, height: Column) -> Column:
    """Metres a pixel, the mean of both axes, to 4 decimals; null for unknown sizes."""
    down = F.abs(north - south) * METRES_PER_DEGREE / F.when(height > 0, height)
    across = F.abs(east - west) * METRES_PER_DEGREE * F.cos(F.radians((north + south) / 2)) / F.when(width > 0, width)
    return F.round((down + across) / 2, 4)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere, to 2 decimals."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.round(2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0)))), 2)


def georeference(raw: Column) -> Column:
    """A stored georeference (a struct with kind, north, south, west, east, corners, width, height), or null if it is not valid."""
    field = lambda c: raw[c]
    box = bbox_error(*map(field, ("north", "south", "west", "east", "width", "height")))
    error = F.when(field("kind") == "corners", corners_error(field("corners"), field("width"), field("height"))).otherwise(box)
    return F.when(raw.isNotNull() & error.isNull(), raw)


GEOREFERENCE = "kind string, north double, south double, west double, east double, corners array<array<double>>, width int, height int"


def restored(text: Column) -> Column:
    """A georeference from its JSON text; null where the text is no object or what it says is not valid."""
    return georeference(F.from_json(text, GEOREFERENCE))


def polygon_latlon(polygon: Column, project) -> Column:
    """Latitude and longitude of each vertex ([x, y]) of a polygon; project maps x and y to both, as bbox_latlon and corners_latlon do."""

    def vertex(p: Column) -> Column:
        lat, lon = project(p[0], p[1])
        return F.struct(lat.alias("latitude"), lon.alias("longitude"))

    return F.transform(polygon, vertex)
