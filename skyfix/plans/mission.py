"""Mission plans: JSON text to waypoints, bounds and warnings, with VARIANT expressions.

Plans are rows (plan_id, body). A body is parsed once and its items are one array of its row; the parts of an item that holds
others are unfolded to any depth by a helper that sees only such items, so one pass over the plans does for all levels, and
what is told of a plan as a whole needs neither a join nor a shuffle.
"""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of the commands.
COMMANDS = {16: "WAYPOINT", 17: "LOITER_UNLIM", 18: "LOITER_TURNS", 19: "LOITER_TIME", 21: "LAND", 22: "TAKEOFF", 82: "SPLINE_WAYPOINT", 189: "DO_LAND_START", 195: "ROI_LOCATION"}

# Warnings.
NO_HOME, NO_WAYPOINTS, NOT_EXPANDED = "No plannedHomePosition in this plan.", "The mission contains no waypoint items.", "Complex mission item '%s' was not expanded."

DISCLAIMER = "The .plan file contains mission coordinates. It does not contain satellite imagery."

#: A plan's header: name in the document, place in the plan, type.
HEADER = (("file_type", "$.fileType", "string"), ("version", "$.version", "int"), ("ground_station", "$.groundStation", "string"), ("vehicle_type", "$.mission.vehicleType", "int"))


def parse(plans: DataFrame) -> DataFrame:
    """Adds doc (VARIANT) and error: invalid_json, not_an_object, no_mission (or one that is no object), or null. A byte-order mark is skipped."""
    doc = F.try_parse_json(F.regexp_replace("body", "^﻿", ""))
    out = plans.withColumn("doc", doc)
    kind = F.schema_of_variant("doc")
    error = F.when(F.col("doc").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "not_an_object")
    section = F.schema_of_variant(F.try_variant_get("doc", "$.mission", "variant"))
    return out.withColumn("error", error.when(~F.coalesce(section.startswith("OBJECT"), F.lit(False)), "no_mission"))


def number(v: Column, path: str) -> Column:
    """A finite number, or null."""
    return F.nullif(F.try_variant_get(v, path, "double"), F.lit(float("nan")))


def _items(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


_PARTS = pa.list_(pa.struct([("path", pa.list_(pa.int32())), ("item", pa.string()), ("is_complex", pa.bool_()), ("n_inner", pa.int32())]))


class _Token(str):
    """A number as the text has it."""


def _text(x: Any) -> str:
    if isinstance(x, _Token):
        return str(x)
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_text(v)}" for k, v in x.items()) + "}"
    return "[" + ",".join(map(_text, x)) + "]" if isinstance(x, list) else json.dumps(x)


def _inner(item: Any) -> list | None:
    """The parts of an item that holds others, else None."""
    if not isinstance(item, dict) or item.get("type") != "ComplexItem":
        return None
    given = item.get("TransectStyleComplexItem")
    given = given.get("Items") if isinstance(given, dict) else None
    parts = given if isinstance(given, list) and given else item.get("Items")
    return parts if isinstance(parts, list) else []


def unfolded(item: str) -> list[dict]:
    """Every part below an item (JSON text): path from the item, text, whether it holds others, and how many. Those that do come without their parts."""
    out, left = [], [((), _inner(json.loads(item, parse_float=_Token, parse_int=_Token)) or [])]
    while left:
        above, parts = left.pop()
        for i, part in enumerate(parts):
            path, below = (*above, i), _inner(part)
            own = part if below is None else {k: v for k, v in part.items() if k not in ("Items", "TransectStyleComplexItem")}
            out.append({"path": path, "item": _text(own), "is_complex": below is not None, "n_inner": len(below or ())})
            if below:
                left.append((path, below))
    return out


def _parts(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [None if item is None else unfolded(item) for item in x] for x in column.to_pylist()], pa.list_(_PARTS))


def _with_entries(parsed: DataFrame) -> DataFrame:
    """Adds entries: path (places from the top), item, is_complex, n_inner of every item of a plan, nested ones too; empty where there are none."""

    def entry(item: Column, i: Column) -> Column:
        given = _items(item, "$.TransectStyleComplexItem.Items")
        is_complex = F.coalesce(F.try_variant_get(item, "$.type", "string") == "ComplexItem", F.lit(False))
        parts = F.coalesce(F.when(is_complex, F.coalesce(F.when(F.size(given) > 0, given), _items(item, "$.Items"))), F.array().cast("array<variant>"))
        return F.struct(F.array(i).alias("path"), item.alias("item"), is_complex.alias("is_complex"), F.size(parts).alias("n_inner"))

    def with_parts(own: Column, below: Column) -> Column:
        part = lambda x: F.struct(F.concat(own["path"], x["path"]).alias("path"), F.parse_json(x["item"]).alias("item"), x["is_complex"].alias("is_complex"), x["n_inner"].alias("n_inner"))
        return F.when(below.isNull(), F.array(own)).otherwise(F.concat(F.array(own), F.transform(below, part)))

    parts_of = F.arrow_udf(_parts, "array<array<struct<path:array<int>,item:string,is_complex:boolean,n_inner:int>>>")
    out = parsed.withColumn("_top", F.transform(F.coalesce(_items(F.col("doc"), "$.mission.items"), F.array().cast("array<variant>")), entry))
    out = out.withColumn("_below", parts_of(F.transform("_top", lambda e: F.when(e["n_inner"] > 0, F.to_json(e["item"])))))
    return out.withColumn("entries", F.flatten(F.zip_with("_top", "_below", with_parts))).drop("_top", "_below")


def items(parsed: DataFrame) -> DataFrame:
    """plan_id, path (places from the top), item, is_complex, n_inner of every item, nested ones too."""
    return _with_entries(parsed.filter("error is null")).select("plan_id", F.inline("entries"))


def _is_simple(item: Column, is_complex: Column) -> Column:
    return ~is_complex & F.coalesce(F.schema_of_variant(item).startswith("OBJECT"), F.lit(False))


def _place(item: Column) -> tuple[Column, Column]:
    """Latitude and longitude; (0, 0) is no position."""
    lat, lon = (number(item, f"$.params[{i}]") for i in (4, 5))
    nowhere = (lat == 0) & (lon == 0)
    return F.when(nowhere, None).otherwise(lat), F.when(nowhere, None).otherwise(lon)


def _described(item: Column, path: Column) -> dict[str, Column]:
    """The columns of a waypoint, of a simple item."""
    params, (lat, lon) = _items(item, "$.params"), _place(item)
    alt = F.when(F.size(F.coalesce(params, F.array().cast("array<variant>"))) > 6, number(item, "$.params[6]")).otherwise(number(item, "$.Altitude"))
    command = F.coalesce(F.try_variant_get(item, "$.command", "int"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    name = F.coalesce(F.try_element_at(names, command), F.concat(F.lit("CMD_"), command.cast("string")))
    # an item without a number of its own counts on from the places of the items that hold it
    seq = F.coalesce(F.try_variant_get(item, "$.doJumpId", "int"), F.aggregate(path, F.lit(1), lambda a, i: a + i))
    return {"seq": seq, "command": command, "command_name": name, "latitude": lat, "longitude": lon, "altitude": alt, "frame": F.try_variant_get(item, "$.frame", "int")}


def waypoints(parsed: DataFrame) -> DataFrame:
    """plan_id, path, seq, command, latitude, longitude, altitude, frame, command_name of every simple item.

    (0, 0) is no position. The altitude falls back to the item's own where there are six parameters or fewer.
    """
    simple = items(parsed).filter(_is_simple(F.col("item"), F.col("is_complex")))
    return simple.withColumns(_described(F.col("item"), F.col("path"))).select("plan_id", "path", "seq", "command", "latitude", "longitude", "altitude", "frame", "command_name")


def home(parsed: DataFrame) -> DataFrame:
    """plan_id, latitude, longitude, altitude of the planned home; null where it is not a list of three."""
    return parsed.filter("error is null").select("plan_id", *_home())


def _home() -> list[Column]:
    at = "$.mission.plannedHomePosition"
    return [F.when(F.size(_items(F.col("doc"), at)) >= 3, number(F.col("doc"), f"{at}[{i}]")).alias(n) for i, n in enumerate(("latitude", "longitude", "altitude"))]


def bounds(points: DataFrame, homes: DataFrame) -> DataFrame:
    """plan_id, north, south, west, east of the waypoints with a position and the home."""
    both = points.select("plan_id", "latitude", "longitude").unionByName(homes.select("plan_id", "latitude", "longitude")).filter("latitude is not null and longitude is not null")
    return both.groupBy("plan_id").agg(F.max("latitude").alias("north"), F.min("latitude").alias("south"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


def suggested_extent(box: DataFrame) -> DataFrame:
    """The bounds with a quarter of their span, at least 1e-4, on every side, to 7 decimals."""
    return box.select("plan_id", *_padded())


def _padded() -> list[Column]:
    pad_lat, pad_lon = (F.greatest((F.col(a) - F.col(b)) * 0.25, F.lit(1e-4)) for a, b in (("north", "south"), ("east", "west")))
    return [F.round(c, 7).alias(n) for n, c in (("north", F.col("north") + pad_lat), ("south", F.col("south") - pad_lat), ("west", F.col("west") - pad_lon), ("east", F.col("east") + pad_lon))]


def overview(parsed: DataFrame) -> DataFrame:
    """parsed with its entries (no duplicates of plan_id are put together), and n_geofences, n_rally, n_waypoints, n_positions and warnings, null where there is an error."""
    out, none = _with_entries(parsed), F.array().cast("array<string>")
    size = lambda path: F.greatest(F.size(F.coalesce(_items(F.col("doc"), path), F.array().cast("array<variant>"))), F.lit(0))
    simple = F.filter("entries", lambda e: _is_simple(e["item"], e["is_complex"]))
    out = out.withColumn("_simple", F.transform(simple, lambda e: e["item"]))
    kind = lambda item: F.coalesce(F.try_variant_get(item, "$.complexItemType", "string"), F.lit("unknown"))
    closed = F.array_sort(F.transform(F.filter("entries", lambda e: e["is_complex"] & (e["n_inner"] == 0)), lambda e: F.struct(e["path"].alias("path"), kind(e["item"]).alias("kind"))))
    homeless, n = size("$.mission.plannedHomePosition") < 3, F.size("_simple").cast("long")
    warnings = F.concat(
        F.when(homeless, F.array(F.lit(NO_HOME))).otherwise(none),
        F.transform(closed, lambda c: F.format_string(NOT_EXPANDED, c["kind"])),
        F.when(n == 0, F.array(F.lit(NO_WAYPOINTS))).otherwise(none),
    )
    positions = F.size(F.filter("_simple", lambda item: _place(item)[0].isNotNull())).cast("long")
    told = {"n_geofences": size("$.geoFence.polygons"), "n_rally": size("$.rallyPoints.points"), "n_waypoints": n, "n_positions": positions, "warnings": warnings}
    return out.withColumns({name: F.when(F.col("error").isNull(), c) for name, c in told.items()}).drop("_simple")


def summary(parsed: DataFrame) -> DataFrame:
    """plan_id, n_geofences, n_rally, n_waypoints, n_positions, warnings of every readable plan."""
    return overview(parsed.filter("error is null")).select("plan_id", "n_geofences", "n_rally", "n_waypoints", "n_positions", "warnings")


def documents(parsed: DataFrame) -> DataFrame:
    """plan_id and the JSON `body` of every readable plan: file name (parsed's column filename, if there is one), header, home, waypoints in order, coordinates, bounds, suggested extent, numbers of
    geofence polygons and rally points, warnings.

    Keys without a value are left out: bounds and extent where neither a waypoint nor the home has a position.
    """
    header = [F.try_variant_get("doc", path, kind).alias(name) for name, path, kind in HEADER]
    speeds = [number(F.col("doc"), f"$.mission.{key}").alias(name) for name, key in (("cruise_speed", "cruiseSpeed"), ("hover_speed", "hoverSpeed"))]
    filename = F.col("filename") if "filename" in parsed.columns else F.lit(None).cast("string")
    waypoint = lambda e: F.struct(e["path"].alias("path"), F.struct(*(c.alias(name) for name, c in _described(e["item"], e["path"]).items())).alias("w"))
    simple = F.filter("entries", lambda e: _is_simple(e["item"], e["is_complex"]))
    waypoints_ = F.transform(F.array_sort(F.transform(simple, waypoint)), lambda e: e["w"]).alias("waypoints")
    out = overview(parsed.filter("error is null")).select("plan_id", "n_geofences", "n_rally", "n_waypoints", "warnings", waypoints_, filename.alias("filename"), *header, *speeds, F.array(*_home()).alias("_home"))
    out = out.withColumn("waypoint_count", F.col("n_waypoints"))
    placed = F.filter("waypoints", lambda w: w["latitude"].isNotNull() & w["longitude"].isNotNull())
    out = out.withColumn("coordinates", F.transform(placed, lambda w: F.array(w["latitude"], w["longitude"])))
    at_home = F.get("_home", 0).isNotNull() & F.get("_home", 1).isNotNull()
    every = F.when(at_home, F.array_append("coordinates", F.slice("_home", 1, 2))).otherwise(F.col("coordinates"))
    out = out.withColumn("_every", every)
    lat, lon = F.transform("_every", lambda p: F.get(p, 0)), F.transform("_every", lambda p: F.get(p, 1))
    out = out.withColumns({"north": F.array_max(lat), "south": F.array_min(lat), "west": F.array_min(lon), "east": F.array_max(lon)})
    known = F.col("north").isNotNull()
    body = F.struct(
        "filename", *[n for n, _, _ in HEADER], "cruise_speed", "hover_speed", F.when(F.get("_home", 0).isNotNull(), F.col("_home")).alias("planned_home_position"),
        "waypoints", "waypoint_count", "coordinates", F.when(known, F.struct("north", "south", "west", "east")).alias("bounds"),
        F.when(known, F.struct(*_padded())).alias("suggested_georeference"), F.col("n_geofences").alias("geofence_polygons"), F.col("n_rally").alias("rally_points"), "warnings", F.lit(DISCLAIMER).alias("disclaimer"),
    )
    return out.select("plan_id", F.to_json(body).alias("body"))


def normalised_path(points: DataFrame) -> DataFrame:
    """plan_id, seq, px, py: positions in a box of 8..92, north up."""
    of = Window.partitionBy("plan_id")
    at = points.filter("latitude is not null and longitude is not null")
    span = lambda c: F.greatest(F.max(c).over(of) - F.min(c).over(of), F.lit(1e-9))
    px = 8 + 84 * (F.col("longitude") - F.min("longitude").over(of)) / span("longitude")
    py = 92 - 84 * (F.col("latitude") - F.min("latitude").over(of)) / span("latitude")
    return at.select("plan_id", "seq", px.alias("px"), py.alias("py"))
